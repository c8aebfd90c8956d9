import gzip
import hashlib
import io
import math
import struct
import time
import wave
import zipfile
import zlib

from plumbline.llm import media, queries


def png(size=3):
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes((size + 1) * size))) + chunk(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "some text")
    return out.getvalue()


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00?\x00\x12\xff\x00\x34\xff\xd9"
BMP = struct.pack("<2sIII", b"BM", 58, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
OGG = b"OggS\x00\x04" + bytes(20) + b"\x01\x03abc"
WAV = media._wave(b"samples!" * 8)
ALL = [(png(), "image/png"), (GIF, "image/gif"), (JPEG, "image/jpeg"), (BMP, "image/bmp"), (PDF, "application/pdf"), (OGG, "audio/ogg"), (WAV, "audio/wav"), (archive(), "application/zip"), (gzip.compress(b"text" * 99), "application/gzip")]


def test_every_format_alone_cut_short_and_embedded():
    search = media.automaton()
    for content, kind in ALL:
        assert media.media_in(content, search) == [(0, len(content), kind)], kind
        assert media.media_in(content[:-1], search) == [] or kind == "application/pdf"
        assert (7, len(content), kind) in media.media_in(b"padding" + content + b"rest", search)
    together = b"".join(c for c, _ in ALL if _ != "application/pdf")
    assert [k for _, _, k in media.media_in(together, search)] == [k for _, k in ALL if k != "application/pdf"]
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.media_in(bytes(broken), search) == []


def test_columns(spark):
    rows = [(1, bytearray(png() + b"x" + GIF), "image/png", "a"), (2, bytearray(GIF), "image/png", "b"), (3, None, None, "c"), (4, bytearray(b""), "text/plain", "d"), (4, bytearray(b""), "text/plain", "d"), (5, bytearray(b"no media " * 50_000), "application/octet-stream", "e")]
    df = spark.createDataFrame(rows, "id long, content binary, declared string, Embedded string")
    out = media.sniff(df)
    assert out.columns == ["id", "content", "declared", "media_type", "media_length", "corrected", "embedded"]
    got = {r.id: (r.media_type, r.media_length, r.corrected, [(x.offset, x.type) for x in r.embedded]) for r in out.collect()}
    unknown = "application/octet-stream"
    assert got == {1: ("image/png", len(png()), False, [(len(png()) + 1, "image/gif")]), 2: ("image/gif", len(GIF), True, []), 3: (unknown, 0, True, []), 4: (unknown, 0, True, []), 5: (unknown, 0, False, [])}
    assert media.sniff(df.limit(0)).count() == 0


def payload_of(content):
    """The payload by other means than the module's: the standard library's reader of WAV, or bytes at fixed places."""
    if content[:4] == b"RIFF":
        with wave.open(io.BytesIO(content)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, 8_000)
            return "audio/wav", w.readframes(w.getnframes()), 44 + w.getnframes()
    if content[:2] == b"BM":
        size, start = struct.unpack_from("<I4xI", content, 2)
        assert struct.unpack_from("<iiHH", content, 18) == (64, -(size - start) // 64, 1, 8)
        return "image/bmp", content[start:size], size
    assert content[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack_from(">I", content, 16) == (64,)
    n = struct.unpack_from(">I", content, 33)[0]
    rows = zlib.decompress(content[41 : 41 + n])
    assert set(rows[::65]) <= {0}
    return "image/png", b"".join(rows[i + 1 : i + 65] for i in range(0, len(rows), 65)), 41 + n + 4 + 12


def test_query_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    stored = {r.doc_id: bytes(r.content) for r in media.pack(docs, kinds=media.KINDS, thumbnails=media.THUMBNAILS).collect()}
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    rows = queries.QUERIES["op9_media"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b, content = texts[r.doc_id], stored[r.doc_id]
        padded = b + bytes(-len(b) % 64 if b else 64)
        kind, payload, size = payload_of(content)
        assert payload == padded
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256, r.media_type, r.media_length) == (len(content), hashlib.sha256(content).hexdigest(), kind, size)
        assert r.corrected == (r.declared != kind) and r.n_embedded == (content[size:] == GIF) and (content[size:] in (b"", GIF))
        shares = [padded.count(x) / len(padded) for x in set(padded)]
        mean = sum(padded) / len(padded)
        want = (len(padded), mean, (sum((x - mean) ** 2 for x in padded) / len(padded)) ** 0.5, -sum(p * math.log2(p) for p in shares), sum((x < 128) != (y < 128) for x, y in zip(padded, padded[1:], strict=False)))
        name, scale, *shown = r.feature.split(";")
        assert (name, scale) == {"audio/wav": ("wav", "rate=8000"), "image/bmp": ("bmp", "width=64"), "image/png": ("png", "width=64")}[kind]
        assert all(abs(float(x.split("=")[1]) - y) < 1e-4 for x, y in zip(shown, want, strict=True))
    assert len({r.media_type for r in rows}) == 3 and {r.corrected for r in rows} == {True, False} and {r.n_embedded for r in rows} == {0, 1}


def test_pdfs_keep_their_attachments():
    search = media.automaton()
    inner = PDF
    outer = b"%PDF-1.7\n1 0 obj\nstream\n" + inner + b"\nendstream\nendobj\nstartxref\n9\n%%EOF"
    assert media.media_in(outer, search) == [(0, len(outer), "application/pdf")]
    updated = outer + b"\n2 0 obj\nendobj\nstartxref\n70\n%%EOF"
    assert media.media_in(updated, search) == [(0, len(updated), "application/pdf")]
    assert media.media_in(outer + b" and " + inner, search) == [(0, len(outer), "application/pdf"), (len(outer) + 5, len(inner), "application/pdf")]
    cut = outer[: -len(b"startxref\n9\n%%EOF")]
    assert media.media_in(cut, search) == [(outer.index(inner), len(inner), "application/pdf")]


def test_ogg_pages_form_streams():
    search = media.automaton()
    page = lambda last: b"OggS\x00" + bytes([4 * last]) + bytes(20) + b"\x01\x03abc"
    stream = page(0) + page(0) + page(1)
    assert media.media_in(b"x" + stream + stream, search) == [(1, len(stream), "audio/ogg"), (1 + len(stream), len(stream), "audio/ogg")]
    assert media.media_in(page(0) * 3, search) == [] and media.media_in(page(0) + b"?" + page(1), search) == [(len(page(0)) + 1, len(page(1)), "audio/ogg")]


def test_packing_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 64)], "id long, text string")
    got = {r.id: media._data(bytes(r.content)) for r in media.pack(df).collect()}
    assert got == {1: bytes(64), 2: bytes(64), 3: b"x" * 64}


def test_many_magic_numbers_take_time_in_proportion():
    search = media.automaton()
    began = time.time()
    for magic in (b"PK\x03\x04", b"%PDF-1", b"\x89PNG\r\n\x1a\n"):
        assert media.media_in(magic * 200_000, search) == []
    assert media.media_in(b"PK\x03\x04" * 50_000 + archive(), search) == [(200_000, len(archive()), "application/zip")]
    assert time.time() - began < 20


def test_time_is_in_proportion_for_all_formats():
    """Starts of every format that never end: four times the bytes take about four times as long."""
    search = media.automaton()
    ogg = b"OggS\x00\x00" + bytes(20) + b"\x00"
    starts = [b"\x89PNG\r\n\x1a\n", GIF[:-1], GIF[:13], JPEG[:-2], b"\xff\xd8\xff\xe0", BMP[:-1], WAV[:-1], b"RIFF\xff\xff\x00\x00WEBP", b"RIFF\x40\x00\x00\x00AVI ", ogg, b"%PDF-1.4 startxref ", b"%PDF-1.4%%EOF", archive()[:-1], gzip.compress(b"text" * 99)[:-9], b"\x1f\x8b\x08" + bytes(7)]
    for start in starts:
        took = []
        for size in (1 << 17, 1 << 19):
            content = start * (size // len(start))
            began = time.process_time()
            media.media_in(content, search)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5 and took[1] < 5, start
