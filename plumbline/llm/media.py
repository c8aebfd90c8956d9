"""Media columns: what a binary column really holds.

One Aho-Corasick automaton over all magic bytes runs through the whole content.  A
magic number alone proves nothing, so a validator for each format then walks the
structure (chunks, markers, blocks, checksums) and finds the true length; what fails is
no medium.  A medium at offset 0 that fills the content gives the type, which corrects a
declared one; media found elsewhere are carved, the first and longest before those that
overlap them.  Media inside a medium are looked for only in what it leaves (its own
samples are data).

``pack`` stores text, padded to a multiple of 64, as the 8-bit samples of a WAV file or the
grey pixels of a BMP or PNG, which of them is chosen by a hash of the text; ``features``
reads them back and describes them.  A PDF's attachments are part of it: ends are paired
with starts like brackets, and further ends belong to what they follow.

Defined results: null content is like empty content, of type ``application/octet-stream``
and length 0; a null declared type is corrected like a wrong one.  Null text packs like
empty text.  Repeated rows give equal results.  Long content is searched whole, in time in
proportion to its length.  No rows give no rows.  Other columns pass through; one with a
result's name gives way.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import add, arrow, free_name

UNKNOWN = "application/octet-stream"
BLOCK = 64
RATE = 8_000
#: A PDF's cross reference is named within so many bytes before its end mark (fixed by the format).
XREF_WITHIN = 1_024
_PDF = re.compile(rb"%PDF-[0-9]\.[0-9]|%%EOF")
#: What texts are stored as.
KINDS = ("audio/wav", "image/bmp", "image/png")
#: One text in so many has a picture of one dot behind its medium.
THUMBNAILS = 4
THUMBNAIL = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


def _riff(b: bytes, at: int, kind: bytes) -> int:
    if len(b) < at + 12 or b[at + 8 : at + 12] != kind:
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    p, seen = at + 12, set()
    while p + 8 <= end:
        name, size = struct.unpack_from("<4sI", b, p)
        if p + 8 + size > end:
            return 0
        seen.add(name)
        p += 8 + size + size % 2
    need = {b"WAVE": {b"fmt ", b"data"}}.get(kind, set())
    good = need <= seen and seen and p - end in (0, 1)
    return end - at if good else 0


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, p)
        if p + 12 + size > len(b) or (first and (name != b"IHDR" or size != 13)):
            return 0
        if binascii.crc32(memoryview(b)[p + 4 : p + 8 + size]) != struct.unpack_from(">I", b, p + 8 + size)[0]:
            return 0
        p, first = p + 12 + size, False
        if name == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if b[at : at + 6] not in (b"GIF87a", b"GIF89a") or len(b) < at + 14:
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at
        if kind == 0x21:
            p = blocks(p + 2)
        elif kind == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p = blocks(p + 10 + (3 << (local & 7) + 1 if local & 0x80 else 0) + 1)
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        size = struct.unpack_from(">H", b, p + 2)[0]
        if kind in (0x00, 0xD8, 0xD9, 0xFF) or size < 2 or p + 2 + size > len(b):
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if kind == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return p + 2 - at if frame else 0
                if b[p + 1] != 0 and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
            else:
                return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 30:
        return 0
    size, spare, start, header = struct.unpack_from("<IIII", b, at + 2)
    fits = header in (12, 40, 52, 56, 108, 124) and spare == 0 and 14 + header <= start <= size and at + size <= len(b)
    return size if fits and struct.unpack_from("<H", b, at + (26 if header > 12 else 22))[0] == 1 else 0


@lru_cache(1)
def _documents(b: bytes) -> dict[int, int]:
    """Where PDFs start, and the ends that belong to them, each with its cross reference before it."""
    found: dict[int, int] = {}
    open_, last = [], -1
    for m in _PDF.finditer(b):
        if m[0] != b"%%EOF":
            open_.append(m.start())
        elif open_ or last >= 0:
            last = open_.pop() if open_ else last
            if b.rfind(b"startxref", max(last, m.start() - XREF_WITHIN), m.start()) >= 0:
                found[last] = m.end()
    return found


def _pdf(b: bytes, at: int) -> int:
    return _documents(b).get(at, at) - at


@lru_cache(1)
def _archives(b: bytes) -> dict[int, int]:
    """Where the archives start that end records speak of, and where they end: one search for all local headers of a content."""
    found: dict[int, int] = {}
    end = b.find(b"PK\x05\x06")
    while end >= 0 and end + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, end + 12)
        if end + 22 + note <= len(b):
            found.setdefault(end - size - start, end + 22 + note)
        end = b.find(b"PK\x05\x06", end + 1)
    return found


def _zip(b: bytes, at: int) -> int:
    return _archives(b).get(at, at) - at


def _gzip(b: bytes, at: int) -> int:
    one = zlib.decompressobj(31)
    try:
        piece = one.decompress(memoryview(b)[at:], 1 << 20)
        while not one.eof and (piece or one.unconsumed_tail):
            piece = one.decompress(one.unconsumed_tail, 1 << 20)
    except zlib.error:
        return 0
    return len(b) - at - len(one.unused_data) if one.eof else 0


@lru_cache(1)
def _streams(b: bytes) -> dict[int, int]:
    """Where OGG pages start, and the end of the last page of their stream: one pass over all headers, from the last."""
    found: dict[int, int] = {}
    p = b.rfind(b"OggS\x00")
    while p >= 0:
        if p + 27 <= len(b):
            n = b[p + 26]
            end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
            if end <= len(b):
                stop = end if b[p + 5] & 4 else found.get(end, 0)
                if stop:
                    found[p] = stop
        p = b.rfind(b"OggS\x00", 0, p + 4)
    return found


def _ogg(b: bytes, at: int) -> int:
    return _streams(b).get(at, at) - at


#: Fixed values of the formats: magic bytes, media type, validator.
FORMATS: list[tuple[bytes, str, Callable[[bytes, int], int]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF8", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", lambda b, at: _riff(b, at, b"WAVE")),
    (b"RIFF", "image/webp", lambda b, at: _riff(b, at, b"WEBP")),
    (b"RIFF", "video/avi", lambda b, at: _riff(b, at, b"AVI ")),
    (b"OggS", "audio/ogg", _ogg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
]


def automaton() -> ahocorasick.Automaton:
    """Over Latin-1 text, in which each byte is one character."""
    found: dict[bytes, list] = {}
    for magic, kind, check in FORMATS:
        found.setdefault(magic, []).append((kind, check))
    out = ahocorasick.Automaton()
    for magic, checks in found.items():
        out.add_word(magic.decode("latin-1"), (len(magic), checks))
    out.make_automaton()
    return out


def media_in(content: bytes, search: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the media in ``content``, in order, none inside another."""
    found, free = [], 0
    for end, (size, checks) in search.iter(content.decode("latin-1")):
        at = end + 1 - size
        if at >= free:
            best = max(((check(content, at), kind) for kind, check in checks), key=lambda x: x[0])
            if best[0]:
                found.append((at, *best))
                free = at + best[0]
    return found


def sniff(df: DataFrame, content: str = "content", declared: str = "declared") -> DataFrame:
    """Adds ``media_type``, ``media_length``, ``corrected`` (the declared type was wrong) and ``embedded``, the media carved from the rest."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = automaton()
        for batch in batches:
            kinds, lengths, carved = [], [], []
            for c in batch:
                media = media_in(c.as_py() or b"", search)
                own = media.pop(0) if media and media[0][0] == 0 else (0, 0, UNKNOWN)
                kinds.append(own[2])
                lengths.append(own[1])
                carved.append([{"offset": a, "length": n, "type": k} for a, n, k in media])
            kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
            yield pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(lengths, pa.int64()), pa.array(carved, kind)], ["media_type", "media_length", "embedded"])

    name = free_name(df, "media")
    made = df.withColumn(name, arrow(run, "media_type string, media_length long, embedded array<struct<offset:long,length:long,type:string>>")(df[f"`{content}`"]))
    out = F.col(name)
    right = F.col(f"`{declared}`").eqNullSafe(out["media_type"]) if declared in df.columns else F.lit(False)
    return add(made, {"media_type": out["media_type"], "media_length": out["media_length"], "corrected": ~right, "embedded": out["embedded"]}).drop(name)


def _wave(payload: bytes) -> bytes:
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def _bitmap(payload: bytes) -> bytes:
    """Rows of BLOCK grey pixels, from the top."""
    grey = b"".join(bytes((g, g, g, 0)) for g in range(256))
    start = 54 + len(grey)
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(payload), 0, start, 40, BLOCK, -(len(payload) // BLOCK), 1, 8, 0, len(payload), 2_835, 2_835, 256, 0) + grey + payload


def _picture(payload: bytes) -> bytes:
    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    rows = np.zeros((len(payload) // BLOCK, BLOCK + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    head = struct.pack(">IIBBBBB", BLOCK, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def _data(content: bytes) -> bytes:
    """The samples of a WAV."""
    p = 12
    while p + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, p)
        if name == b"data":
            return content[p + 8 : p + 8 + size]
        p += 8 + size + size % 2
    return b""


def _pixels(content: bytes) -> bytes:
    """The grey pixels of a BMP without padding."""
    start, width, height = struct.unpack_from("<I4xii", content, 10)
    rows = np.frombuffer(content, np.uint8, width * abs(height), start).reshape(-1, width)
    return rows[:: -1 if height > 0 else 1].tobytes()


def _unfiltered(content: bytes) -> bytes:
    """The grey pixels of a PNG whose rows aren't filtered."""
    p, packed, width = 8, [], 0
    while p + 12 <= len(content):
        size, name = struct.unpack_from(">I4s", content, p)
        if name == b"IHDR":
            width = struct.unpack_from(">I", content, p + 8)[0]
        elif name == b"IDAT":
            packed.append(content[p + 8 : p + 8 + size])
        elif name == b"IEND":
            break
        p += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


#: How a payload is stored as each kind and read back, and the name of its features.
STORES: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes], str]] = {"audio/wav": (_wave, _data, f"wav;rate={RATE}"), "image/bmp": (_bitmap, _pixels, f"bmp;width={BLOCK}"), "image/png": (_picture, _unfiltered, f"png;width={BLOCK}")}


def pack(df: DataFrame, text: str = "text", into: str = "content", kinds: tuple[str, ...] = KINDS[:1], thumbnails: int = 0) -> DataFrame:
    """Adds a medium that holds the text's UTF-8 bytes, then zeros up to a positive multiple of 64; its kind, and whether a picture follows it (one text in ``thumbnails``; 0: never), are chosen by the text's hash."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for t in batch.cast(pa.binary()):
                b = t.as_py() or b""
                h = xxhash.xxh64_intdigest(b)
                made = STORES[kinds[h % len(kinds)]][0](b + bytes(-len(b) % BLOCK if b else BLOCK))
                out.append(made + THUMBNAIL if thumbnails and h // len(kinds) % thumbnails == 0 else made)
            yield pa.array(out, pa.binary())

    return add(df, {into: arrow(run, "binary")(df[f"`{text}`"])})


def declared(text: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """A type as a careless source would state it: one of ``kinds`` by a hash of the text that knows nothing of what is stored."""
    return F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.pmod(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(len(kinds))) + 1).cast("int"))


def features(content: Column, kind: Column) -> Column:
    """Of a medium that ``pack`` could have made: its payload's length, digest and tail checksum, and a line of features; nulls for other media."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for contents, kinds in batches:
            rows = []
            for c, k in zip(contents, kinds.to_pylist(), strict=True):
                if k not in STORES:
                    rows.append(None)
                    continue
                _, read, name = STORES[k]
                payload = read(c.as_py())
                x = np.frombuffer(payload, np.uint8)
                share = np.bincount(x, minlength=256)
                share = share[share > 0] / max(1, len(x))
                rows.append(
                    {
                        "payload_bytes": len(payload),
                        "payload_sha256": hashlib.sha256(payload).hexdigest(),
                        "tail_crc32": zlib.crc32(payload[-BLOCK:]),
                        "feature": f"{name};samples={len(x)};mean={x.mean() if len(x) else 0:.4f};deviation={x.std() if len(x) else 0:.4f};entropy={-(share * np.log2(share)).sum() + 0.0:.4f};crossings={np.count_nonzero(np.diff(x >= 128))}",
                    }
                )
            yield pa.array(rows, pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())]))

    return arrow(run, "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string", several=True)(content, kind)
