"""Importance resampling towards a target corpus, over hashed word n-grams whose CRC-32 comes from the words' own.

The CRC of a joined n-gram is never taken from its bytes.  With ``shift(c, k)`` the change
that ``k`` more bytes make to a CRC, a linear map over GF(2),

    crc(a + b) = shift(crc(a), len(b)) xor crc(b)

so each word's CRC is computed once, and an n-gram's follows from those of its words and
of the space between them: one shift for each word that joins.  A shift by 2**k bytes is
a 32 x 32 matrix of bits, the square of the one before; here four tables of 256 entries
each, applied to whole arrays, and a shift by any length takes those of its binary digits.

The corpus is read twice, in place: once for the number of features in each bucket, summed
within a task and then across tasks, and once for the documents' weights.  Nothing but
``buckets`` sums for each task and a row for each document moves.  Bucket gains, the only
thing that is sent to all tasks, are ``buckets`` numbers, whatever the corpus.

A document's draw adds Gumbel noise to its weight, from a hash of its id, so the highest
scores are a sample without replacement in proportion to exp(weight / 1000).  Ranks come
from the number of documents at each score (scores are small whole numbers) and, within
one score, from the ids: no sort over all documents.

Defined results: a null or wordless text has no features and weight 0.  A null id has no
hash: its score is null, and it is neither counted nor drawn.  Rows that repeat an id are
documents of their own, with one score if their texts agree.  Rows with fewer than
``min_words`` words are scored and never drawn.  No rows give none; an empty target gives
gains from the corpus alone.  Long texts are read whole, a piece at a time.  Other columns
take no part.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow, tidy
from plumbline.sources.shared import written

BUCKETS = 10_000
NGRAM = 2
#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Bytes of text whose words are held at a time.
PIECE = 1 << 20
#: All bytes but digits, letters and those of characters beyond ASCII end a word; A-Z are lower-cased.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPACE = np.uint32(zlib.crc32(b" "))


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as one table for each byte."""
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


@lru_cache(64)
def shift_tables(power: int) -> np.ndarray:
    """Tables (4, 256) of the shift by 2**power bytes."""
    if power:
        half = shift_tables(power - 1)
        return np.stack([_apply(half, half[i]) for i in range(4)])
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):  # a zero bit goes in, eight times
        bits = np.where(bits & 1, bits >> 1 ^ np.uint32(POLYNOMIAL), bits >> 1).astype(np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for i in range(4):
        for bit in range(8):
            out[i][np.arange(256) >> bit & 1 == 1] ^= bits[8 * i + bit]
    return out


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs after as many bytes more as ``length`` says, each its own; what those bytes are is still to be added."""
    crc, power = crc.copy(), 0
    while (length >> power).any():
        at = np.flatnonzero(length >> power & 1)
        crc[at] = _apply(shift_tables(power), crc[at])
        power += 1
    return crc


def _words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _features(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of all n-grams of up to ``n`` words, the text that each belongs to, and the number of words in each text."""
    parts = [_words(t) for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    words = [w for p in parts for w in p]
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    doc = np.repeat(np.arange(len(parts)), counts)
    out, of, gram = [crc], [doc], crc
    spaced = _SPACE
    if n > 1 and len(words):
        spaced = shifted(np.full(len(words), _SPACE, np.uint32), size) ^ crc  # a space and the word
    for k in range(1, n):
        if len(words) <= k:
            break
        same = np.flatnonzero(doc[k:] == doc[:-k])
        grams = shifted(gram[same], size[same + k] + 1) ^ spaced[same + k]
        out.append(grams)
        of.append(doc[same])
        gram = np.zeros(len(words), np.uint32)
        gram[same] = grams
    return np.concatenate(out), np.concatenate(of), counts


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about PIECE bytes of text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or b"") > PIECE:
            yield start, i
            start, size = i, 0
        size += len(t or b"")
    if start < len(texts):
        yield start, len(texts)


def counts(df: DataFrame, text: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any; a task sends each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _pieces(texts):
                crc, _, _ = _features([t or b"" for t in texts[a:b]], ngram)
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["bucket", "n"])
        tidy()

    sums = df.select(F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the source, one added to all; both are ``counts``."""
    s, t = ({r.bucket: r.n for r in d.collect()} for d in (source, target))  # a row for each bucket at most
    whole, wanted = sum(s.values()), sum(t.values())
    each = (float(t.get(b, 0) + 1) * float(whole + buckets) / (float(s.get(b, 0) + 1) * float(wanted + buckets)) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in each], np.int64)


def weights(df: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id", ngram: int = NGRAM, seed: int = 7) -> DataFrame:
    """(key, n_words, n_features, weight, score) of each row."""
    buckets = len(gain)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, batch in batches:
            texts, found = batch.to_pylist(), []
            for a, b in _pieces(texts):
                crc, of, words = _features([t or b"" for t in texts[a:b]], ngram)
                n = np.bincount(of, minlength=b - a)
                total = np.bincount(of, gain[crc % np.uint32(buckets)].astype(np.float64), b - a).astype(np.int64)  # whole numbers far below 2**53
                found += zip(words.tolist(), n.tolist(), (total // np.maximum(n, 1)).tolist(), strict=True)
            noise = [None if k is None else _noise(f"{seed}:{k}") for k in keys.to_pylist()]
            columns = list(zip(*((w, n, weight, None if g is None else weight + g) for (w, n, weight), g in zip(found, noise, strict=True)), strict=True)) or [[]] * 4
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n_words", "n_features", "weight", "score"])

    out = arrow(run, "n_words long, n_features long, weight long, score long", several=True)(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`").cast("binary"))
    return df.select(F.col(f"`{key}`").alias(key), out.alias("_found")).select(key, "_found.*")


def _noise(name: str) -> int:
    """A Gumbel draw in thousandths, from the first 32 bits of a SHA-256."""
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, key: str, taken: Column, percent: int) -> DataFrame:
    """Adds ``rank`` (1, 2, ...) to the rows of highest score among those ``taken``: ``percent`` of a hundred of them, ties to the smaller key.

    ``scored`` is read twice, so it should be a written table.
    """
    taken = F.coalesce(taken, F.lit(False)) & F.col("score").isNotNull()
    pool = scored.where(taken)
    per = pool.groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()  # whole numbers in a range that logarithms bound
    most, before, rows = sum(r.n for r in per) * percent // 100, 0, []
    for r in per:
        if before >= most:
            break
        rows.append((r.score, before))
        before += r.n
    drawn = F.broadcast(scored.sparkSession.createDataFrame(rows, "score long, before long"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(key))
    undrawn = pool.join(drawn, "score", "left_anti").select(*scored.columns).union(scored.where(~taken))
    high = pool.join(drawn, "score").withColumn("rank", place)  # of the lowest score among them some may not be drawn
    return high.select(*scored.columns, F.when(F.col("rank") <= most, F.col("rank")).cast("long").alias("rank")).union(undrawn.withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 25, min_words: int = 20, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of each row of ``docs``; ``target`` has the texts to be like, in a column of the same name."""
    if ngram < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("ngram and buckets: 1 or more; percent: 0 to 100")
    gain = gains(counts(docs, text, ngram, buckets), counts(target, text, ngram, buckets), buckets)
    scored = written(weights(docs, gain, text, key, ngram, seed), "weights")
    return ranked(scored, key, F.col("n_words") >= min_words, percent)


#: The CRC of each distinct n-gram from its bytes, by the usual table (made by its rule).
ORACLE = """
WITH steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b::BIGINT)) AS t
), words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), wanted AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM words
), of_target AS (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM wanted
), distinct_grams AS (
  SELECT g, string_split(regexp_replace(hex(g), '(..)', '\\1 ', 'g'), ' ') AS h FROM (SELECT g FROM grams UNION SELECT g FROM of_target)
), bucketed AS (
  SELECT g, xor(list_reduce(list_transform(h[:len(h) - 1], lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM distinct_grams, steps
), s AS (SELECT bucket, count(*) AS n FROM grams JOIN bucketed USING (g) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS n FROM of_target JOIN bucketed USING (g) GROUP BY bucket
), totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t
), gain AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (totals.s + 10000) / ((s.n + 1)::DOUBLE * (totals.t + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals
), weighed AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM grams JOIN bucketed USING (g) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
         ('0x' || sha256('7:' || doc_id)[:8])::BIGINT AS h
  FROM words LEFT JOIN weighed USING (doc_id)
), noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM noisy WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM noisy LEFT JOIN drawn USING (doc_id)
"""
