"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds (multiplies)
its letters' vectors, each permuted (rotated) by its distance from the n-gram's end; a
document's vector bundles (adds) those of all its n-grams.  A language's prototype
bundles the documents that are known to be in it, each at the same weight, less what
all prototypes share; a document takes the language whose prototype has the greatest
cosine with its own vector.

Text is read whole: case is folded, each run of other characters than letters counts
as one gap, and a gap stands at both ends.  Letters a to z have a vector each, all
others share ``CLASSES`` - 27 vectors by code point, the 32 of Latin-1 apart.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go
to the language first in code point order; rows with a null language or text teach
nothing; with nothing learned every text is ``und``.  Repeated rows get the same result
and count again in learning.  Other columns pass through; one with a result's name
gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import add, arrow, free_name

DIMENSIONS = 2_048
CLASSES = 64
ORDER = 3
SEED = 20_240_611
#: Documents of each language that are learned from, at most (in expectation; a hash of doc_id chooses them).
DOCS_PER_LANGUAGE = 2_000
#: A prototype is a row on the driver; more languages than this are refused, not cut.
MAX_LANGUAGES = 1_000
UNKNOWN = "und"
SCALE = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """Class of each code point of the basic plane, -1 for others than letters; beyond it letters are rare and asked for one by one."""
    out = np.full(0x10000, -1, np.int16)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % (CLASSES - 27)
    return out


@lru_cache(1)
def _bound() -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all pairs of leading letters, already bound, and of last letters."""
    base = np.random.default_rng(SEED).integers(0, 2, (CLASSES, DIMENSIONS)).astype(np.int8) * 2 - 1
    pair = np.roll(base, 2, axis=1)[:, None, :] * np.roll(base, 1, axis=1)[None, :, :]
    return pair.reshape(CLASSES * CLASSES, DIMENSIONS), base


def profile(text: str | None) -> np.ndarray | None:
    """The bundle of a text's n-grams; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    for i in far:
        codes[i] = 27 + int(points[i]) % (CLASSES - 27) if chr(points[i]).isalpha() else -1
    codes = np.concatenate(([0], codes, [0])).astype(np.int32)
    gap = codes <= 0
    codes[gap] = 0
    codes = codes[~(gap & np.concatenate(([False], gap[:-1])))]  # one gap for each run
    if len(codes) < ORDER:
        return None
    grams, counts = np.unique((codes[:-2] * CLASSES + codes[1:-1]) * CLASSES + codes[2:], return_counts=True)
    pair, last = _bound()
    out, counts = np.zeros(DIMENSIONS, np.float32), counts.astype(np.float32)
    for at in range(0, len(grams), 128):
        g = grams[at : at + 128]
        out += counts[at : at + 128] @ (pair[g // CLASSES] * last[g % CLASSES]).astype(np.float32)
    return out


def learn(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Unit prototypes by language from rows of known language; a bounded number of rows of each, chosen by a hash of ``key``."""
    known = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{key}`").alias("key")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {}
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_language / n)))])
    chosen = known.where(F.pmod(F.xxhash64("key"), F.lit(SCALE)) < share[F.col("lang")] * SCALE)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, k in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                if (v := profile(t.as_py())) is not None:
                    # whole numbers: the sum is the same in any order
                    one = np.rint(v * (SCALE / max(float(np.linalg.norm(v)), 1e-9))).astype(np.int64)
                    sums[k] = sums[k] + one if k in sums else one
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [k] * DIMENSIONS, "i": np.arange(DIMENSIONS, dtype=np.int32), "v": v})

    rows = chosen.select("text", "lang").mapInArrow(bundle, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
    found: dict[str, np.ndarray] = {}
    for r in rows:
        found.setdefault(r.lang, np.zeros(DIMENSIONS))[r.i] = r.v
    found = {k: v / max(np.linalg.norm(v), 1e-9) for k, v in found.items()}
    if len(found) > 1:
        shared = np.mean(list(found.values()), axis=0)
        found = {k: (v - shared) / max(np.linalg.norm(v - shared), 1e-9) for k, v in found.items()}
    return found


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the cosine with that language's prototype (0 where it is negative)."""
    name = free_name(df, "language")
    out = F.col(name)
    return add(df.withColumn(name, guess(prototypes, df[f"`{text}`"])), {"lang_pred": out["lang_pred"], "score": out["score"]}).drop(name)


def guess(prototypes: dict[str, np.ndarray], text: Column) -> Column:
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names]) if names else np.zeros((0, DIMENSIONS))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            langs, scores = [], []
            for t in batch:
                v = profile(t.as_py()) if names else None
                if v is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    cosines = matrix @ v / max(float(np.linalg.norm(v)), 1e-9)
                    best = int(np.argmax(cosines))
                    langs.append(names[best])
                    scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return arrow(run, "lang_pred string, score double")(text)


def remainder(of: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of
