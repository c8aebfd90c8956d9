"""Line deduplication across documents.

Lines are exploded under a normalised key (white space stripped at both ends, A-Z
lower-cased), hashed to 128 bits, and the distinct documents of each hash counted.
Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose all
their lines but those of the largest doc_id that holds them; what stays is put together
again by position.

Each document sends every key once, so a line that a third of all documents share costs
a count per task in the aggregation, and in the join back its rows are dealt to
``SALTS`` tasks; texts travel once, by their own id.

Defined results: a null or empty text is one empty line.  Rows of the same doc_id are
one document for counting, and each keeps its own lines; a null doc_id adds nothing to
counts, and its rows lose such lines as any other.  Other columns pass through; one
with a result's name gives way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import add, arrow, ASCII_SPACE, by_merge, free_name

MIN_CHARS = 40
MIN_DOCS = 5
#: Parts that the rows of one key are dealt to.
SALTS = 32


def _key(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key; None if it is too short."""
    key = line.strip(ASCII_SPACE)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_chars else None


def line_keys(df: DataFrame, text: str, key: str, min_chars: int) -> DataFrame:
    """(doc, h1, h2), once for each row and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, t in enumerate(batch.column("text")):
                keys = {_key(x, min_chars) for x in (t.as_py() or "").split("\n")} - {None}
                rows += [i] * len(keys)
                found += keys
            halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))], ["doc", "h1", "h2"])

    return df.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc {df.schema[key].dataType.simpleString()}, h1 long, h2 long")


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, into: str = "kept") -> DataFrame:
    """Adds ``n_lines``, ``n_dropped`` and the text that stays."""
    lines = line_keys(df, text, key, min_chars)
    common = lines.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    gone = free_name(df, "gone")
    doc = free_name(df, "doc")
    # a line that many documents share is dealt to SALTS tasks
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("byte"))
    common = common.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("byte") for i in range(SALTS)])))
    drops = (
        by_merge(lines).join(common, ["h1", "h2", "salt"])
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc").alias(doc))
        .agg(F.collect_set(F.struct("h1", "h2")).alias(gone))
    )
    joined = df.join(drops, df[f"`{key}`"].eqNullSafe(drops[doc]), "left").drop(doc)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, sets in batches:
            total, dropped, kept = [], [], []
            for t, s in zip(texts, sets, strict=True):
                text = t.as_py() or ""
                found = text.split("\n")
                total.append(len(found))
                if s.is_valid:
                    away = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in s.as_py()}
                    stay = [x for x in found if _key(x, min_chars) not in away]
                    dropped.append(len(found) - len(stay))
                    kept.append("\n".join(stay))
                else:
                    dropped.append(0)
                    kept.append(text)
            yield pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["n_lines", "n_dropped", "kept"])

    out = free_name(joined, "lines")
    made = joined.withColumn(out, arrow(run, "n_lines long, n_dropped long, kept string", several=True)(F.col(f"`{text}`"), F.col(gone)))
    return add(made.drop(gone), {"n_lines": F.col(out)["n_lines"], "n_dropped": F.col(out)["n_dropped"], into: F.col(out)["kept"]}).drop(out)


ORACLE = """
WITH lines AS (
  SELECT doc_id, pos, line,
         lower_ascii AS key
  FROM (
    SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))
), common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, c.key IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM lines l LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
