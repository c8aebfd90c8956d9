"""What filters of documents do to each other, whatever the order in which they run.

Each document fails some of the filters; that set, as bits, is its mask.  All that can be
asked about an order of filters follows from the number of documents with each mask, so
the corpus is read once and a few dozen counts for each part of it are all that remains.

One filter isn't the document's own affair: it fails those whose text a smaller id has.
For it, an RDD is routed by fingerprint:

1. Each task keeps, for every text it reads, the rows of its smallest id; rows that lose
   against another row of the task have failed and go on without their text.
2. What is left is partitioned by the text's XXH64.  A task holds a chain of the texts with
   one fingerprint, each in full with its smallest id so far and the rows of that id; texts
   are compared, so that equal fingerprints alone fail nobody.
3. Rows that lose there have failed; those that stand at the end haven't.

So a text in a third of all documents is sent once by each task, and the receiver holds it
once.  Partitions grow with the text (``PARTITION_BYTES``), a task's own chains are sent
off whenever they hold ``HELD_BYTES``, and rows beyond this step carry no text.

Labels are joined by id afterwards, and ``combineByKey`` merges vectors of counts, one for
each part: a source with a third of the documents costs one vector for each task.

Defined results: a null text counts as empty; a null id is larger than all others and has
no labels; rows that repeat an id are documents of their own, neither smaller than the
other, and share its labels, of which the largest counts.  A null part is the empty string.
No rows give none.  Long texts are read whole; other columns take no part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.shared import written

PARTITION_BYTES = 8 << 20
MIN_PARTITIONS = 12
#: Bytes of text that a task holds before it sends what it has.
HELD_BYTES = 8 << 20
#: All orders of more filters than this are too many to report.
MOST_FILTERS = 6

_UPPER = bytes(range(65, 91))
_ODD = re.compile(rb"[#$%&*|]")

Filter = Callable[[bytes, list[bytes]], bool]

#: What a text (UTF-8) and its words fail by; None: texts that a smaller id has.
FILTERS: dict[str, Filter | None] = {
    "A": lambda text, words: len(words) < 200,
    "B": lambda text, words: 100 * len(set(words)) < 50 * len(words),
    "C": lambda text, words: 100 * (len(text) - len(text.translate(None, _UPPER))) > 2 * len(text.decode()),
    "D": lambda text, words: _ODD.search(text) is not None,
    "E": None,
}


class _Chain:
    """Texts of one fingerprint, each with its smallest id and that id's rows: [text, id, {(part, mask): rows}]."""

    def __init__(self) -> None:
        self.links: list[list] = []

    def add(self, text: bytes, id, rows: dict) -> tuple[object, dict] | None:
        """The id and rows that fail because of this one, or because of those that were there."""
        for link in self.links:
            if link[0] == text:
                if _before(link[1], id):
                    return id, rows
                if _before(id, link[1]):
                    lost = link[1], link[2]
                    link[1:] = id, rows
                    return lost
                for k, n in rows.items():
                    link[2][k] = link[2].get(k, 0) + n
                return None
        self.links.append([text, id, rows])
        return None


def _before(a, b) -> bool:
    return a is not None and (b is None or a < b)


def failures(df: DataFrame, filters: dict[str, Filter | None] = FILTERS, text: str = "text", key: str = "doc_id", part: str = "source", partition_bytes: int = PARTITION_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(key, part, mask, n): the filters that each document fails, the first as bit 0; ``n`` rows agree in all three."""
    own = {i: f for i, f in enumerate(filters.values()) if f}
    twin = sum(1 << i for i, f in enumerate(filters.values()) if not f)
    if twin & (twin - 1):
        raise ValueError("one filter at most can be None")
    docs = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    partitions = max(MIN_PARTITIONS, -(-total // partition_bytes))

    def local(rows: Iterable) -> Iterator[tuple[int, tuple]]:
        chains: dict[int, _Chain] = {}
        held = 0
        for r in rows:
            text = bytes(r.text)
            words = text.split()
            mask = sum(1 << i for i, f in own.items() if f(text, words))
            if not twin:
                yield xxhash.xxh64_intdigest(repr(r.key)), (r.key, {(r.part, mask): 1}, None)
                continue
            print_ = xxhash.xxh64_intdigest(text)
            chain = chains.setdefault(print_, _Chain())
            before = len(chain.links)
            if lost := chain.add(text, r.key, {(r.part, mask): 1}):
                yield print_ ^ xxhash.xxh64_intdigest(repr(lost[0])), (lost[0], {(p, m | twin): n for (p, m), n in lost[1].items()}, None)
            held += len(text) if len(chain.links) > before else 0
            if held > held_bytes:
                yield from sent(chains)
                chains, held = {}, 0
        yield from sent(chains)

    def sent(chains: dict[int, _Chain]) -> Iterator[tuple[int, tuple]]:
        for print_, chain in chains.items():
            for text, id, rows in chain.links:
                yield print_, (id, rows, text)

    def meet(records: Iterable[tuple[int, tuple]]) -> Iterator[tuple]:
        chains: dict[int, _Chain] = {}
        for print_, (id, rows, text) in records:
            if text is None:
                yield from shown(id, rows, 0)
            elif lost := chains.setdefault(print_, _Chain()).add(text, id, rows):
                yield from shown(*lost, twin)
        for chain in chains.values():
            for _, id, rows in chain.links:
                yield from shown(id, rows, 0)

    def shown(id, rows: dict, also: int) -> Iterator[tuple]:
        for (p, m), n in rows.items():
            yield id, p, m | also, n

    routed = docs.rdd.mapPartitions(local).partitionBy(partitions, lambda print_: print_)
    schema = docs.select(F.col("key").alias(key), F.col("part"), F.lit(0).alias("mask"), F.lit(0).cast("long").alias("n")).schema
    for f in schema:
        f.nullable = True
    return df.sparkSession.createDataFrame(routed.mapPartitions(meet), schema, verifySchema=False)


def later_copies(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n): the ids that aren't the smallest of those with their text, and how many rows each has."""
    found = failures(df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text"), F.lit("").alias("_part")), {"E": None}, "_text", key, "_part")
    return found.where("mask = 1").groupBy(key).agg(F.sum("n").alias("n"))


def audit(failed: DataFrame, labels: DataFrame, filters: Iterable[str] = FILTERS, key: str = "doc_id", good: str = "quality", bad: str = "toxic") -> DataFrame:
    """A row for each part, order and step, from the rows of ``failures``; ``labels`` has 1 where a document is good, or bad."""
    letters = list(filters)
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"{MOST_FILTERS} filters at most, for all orders are reported")
    masks = 1 << len(letters)
    known = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(key)).agg(F.max((F.col(f"`{good}`") == 1).cast("int")).alias("good"), F.max((F.col(f"`{bad}`") == 1).cast("int")).alias("bad"))
    rows = failed.join(known, key, "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))

    def add(vector: np.ndarray, r: tuple) -> np.ndarray:
        mask, n, is_good, is_bad = r
        vector[:, mask] += np.array((n, n * is_good, n * is_bad))
        return vector

    vectors = rows.rdd.map(lambda r: (r.part, (r.mask, r.n, r.good, r.bad))).combineByKey(lambda r: add(np.zeros((3, masks), np.int64), r), add, lambda a, b: a + b, max(MIN_PARTITIONS, rows.sparkSession.sparkContext.defaultParallelism))
    return rows.sparkSession.createDataFrame(vectors.flatMap(lambda x: _orders(x[0], x[1], letters)), "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long", verifySchema=False)


def _orders(part: str, vector: np.ndarray, letters: list[str]) -> Iterator[tuple]:
    """All orders of one part's filters; ``vector`` has documents, good ones and bad ones by mask."""
    masks = np.arange(vector.shape[1])
    fails = [(masks >> i & 1).astype(bool) for i in range(len(letters))]
    alone = [int(vector[0, 1 << i]) for i in range(len(letters))]
    rows, every = [], dict.fromkeys(range(len(letters)), 0)
    for order in permutations(range(len(letters))):
        gone = np.zeros(len(masks), bool)
        for step, i in enumerate(order, 1):
            now = fails[i] & ~gone
            removed, good, bad = (int(v[now].sum()) for v in vector)
            redundant = int(vector[0][fails[i] & gone].sum())
            gone |= now
            every[i] += removed
            rows.append((i, "".join(letters[j] for j in order), step, int(vector[0][~gone].sum()), removed, redundant, good, bad))
    for i, name, step, kept, removed, redundant, good, bad in rows:
        yield part, name, step, kept, removed, redundant, alone[i], good, bad, every[i]


def run(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter | None] = FILTERS) -> DataFrame:
    return audit(written(failures(docs, filters), "failures"), labels, filters)


ORACLE = """
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents
), masks AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS mask
  FROM words
), marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT filter_order, step, filter_order[step] AS x, filter_order[:step - 1] AS earlier FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), judged AS (
  SELECT part, filter_order, step, x, n, good, bad, contains(mask, x) AS fails, length(translate(mask, earlier, '')) < length(mask) AS gone, mask = x AS alone FROM steps, counted
), summed AS (
  SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE alone), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM summed
"""
