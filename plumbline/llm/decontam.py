"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every run of ``SEED_WORDS`` words of a test item is a seed.  A first scan of all
documents counts in how many of them each seed stands.  A seed is rare for its item if
that number is at most ``RARE_DOCS``, or at most ``RARE_TIMES`` the number of the item's
lower quartile seed, so stock phrases go while an item that leaked everywhere keeps its
seeds.  In a second scan each rare seed joins the passage around it to its items, and a
local alignment over words (match 2, mismatch -1, gap -1) scores each such passage by
its share of the best possible score; edited and shortened copies score in between.
An edited copy that many documents hold may have no rare seed, so passages around all
seeds are aligned too, unless no alignment of the passage's words could reach
``min_score`` (all those of the item matching, all others costing); of equal passages
one is aligned.  Rarity hence decides only which seeds name a passage, never whether it
is found.

The test items are the query set.  They are taken in blocks of at most ``BLOCK_WORDS``
words, so what is broadcast is bounded; more items mean more scans, never a cut.  Texts
are neither shuffled nor joined, hence no passage, however common, makes a hot task.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, in lower
case.  Defined results: null, empty and wordless texts or items have no matches; an item
of fewer words than a seed is one seed by itself.  Equal items each match; repeated rows
of documents each get their matches.  Long texts are read whole, with the memory of their
words' numbers, and alignments hold ``ROW_CELLS`` cells or one passage.  No documents give
no rows.  Other columns pass through; one with the result's name gives way.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import add, arrow

SEED_WORDS = 4
RARE_DOCS = 20
RARE_TIMES = 4
MIN_SCORE = 0.4
BLOCK_WORDS = 200_000
#: Cells of a row of passages that are aligned at a time: a long passage has few beside it.
ROW_CELLS = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
KIND = "array<struct<item_id:{},score:double,first_word:int,last_word:int>>"

_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


class Block:
    """Some test items, their vocabulary and their seeds."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64) for _, ws in items]
        self.base = len(self.vocabulary) + 1
        # seeds by their length: short items are one seed of their own length
        self.places: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for x, ws in enumerate(self.words):
            n = min(SEED_WORDS, len(ws))
            for code in set(self.codes(ws, n).tolist()):
                self.places[n][code].append(x)
        self.places = {n: dict(v) for n, v in self.places.items()}
        self.sorted = {n: np.array(sorted(v), np.int64) for n, v in self.places.items()}

    def codes(self, ids: np.ndarray, n: int) -> np.ndarray:
        """A number for each run of n words; wraps around where words are many, which can only add candidates."""
        out = ids[: len(ids) - n + 1].copy()
        for k in range(1, n):
            out *= self.base
            out += ids[k : len(ids) - n + 1 + k]
        return out

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts end to end (0: not in any item) with a 0 after each text, and where each text starts."""
        ids: list[int] = []
        starts, get = [], self.vocabulary.get
        for t in texts:
            starts.append(len(ids))
            ids += [get(w, 0) for w in words_of(t)]
            ids.append(0)
        return np.array(ids, np.int64), np.array(starts, np.int64)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each seed length: the places where seeds start and their codes."""
        known = ids > 0
        for n, seeds in self.sorted.items():
            whole = known[: len(known) - n + 1].copy()
            for k in range(1, n):
                whole &= known[k : len(known) - n + 1 + k]
            at = np.flatnonzero(whole)
            if len(at):
                codes = ids[at].copy()
                for k in range(1, n):
                    codes = codes * self.base + ids[at + k]
                found = np.searchsorted(seeds, codes)
                found[found == len(seeds)] = 0
                same = seeds[found] == codes
                yield n, at[same], codes[same]


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each passage with its item as a share of the item's own, many at a time."""
    out = np.zeros(len(items))
    order = sorted(range(len(items)), key=lambda i: (len(passages[i]), len(items[i])))
    at = 0
    while at < len(order):
        n = 1
        while n < 256 and at + n < len(order) and (n + 1) * len(passages[order[at + n]]) <= ROW_CELLS:
            n += 1
        own = order[at : at + n]
        at += n
        wide, tall = max(len(passages[i]) for i in own), max(len(items[i]) for i in own)
        text, item = np.zeros((len(own), wide), np.int64), np.full((len(own), tall), -1, np.int64)
        for r, i in enumerate(own):
            text[r, : len(passages[i])], item[r, : len(items[i])] = passages[i], items[i]
        step = GAP * np.arange(wide, dtype=np.int32)
        above, best = np.zeros((len(own), wide + 1), np.int32), np.zeros(len(own), np.int32)
        for j in range(tall):
            row = np.where(text == item[:, j : j + 1], MATCH, MISMATCH) + above[:, :-1]
            np.maximum(row, above[:, 1:] + GAP, out=row)
            np.maximum(row, 0, out=row)
            # a gap in the item: the best cell to the left, less its distance
            row = np.maximum.accumulate(row - step, axis=1) + step
            np.maximum(best, row.max(axis=1), out=best)
            above[:, 1:] = row
        for r, i in enumerate(own):
            out[i] = best[r] / (MATCH * max(1, len(items[i])))
    return out


def reachable(passage: np.ndarray, item: np.ndarray) -> float:
    """No alignment of the two scores more: every word of the passage that the item has matches, and the others cost."""
    sums = np.cumsum(np.where(np.isin(passage, item), MATCH, max(MISMATCH, GAP)))
    best = (sums - np.minimum.accumulate(np.append(0, sums))[:-1]).max(initial=0)
    return min(1.0, best / (MATCH * max(1, len(item))))


def spans(spots: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """First and last word of each run of seeds that are at most ``reach`` words from the next."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spots):
        if out and a - out[-1][1] <= reach:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, text: str, key: str, most: int = BLOCK_WORDS) -> Iterator[Block]:
    held, size = [], 0
    for r in items.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        if ws := words_of(r.t):
            if held and size + len(ws) > most:
                yield Block(held)
                held, size = [], 0
            held.append((r.k, ws))
            size += len(ws)
    if held:
        yield Block(held)


def _rare(df: DataFrame, text: str, block: Block) -> dict[int, dict[int, frozenset[int]]]:
    """Seed length -> code -> the items for which the seed is rare."""
    shared = df.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, totals = shared.value, defaultdict(int)
        for batch in batches:
            ids, starts = one.read(batch.column(0).to_pylist())
            for n, at, codes in one.hits(ids):
                pairs = np.unique(np.stack((np.searchsorted(starts, at, side="right"), codes)), axis=1)
                for code, k in zip(*np.unique(pairs[1], return_counts=True), strict=True):
                    totals[n, int(code)] += int(k)
        rows = list(totals.items())
        yield pa.RecordBatch.from_pydict({"n": [k[0] for k, _ in rows], "code": [k[1] for k, _ in rows], "docs": [v for _, v in rows]}, schema=pa.schema([("n", pa.int32()), ("code", pa.int64()), ("docs", pa.int64())]))

    rows = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "n int, code long, docs long").groupBy("n", "code").agg(F.sum("docs").alias("docs")).collect()  # a row a seed at most
    docs = {(r.n, r.code): r.docs for r in rows}
    by_item: dict[int, list[int]] = defaultdict(list)
    for n, seeds in block.places.items():
        for code, items in seeds.items():
            for x in items:
                by_item[x].append(docs.get((n, code), 0))
    most = {x: max(RARE_DOCS, RARE_TIMES * sorted(v)[len(v) // 4]) for x, v in by_item.items()}
    return {n: {code: keep for code, items in seeds.items() if (keep := frozenset(x for x in items if docs.get((n, code), 0) <= most[x]))} for n, seeds in block.places.items()}


def match(df: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", min_score: float = MIN_SCORE, into: str = "leaks") -> DataFrame:
    """Adds the items that each text holds: id, alignment score and the first and last word of the seeds' passage."""
    kind = KIND.format(items.schema[item_key].dataType.simpleString())
    found = F.array().cast(kind)
    for block in blocks(items, item_text, item_key):
        found = F.concat(found, _scan(df, text, block, _rare(df, text, block), kind, min_score))
    return add(df, {into: found})


def _scan(df: DataFrame, text: str, block: Block, rare: dict, kind: str, min_score: float):
    shared = df.sparkSession.sparkContext.broadcast((block, rare))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one, seeds = shared.value
        for batch in batches:
            ids, starts = one.read(batch.to_pylist())
            ends = np.append(starts[1:], len(ids)) - 1
            rare, common = defaultdict(list), defaultdict(list)  # (text, item) -> where its seeds are
            for n, at, codes in one.hits(ids):
                docs = np.searchsorted(starts, at, side="right") - 1
                for d, p, code in zip(docs.tolist(), at.tolist(), codes.tolist(), strict=True):
                    few = seeds[n].get(code, ())
                    for x in one.places[n][code]:
                        (rare if x in few else common)[d, x].append((p, p + n - 1))

            def passage(d: int, x: int, a: int, b: int) -> np.ndarray:
                return ids[max(starts[d], a - 2 * len(one.words[x])) : min(ends[d], b + 1 + 2 * len(one.words[x]))]  # noqa: B023

            jobs = [(d, x, 0, a, b) for (d, x), spots in rare.items() for a, b in spans(spots, 2 * len(one.words[x]))]
            known = {(d, x, a, b) for d, x, _, a, b in jobs}
            for (d, x), spots in common.items():
                for a, b in spans(spots + rare.get((d, x), []), 2 * len(one.words[x])):
                    if (d, x, a, b) not in known and reachable(passage(d, x, a, b), one.words[x]) >= min_score:
                        jobs.append((d, x, 1, a, b))
            places: dict[tuple[int, bytes], int] = {}  # equal passages share a place
            passages, own, spot = [], [], []
            for d, x, _, a, b in jobs:
                found = passage(d, x, a, b)
                k = places.setdefault((x, found.tobytes()), len(places))
                if k == len(passages):
                    passages.append(found)
                    own.append(one.words[x])
                spot.append(k)
            scores = align(passages, own)[spot] if jobs else np.zeros(0)
            out = [[] for _ in range(len(batch))]
            good = sorted((d, x, -s, k, a, b) for (d, x, k, a, b), s in zip(jobs, scores.tolist(), strict=True) if s >= min_score)
            for (d, x), group in groupby(good, key=lambda g: g[:2]):  # an item's best passage
                _, _, s, _, a, b = next(group)
                out[d].append({"item_id": one.ids[x], "score": -s, "first_word": int(a - starts[d]), "last_word": int(b - starts[d])})
            yield pa.array(out, pa.list_(pa.struct([("item_id", pa.array(one.ids).type), ("score", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())])))

    return arrow(run, kind)(df[f"`{text}`"])
