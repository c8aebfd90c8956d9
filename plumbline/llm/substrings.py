"""Exact substring deduplication by fixed-block anchors.

A repeat is a run of ``WINDOW`` words or more that also stands earlier.  Every such run
holds a whole block of ``BLOCK`` = WINDOW // 2 words that starts at a multiple of BLOCK
in the earlier document, wherever it starts in the later one.  So the blocks at those
places are the index, and every rolling window of BLOCK words probes it.  Around the
hits all windows of WINDOW words are compared by a 128-bit digest of their words, each
later one covers its words, and windows that overlap join into maximal repeats.

Documents are dealt to groups of about ``GROUP_BYTES`` by a hash of their key, and a
group is the unit of all exchange:

1. Each group sends the distinct hashes of its rolling windows, with a mark on those
   that are blocks, packed by hash range (one for each ``RANGE_BYTES`` of text).  Where two groups or more hold a hash and one
   of them as a block, all of them are told so.
2. Each group sends the distinct digests of its full windows that hold such a hit, with
   the smallest key that has them, and is told which of them an earlier document of
   another group has.
3. Each group drops covered words; repeats within a group or a document it sees itself,
   by the digests of those windows whose rolling hash another one shares.

A passage in a third of all documents is one entry for each group, never one for each
document, and nothing is paired.  The texts are exchanged once.  Rolling hashes only
propose: 31 bits in step 1 within a hash range, where a chance hit adds candidates, and 64
bits in step 3.  What removes words is XXH3 with 128 bits over a window's words as they
stand, which rolling hashes' own collisions (such as those of a Thue-Morse word and its
complement, for any polynomial modulo 2**64) don't touch.  Groups and
ranges grow with the text while partitions stop at ``MOST_PARTITIONS``: a task then takes
its groups or ranges one after another and holds one of them.  Work is in proportion to
the words, since only ranges that a group has hashes in are visited or sent.

Defined results: a null, empty or blank text has no words.  Rows of the same key don't
count as earlier than each other; a null key is later than all others.  The result has
a row for each row, with the key and the results; other columns take no part.  A long
text is read whole and makes its group larger by itself; no rows give no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 20
GROUP_BYTES = 8 << 20
MIN_GROUPS = 12
RANGE_BYTES = 8 << 20
MOST_PARTITIONS = 20_000
#: Bytes hashed at a time; a longer text is hashed as one piece.
PIECE = 1 << 19
LAST = np.int64(2**63 - 1)

_RNG = np.random.default_rng(7_919)
_TABLE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Group:
    """The words of some documents, which are put in the order of their keys."""

    def __init__(self, table: pa.Table, window: int):
        keys = table.column("key").to_numpy() if table.num_rows else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], order
        parts = [(t or b"").split() for t in table.column("text").take(pa.array(order)).to_pylist()]
        self.counts = np.fromiter(map(len, parts), np.int64, len(parts))
        self.joined = [b" ".join(p) for p in parts]
        self.doc = np.repeat(np.arange(len(parts)), self.counts)
        self.first = np.cumsum(self.counts) - self.counts
        self.window, self.block = window, window // 2

    def hashes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of k words within one document, and the windows' hashes."""
        at, found, word, i, n = [], [], 0, 0, len(self.joined)
        while i < n:
            j, size = i, 0
            while j < n and (j == i or size + len(self.joined[j]) < PIECE):
                size += len(self.joined[j]) + 1
                j += 1
            words = int(self.counts[i:j].sum())
            if words >= k:
                raw = np.frombuffer(b" ".join(x for x in self.joined[i:j] if x), np.uint8)
                size = max(PIECE, len(raw) + 1)
                up, down = _powers(size if size == PIECE else 1 << size.bit_length())
                total = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum(_TABLE[raw] * up[: len(raw)], out=total[1:])
                gaps = np.flatnonzero(raw == 32)
                starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(raw))
                good = np.flatnonzero(self.doc[word : word + words - k + 1] == self.doc[word + k - 1 : word + words])
                s, e = starts[good], ends[good + k - 1]
                found.append(_mixed((total[e] - total[s]) * down[s]))
                at.append(good + word)
            word += words
            i = j
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(at), np.concatenate(found)

    def digests(self, at: np.ndarray) -> np.ndarray:
        """128 bits (as two numbers) of the words of each full window, given by first words in ascending order."""
        out, digest = [], xxhash.xxh3_128_digest
        for one in np.split(at, np.flatnonzero(np.diff(self.doc[at])) + 1) if len(at) else []:
            text, first = self.joined[self.doc[one[0]]], one - self.first[self.doc[one[0]]]
            gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            begin, end = np.append(0, gaps + 1)[first], np.append(gaps, len(text))[first + self.window - 1]
            out += [digest(text[i:j]) for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
        return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2)

    def candidates(self, hits: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First words of the full windows around hits, their digests, and of the distinct digests, in the order in which they are sent: range, digest, smallest key."""
        at, h = self.hashes(self.block)
        hit = np.zeros(len(self.doc) + 1, np.int64)
        if len(hits):
            keys = _place(h, ranges)
            spot = np.searchsorted(hits, keys)
            spot[spot == len(hits)] = 0
            hit[at[hits[spot] == keys] + 1] = 1
        hit = np.cumsum(hit)
        at = np.flatnonzero(self.doc[: len(self.doc) - self.window + 1] == self.doc[self.window - 1 :]) if len(self.doc) >= self.window else np.zeros(0, np.int64)
        # a hit starts within the window early enough to end within it
        at = at[hit[np.minimum(at + self.window - self.block + 1, len(self.doc))] - hit[at] > 0]
        h = self.digests(at)
        order, new = _sorted(h)  # keys ascend among equal digests
        order = order[new]
        ranged = _range(h[order], ranges)
        order = order[np.argsort(ranged, kind="stable")]
        return at, h, _range(h[order], ranges), h[order], self.keys[self.doc[at[order]]]


def _sorted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of digests in their order, equal ones in theirs, and which of them are the first of their kind."""
    order = np.lexsort((h[:, 1], h[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]).any(1)
    return order, new


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    return h[:, 1] % np.uint64(ranges)


def _place(h: np.ndarray, ranges: int) -> np.ndarray:
    """Range of a hash, chosen by its upper bits, before its lower 31 bits."""
    return ((h >> np.uint64(31)) % np.uint64(ranges)) << np.uint64(31) | h & np.uint64(0x7FFFFFFF)


def _cut(ranged: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, from, to) of a sorted array of ranges: those that are there, whatever their number."""
    if not len(ranged):
        return []
    starts = np.append(0, np.flatnonzero(ranged[1:] != ranged[:-1]) + 1)
    return list(zip(ranged[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ranged)], strict=True))


def _hits(right: pa.Table) -> np.ndarray:
    """Sorted places of the hits that a group was told of."""
    found = [np.frombuffer(b, np.uint32).astype(np.uint64) | np.uint64(r) << np.uint64(31) for r, kind, b in zip(right.column("range").to_pylist(), right.column("kind").to_pylist(), right.column("blob").to_pylist(), strict=True) if kind == 0]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, group_bytes: int = GROUP_BYTES, range_bytes: int = RANGE_BYTES, most_partitions: int = MOST_PARTITIONS) -> DataFrame:
    """A row for each row of ``df``: ``key``, ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by one space."""
    if window < 4 or window % 2:
        raise ValueError("window: an even number of words, 4 or more")
    total = df.agg(F.sum(F.octet_length(f"`{text}`").cast("long"))).first()[0] or 0
    groups, ranges = max(MIN_GROUPS, -(-total // group_bytes)), max(MIN_GROUPS, -(-total // range_bytes))
    partitions = min(groups, most_partitions)
    docs = df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(int(LAST))).alias("key"), F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{text}`").cast("binary").alias("text"))
    docs = docs.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")).repartition(partitions, "g")

    def probe(name: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = Group(table, window)
        at, h = group.hashes(group.block)
        block = (at - group.first[group.doc[at]]) % group.block == 0 if len(at) else np.zeros(0, bool)
        places = _place(h, ranges) << np.uint64(1) | block.astype(np.uint64)
        places = np.unique(places)
        last = np.ones(len(places), bool)
        last[:-1] = places[1:] >> np.uint64(1) != places[:-1] >> np.uint64(1)  # of a hash as a block and as none, the block
        places = places[last]
        small = places.astype(np.uint32)  # range bits fall away
        cuts = _cut(places >> np.uint64(32))
        return pa.table({"range": pa.array([r for r, _, _ in cuts], pa.int32()), "g": pa.array([name[0].as_py()] * len(cuts), pa.int32()), "blob": pa.array([small[a:b].tobytes() for _, a, b in cuts], pa.binary())})

    def answer(name: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        r, groups_of = name[0].as_py(), sent.column("g").to_pylist()
        blobs = [np.frombuffer(b.as_buffer(), np.uint32) for chunk in sent.column("blob").chunks for b in chunk]
        each = np.concatenate(blobs)
        hashes, marks = each >> 1, each & 1
        distinct, back = np.unique(hashes, return_inverse=True)
        good = (np.bincount(back, minlength=len(distinct)) > 1) & (np.bincount(back, marks, minlength=len(distinct)) > 0)
        told, ends = good[back], np.cumsum([0, *map(len, blobs)])
        out = [(g, hashes[a:z][told[a:z]].tobytes()) for g, a, z in zip(groups_of, ends, ends[1:], strict=False) if told[a:z].any()]
        return pa.table({"g": pa.array([g for g, _ in out], pa.int32()), "range": pa.array([r] * len(out), pa.int32()), "kind": pa.array([0] * len(out), pa.int8()), "blob": pa.array([x for _, x in out], pa.binary())})

    def offer(name: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        hits = _hits(right)
        if len(hits) and left.num_rows:
            _, _, ranged, h, first = Group(left, window).candidates(hits, ranges)
            for r, a, b in _cut(ranged):
                base = int(first[a:b].min())
                wide = first[a:b] - base
                rows.append((r, name[0].as_py(), h[a:b].tobytes(), base, wide.astype(np.uint32).tobytes() if wide.max() < 1 << 32 else wide.tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary())
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("range", "g", "hashes", "base", "first"), columns, kinds, strict=True)})

    def compare(name: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        r, own = name[0].as_py(), list(zip(*(sent.column(c).to_pylist() for c in ("g", "hashes", "base", "first")), strict=True))
        h = [np.frombuffer(x[1], np.uint64).reshape(-1, 2) for x in own]
        first = [np.frombuffer(x[3], np.uint32 if len(x[3]) == 4 * len(a) else np.int64).astype(np.int64) + x[2] for x, a in zip(own, h, strict=True)]
        order, new = _sorted(np.concatenate(h))
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        each = np.concatenate(first)
        least = np.full(int(back.max()) + 1, LAST)
        np.minimum.at(least, back, each)
        late, ends = each > least[back], np.cumsum([0, *map(len, h)])
        out = [(x[0], np.packbits(late[a:z]).tobytes()) for x, a, z in zip(own, ends, ends[1:], strict=False) if late[a:z].any()]
        return pa.table({"g": pa.array([g for g, _ in out], pa.int32()), "range": pa.array([r] * len(out), pa.int32()), "kind": pa.array([1] * len(out), pa.int8()), "blob": pa.array([x for _, x in out], pa.binary())})

    def drop(name: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left, window)
        chosen, digest, ranged, sent, _ = group.candidates(_hits(right), ranges)
        at, h = group.hashes(window)
        # within the group: later than the smallest key, or later in the same document
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(order), bool)
        same[1:] = h[order][1:] == h[order][:-1]
        same[:-1] |= same[1:]
        at = np.sort(at[order[same]])
        h, doc = group.digests(at), group.doc[at] if len(at) else np.zeros(0, np.int64)
        order, new = _sorted(h)
        lead = order[new][np.cumsum(new) - 1]
        again = np.zeros(len(order), bool)
        again[1:] = ~new[1:] & (doc[order][1:] == doc[order][:-1])
        late = [at[order[again | (group.keys[doc[order]] > group.keys[doc[lead]])]]]
        # elsewhere: as told
        cuts = {r: (a, b) for r, a, b in _cut(ranged)}
        told = np.zeros(len(sent), bool)
        for r, kind, b in zip(right.column("range").to_pylist(), right.column("kind").to_pylist(), right.column("blob").to_pylist(), strict=True):
            if kind == 1:
                a, z = cuts[r]
                told[a:z] = np.unpackbits(np.frombuffer(b, np.uint8), count=z - a).astype(bool)
        if told.any():
            both = np.concatenate([sent[told], digest])
            order, new = _sorted(both)
            gone = np.zeros(len(both), bool)
            gone[order] = np.maximum.reduceat(order < told.sum(), np.flatnonzero(new))[np.cumsum(new) - 1]
            late.append(chosen[gone[told.sum() :]])
        late = np.unique(np.concatenate(late))
        covered = np.zeros(len(group.doc) + 1, np.int64)
        covered[late] += 1
        covered[late + window] -= 1
        covered = np.cumsum(covered)[: len(group.doc)] > 0
        removed = np.bincount(group.doc[covered], minlength=len(group.keys)) if len(group.keys) else np.zeros(0, np.int64)
        kept = []
        for i, text in enumerate(group.joined):
            if removed[i]:
                stay = ~covered[group.first[i] : group.first[i] + group.counts[i]]
                text = b" ".join([w for w, s in zip(text.split(b" "), stay.tolist(), strict=True) if s])
            kept.append(text)
        none = left.column("none").to_numpy(zero_copy_only=False)[group.rows] if left.num_rows else np.zeros(0, bool)
        return pa.table({"key": pa.array(group.keys, pa.int64(), mask=none.astype(bool)), "n_words": pa.array(group.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    told = "g int, range int, kind byte, blob binary"
    hits = docs.groupBy("g").applyInArrow(probe, "range int, g int, blob binary").repartition(partitions, "range").groupBy("range").applyInArrow(answer, told)
    offers = docs.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(offer, "range int, g int, hashes binary, base long, first binary")
    late = offers.repartition(partitions, "range").groupBy("range").applyInArrow(compare, told)
    out = docs.groupBy("g").cogroup(hits.union(late).groupBy("g")).applyInArrow(drop, "key long, n_words long, n_removed long, kept string")
    return out.select(F.col("key").alias(key), "n_words", "n_removed", "kept")
