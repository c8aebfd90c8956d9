"""Byte-level BPE encoding and decoding over a given rank file.

Two tiers look a pre-token up.  A minimal perfect hash over the vocabulary's byte
strings resolves those that are a token as they stand; the rest go through a merge
loop that keeps bytes in a linked list and candidate pairs in a heap, so a
pre-token of n bytes costs n log n.  Pre-tokens repeat, so each Python worker keeps
a bounded memo of what it has resolved; it changes no result.

Defined results: a null text encodes as no ids and an empty text likewise; null ids
decode to empty bytes; an id outside the vocabulary raises.  Repeated rows are
encoded alike.  Other columns pass through untouched; one that has the name of the
result gives way to it.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import add, arrow

MEMO_ENTRIES = 1 << 17
#: Longer pre-tokens are not kept in the memo.
MEMO_CHARS = 64


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in rank order (rank = id, 0 to n - 1 without gaps)."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens) or len(set(tokens)) != len(tokens):
        raise ValueError(f"{path}: ranks must be distinct and without gaps")
    return tokens


class PerfectHash:
    """A minimal perfect hash of n distinct byte strings onto 0..n-1, by displacement.

    Keys fall into buckets; larger buckets are placed first, each with the smallest
    displacement that sends its keys to free slots.  A bucket of one key names its
    slot outright (stored as -slot - 1).
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        rows: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            rows.setdefault(h % self.buckets, []).append(i)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slots = np.full(n, -1, np.int32)  # slot -> key
        free = np.ones(n, bool)
        order = sorted(rows.items(), key=lambda x: -len(x[1]))
        for bucket, members in order:
            if len(members) == 1:
                continue
            shift = 0
            while True:
                places = {self._place(hashes[i], shift) for i in members}
                if len(places) == len(members) and all(free[p] for p in places):
                    break
                shift += 1
            self.shift[bucket] = shift
            for i in members:
                p = self._place(hashes[i], shift)
                self.slots[p], free[p] = i, False
        left = iter(np.flatnonzero(free))
        for bucket, members in order:
            if len(members) == 1:
                p = int(next(left))
                self.shift[bucket], self.slots[p] = -p - 1, members[0]
        self.shift = self.shift.tolist()
        self.slots = self.slots.tolist()

    def _place(self, h: int, shift: int) -> int:
        return ((h >> 24) + shift * (h >> 40 | 1)) % self.n

    def __call__(self, key: bytes) -> int:
        """The only key that ``key`` can be; the caller compares."""
        h = xxhash.xxh3_64_intdigest(key)
        shift = self.shift[h % self.buckets]
        return self.slots[-shift - 1 if shift < 0 else self._place(h, shift)]


class Vocabulary:
    """Encodes text by ranks, as the public rank-file tokenizers do, without special tokens."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.find = PerfectHash(tokens)
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(self.pattern).findall
        ids = {t: i for i, t in enumerate(self.tokens)}
        self.bytes = [ids.get(bytes([b]), -1) for b in range(256)]
        # what two neighbouring tokens merge into
        self.pairs = {(ids[t[:i]], ids[t[i:]]): x for t, x in ids.items() for i in range(1, len(t)) if t[:i] in ids and t[i:] in ids}
        self.memo = _Memo(self)

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens, "pattern": self.pattern, "find": self.find}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def rank(self, piece: bytes) -> int:
        """Id of a whole token, -1 if there is none."""
        i = self.find(piece)
        return i if self.tokens[i] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token: the pair of lowest rank merges first, the leftmost of equals."""
        n, pair, push, pop = len(piece), self.pairs.get, heapq.heappush, heapq.heappop
        ids = [self.bytes[b] for b in piece]
        if min(ids) < 0:
            raise ValueError("a single byte has no token")
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # a candidate is rank << 32 | place of its left part
        heap = [r << 32 | i for i, r in enumerate(map(pair, zip(ids, ids[1:]))) if r is not None]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if j >= n or ids[i] < 0 or pair((ids[i], ids[j])) != rank:
                continue  # one of the two parts has changed since
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pair((rank, ids[k]))) is not None:
                    push(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := pair((ids[h], rank))) is not None:
                push(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as packed 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))


class _Memo(dict):
    """Pre-token -> packed ids.  When full it becomes the older of two generations, from which what is asked for again comes back."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            piece = word.encode("utf-8")
            one = self.vocabulary.rank(piece)
            packed = array("i", [one] if one >= 0 else self.vocabulary.merge(piece)).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed


def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(read_ranks(path), pattern)


def encode(df: DataFrame, vocab: Vocabulary, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the ids of ``text`` as array<int>."""
    return add(df, {into: ids_of(df.sparkSession, vocab, df[f"`{text}`"])})


def ids_of(spark: SparkSession, vocab: Vocabulary, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(vocab)  # as large as the vocabulary file

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = shared.value
        for batch in batches:
            parts = [coder.encode(x.as_py() or "") for x in batch]
            ends = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))

    return arrow(run, "array<int>")(text)


def decode(df: DataFrame, vocab: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the bytes that ``ids`` stand for."""
    return add(df, {into: bytes_of(df.sparkSession, vocab, df[f"`{ids}`"])})


def bytes_of(spark: SparkSession, vocab: Vocabulary, ids: Column) -> Column:
    shared = spark.sparkContext.broadcast(vocab.tokens)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = pa.array(shared.value, pa.binary())
        lengths = np.fromiter(map(len, shared.value), np.int64, len(tokens))
        for batch in batches:
            flat = batch.flatten()  # skips what null rows may hold
            sizes = np.diff(batch.offsets.to_numpy())
            sizes[batch.is_null().to_numpy(zero_copy_only=False)] = 0
            joined = tokens.take(flat)
            at = np.concatenate(([0], np.cumsum(lengths[flat.to_numpy()])))
            ends = at[np.concatenate(([0], np.cumsum(sizes)))]
            start = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset] if len(flat) else 0
            data = joined.buffers()[2] if len(flat) else pa.py_buffer(b"")
            yield pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((ends + start).astype(np.int32).tobytes()), data])

    return arrow(run, "binary")(ids)


def digests(df: DataFrame) -> DataFrame:
    """The contract's columns from a frame that has doc_id, ids and decoded."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
