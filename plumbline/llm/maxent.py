"""Language-model scores of whole texts: a hashed maximum-entropy model of the next token, beside an add-one unigram base.

**Outcomes.**  A token is one of the V words of the learned texts (each text's end is one of
them) or the unknown word.  Its chance is a product of three softmax-like factors, each of
which sums to one over its outcomes, so the whole does too:

    P(token | history) = P(class | history) P(leaf | class, history) P(token | leaf)

The ``HEAD`` most frequent words have a leaf each, other words share one with those of the
same ending, and words seen once share one with the unknown word: seen by a text that is
left out they would have been unknown, so that leaf teaches when unknown words come.
Within a leaf, chances are in proportion to counts; the unknown word's share of its leaf is
Good and Turing's, words seen once against twice the words seen twice.  ``WIDTH`` leaves
make a class, so both softmax layers have ``WIDTH`` outcomes whatever the vocabulary.

**Features** of a history are its n-grams and skips of leaves: the last one, the one before
it and the third last for the class, the last one, the one before it and the last two
together for the leaf; each, joined with the layer's node, is hashed to one of ``ROWS`` rows of WIDTH weights.
Unigram shares are the layers' offsets.

**Training** is by distributed gradient updates.  Learned texts are dealt to shards, shards to
``ROUNDS`` rounds.  In a round, every shard starts from the weights so far and takes Adagrad
steps over its own tokens in sparse batches (rows that a batch touches are summed once
each); the changes of all shards that touched a row are averaged across tasks.  Every learned
token is used once, so the work is in proportion to the corpus.

**Exchange.**  Texts aren't shuffled.  A task reads about ``BUNDLE_BYTES`` of them into a
bundle: token codes, and the bundle's distinct words, cut by ranges of their hash.  A range
adds up its words' counts over all bundles (words are compared whole, no hash stands for
one) and tells each bundle its words' leaves and counts.  From then on a token is the two
bytes of its leaf.  A word in every document costs a row for each bundle.  The driver and all
tasks get ``HEAD`` words, the leaves' totals and the weights: fixed numbers of bytes.

Defined results: a null or empty text is its end alone.  A row whose ``learn`` is null teaches
nothing.  Rows that repeat an id teach and are scored each for itself.  With nothing learned
the unknown word is certain and scores are 0.  No rows give none.  Long texts are read whole.
Ids of any type pass through; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log, log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import forget, tidy
from plumbline.sources.shared import written

WIDTH = 32
LEAVES = WIDTH * WIDTH
HEAD = 512
ROWS = 1 << 16
ROUNDS = 4
RATE = 1.0
BUNDLE_BYTES = 16 << 20
RANGE_BYTES = 64 << 20
MIN_RANGES = 12
MIN_SHARDS = 8
#: Tokens of one gradient step, and rows of weights that are averaged as one.
BATCH = 1 << 14
BLOCK = 1 << 10
#: The key of a text's end among the words: white space, so no word has it.
END = b"\n"
#: Stands for it between the words of a text: no UTF-8 text has this byte.
STOP = b"\xff"
RARE, ENDING, TAIL = 0, 1, 2 + HEAD
#: Features (last, second last, third last, last two) of the classes and of the leaves.
TOP, LOW = [0, 1, 2], [0, 1, 3]
MOST_WEIGHT = 20.0
#: Stands before a text's first token.
START = LEAVES

_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_NODE, _MIX = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@dataclass
class Vocabulary:
    """What all tasks know of the learned tokens."""

    head: dict[bytes, int]
    mass: np.ndarray
    tokens: int
    types: int
    once: int
    twice: int

    def leaf(self, word: bytes, n: int) -> int:
        if word == END and n:
            return ENDING
        if n < 2:
            return RARE
        return self.head.get(word) or _tail(word)

    @property
    def unknown(self) -> float:
        """The unknown word's share of its leaf."""
        return (self.once + 1) / (self.once + 1 + 2 * self.twice + 1) if self.once else 1.0

    def within(self, leaf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 P(token | leaf)."""
        p = n / self.mass[leaf]
        rare = leaf == RARE
        p[rare] = np.where(n[rare] > 0, (1 - self.unknown) / max(self.once, 1), self.unknown)
        return np.log10(p)

    def offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the classes' shares, and of the leaves' in their class; those without a word are impossible."""
        mass = self.mass.reshape(WIDTH, WIDTH)
        with np.errstate(divide="ignore", invalid="ignore"):
            classes = np.log(mass.sum(1) / mass.sum())
            leaves = np.log(mass / mass.sum(1, keepdims=True))
        floor = lambda x: np.maximum(np.nan_to_num(x, nan=0.0, neginf=-1e4), -1e4).astype(np.float32)
        return floor(classes), floor(leaves)


def _tail(word: bytes) -> int:
    return TAIL + xxhash.xxh64_intdigest(word[-3:]) % (LEAVES - TAIL)


def _ints(blob: bytes | None, kind: type) -> np.ndarray:
    return np.frombuffer(blob or b"", kind)


# -- bundles and the words' counts


def bundles(df: DataFrame, learn: Column, text: str, key: str, ranges: int, shards: int, bundle_bytes: int) -> DataFrame:
    """A row for each bundle (range -1) and one for each range of its words."""
    docs = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, n = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            for at in range(batch.num_rows):
                held.append(batch.slice(at, 1))
                size += len(batch.column(2)[at].as_buffer() or b"") if batch.column(2)[at].is_valid else 0
                if size >= bundle_bytes:
                    yield from made(held, part, n)
                    held, size, n = [], 0, n + 1
        if held:
            yield from made(held, part, n)
        tidy()

    def made(held: list[pa.RecordBatch], part: int, n: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        flags = table.column("learn").to_numpy().astype(np.uint8)
        sizes, parts = [], []
        for t in table.column("text"):
            own = (t.as_py() or b"").lower().split()
            sizes.append(len(own) + 1)
            own.append(STOP)
            parts.append(b" ".join(own))
        coded = _spaced(b" ".join(parts) + b" ").dictionary_encode()
        del parts
        codes, names = coded.indices.to_numpy().astype(np.uint32), [w[:-1] if w != STOP + b" " else END for w in coded.dictionary.to_pylist()]
        counts = np.bincount(codes[np.repeat(flags, sizes) > 0], minlength=len(names))
        home = np.fromiter((xxhash.xxh64_intdigest(w) % ranges for w in names), np.int64, len(names))
        order = np.argsort(home, kind="stable")
        name, shard = f"{part}-{n}", (part * 7_919 + n) % shards
        nothing = [None, b"", b"", b""]
        rows = [[name, shard, -1, table.column("key").to_pylist(), flags.tobytes(), np.array(sizes, np.int32).tobytes(), codes.tobytes(), b"", b"", b""]]
        for own in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            rows.append([name, shard, int(home[own[0]]), *nothing, own.astype(np.int32).tobytes(), b" ".join([names[i] for i in own]), counts[own].astype(np.int64).tobytes()])
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(table.schema.field("key").type), *[pa.binary()] * 6]
        names = ["bundle", "shard", "range", "keys", "learn", "sizes", "codes", "spots", "words", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(run, f"bundle string, shard int, range int, keys array<{kind}>, learn binary, sizes binary, codes binary, spots binary, words binary, n binary")


def _spaced(data: bytes) -> pa.BinaryArray:
    """Words that each end in a space, as an array over the bytes as they are."""
    ends = np.append(0, np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])


def _totals(sent: pa.Table) -> tuple[list[list[bytes]], pa.DictionaryArray, np.ndarray]:
    """The words of each row, all of them as codes, and the count of each distinct one."""
    words = [b.split(b" ") for b in sent.column("words").to_pylist()]
    coded = pa.chunked_array([pa.array(w, pa.binary()) for w in words]).combine_chunks().dictionary_encode()
    n = np.concatenate([_ints(b, np.int64) for b in sent.column("n").to_pylist()])
    return words, coded, np.bincount(coded.indices.to_numpy(), n, len(coded.dictionary)).astype(np.int64)


def _tally(name: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
    """A range's most frequent words, totals of its leaves as if none had its own, and numbers of tokens and words."""
    _, coded, n = _totals(sent)
    names = coded.dictionary.to_pylist()
    end = int(sum(n[i] for i, w in enumerate(names) if w == END))
    often = [i for i in np.flatnonzero(n > 1).tolist() if names[i] != END]
    leaves = np.bincount(np.fromiter((_tail(names[i]) for i in often), np.int64, len(often)), n[often], LEAVES).astype(np.int64)
    best = sorted(often, key=lambda i: (-n[i], names[i]))[:HEAD]
    single = [i for i in np.flatnonzero(n == 1).tolist() if names[i] != END]
    rows = [("head", 0, names[i], int(n[i])) for i in best] + [("leaf", int(i), None, int(leaves[i])) for i in np.flatnonzero(leaves)]
    rows += [("tokens", 0, None, int(n.sum())), ("types", 0, None, int((n > 0).sum())), ("once", 0, None, len(single)), ("twice", 0, None, sum(1 for i in often if n[i] == 2)), ("end", 0, None, end)]
    kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64())
    return pa.table({c: pa.array(list(v), k) for c, v, k in zip(("kind", "leaf", "word", "n"), zip(*rows, strict=True), kinds, strict=True)})


def vocabulary(words: DataFrame) -> Vocabulary:
    """From the ranges' rows of ``bundles``; what comes to the driver is HEAD words and a number for each leaf."""
    found = written(words.groupBy("range").applyInArrow(_tally, "kind string, leaf int, word binary, n long"), "tally")
    head = {bytes(r.word): (i, r.n) for i, r in enumerate(found.where("kind = 'head'").orderBy(F.desc("n"), "word").limit(HEAD).collect())}
    sums = {(r.kind, r.leaf): r.n for r in found.where("kind <> 'head'").groupBy("kind", "leaf").agg(F.sum("n").alias("n")).collect()}
    forget(found)
    mass = np.zeros(LEAVES)
    for (kind, leaf), n in sums.items():
        if kind == "leaf":
            mass[leaf] = n
    for word, (i, n) in head.items():
        mass[2 + i] = n
        mass[_tail(word)] -= n
    mass[RARE], mass[ENDING] = sums.get(("once", 0), 0) + 1, sums.get(("end", 0), 0)
    return Vocabulary({w: 2 + i for w, (i, _) in head.items()}, mass, *(sums.get((k, 0), 0) for k in ("tokens", "types", "once", "twice")))


def streams(packed: DataFrame, words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """A row for each shard: its documents' keys, their tokens' leaves, and what needs no model: known tokens, base score, chances within leaves."""

    def answer(name: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        words, coded, n = _totals(sent)
        leaf = np.fromiter((vocab.leaf(w, c) for w, c in zip(coded.dictionary.to_pylist(), n.tolist(), strict=True)), np.uint16, len(n))
        at = np.split(coded.indices.to_numpy(), np.cumsum([len(w) for w in words])[:-1])
        return pa.table({"shard": sent.column("shard"), "bundle": sent.column("bundle"), "spots": sent.column("spots"), "leaf": pa.array([leaf[i].tobytes() for i in at], pa.binary()), "n": pa.array([n[i].tobytes() for i in at], pa.binary())})

    def merge(name: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        told: dict[str, list[dict]] = {}
        for r in right.to_pylist():
            told.setdefault(r["bundle"], []).append(r)
        keys, blobs = [], {c: [] for c in ("learn", "sizes", "leaves", "known", "base", "within")}
        for i in np.argsort(left.column("bundle").to_pylist(), kind="stable").tolist():
            row = left.slice(i, 1)
            one = {c: row.column(c)[0].as_py() for c in ("bundle", "learn", "sizes", "codes")}
            codes, sizes = _ints(one["codes"], np.uint32), _ints(one["sizes"], np.int32)
            leaf, n = np.zeros(int(codes.max()) + 1, np.uint16), np.zeros(int(codes.max()) + 1, np.int64)
            for r in told[one["bundle"]]:
                spots = _ints(r["spots"], np.int32)
                leaf[spots], n[spots] = _ints(r["leaf"], np.uint16), _ints(r["n"], np.int64)
            starts = np.cumsum(sizes) - sizes
            keys.append(row.column("keys").combine_chunks().flatten())
            base = np.log10((n + 1) / (vocab.tokens + vocab.types + 1))
            blobs["learn"].append(one["learn"])
            blobs["sizes"].append(one["sizes"])
            blobs["leaves"].append(leaf[codes].tobytes())
            blobs["known"].append(np.add.reduceat((n > 0)[codes], starts, dtype=np.int64).tobytes())
            blobs["base"].append(np.add.reduceat(base[codes], starts).tobytes())
            blobs["within"].append(np.add.reduceat(vocab.within(leaf.astype(np.int64), n)[codes], starts).tobytes())
        every = pa.concat_arrays(keys)
        made = {"shard": pa.array([name[0].as_py()], pa.int32()), "keys": pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)}
        tidy()
        return pa.table(made | {c: pa.array([b"".join(b)], pa.binary()) for c, b in blobs.items()})

    kind = packed.schema["keys"].dataType.simpleString()
    told = words.groupBy("range").applyInArrow(answer, "shard int, bundle string, spots binary, leaf binary, n binary")
    whole = packed.select("bundle", "shard", "keys", "learn", "sizes", "codes")
    return whole.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(merge, f"shard int, keys {kind}, learn binary, sizes binary, leaves binary, known binary, base binary, within binary")


# -- the model


def places(sizes: np.ndarray) -> np.ndarray:
    """Each token's place in its document."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def histories(leaves: np.ndarray, place: np.ndarray, a: int, b: int) -> np.ndarray:
    """The four features of the histories of tokens a to b (4, tokens), as numbers spread over 64 bits."""
    back = np.full((3, b - a), START, np.uint64)
    for k in range(1, 4):
        first = max(k - a, 0)
        back[k - 1, first:] = leaves[a + first - k : b - k]
        back[k - 1][place[a:b] < k] = START
    pair = back[1] * np.uint64(START + 1) + back[0] + np.uint64(1)
    return np.stack([*(back + np.uint64(1)), pair]) * _SPREAD[:, None]


def rows_of(features: np.ndarray, node: np.ndarray | int) -> np.ndarray:
    """Rows of weights of features at a node: 0 for the classes, a class and one for its leaves."""
    mixed = (features ^ np.asarray(node, np.uint64) * _NODE) * _MIX
    return ((mixed ^ mixed >> np.uint64(29)) * _NODE >> np.uint64(48)).astype(np.uint16)


def _softmax(weights: np.ndarray, rows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    z = offset + weights.take(rows[0], 0)
    for r in rows[1:]:
        z += weights.take(r, 0)
    np.exp(z, z)  # offsets are 0 at most and weights bounded, so nothing overflows
    z /= z.sum(1, keepdims=True)
    return z


def chances(weights: np.ndarray, offsets: tuple[np.ndarray, np.ndarray], features: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chances of all classes and of all leaves of each token's class, and the rows of both layers."""
    classes = leaves // WIDTH
    top, low = rows_of(features[TOP], 0), rows_of(features[LOW], classes.astype(np.uint64) + np.uint64(1))
    return _softmax(weights, top, offsets[0]), _softmax(weights, low, offsets[1].take(classes, 0)), top, low


def fit_shard(weights: np.ndarray, squares: np.ndarray, offsets: tuple[np.ndarray, np.ndarray], leaves: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Adagrad steps over a shard's tokens, in place; which rows were touched."""
    touched, place = np.zeros(len(weights), bool), places(sizes)
    spot = np.zeros(len(weights), np.intp)
    for a in range(0, len(leaves), BATCH):
        own = leaves[a : a + BATCH].astype(np.int64)
        n = len(own)
        top, low, high_rows, low_rows = chances(weights, offsets, histories(leaves, place, a, a + n), own)
        top[np.arange(n), own // WIDTH] -= 1
        low[np.arange(n), own % WIDTH] -= 1
        seen = np.zeros(len(weights), bool)
        seen[high_rows.ravel()] = seen[low_rows.ravel()] = True
        at = np.flatnonzero(seen)
        spot[at] = np.arange(len(at))
        slope = np.zeros((WIDTH, len(at)))
        for errors, rows in ((top, high_rows), (low, low_rows)):
            columns, rows = errors.T.astype(np.float64), spot[rows]
            for c in range(WIDTH):
                for r in rows:
                    slope[c] += np.bincount(r, columns[c], len(at))
        slope = np.ascontiguousarray(slope.T, np.float32)
        square = squares[at] + np.einsum("ij,ij->i", slope, slope)
        squares[at] = square
        slope *= (RATE / np.sqrt(1 + square))[:, None]
        weights[at] = np.clip(weights[at] - slope, -MOST_WEIGHT, MOST_WEIGHT)
        touched[at] = True
    return touched


def train(shards: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """The weights (ROWS, WIDTH); each round is one job over its share of the shards."""
    spark, offsets = shards.sparkSession, vocab.offsets()
    table = np.zeros((ROWS, WIDTH + 1), np.float32)  # a row's weights and the sum of its squared slopes
    for now in range(rounds):
        given = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            change, times = np.zeros((ROWS, WIDTH + 1)), np.zeros(ROWS, np.int64)
            for batch in batches:
                for r in batch.to_pylist():
                    sizes, flags = _ints(r["sizes"], np.int32), _ints(r["learn"], np.uint8)
                    leaves = _ints(r["leaves"], np.uint16)[np.repeat(flags, sizes) > 0]
                    weights, squares = given.value[:, :WIDTH].copy(), given.value[:, WIDTH].copy()
                    touched = fit_shard(weights, squares, offsets, leaves, sizes[flags > 0])
                    change[touched, :WIDTH] += weights[touched] - given.value[touched, :WIDTH]
                    change[touched, WIDTH] += squares[touched] - given.value[touched, WIDTH]
                    times += touched
            if times.any():
                part, blocks = TaskContext.get().partitionId(), range(ROWS // BLOCK)
                cut = lambda x, b: x[b * BLOCK : (b + 1) * BLOCK].tobytes()
                yield pa.record_batch([pa.array(list(blocks), pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array([cut(change.astype(np.float32), b) for b in blocks], pa.binary()), pa.array([cut(times, b) for b in blocks], pa.binary())], ["block", "part", "change", "times"])
            tidy()

        sent = shards.where((F.col("shard") % rounds == now)).select("learn", "sizes", "leaves").mapInArrow(run, "block int, part int, change binary, times binary")
        schema = "block int, part int, change binary, times binary"
        some = sent.withColumn("several", F.floor(F.col("part") / 64)).groupBy("block", "several").applyInArrow(_added, schema)
        for r in some.groupBy("block").applyInArrow(_added, schema).collect():  # ROWS x WIDTH numbers
            times = _ints(r.times, np.int64)
            own = slice(r.block * BLOCK, (r.block + 1) * BLOCK)
            table[own] += _ints(r.change, np.float32).reshape(BLOCK, WIDTH + 1) / np.maximum(times, 1)[:, None]
        given.unpersist()
    return np.ascontiguousarray(table[:, :WIDTH])


def _added(name: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
    """Sums of the changes of one block, in the order of their parts."""
    change, times = np.zeros((BLOCK, WIDTH + 1)), np.zeros(BLOCK, np.int64)
    for i in np.argsort(sent.column("part").to_numpy(), kind="stable").tolist():
        change += _ints(sent.column("change")[i].as_py(), np.float32).reshape(change.shape)
        times += _ints(sent.column("times")[i].as_py(), np.int64)
    part = int(sent.column("part").to_numpy().min())
    return pa.table({"block": pa.array([name[0].as_py()], pa.int32()), "part": pa.array([part], pa.int32()), "change": pa.array([change.astype(np.float32).tobytes()], pa.binary()), "times": pa.array([times.tobytes()], pa.binary())})


def scores(weights: np.ndarray, offsets: tuple[np.ndarray, np.ndarray], leaves: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of the chance of each document's leaves."""
    total = np.zeros(len(sizes))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = places(sizes)
    for a in range(0, len(leaves), BATCH):
        own = leaves[a : a + BATCH].astype(np.int64)
        n = np.arange(len(own))
        top, low, _, _ = chances(weights, offsets, histories(leaves, place, a, a + len(own)), own)
        p = np.maximum(top[n, own // WIDTH].astype(np.float64) * low[n, own % WIDTH], 1e-300)
        at = doc[a : a + len(own)]
        total[at[0] : at[-1] + 1] += np.bincount(at - at[0], np.log10(p))
    return total


def score(df: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", rounds: int = ROUNDS, bundle_bytes: int = BUNDLE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of each row; rows where ``learn`` holds teach."""
    spark = df.sparkSession
    total = df.agg(F.sum(F.octet_length(f"`{text}`").cast("long"))).first()[0] or 0
    ranges, shards = max(MIN_RANGES, -(-total // range_bytes)), max(MIN_SHARDS, -(-total // bundle_bytes))
    packed = written(bundles(df, learn, text, key, ranges, shards, bundle_bytes), "bundles")
    words = packed.where("range >= 0").select("bundle", "shard", "range", "spots", "words", "n")
    vocab = vocabulary(words)
    docs = written(streams(packed.where("range < 0"), words, vocab), "streams")
    forget(packed)
    weights, offsets = train(docs, vocab, rounds), vocab.offsets()
    given = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                sizes = _ints(r["sizes"].as_py(), np.int32)
                found = scores(given.value, offsets, _ints(r["leaves"].as_py(), np.uint16), sizes) + _ints(r["within"].as_py(), np.float64)
                n = len(sizes)
                columns = [pa.array(sizes, pa.int64()), pa.array(_ints(r["known"].as_py(), np.int64)), pa.array(np.full(n, vocab.tokens, np.int64)), pa.array(_ints(r["base"].as_py(), np.float64)), pa.array(found)]
                yield pa.RecordBatch.from_arrays([r["keys"].values, *columns], ["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        tidy()

    kind = docs.schema["keys"].dataType.elementType.simpleString()
    out = docs.select("keys", "sizes", "leaves", "known", "base", "within").mapInArrow(run, f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)
