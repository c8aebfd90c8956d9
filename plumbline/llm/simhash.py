"""SimHash near-duplicate groups by deletion-variant signatures.

A fingerprint has one bit per position that is set in over half of the XXH64 hashes of
a document's word shingles (repeats count).  Fingerprints link at ``distance`` or fewer
differing bits.  For distance d they are cut into (d + 2) // 2 segments, so that one
segment of a linked pair differs by one bit at most: each distinct fingerprint is
indexed under every segment with every single bit deleted, and an equality join on
(segment, deleted position, what remains) proposes pairs that are then verified.

Copies never meet in that join: it works on distinct fingerprints, and each stands
for its documents by the smallest doc_id.  A signature with over ``BUSY`` fingerprints
isn't joined with itself.  Its members go to an exact other way instead: each sends
itself and its 64 one-bit neighbours, and those that meet at a point, all within two
bits of each other, are linked to the smallest of them.  Two linked fingerprints always
meet so, hence no link is lost and no group is expanded into pairs.

``keep_similar`` also links texts by the similarity of their shingle sets (Jaccard,
``SIMILARITY`` or more), for which no number of bits serves: at five words and 0.8, texts
are 5 to 20 bits apart, and segments of which one surely differs by a bit at most would
then have six bits and meet everywhere.  So its other candidates come from ``BANDS``
bands of ``ROWS`` smallest hashes each (a pair at 0.8 shares none once in 10,000), and
every candidate is verified on the sets themselves.  Equal sets are one node.  The nodes
of a band value are compared in pairs if they are ``FEW`` at most.  A larger one has ``HEADS``
heads, with which all others are compared; who is similar to none of them
goes on as a head, again against all, with eight times as many each time, so rounds are
few.  A set moves once a band and round then, however many heads it meets, and what is
held is the heads' sets of one band value, ``MOST_HEADS`` at most.

Two that both resemble heads of their own haven't met so.  Where a large band value's nodes
are still of several groups after that, they do: each node that isn't of the value's
largest group is compared with every node of another group whose set could be similar by
its size.  Such nodes are held in blocks of ``BLOCK`` sets, past which the others stream, and
only pairs of different groups are told.  So every two sets that share a band value have
been compared or are in one group already, and no link between groups is lost.

Defined results: a text without words (null, empty or white space) has fingerprint
zero and is linked as any other; a text of fewer words than a shingle is one shingle.
Rows of the same doc_id and text get the same result.  A null doc_id gets its group's
smallest id and takes no part in choosing it; a group of nulls alone has component null.
Other columns of the input don't matter to ``members`` and pass through ``keep_one``,
which also keeps one of rows that repeat doc_id and text; ``keep_similar`` likewise.
Long texts are read whole.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow, by_merge, forget, free_name, tidy
from plumbline.llm.components import components
from plumbline.sources.shared import written

WORDS = 3
SEED = 42
DISTANCE = 2
#: Distinct fingerprints of one signature that are compared with each other.
BUSY = 64
SIMILARITY = 0.8
BANDS, ROWS, FEW, HEADS, MOST_HEADS = 24, 5, 16, 64, 512
#: Parts into which the nodes compared with one node are dealt if there are over MANY.
PARTS, MANY = 32, 1_000
#: Sets that are held at a time where groups of a band value are compared with each other.
BLOCK = 256


def _hashes(text: str | None, words: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, some thousand at a time."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    joined, n = b" ".join(parts), len(parts)
    sizes = np.fromiter(map(len, parts), np.int64, n) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    k = min(words, n)
    digest, many = xxhash.xxh64_intdigest, n - k + 1
    for at in range(0, many, 8192):
        cuts = zip(starts[at : min(at + 8192, many)].tolist(), (ends[at + k - 1 : at + 8192 + k - 1] - 1).tolist(), strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in cuts], np.uint64)


def _vote(pieces: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for hashes in pieces:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """As a signed 64-bit integer."""
    return _vote(_hashes(text, words, seed))


def fingerprints(text: Column, words: int = WORDS, seed: int = SEED) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(t.as_py(), words, seed) for t in batch], pa.int64())

    return arrow(run, "long")(text)


def _signatures(points: DataFrame, segments: int) -> DataFrame:
    """(segment, position, rest, fp): each fingerprint under each one-bit deletion of each segment."""
    variants = []
    for s in range(segments):
        low, high = 64 * s // segments, 64 * (s + 1) // segments
        for bit in range(low, high):
            keep = ((1 << high) - (1 << low)) & ~(1 << bit)
            variants.append((bit, keep - (1 << 64) if keep >> 63 else keep))
    each = F.explode(F.array(*[F.struct(F.lit(b).cast("byte").alias("bit"), F.col("fp").bitwiseAND(F.lit(k).cast("long")).alias("rest")) for b, k in variants]))
    return points.select("fp", each.alias("x")).select("x.bit", "x.rest", "fp")


def _meetings(points: DataFrame, distance: int) -> DataFrame:
    """Links of fingerprints within two bits: to the smallest of those that share a point at most one bit away from each.

    Within one bit: to the smallest of those that agree but for one deleted bit.
    """
    bits = [(1 << b) - (1 << 64) if b == 63 else 1 << b for b in range(64)]
    if distance == 2:
        spots = [F.struct(F.lit(-1).cast("byte").alias("bit"), F.col("fp").alias("rest")), *[F.struct(F.lit(-1).cast("byte").alias("bit"), F.col("fp").bitwiseXOR(F.lit(b).cast("long")).alias("rest")) for b in bits]]
    else:
        spots = [F.struct(F.lit(i).cast("byte").alias("bit"), F.col("fp").bitwiseAND(F.lit(~b).cast("long")).alias("rest")) for i, b in enumerate(bits)]
    spread = points.select("fp", F.explode(F.array(*spots)).alias("at"))
    least = spread.groupBy("at").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1")
    return by_merge(spread).join(least, "at").where("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v")).distinct()


def links(points: DataFrame, distance: int = DISTANCE, busy: int = BUSY) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` whose components are those of all pairs within ``distance`` bits."""
    if distance not in (1, 2):
        raise ValueError("distance: 1 or 2")
    # few bytes become many rows: spread them before, or too few tasks would do it
    points = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    signed = _signatures(points, (distance + 2) // 2)
    sizes = signed.groupBy("bit", "rest").agg(F.count("*").alias("n")).where("n > 1")
    met = written(by_merge(signed).join(sizes, ["bit", "rest"]), "signatures")
    few = met.where(F.col("n") <= busy)
    other = few.select("bit", "rest", F.col("fp").alias("v"))
    pairs = by_merge(few).join(other, ["bit", "rest"]).where((F.col("fp") > F.col("v")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= distance))
    found = pairs.select(F.col("fp").alias("u"), "v").distinct()
    return found.union(_meetings(met.where(F.col("n") > busy).select("fp").distinct(), distance))


def members(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """A row for each row of ``df``: ``key``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest ``key`` of its group."""
    docs = written(df.select(F.col(f"`{key}`").alias("id"), fingerprints(df[f"`{text}`"], words, seed).alias("fp")), "fingerprints")
    prints = docs.groupBy("fp").agg(F.min("id").alias("id"))
    roots = components(links(prints.select("fp"), distance))
    rooted = by_merge(prints).join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    # a group's root is a fingerprint; its name is the smallest id below it
    named = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    where = by_merge(rooted).join(named, "root").select("fp", "component_id")
    return by_merge(docs).join(where, "fp").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", **how: int) -> DataFrame:
    """The rows of ``df`` that name their group, one for each group: those of smallest ``key``."""
    first = members(df, text, key, **how).where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("kept_id")).distinct()
    stay = df.join(first, df[f"`{key}`"].eqNullSafe(F.col("kept_id")), "left_semi")
    return stay.dropDuplicates([key, text])


_RNG = np.random.default_rng(20_011)
_TIMES, _PLUS = _RNG.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_TIMES |= np.uint64(1)


def _sketch(text: str | None, words: int, seed: int) -> dict:
    """Fingerprint, name and set of a text's shingles (32 bits of each hash), and its bands."""
    pieces = list(_hashes(text, words, seed))
    own = np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), 2048):
        np.minimum(least, (own[at : at + 2048, None] * _TIMES + _PLUS).min(axis=0), out=least)
    bands = [xxhash.xxh64_intdigest(b.tobytes()) - (1 << 63) for b in least.reshape(BANDS, ROWS)]
    return {"fp": _vote(pieces), "node": xxhash.xxh3_128_hexdigest(own.tobytes()), "bands": bands, "shingles": np.unique(own.astype(np.uint32)).tobytes()}


def _verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the edges (u, v) whose sets are similar: each v's set is read once, then those of its u, in a sorted stream."""
    sizes = edges.groupBy("v").agg(F.count("*").alias("n"))
    parted = by_merge(edges).join(sizes, "v").select("u", "v", F.when(F.col("n") > MANY, F.pmod(F.xxhash64("u"), F.lit(PARTS))).otherwise(0).cast("int").alias("part"))
    heads = parted.select("v", "part").distinct().select(F.col("v").alias("node"), "v", "part", F.lit(0).alias("at"))
    rows = by_merge(heads.union(parted.select(F.col("u").alias("node"), "v", "part", F.lit(1).alias("at")))).join(sets, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint32)
        for batch in batches:
            found = []
            for node, v, at, blob in zip(batch.column("node").to_pylist(), batch.column("v").to_pylist(), batch.column("at").to_pylist(), batch.column("shingles"), strict=True):
                own = np.frombuffer(blob.as_buffer(), np.uint32) if blob.as_buffer().size else np.zeros(0, np.uint32)
                if at == 0:
                    head = own
                    continue
                both = np.intersect1d(head, own, assume_unique=True).size
                if both >= similarity * (len(head) + len(own) - both):
                    found.append((node, v))
            yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in found], pa.string()), "v": pa.array([v for _, v in found], pa.string())})
        tidy()

    return rows.repartition("v", "part").sortWithinPartitions("v", "part", "at").select("node", "v", "at", "shingles").mapInArrow(compare, "u string, v string")


def _led(rows: DataFrame, similarity: float) -> DataFrame:
    """(band, value, node, v): members of a band value that are similar to one of its heads, v, and not of the same ``root`` (null: of none).

    Rows of a band value and part come in order, the heads (``at`` 0) before the members,
    each with its set: the heads' sets are held as one sorted array, in which a member's
    hashes are looked up, so a set moves once and is compared with all heads at a time.
    """
    kind = "band int, value long, node string, v string"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("band", "value", "part", "at", "node", "h", "open", "root")
        place, heads, sets = None, [], []
        hashes = owners = sizes = np.zeros(0, np.int64)
        for batch in batches:
            found = []
            for (band, value, part, at, node, h, free, root), blob in zip(zip(*(batch.column(c).to_pylist() for c in names), strict=True), batch.column("shingles"), strict=True):
                own = np.frombuffer(blob.as_py(), np.uint32)
                if (band, value, part) != place:
                    place, heads, sets = (band, value, part), [], []
                if at == 0:
                    heads.append((h, node, root))
                    sets.append(own)
                    hashes = None
                    continue
                if not heads:  # a block that no head fell into
                    continue
                if hashes is None:
                    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                    hashes, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                    order = np.argsort(hashes, kind="stable")
                    hashes, owners = hashes[order], owners[order]
                low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
                n = high - low
                spots = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owners[spots], minlength=len(heads))
                for i in np.flatnonzero(both >= similarity * (sizes + len(own) - both)).tolist():
                    if heads[i][1] != node and (not free or (h, node) > heads[i][:2]) and (root is None or root != heads[i][2]):
                        found.append((band, value, node, heads[i][1]))
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["band", "value", "node", "v"])
        tidy()

    return rows.repartition("band", "value", "part").sortWithinPartitions("band", "value", "part", "at").select("band", "value", "part", "at", "node", "h", "open", "root", "shingles").mapInArrow(compare, kind)


def _similar(shared: DataFrame, sets: DataFrame, similarity: float) -> list[DataFrame]:
    """Links of similar nodes, from the band values that they share: all of small ones, of large ones those with their heads."""
    at = ["band", "value"]
    few = shared.where(F.col("n") <= FEW).select(*at, "node")
    pairs = by_merge(few.alias("a")).join(few.alias("b"), at).where("a.node > b.node").select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    links = [written(_verified(pairs, sets, similarity), "similar")]
    now, heads_of = written(shared.where(F.col("n") > FEW).select(*at, "node", "n", F.xxhash64("node").alias("h"), F.lit(True).alias("open"), F.lit(None).cast("string").alias("root")), "busy"), HEADS
    while not now.isEmpty():
        # the first of each value by hash: of each part of it, then of all parts
        order, salt = ["h", "node"], F.pmod(F.col("h"), F.lit(PARTS))
        for by in ([*at, salt], at):
            place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
            heads = (now.where("open") if by is not at else heads).withColumn("place", place).where(F.col("place") <= heads_of).drop("place")
        parts = F.when(F.col("n") > MANY, PARTS).otherwise(1)
        first = heads.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long")))).withColumn("at", F.lit(0))
        rest = now.withColumn("part", F.pmod(F.col("h"), parts).cast("long")).withColumn("at", F.lit(1))
        met = written(_led(by_merge(first.union(rest.select(first.columns))).join(sets, "node"), similarity), "similar")
        links.append(met.select(F.col("node").alias("u"), "v"))
        closed = met.select(*at, "node").union(heads.select(*at, "node")).distinct().withColumn("closed", F.lit(True))
        left = by_merge(now).join(closed, [*at, "node"], "left").withColumn("open", F.col("open") & F.col("closed").isNull()).drop("closed")
        last, now = now, written(left.join(left.where("open").select(*at).distinct(), at, "left_semi").select(now.columns), "busy")
        forget(last)
        heads_of = min(8 * heads_of, MOST_HEADS)
    forget(now)
    return links


def _between(shared: DataFrame, sets: DataFrame, rooted: DataFrame, similarity: float) -> DataFrame | None:
    """Links of similar nodes of different groups that share a large band value; None where each such value has one group."""
    at = ["band", "value"]
    named = by_merge(shared.where(F.col("n") > FEW).select(*at, "node")).join(rooted.select("node", "root"), "node")
    sizes = named.groupBy(*at, "root").agg(F.count("*").alias("m"))
    several = sizes.groupBy(*at).agg(F.count("*").alias("groups"), F.max_by("root", F.struct("m", "root")).alias("largest")).where("groups > 1").drop("groups")
    # sets that are similar differ in size by a factor of 1 / similarity at most, so by one bucket
    bucket = F.floor(F.log(F.greatest(F.octet_length("shingles") / 4, F.lit(1.0))) / (-np.log(similarity) + 1e-9)).cast("int")
    rows = written(named.join(several, at).join(by_merge(sets.select("node", bucket.alias("bucket"))), "node").withColumns({"h": F.xxhash64("node"), "open": F.lit(False)}), "between")
    if rows.isEmpty():
        forget(rows)
        return None
    heads = rows.where("root <> largest")
    cells = heads.groupBy(*at, "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    part = F.xxhash64("bucket", "chunk")
    columns = [*at, "node", "h", "open", "root"]
    first = heads.join(cells, [*at, "bucket"]).withColumn("chunk", F.pmod("h", F.col("chunks")).cast("int")).select(*columns, part.alias("part"), F.lit(0).alias("at"))
    near = by_merge(rows.withColumn("bucket", F.explode(F.array(*[F.col("bucket") + i for i in (-1, 0, 1)])))).join(cells, [*at, "bucket"])
    rest = near.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*columns, part.alias("part"), F.lit(1).alias("at"))
    found = written(_led(by_merge(first.union(rest)).join(sets, "node"), similarity).select(F.col("node").alias("u"), "v").distinct(), "similar")
    forget(rows)
    return found


def keep_similar(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, seed: int = SEED, distance: int = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` of smallest ``key`` of each group, where fingerprints within ``distance`` bits and similar shingle sets link."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("fp", pa.int64()), ("node", pa.string()), ("bands", pa.list_(pa.int64())), ("shingles", pa.binary())])
        for batch in batches:
            yield pa.array([_sketch(t.as_py(), words, seed) for t in batch], kind)

    sketch = arrow(run, "struct<fp:long,node:string,bands:array<long>,shingles:binary>")(df[f"`{text}`"])
    docs = written(df.select(F.col(f"`{key}`").alias("id"), sketch.alias("s")).select("id", "s.*"), "sketches")
    # equal sets have the same bands, but texts of equal sets may have several fingerprints
    points = docs.groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    sets = docs.groupBy("node").agg(F.first("shingles").alias("shingles"))
    prints = docs.groupBy("fp").agg(F.min("node").alias("node"))
    edges = docs.select("node", "fp").distinct().join(prints.withColumnRenamed("node", "v"), "fp").where("node <> v").select(F.col("node").alias("u"), "v")
    near = links(prints.select("fp"), distance)
    for a in ("u", "v"):
        near = by_merge(near).join(prints.select(F.col("fp").alias(a), F.col("node").alias(f"{a}_node")), a)
    edges = edges.union(near.select("u_node", "v_node"))
    held = points.select("node", F.posexplode("bands").alias("band", "value"))
    met = held.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(by_merge(held).join(met, ["band", "value"]), "bands")
    found = _similar(shared, sets, similarity)
    for one in found:
        edges = edges.union(one)

    def named(links: DataFrame) -> DataFrame:
        return written(by_merge(points.select("node", "id")).join(components(links).select("node", "root"), "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")), "rooted")

    rooted = named(edges)
    if (more := _between(shared, sets, rooted, similarity)) is not None:
        last, rooted = rooted, named(rooted.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
        forget(last)
        found.append(more)
    for one in (*found, shared):
        forget(one)
    groups = rooted.groupBy("root").agg(F.min("id").alias("id"), F.min("node").alias("node"))
    kept, node = free_name(df, "kept"), free_name(df, "node")
    stay = df.join(groups.where("id is not null").select(F.col("id").alias(kept)), df[f"`{key}`"] == F.col(kept), "left_semi")
    nameless = groups.where("id is null").select(F.col("node").alias(node))  # of null keys alone: those of the smallest node stay
    if not nameless.isEmpty():
        stay = stay.unionByName(df.where(df[f"`{key}`"].isNull()).withColumn(node, sketch["node"]).join(nameless, node, "left_semi").drop(node))
    return stay.dropDuplicates([key, text])
