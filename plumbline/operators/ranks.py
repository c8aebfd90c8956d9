"""Ranks over whole tables without a window over all rows."""

from __future__ import annotations

from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRIPES = 256


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, value, n, rank): each distinct non-null value, its count and the average rank of its rows, within ``by``; ``weight``: rows that a row stands for.

    Values are counted first.  Then they are dealt to stripes by approximate quantiles,
    which only choose the stripes: a stripe's rows are ranked among themselves and
    shifted by the exact counts of the stripes below, a few hundred numbers for each
    ``by``.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    edges = counts.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(i / STRIPES) for i in range(1, STRIPES)]), F.lit(STRIPES * 4)).alias("edges"))
    if by:
        named = edges.select(*[F.col(c).alias(f"_e_{c}") for c in by], "edges")
        joined = counts.join(named, _same(by, "_e_")).select(*by, value, "n", "edges")
    else:
        joined = counts.crossJoin(F.broadcast(edges))  # one row of STRIPES numbers
    striped = joined.withColumn("stripe", _below("edges", F.col(value).cast("double"))).drop("edges")
    below = striped.groupBy(*by, "stripe").agg(F.sum("n").alias("size"))
    before = Window.partitionBy(*by).orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    below = below.withColumn("below", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    inside = Window.partitionBy(*by, "stripe").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = striped.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    keys = [*by, "stripe"]
    both = ranked.join(below.select(*[F.col(c).alias(f"_b_{c}") for c in keys], "below"), _same(keys, "_b_"))
    return both.select(*by, value, "n", (F.col("below") + F.col("inside") + (F.col("n") + 1) / 2).alias("rank"))


def _below(edges: str, x: Column) -> Column:
    """How many of STRIPES - 1 ascending edges are below ``x``, by halving: a row looks at eight of them, not at all."""
    steps = F.array(*[F.lit(STRIPES >> i) for i in range(1, STRIPES.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) < x, at + step).otherwise(at))


def _same(names: list[str], prefix: str) -> Column:
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in names])


def exact_quantiles(df: DataFrame, value: str, at: list[float]) -> list[float]:
    """Quantiles with linear interpolation, from the ranks of distinct values: no task holds them all.  Empty if there is no value."""
    x = df.select(F.col(value).cast("double").alias("x")).where("x is not null")
    n = x.count()
    if not n:
        return []
    places = [q * (n - 1) for q in at]
    wanted = F.array(*[F.lit(p) for p in sorted({f(h) for h in places for f in (floor, ceil)})])
    ranked = average_ranks(x, "x").select("x", (F.col("rank") - (F.col("n") + 1) / 2).alias("first"), (F.col("rank") + (F.col("n") - 3) / 2).alias("last"))
    held = ranked.select("x", F.explode(F.filter(wanted, lambda p: p.between(F.col("first"), F.col("last")))).alias("p"))
    found = {r.p: r.x for r in held.collect()}  # two rows a quantile at most
    return [found[floor(h)] + (h - floor(h)) * (found[ceil(h)] - found[floor(h)]) for h in places]  # exact where both are equal


def smallest_by_hash(df: DataFrame, by: str, key: str, seed: int, into: str) -> DataFrame:
    """Adds each row's place within ``by`` in the order of a hash of its key (52 bits of it)."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), 1, 13), 16, 10).cast("long")
    marked = df.withColumn("_h", h)
    places = average_ranks(marked.select(F.col(by).alias("_b"), "_h"), "_h", ["_b"]).select("_b", F.col("_h").alias("_g"), F.col("rank").alias(into))
    return marked.alias("m").join(places.alias("p"), F.col(f"m.{by}").eqNullSafe(F.col("p._b")) & (F.col("m._h") == F.col("p._g"))).select("m.*", into).drop("_h")


def stripe_edges(df: DataFrame, value: str) -> list[float]:
    """Approximate quantiles that deal rows to stripes, STRIPES - 1 of them; empty if there is no value."""
    return df.agg(F.percentile_approx(F.col(value).cast("double"), [i / STRIPES for i in range(1, STRIPES)], STRIPES * 4).alias("e")).first().e or []


def _striped(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    held = F.array(*[F.lit(e) for e in edges]).cast("array<double>")
    return df.withColumn("_edges", held).withColumn("_stripe", _below("_edges", F.col(value).cast("double"))).drop("_edges")


def _under(df: DataFrame, value: str, edges: list[float]) -> Column:
    """How many rows are in the stripes below ``_stripe``: a number a stripe is all that is gathered."""
    sizes = {r["_stripe"]: r.n for r in _striped(df.select(value), value, edges).groupBy("_stripe").agg(F.count("*").alias("n")).collect()}
    upto = [sum(sizes.get(i, 0) for i in range(s)) for s in range(STRIPES)]
    return F.get(F.array(*[F.lit(n).cast("long") for n in upto]), F.col("_stripe"))


def row_places(df: DataFrame, value: str, row: str, into: str) -> DataFrame:
    """Adds each row's place in the order of a value, from 1, equal values in the order of ``row``; no two rows share one.

    Rows of a stripe are numbered in one task, and shifted by the counts of the stripes
    below; so a value that many rows have wants something small and of its own added to each.
    """
    known = df.where(F.col(value).isNotNull())
    edges = stripe_edges(known, value)
    if not edges:
        return known.withColumn(into, F.lit(None).cast("long"))
    within = F.row_number().over(Window.partitionBy("_stripe").orderBy(value, row))
    return _striped(known, value, edges).withColumn("_at", within).withColumn(into, _under(known, value, edges) + F.col("_at")).drop("_stripe", "_at")


def with_ranks(df: DataFrame, value: str, into: str, base: DataFrame | None = None) -> DataFrame:
    """Adds the average rank of each row's value, which must not be null; ``base``: the same rows by a shorter way.

    Where no value fills a stripe, rows are dealt to stripes once and ranked there, without
    a join on values; else (an edge comes twice) ranks of distinct values are joined.
    """
    base = (df if base is None else base).select(value)
    edges = stripe_edges(base, value)
    if len(set(edges)) < STRIPES - 1:
        ranks = average_ranks(base.select(F.col(value).alias("_v")), "_v").select("_v", F.col("rank").alias(into))
        return df.join(ranks, F.col(value) == F.col("_v")).drop("_v")
    stripe = Window.partitionBy("_stripe").orderBy(value)
    first, last = F.rank().over(stripe), F.count("*").over(stripe)  # the frame ends with the value's last row
    ranked = _striped(df, value, edges).withColumns({"_first": first, "_last": last})
    return ranked.withColumn(into, _under(base, value, edges) + (F.col("_first") + F.col("_last")) / 2).drop("_stripe", "_first", "_last")


def standard_ranks(df: DataFrame, value: str, into: str) -> DataFrame:
    """Adds the average rank of each row's value, less the mean rank, over its deviation; 0 where there is no value or only one."""
    ranks = average_ranks(df.select(F.col(value).alias("_v")), "_v").select("_v", "n", "rank")
    one = ranks.agg((F.sum(F.col("n") * F.col("rank")) / F.sum("n")).alias("_m"), F.sqrt(F.sum(F.col("n") * F.col("rank") * F.col("rank")) / F.sum("n") - F.pow(F.sum(F.col("n") * F.col("rank")) / F.sum("n"), F.lit(2))).alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("rank") - F.col("_m")) / F.col("_s"))
    return df.join(ranks.crossJoin(F.broadcast(one)).select("_v", z.alias("_z")), F.col(value) == F.col("_v"), "left").withColumn(into, F.coalesce("_z", F.lit(0.0))).drop("_v", "_z")  # one: a row
