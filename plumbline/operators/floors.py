"""What sampling alone would read: noise floors of distances, curves and cells, and verdicts that respect them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.seeds import uniform
from plumbline.functions.stats import safe

# Constants of the published noise laws and bars.
NOISE_C = 1.6
SURFACE_C = 2.3
KS_C = 1.63
KS_LEAST = 0.03
TOLERANCE = 0.05
TRACK_SD = 0.35
FLOOR_SPLITS = 5


def noise_floor(n: Column, m: Column) -> Column:
    """What a faithful table of m rows reads as total variation against one of n; null where either is empty."""
    return NOISE_C * F.sqrt(0.5 * (safe(F.lit(1.0), n) + safe(F.lit(1.0), m)))


def effective_bar(floor: Column, tolerance: float = TOLERANCE) -> Column:
    return F.greatest(F.lit(tolerance), 2 * floor)


def blame(grid_source: Column, grid_made: Column, tolerance: float = TOLERANCE) -> Column:
    """Whose fault a gap is: the published grid departs from the source, the table from the grid, or both."""
    source, made = grid_source > tolerance, grid_made > tolerance
    return F.when(source & made, "BOTH").when(source, "CONTRACT").when(made, "GENERATION").otherwise("CLEAR")


def surface_floor(n: Column, m: Column) -> Column:
    return SURFACE_C * F.sqrt(safe(F.lit(1.0), n) + safe(F.lit(1.0), m))


def ks_tolerance(n: Column, m: Column) -> Column:
    n, m = n.cast("double"), m.cast("double")
    return F.greatest(F.lit(KS_LEAST), KS_C * F.sqrt((n + m) / (n * m)))


def level_floors(one: DataFrame, two: DataFrame, level: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Total variation of a level column between two tables with the floor and bar of their sizes: a finding only beyond the bar, unreadable where the floor reaches the tolerance."""
    both = one.select(F.col(level).alias("level"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(two.select(F.col(level), F.lit(0), F.lit(1))).where("level is not null")
    cells = both.groupBy("level").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = cells.agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    out = cells.crossJoin(sums).groupBy("n", "m").agg((F.sum(F.abs(safe(F.col("a"), F.col("n")) - safe(F.col("b"), F.col("m")))) / 2).alias("tvd"))  # sums: one row
    floor = noise_floor(F.col("n"), F.col("m"))
    bar = effective_bar(floor, tolerance)
    verdict = F.when(floor >= tolerance, "UNREADABLE").when(F.col("tvd") > bar, "DEPARTS").otherwise("HOLDS")
    return out.select("n", "m", F.round("tvd", 6).alias("tvd"), F.round(floor, 6).alias("floor"), F.round(bar, 6).alias("bar"), verdict.alias("verdict"))


def judge_cells(one: DataFrame, two: DataFrame, cell: list[str], value: str, track: float = TRACK_SD) -> DataFrame:
    """Whether the cells' means agree where there are rows enough to say: each cell against its own noise, in deviations of the first table.

    (tracks, gap, floor, bar, cells): of the readable cells the worst, or null and the
    least floor if none is readable.
    """
    spread = one.agg(F.stddev_samp(value).alias("sd"))
    x, y = (df.where(F.col(value).isNotNull()).groupBy(*cell).agg(F.avg(value).alias(f"m{i}"), F.count("*").alias(f"n{i}")) for i, df in ((1, one), (2, two)))
    joined = x.join(y, cell).crossJoin(spread)  # spread: one row
    gap = F.abs(F.col("m1") - F.col("m2")) / F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0))
    floor = surface_floor(F.col("n1"), F.col("n2"))
    judged = joined.select(gap.alias("gap"), floor.alias("floor"), F.greatest(F.lit(track), 2 * floor).alias("bar"))
    readable = F.col("floor") < track
    worst = F.max_by(F.struct("gap", "floor", "bar"), F.when(readable, F.col("gap")))
    out = judged.agg(F.count_if(readable).alias("cells"), F.bool_or(F.when(readable, F.col("gap") > F.col("bar"))).alias("departs"), worst.alias("w"), F.min("floor").alias("least"))
    some = F.col("cells") > 0
    return out.select(F.when(some, ~F.col("departs")).alias("tracks"), F.round(F.when(some, F.col("w.gap")), 6).alias("gap"), F.round(F.when(some, F.col("w.floor")).otherwise(F.col("least")), 6).alias("floor"), F.round(F.when(some, F.col("w.bar")), 6).alias("bar"), "cells")


def curve_floor(df: DataFrame, entity: str, bin_: str, value: str, splits: int = FLOOR_SPLITS, seed: int = 0) -> DataFrame:
    """The gap that a curve's own halves read, by entity: the greatest difference of bin means in deviations, averaged over splits.

    Of bins that are levels.  A curve over a number, whose gap is read between places, has
    its floor from ``audit.shape_floor``, which is that computation itself.

    All splits are one pass: each row is in one half of every split.
    """
    known = df.where(F.col(value).isNotNull() & F.col(bin_).isNotNull())
    sides = F.array(*[F.struct(F.lit(s).alias("split"), (uniform(seed + s, F.col(entity), "half") < 0.5).alias("left")) for s in range(splits)])
    cells = known.select(F.col(bin_).alias("b"), F.col(value).cast("double").alias("y"), F.explode(sides).alias("s")).groupBy("b", "s.split").agg(F.avg(F.when(F.col("s.left"), F.col("y"))).alias("l"), F.avg(F.when(~F.col("s.left"), F.col("y"))).alias("r"))
    gaps = cells.groupBy("split").agg(F.max(F.abs(F.col("l") - F.col("r"))).alias("gap")).where("gap is not null")
    spread = known.agg(F.stddev_samp(F.col(value).cast("double")).alias("sd"))
    return gaps.agg(F.count("*").alias("splits"), F.avg("gap").alias("gap")).crossJoin(spread).select("splits", F.round(F.col("gap") / F.nullif("sd", F.lit(0.0)), 6).alias("floor"))  # a row each


def additive_departure(df: DataFrame, a: str, b: str, value: str, min_rows: int = 5) -> DataFrame:
    """How far cell means stray from the sum of both columns' own effects, as a share of the value's deviation."""
    known = df.where(F.col(value).isNotNull())
    y = F.col(value).cast("double")
    cells = known.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.avg(y).alias("m"), F.count("*").alias("n")).where(F.col("n") >= min_rows)
    ma, mb = (known.groupBy(F.col(c).alias(n)).agg(F.avg(y).alias(f"m{n}")) for c, n in ((a, "a"), (b, "b")))
    whole = known.agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"))
    out = cells.join(ma, "a").join(mb, "b").crossJoin(whole)  # whole: one row
    stray = F.abs(F.col("m") - (F.col("ma") + F.col("mb") - F.col("mean"))) / F.nullif("sd", F.lit(0.0))
    return out.agg(F.count("*").alias("cells"), F.round(F.max(stray), 6).alias("greatest"), F.round(F.sqrt(F.sum(F.col("n") * stray * stray) / F.sum("n")), 6).alias("departure"))


def evidence(source: Column, requested: Column) -> Column:
    """Entities of the source for each one asked for, one at most: beyond, a table repeats what it was learned from."""
    return F.least(F.lit(1.0), safe(source.cast("double"), requested))


def advise(source: int, sizes: list[int], floor: float = 0.5) -> Column:
    """(requested, ratio, verdict) for each size."""
    rows = [F.struct(F.lit(n).cast("long").alias("requested"), F.round(evidence(F.lit(source), F.lit(n)), 6).alias("ratio")) for n in sizes]
    return F.transform(F.array(*rows), lambda r: r.withField("verdict", F.when(r["ratio"] >= 1, "WITHIN").when(r["ratio"] >= floor, "STRETCHED").otherwise("BEYOND")))


def curve_shape(df: DataFrame, at: str, mean: str, spread: float, flat: float = 0.1, turn: float = 0.35) -> DataFrame:
    """A curve's shape by name: flat, rising, falling, or turning up or down between its ends; (shape, rise, dip, bump) in units of ``spread``."""
    points = df.agg(F.min_by(mean, at).alias("first"), F.max_by(mean, at).alias("last"), F.min(mean).alias("low"), F.max(mean).alias("high"))
    rise = (F.col("last") - F.col("first")) / spread
    dip = (F.least("first", "last") - F.col("low")) / spread
    bump = (F.col("high") - F.greatest("first", "last")) / spread
    shape = F.when((F.col("high") - F.col("low")) / spread < flat, "flat").when((dip >= turn) & (dip >= bump), "u-shaped").when(bump >= turn, "peaked").when(rise > 0, "rising").otherwise("falling")
    return points.select(shape.alias("shape"), F.round(rise, 6).alias("rise"), F.round(dip, 6).alias("dip"), F.round(bump, 6).alias("bump"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)
