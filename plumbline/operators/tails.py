"""What a number's distribution may publish: knots, tails and presence that k entities stand behind, never one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ranks import average_ranks, exact_quantiles
from plumbline.sources.shared import written

K = 10
BANDS = 4
PRESENCE_BINS = 6
LEAST_SPREAD = 0.10


def k_knots(df: DataFrame, entity: str, value: str, row: list[str], at: list[float], k: int = K) -> DataFrame:
    """(q, v, raw): knots of a number that each rest on k entities; ``raw``: on the value itself.

    A value that k entities hold is published as it is.  Otherwise rows come in from the
    quantile's place outward, one below and one above in turn, until k entities are among
    them: an entity comes in with its nearest row, so the window ends with the k-th
    nearest entity.

    Places are exact and need no order over all rows: ranks of distinct values, and within
    a value by ``row``.  Only the values that reach into a window are looked at row by row;
    windows grow until each holds k entities or all rows.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(entity).alias("e"), *[F.col(c).alias(f"_r{i}") for i, c in enumerate(row)])
    shape = "q double, v double, raw boolean"
    ranks = written(average_ranks(known, "v").select(F.col("v").alias("x"), (F.col("rank") - (F.col("n") + 1) / 2).cast("long").alias("below"), "n"), "ranks")
    total = ranks.agg(F.sum("n").alias("n")).first().n
    if not total:
        return known.sparkSession.createDataFrame([], shape)
    places = {q: max(0, min(total - 1, round(q * (total - 1)))) for q in at}
    wanted = F.array(*[F.lit(p).cast("long") for p in sorted(set(places.values()))])
    inside = F.filter(wanted, lambda p: (p >= F.col("below")) & (p < F.col("below") + F.col("n")))
    raw, shown = {}, {}
    for r in ranks.select("x", F.round("x", 6).alias("shown"), F.explode(inside).alias("p")).collect():  # a row a place
        raw[r.p], shown[r.p] = r.x, r.shown
    some = sorted(set(raw.values()))
    holders = {r.v: r.m for r in known.where(F.col("v").isin(some)).groupBy("v").agg(F.count_distinct("e").alias("m")).collect()}  # a row a place at most
    means, left, reach = {}, {p for p in raw if holders[raw[p]] < k}, 64 * k
    while left:
        means |= _windows(known, ranks, sorted(left), reach, k, len(row), reach >= total)
        left, reach = left - set(means), reach * 16
    rows = [(float(q), shown[p] if holders[raw[p]] >= k else means[p], holders[raw[p]] >= k) for q, p in places.items()]
    return known.sparkSession.createDataFrame(rows, shape)


def _windows(known: DataFrame, ranks: DataFrame, places: list[int], reach: int, k: int, n_row: int, last: bool) -> dict[int, float]:
    """Means of the rows of each place's window, of windows that end within ``reach`` places of it, or all if this is the last try."""
    near = F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (F.col("below") <= p + reach) & (F.col("below") + F.col("n") > p - reach))
    met = ranks.where(F.size(near) > 0).select("x", "below")
    within = F.row_number().over(Window.partitionBy("v").orderBy(*[f"_r{i}" for i in range(n_row)]))
    placed = known.join(met, F.col("v") == F.col("x")).withColumn("p", F.col("below") + within - 1)
    each = F.explode(F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: F.abs(p - F.col("p")) <= reach))
    # the row at the place itself, then one below, one above, two below, ...
    turn = F.when(F.col("p") <= F.col("at"), 2 * (F.col("at") - F.col("p")) - (F.col("p") < F.col("at")).cast("long")).otherwise(2 * (F.col("p") - F.col("at")))
    rows = written(placed.withColumn("at", each).select("at", "v", "e", turn.alias("turn")), "windows")
    order = F.row_number().over(Window.partitionBy("at").orderBy("turn"))  # entities of a window of bounded reach
    ends = rows.groupBy("at", "e").agg(F.min("turn").alias("turn")).withColumn("i", order).where(F.col("i") <= k).groupBy("at").agg(F.max("turn").alias("last"), F.count("*").alias("m"))
    if not last:
        ends = ends.where(F.col("m") == k)
    one = rows.join(ends.select("at", "last"), "at").where("turn <= last").groupBy("at").agg(F.round(F.avg("v"), 6).alias("mean"))
    return {r["at"]: r["mean"] for r in one.collect()}  # a row a place


def _segment(df: DataFrame, entity: str, value: str, cut: float, upper: bool, bound: float | None) -> DataFrame:
    x = F.col(value).cast("double")
    held = F.least(x, F.lit(bound)) if upper else F.greatest(x, F.lit(bound))
    return df.where(x >= cut if upper else x <= cut).groupBy(F.col(entity).alias("e")).agg(F.avg(x if bound is None else held).alias("m"), F.count("*").alias("n"))


def tail(df: DataFrame, entity: str, value: str, cut: float, upper: bool = True, k: int = K, bound: float | None = None) -> DataFrame:
    """(entities, mean, sd) of the values beyond a cut, each entity once by its own mean; null below k entities.

    The deviation is that of the values held to ``bound``, since nothing beyond it is drawn.
    """
    plain = _segment(df, entity, value, cut, upper, None).agg(F.count("*").alias("entities"), F.avg("m").alias("mean"))
    held = _segment(df, entity, value, cut, upper, bound).agg(F.stddev_samp("m").alias("sd"))
    enough = F.col("entities") >= k
    return plain.crossJoin(held).select("entities", F.round(F.when(enough, F.col("mean")), 6).alias("mean"), F.round(F.when(enough & (F.col("sd") > 0), F.col("sd")), 6).alias("sd"))  # a row each


def tail_bands(df: DataFrame, entity: str, value: str, cut: float, cut_q: float, k: int = K, most: int = BANDS) -> DataFrame:
    """(q, v): knots within the top segment, each the mean of a band of k entities or more.

    Bands of k are cut from the top; the lowest takes what is left, and the top one is
    the published end itself and is left out.  Only the entities of the upper bands are
    ordered, k for each.
    """
    per = _segment(df, entity, value, cut, True, None)
    n = per.count()
    bands = min(most, n // k)
    if bands < 2:
        return df.sparkSession.createDataFrame([], "q double, v double")
    upper = per.orderBy(F.desc("m"), F.desc("e")).limit(k * (bands - 1))
    place = F.row_number().over(Window.orderBy(F.desc("m"), F.desc("e")))  # k * (bands - 1) rows
    banded = upper.withColumn("band", F.floor((place - 1) / k)).groupBy("band").agg(F.sum("n").alias("n"), F.avg("m").alias("v"), F.sum("m").alias("s"), F.count("*").alias("c"))
    above = banded.agg(F.sum("n").alias("rows"), F.sum("s").alias("s"), F.sum("c").alias("c"))
    whole = per.agg(F.sum("n").alias("all"), F.sum("m").alias("total"), F.count("*").alias("entities"))
    lowest = whole.crossJoin(above).select(F.lit(bands - 1).cast("long").alias("band"), (F.col("all") - F.col("rows")).alias("n"), ((F.col("total") - F.col("s")) / (F.col("entities") - F.col("c"))).alias("v"))
    every = banded.select("band", "n", "v").union(lowest).crossJoin(whole.select("all"))  # a row each, and a row a band
    upto = F.sum("n").over(Window.orderBy(F.desc("band")))
    placed = every.select("band", (cut_q + (1.0 - cut_q) * upto / F.col("all")).alias("q"), "v")
    return placed.where((F.col("band") > 0) & (F.col("q") > cut_q) & (F.col("q") < 1)).select(F.round("q", 6).alias("q"), F.round("v", 6).alias("v"))


def presence_model(df: DataFrame, entity: str, column: str, others: list[str], k: int = K, bins: int = PRESENCE_BINS, least: float = LEAST_SPREAD) -> DataFrame:
    """(driver, bin, entities, rate): how often a column has a value along the quantile bins of the other column that moves it most.

    No rows if a bin of every candidate has fewer than k entities or the rates differ by
    less than ``least``.  All candidates are binned in one pass.
    """
    def place(c: str, edges: list[float]) -> Column:
        return F.when(F.col(c).isNotNull(), F.aggregate(F.array(*[F.lit(float(e)) for e in edges]), F.lit(0), lambda n, e: n + (F.col(c).cast("double") > e).cast("int")))

    cuts = {c: sorted(set(exact_quantiles(df, c, [i / bins for i in range(1, bins)]))) for c in others}
    each = F.array(*[F.struct(F.lit(c).alias("driver"), place(c, e).alias("bin")) for c, e in cuts.items() if e])
    long = df.select(F.col(entity).alias("e"), F.col(column).isNotNull().cast("double").alias("has"), F.explode(each).alias("d")).where("d.bin is not null")
    rates = long.groupBy("d.driver", "d.bin").agg(F.count_distinct("e").alias("entities"), F.avg("has").alias("rate"))
    spread = rates.groupBy("driver").agg((F.max("rate") - F.min("rate")).alias("spread"), F.min("entities").alias("fewest")).where((F.col("fewest") >= k) & (F.col("spread") >= least))
    best = spread.orderBy(F.desc("spread"), "driver").limit(1).select("driver")
    return rates.join(F.broadcast(best), "driver", "left_semi").select("driver", F.col("bin").cast("long").alias("bin"), "entities", F.round("rate", 6).alias("rate"))  # best: one row
