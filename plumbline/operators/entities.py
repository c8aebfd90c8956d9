"""Aggregates that are safe to publish: support counts distinct entities, never rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.parse import tokens
from plumbline.functions.stats import safe
from plumbline.operators.ranks import exact_quantiles

K = 10
KNOTS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def safe_bounds(df: DataFrame, entity: str, value: str, k: int = K) -> DataFrame:
    """Means of the k smallest minima and the k largest maxima of entities; null below 2k entities."""
    return bounds_of(df.where(F.col(value).isNotNull()).groupBy(entity).agg(F.min(value).alias("low"), F.max(value).alias("high")), k)


def bounds_of(per: DataFrame, k: int = K) -> DataFrame:
    """``safe_bounds`` from the least and greatest value, ``low`` and ``high``, of each entity."""
    low = per.orderBy("low").limit(k).agg(F.avg("low").alias("low"))
    high = per.orderBy(F.desc("high")).limit(k).agg(F.avg("high").alias("high"))
    out = per.agg(F.count("*").alias("entities")).crossJoin(low).crossJoin(high)  # a row each
    good = (F.col("entities") >= 2 * k) & (F.col("high") > F.col("low"))
    return out.select("entities", F.round(F.when(good, F.col("low")), 6).alias("low"), F.round(F.when(good, F.col("high")), 6).alias("high"))


def levels(df: DataFrame, entity: str, level: str, k: int = K) -> DataFrame:
    """Levels held by k entities or more, with their share of what is kept."""
    per = df.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("level")).agg(F.count("*").alias("n_rows"), F.count_distinct(entity).alias("entities")).where(F.col("entities") >= k)
    total = per.agg(F.sum("n_rows").alias("total"))
    return per.crossJoin(total).select("level", "n_rows", "entities", F.round(safe(F.col("n_rows"), F.col("total")), 6).alias("share"))  # total: one row


def numeric_marginal(df: DataFrame, value: str) -> DataFrame:
    """(q, v): quantile knots, and of the whole the mean, deviation (population), integrality and share of zeros."""
    x = F.col(value).cast("double")
    knots = [F.struct(F.lit(q).alias("q"), F.lit(v).alias("v")) for q, v in zip(KNOTS, exact_quantiles(df, value, KNOTS), strict=False)]
    one = df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.bool_and(x == F.floor(x)).alias("integral"), F.avg((x == 0).cast("double")).alias("zeros"))
    return one.select(F.explode(F.array(*knots).cast("array<struct<q:double,v:double>>")).alias("k"), "mean", "sd", "integral", "zeros").select("k.q", F.round("k.v", 6).alias("v"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "integral", F.round("zeros", 6).alias("zeros"))


def vocabulary(df: DataFrame, entity: str, column: str, k: int = K, sep: str = ";") -> DataFrame:
    """Tokens of a set column held by k entities or more, and their share of rows where the set is known."""
    known = df.where(F.col(column).isNotNull())
    exploded = known.select(F.col(entity).alias("e"), F.explode(F.array_distinct(tokens(F.col(column), sep))).alias("token"))
    per = exploded.groupBy("token").agg(F.count("*").alias("n_rows"), F.count_distinct("e").alias("entities")).where(F.col("entities") >= k)
    return per.crossJoin(known.agg(F.count("*").alias("total"))).select("token", "n_rows", "entities", F.round(safe(F.col("n_rows"), F.col("total")), 6).alias("share"))  # total: one row


def cooccurrence(df: DataFrame, entity: str, row: str, column: str, k: int = K, sep: str = ";", min_rows: int = 30) -> DataFrame:
    """Ordered token pairs of one row: how much one lifts the other, and their phi."""
    held = df.select(F.col(row).alias("r"), F.col(entity).alias("e"), F.explode(F.array_distinct(tokens(F.col(column), sep))).alias("t"))
    # a row's own pairs, made within the row, the smaller first; counted by entity, then over entities, and told both ways
    pairs = df.select(F.col(entity).alias("e"), F.array_distinct(tokens(F.col(column), sep)).alias("ts")).select("e", F.explode("ts").alias("a"), "ts").select("e", "a", F.explode(F.filter("ts", lambda t: t > F.col("a"))).alias("b"))
    once = pairs.groupBy("e", "a", "b").agg(F.count("*").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("joint"), F.count("e").alias("entities")).where(F.col("entities") >= k)
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    joint = once.select(ways.alias("w"), "joint", "entities").select("w.a", "w.b", "joint", "entities")
    each = held.groupBy("t").agg(F.count("*").alias("n_t"))
    whole = df.agg(F.count("*").alias("n"))
    out = joint.join(each.select(F.col("t").alias("a"), F.col("n_t").alias("n_a")), "a").join(each.select(F.col("t").alias("b"), F.col("n_t").alias("n_b")), "b").crossJoin(whole).where(F.col("n_a") >= min_rows)  # whole: one row
    pa, pb, pj = (F.col(c) / F.col("n").cast("double") for c in ("n_a", "n_b", "joint"))
    phi = safe(pj - pa * pb, F.sqrt(pa * (1 - pa) * pb * (1 - pb)))
    return out.select("a", "b", "joint", "entities", F.round((F.col("joint") / F.col("n_a").cast("double")) / pb, 6).alias("lift"), F.round(phi, 6).alias("phi"))


def person_stats(df: DataFrame, entity: str, day: str, level: str, k: int = K) -> DataFrame:
    """What entities are like: rows, distinct levels and span in days, as means, medians and k-safe ends."""
    per = df.groupBy(entity).agg(F.count("*").alias("encounters"), F.count_distinct(level).alias("levels"), F.datediff(F.max(day), F.min(day)).alias("span_days"))
    parts = []
    for name in ("encounters", "levels", "span_days"):
        x = per.select(F.col(name).cast("double").alias("x"))
        one = x.agg(F.count("*").alias("entities"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.median("x"), 6).alias("median"), F.round(F.stddev_pop("x"), 6).alias("sd"))
        low = x.orderBy("x").limit(k).agg(F.round(F.avg("x"), 6).alias("low"))
        high = x.orderBy(F.desc("x")).limit(k).agg(F.round(F.avg("x"), 6).alias("high"))
        parts.append(one.crossJoin(low).crossJoin(high).select(F.lit(name).alias("measure"), "*"))  # a row each
    return reduce(DataFrame.union, parts)


def census(df: DataFrame, entity: str, columns: list[str], k: int = K) -> DataFrame:
    """For each column: distinct levels, those that k entities hold, and the share of rows they keep."""
    long = df.select(F.col(entity).alias("e"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["e"], columns, "column_name", "level").where("level is not null")
    per = long.groupBy("column_name", "level").agg(F.count("*").alias("n"), F.count_distinct("e").alias("entities"))
    out = per.groupBy("column_name").agg(F.count("*").alias("n_levels"), F.count(F.when(F.col("entities") >= k, 1)).alias("n_kept"), F.sum(F.when(F.col("entities") >= k, F.col("n")).otherwise(0)).alias("kept"), F.sum("n").alias("total"))
    share = F.round(safe(F.col("kept"), F.col("total")), 6)
    return out.select("column_name", "n_levels", "n_kept", share.alias("mass_kept"), F.when(share >= 0.9, "RICH").when(share >= 0.5, "WORKABLE").otherwise("SPARSE").alias("verdict"))


def laplace(u: Column, scale: float) -> Column:
    """A Laplace draw from a uniform one."""
    v = u - 0.5
    return -scale * F.signum(v) * F.log(1 - 2 * F.abs(v))


def dp_histogram(df: DataFrame, entity: str, level: str, order: list[Column], epsilon: float, cap: int, u) -> DataFrame:
    """Counts of levels, of each entity at most ``cap``, with Laplace noise of scale cap / epsilon; ``u(level)`` draws."""
    once = df.select(F.col(entity).alias("e"), F.col(level).alias("level"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    w = Window.partitionBy("e").orderBy(*[f"_o{i}" for i in range(len(order))])
    kept = once.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap)
    return kept.groupBy("level").agg(F.count("*").alias("n")).select("level", "n", F.round(F.col("n") + laplace(u(F.col("level")), cap / epsilon), 6).alias("noisy"))
