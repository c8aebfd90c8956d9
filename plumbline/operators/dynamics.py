"""What changes within an entity from row to row, and what differs between entities.

All of it is windows and sums partitioned by entity.  A statistic that cannot be had is
null with a reason, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import clamp, safe

MIN_PAIRS = 30


def last_observed(df: DataFrame, entity: str, order: list[str], value: str, into: str) -> DataFrame:
    """Adds the last non-null value before each row of the same entity, and the change since."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(f"{into}__prev", F.last(value, ignorenulls=True).over(w)).withColumn(f"{into}__delta", F.col(value) - F.col(f"{into}__prev"))


def _pairs(df: DataFrame, entity: str, order: list[str], value: str) -> DataFrame:
    """(x, p, has): each row's value, the one of the row before it, and whether there is such a row."""
    w = Window.partitionBy(entity).orderBy(*order)
    return df.select(F.col(value).alias("x"), F.lag(value).over(w).alias("p"), (F.row_number().over(w) > 1).alias("has"))


def lag1(df: DataFrame, entity: str, order: list[str], value: str) -> DataFrame:
    """Correlation of neighbouring rows of an entity that both have a value."""
    both = _pairs(df, entity, order, value).where("x is not null and p is not null")
    r = both.agg(F.count("*").alias("n_pairs"), F.corr("p", "x").alias("r"))
    return r.select("n_pairs", F.round(F.when(F.col("n_pairs") >= MIN_PAIRS, clamp(F.col("r"), -0.98, 0.98)), 6).alias("lag1"))


def missing_clustering(df: DataFrame, entity: str, order: list[str], value: str) -> DataFrame:
    """How much likelier a value is present after a present one than after an absent one."""
    p = _pairs(df, entity, order, value).where("has").select(F.col("x").isNotNull().cast("int").alias("now"), F.col("p").isNotNull().alias("before"))
    r = p.agg(
        F.count("*").alias("n_pairs"), F.count(F.when(F.col("before"), 1)).alias("n_present"), F.count(F.when(~F.col("before"), 1)).alias("n_absent"),
        F.avg(F.when(F.col("before"), F.col("now"))).alias("a"), F.avg(F.when(~F.col("before"), F.col("now"))).alias("b"),
    )
    enough = (F.col("n_pairs") >= MIN_PAIRS) & (F.col("n_present") >= 15) & (F.col("n_absent") >= 15)
    return r.select("n_pairs", "n_present", "n_absent", F.round(F.when(enough, clamp(F.col("a") - F.col("b"), 0.0, 0.98)).otherwise(0.0), 6).alias("clustering"))


def stickiness(df: DataFrame, entity: str, order: list[str], level: str) -> DataFrame:
    """How much oftener a level stays than chance would have it."""
    both = _pairs(df, entity, order, level).where("x is not null and p is not null")
    same = both.agg(F.count("*").alias("n_pairs"), F.avg((F.col("x") == F.col("p")).cast("double")).alias("stays"))
    levels = df.where(F.col(level).isNotNull()).groupBy(level).agg(F.count("*").alias("n"))
    chance = levels.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")).cast("double")).alias("chance"))
    out = same.crossJoin(chance)  # a row each
    return out.select("n_pairs", F.round("stays", 6).alias("stays"), F.round("chance", 6).alias("chance"), F.round(F.when(F.col("chance") >= 0.999, 0.0).otherwise((F.col("stays") - F.col("chance")) / (1 - F.col("chance"))), 6).alias("stickiness"))


def icc1(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Share of variance between entities, from mean squares, with unequal sizes allowed for; null with a reason if it isn't measurable."""
    per = df.where(F.col(value).isNotNull()).groupBy(entity).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("ss"))
    whole = per.agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.sum("ss").alias("ssw"), F.sum(F.col("n") * F.col("n")).cast("double").alias("n2"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nm2"))
    w = whole.select("n", "g", safe(F.col("nm2") - F.col("n") * F.col("mean") * F.col("mean"), F.col("g") - 1).alias("msb"), safe(F.col("ssw"), F.col("n") - F.col("g")).alias("msw"), safe(F.col("n") - safe(F.col("n2"), F.col("n")), F.col("g") - 1).alias("k0"))
    reason = F.when(F.col("n") < 20, "too_few_rows").when(F.col("g") < 3, "too_few_groups").when(F.col("n") <= F.col("g"), "one_row_each").when(F.col("k0") <= 1, "degenerate_group_size").when((F.col("msw") <= 0) & (F.col("msb") <= 0), "no_variance")  # fixed values: the reasons' names
    icc = F.when(F.col("msw") <= 0, F.when(F.col("msb") > 0, 0.98)).otherwise(clamp(safe(F.col("msb") - F.col("msw"), F.col("msb") + (F.col("k0") - 1) * F.col("msw")), 0.0, 0.98))
    return w.select("n", "g", F.round("k0", 6).alias("k0"), F.round(F.when(reason.isNull(), icc), 6).alias("icc"), reason.alias("reason"))


def within(lag: Column, icc: Column) -> Column:
    """The part of a lag correlation that is not just the entity's own level."""
    return clamp((lag - icc) / F.nullif(1 - icc, F.lit(0.0)), -0.98, 0.98)


def returned_within(df: DataFrame, entity: str, day: str, order: list[str], days: int) -> DataFrame:
    """Adds the gap to the entity's next dated row, whether it is within ``days``, and whether there is none."""
    dated = df.where(F.col(day).isNotNull())
    w = Window.partitionBy(entity).orderBy(day, *order)
    gap = F.datediff(F.lead(day).over(w), F.col(day))
    return dated.withColumn("days_to_next", gap).withColumn("returned", F.coalesce(F.col("days_to_next").between(0, days).cast("int"), F.lit(0))).withColumn("is_last", F.col("days_to_next").isNull().cast("int"))


def monotone_share(df: DataFrame, entity: str, order: list[str], candidate: str) -> DataFrame:
    """Share of entities down whose rows a candidate time never falls."""
    w = Window.partitionBy(entity).orderBy(*order)
    steps = df.select(F.col(entity).alias("e"), F.coalesce(F.col(candidate) >= F.lag(candidate).over(w), F.lit(True)).alias("ok"))
    return steps.groupBy("e").agg(F.bool_and("ok").alias("ok")).agg(F.count("*").alias("entities"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("monotone"))


def varies_within(df: DataFrame, entity: str, value: str) -> DataFrame:
    per = df.groupBy(entity).agg(F.count_distinct(value).alias("d"))
    return per.agg(F.count("*").alias("entities"), F.round(F.avg((F.col("d") > 1).cast("double")), 6).alias("varies_within"))


def within_visit(df: DataFrame, visit: str, concept: str, time: str, value: str) -> DataFrame:
    """For each concept: visits that repeat it, repeat it at other times, and show it move."""
    per = df.groupBy(visit, concept).agg(F.count("*").alias("n"), F.count_distinct(time).alias("times"), F.count_distinct(value).alias("vals"))
    return per.groupBy(concept).agg(F.count("*").alias("visits"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"), F.count(F.when(F.col("times") > 1, 1)).alias("timed"), F.count(F.when((F.col("times") > 1) & (F.col("vals") > 1), 1)).alias("moving"), F.round(F.median("n"), 6).alias("median_points"))
