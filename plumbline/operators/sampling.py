"""Samples that depend on keys and a seed only, never on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.seeds import uniform
from plumbline.operators.ranks import smallest_by_hash


def stratified(df: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """``size`` rows with each stratum at its share, fractions going to the largest remainders (ties by name)."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    quota = counts.crossJoin(total).withColumn("_quota", F.lit(float(size)) * F.col("_n") / F.col("_total")).withColumn("_base", F.floor("_quota"))  # total: one row
    left = quota.agg((F.lit(size) - F.sum("_base")).alias("_left"))
    places = Window.orderBy(F.desc(F.col("_quota") - F.col("_base")), stratum)  # a row a stratum
    take = quota.withColumn("_place", F.row_number().over(places)).crossJoin(left).select(F.col(stratum).alias("_s"), (F.col("_base") + (F.col("_place") <= F.col("_left")).cast("int")).alias("_take"))
    return smallest_by_hash(df, stratum, key, seed, "_rn").join(take, F.col(stratum) == F.col("_s")).where("_rn <= _take").drop("_rn", "_s", "_take")


def split(df: DataFrame, entity: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two parts no entity is in both of."""
    u = uniform(seed, F.col(entity))
    return df.where(u < share), df.where(u >= share)
