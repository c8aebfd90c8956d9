"""Grading of outside tools against planted truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import required_n, safe, wilson


def _long(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    return df.select("row_id", *[F.trim(F.regexp_replace(F.col(c), "\\s+", " ")).alias(c) for c in columns]).unpivot(["row_id"], columns, "column_name", name)


def cleaning(clean: DataFrame, dirty: DataFrame, cleaned: DataFrame, ledger: DataFrame, columns: list[str]) -> DataFrame:
    """For each op: corrupted cells and those a cleaner put right; under ``none``: sound cells and those it changed."""
    cells = _long(clean, columns, "truth").join(_long(cleaned, columns, "answer"), ["row_id", "column_name"]).join(ledger.select("row_id", "column_name", "op"), ["row_id", "column_name"], "left")
    right = F.col("truth").eqNullSafe(F.col("answer"))
    per = cells.groupBy(F.coalesce("op", F.lit("none")).alias("op")).agg(F.count("*").alias("cells"), F.count(F.when(right, 1)).alias("right"))
    low, high = wilson(F.col("right"), F.col("cells"))
    return per.select("op", "cells", "right", F.round(safe(F.col("right"), F.col("cells")), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def links(orphans: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """Precision and recall of flagged orphans against the planted ones (each ``key`` once)."""
    t, f = orphans.select(F.col(key).alias("k")).distinct(), flags.select(F.col(key).alias("j")).distinct()
    one = t.join(f, F.col("k") == F.col("j"), "full").agg(F.count("k").alias("planted"), F.count("j").alias("flagged"), F.count(F.when(F.col("k").isNotNull() & F.col("j").isNotNull(), 1)).alias("found"))
    return one.select("planted", "flagged", "found", F.round(safe(F.col("found"), F.col("planted")), 6).alias("recall"), F.round(safe(F.col("found"), F.col("flagged")), 6).alias("precision"))


def extraction(truth: DataFrame, claims: DataFrame) -> DataFrame:
    """For each category: planted elements (doc, category, needle) that a claim (doc, category, text) of it holds."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    t = truth.select("doc", "category", norm(F.col("needle")).alias("needle")).distinct()
    c = claims.select("doc", "category", norm(F.col("text")).alias("claim"))
    hit = t.join(c, ["doc", "category"], "left").groupBy("doc", "category", "needle").agg(F.max(F.coalesce(F.contains("claim", "needle"), F.lit(False))).alias("hit"))
    per = hit.groupBy("category").agg(F.count("*").alias("planted"), F.count(F.when(F.col("hit"), 1)).alias("found"))
    low, high = wilson(F.col("found"), F.col("planted"))
    return per.select("category", "planted", "found", F.round(safe(F.col("found"), F.col("planted")), 6).alias("recall"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def verdict(rates: DataFrame, k: str, n: str, bar: float) -> DataFrame:
    """Pass or fail by the point estimate; decisive if the whole interval is on one side of the bar, else how many cases would do."""
    p = safe(F.col(k), F.col(n))
    low, high = wilson(F.col(k), F.col(n))
    return rates.withColumn("passed", p >= bar).withColumn("decisive", (low >= bar) | (high < bar)).withColumn("n_to_resolve", F.when(~F.col("decisive"), required_n(p, p - bar)))
