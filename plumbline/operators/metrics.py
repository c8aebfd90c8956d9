"""Scores of predictions against labels, with intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import Z95, hanley, safe, wilson
from plumbline.operators.ranks import average_ranks, with_ranks


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney by average ranks; ties count half; null if one class is absent."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).alias("s"), (F.col(label) > 0).cast("int").alias("y"))
    return _mann_whitney(with_ranks(known, "s", "rank").agg(F.sum("y").alias("positives"), F.sum(1 - F.col("y")).alias("negatives"), F.sum(F.col("y") * F.col("rank")).alias("r")))


def counted_auroc(df: DataFrame, score: str, ones: str, zeros: str) -> DataFrame:
    """``auroc`` of rows that are counted by class for each score."""
    each = df.groupBy(F.col(score).alias("s")).agg(F.sum(ones).alias("y"), F.sum(zeros).alias("x"))
    ranks = average_ranks(each.withColumn("n", F.col("y") + F.col("x")), "s", weight="n").select(F.col("s").alias("v"), "rank")
    return _mann_whitney(each.join(ranks, F.col("s") == F.col("v")).agg(F.sum("y").alias("positives"), F.sum("x").alias("negatives"), F.sum(F.col("y") * F.col("rank")).alias("r")))


def _mann_whitney(r: DataFrame) -> DataFrame:
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    a = safe(F.col("r") - p * (p + 1) / 2, p * n)
    se = hanley(a, p, n)
    return r.select("positives", "negatives", F.round(a, 6).alias("auroc"), F.round(F.greatest(a - Z95 * se, F.lit(0.0)), 6).alias("low"), F.round(F.least(a + Z95 * se, F.lit(1.0)), 6).alias("high"))


def ordinal_c(df: DataFrame, score: str, level: str) -> DataFrame:
    """Chance that of two rows of different levels the higher has the higher score, from counts of (level, score)."""
    cells = df.where(F.col(score).isNotNull() & F.col(level).isNotNull()).groupBy(F.col(level).alias("l"), F.col(score).alias("s")).agg(F.count("*").alias("n"))
    classes = [r.l for r in cells.select("l").distinct().orderBy("l").limit(65).collect()]
    if len(classes) > 64:
        raise ValueError("ordinal_c: more than 64 levels")
    pair = F.explode(F.array(*[F.lit(c) for c in classes]))
    each = cells.withColumn("o", pair).where("o <> l").select(F.least("l", "o").alias("low"), F.greatest("l", "o").alias("top"), "s", "n", (F.col("l") > F.col("o")).cast("int").alias("y"))
    ranked = average_ranks(each, "s", ["low", "top"], "n").select(F.col("low").alias("a"), F.col("top").alias("b"), F.col("s").alias("v"), "rank")
    both = each.join(ranked, (F.col("low") == F.col("a")) & (F.col("top") == F.col("b")) & (F.col("s") == F.col("v")))
    per = both.groupBy("low", "top").agg(F.sum(F.col("n") * F.col("y")).cast("double").alias("p"), F.sum(F.col("n") * (1 - F.col("y"))).cast("double").alias("q"), F.sum(F.col("n") * F.col("y") * F.col("rank")).alias("r"))
    won = F.col("r") - F.col("p") * (F.col("p") + 1) / 2  # pairs of rows in order
    return per.agg(F.sum(F.col("p") * F.col("q")).cast("long").alias("n_pairs"), F.round(safe(F.sum(won), F.sum(F.col("p") * F.col("q"))), 5).alias("ordinal_c"))


def at_threshold(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    s, y = F.col(score) >= threshold, F.col(label) > 0
    one = df.agg(F.count(F.when(s & y, 1)).alias("tp"), F.count(F.when(s & ~y, 1)).alias("fp"), F.count(F.when(~s & y, 1)).alias("fn"), F.count(F.when(~s & ~y, 1)).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    low, high = wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return one.select("tp", "fp", "fn", "tn", F.round(safe(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"), F.round(safe(tp, tp + fp), 6).alias("precision"), F.round(safe(tp, tp + fn), 6).alias("recall"), F.round(safe(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), F.round(low, 6).alias("recall_low"), F.round(high, 6).alias("recall_high"))


def brier(df: DataFrame, p: str, label: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col(p) - F.col(label), 2)), 6).alias("brier"))


def regression(df: DataFrame, truth: str, signal: str, predicted: str) -> DataFrame:
    """R squared, RMSE and MAE, beside the best R squared that the signal allows."""
    e = F.col(truth) - F.col(predicted)
    one = df.agg(F.count("*").alias("n"), F.sum(e * e).alias("sse"), (F.var_pop(truth) * F.count("*")).alias("sst"), F.avg(F.abs(e)).alias("mae"), F.var_pop(signal).alias("vs"), F.var_pop(truth).alias("vt"))
    return one.select("n", F.round(1 - safe(F.col("sse"), F.col("sst")), 6).alias("r2"), F.round(F.sqrt(F.col("sse") / F.col("n")), 6).alias("rmse"), F.round("mae", 6).alias("mae"), F.round(F.least(safe(F.col("vs"), F.col("vt")), F.lit(1.0)), 6).alias("ceiling_r2"))
