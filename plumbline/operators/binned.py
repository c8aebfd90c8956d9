"""Boosted trees learned from counts: rows are counted by the bins that a tree can tell apart, and it is fitted on those cells, weighted by their rows.

Splits weigh means and counts only, and a tree says the same of all rows of a cell, so the
model is that of the rows, whose number no longer matters to it.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise
from math import isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.shared import written

BINS = 32  # a column's at most, as with Spark's trees
# Distinct values up to which each is looked at, and the parts of the rows' order that are otherwise; cells of a partition.
PARTS, CELLS = 4_096, 50_000


def thresholds(df: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Where a tree may split each column: the midpoints that Spark's trees choose, from all rows rather than a sample of them.

    Values are counted; where they are more than ``PARTS``, neighbours that begin in the
    same part of the rows' order go together, so a split is out by a part at most.
    """
    counts = written(df.select(*columns).unpivot([], columns, "c", "x").where("x is not null").groupBy("c", "x").agg(F.count("*").alias("n")), "values")
    sizes = {r.c: r for r in counts.groupBy("c").agg(F.count("*").alias("d"), F.sum("n").alias("n")).collect()}
    many = [c for c in columns if c in sizes and sizes[c].d > PARTS]
    parts = [counts.where(~F.col("c").isin(many)).select("c", F.col("x").alias("low"), F.col("x").alias("high"), "n")]
    if many:
        # values in order, range by range: what lies below a range is a number for each, and the rest is summed within it
        ranged = written(counts.where(F.col("c").isin(many)).repartitionByRange("c", "x").withColumn("p", F.spark_partition_id()), "ranges")
        below, upto = {}, dict.fromkeys(many, 0)
        for r in sorted(ranged.groupBy("c", "p").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.p):  # a row a column and range
            below[f"{r.c}/{r.p}"] = upto[r.c]
            upto[r.c] += r.n
        told = F.element_at(F.create_map(*[F.lit(v) for kv in below.items() for v in kv]), F.concat_ws("/", "c", "p"))
        whole = F.element_at(F.create_map(*[F.lit(v) for kv in upto.items() for v in kv]), F.col("c"))
        inside = F.sum("n").over(Window.partitionBy("c", "p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
        part = F.floor((told + inside - F.col("n")) * PARTS / whole)
        parts.append(ranged.withColumn("part", part).groupBy("c", "part").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("n")).drop("part"))
    held: dict[str, list] = {c: [] for c in columns}
    for r in reduce(DataFrame.union, parts).collect():  # PARTS rows a column at most
        held[r.c].append((r.low, r.high, r.n))
    return {c: _chosen(sorted(v)) for c, v in held.items()}


def _chosen(parts: list[tuple[float, float, int]]) -> list[float]:
    """Midpoints between neighbours: all, or those at which the rows so far come nearest to the next of ``BINS`` equal shares."""
    if len(parts) <= BINS:
        return [(a[1] + b[0]) / 2 for a, b in pairwise(parts)]
    share = sum(n for _, _, n in parts) / BINS
    out, upto, target = [], parts[0][2], share
    for a, b in pairwise(parts):
        before, upto = upto, upto + b[2]
        if abs(before - target) < abs(upto - target):
            out.append((a[1] + b[0]) / 2)
            target += share
    return out


def place(x: Column, edges: list[float], first: int = 1) -> Column:
    """A value's bin, from 1, by halving."""
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    return F.when(x <= edges[mid], place(x, edges[:mid], first)).otherwise(place(x, edges[mid + 1 :], first + mid + 1))


def cells(df: DataFrame, by: dict[str, Column], values: list[str]) -> DataFrame:
    """Written: rows by cell, ``n``, with the mean, the sum of squared deviations from it and the ends of each value (``m0``, ``s0``, ``low0``, ``high0``, ``m1``, ...)."""
    known = df.withColumns(by)
    each = [f for i, v in enumerate(values) for f in (F.avg(v).alias(f"m{i}"), (F.var_pop(v) * F.count(v)).alias(f"s{i}"), F.min(v).alias(f"low{i}"), F.max(v).alias(f"high{i}"))]
    return written(known.groupBy(*by).agg(F.count("*").alias("n"), *each), "cells")


def spread(held: DataFrame, values: int) -> tuple[int, list[float], list[float]]:
    """Rows of cells, and the mean and population variance of each value; exactly 0 for a constant."""
    one = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[(F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n")).alias(f"m{i}") for i in range(values)], *[(F.min(f"low{i}") < F.max(f"high{i}")).alias(f"v{i}") for i in range(values)]).first()
    if not one.n:
        return 0, [0.0] * values, [0.0] * values
    means = [one[f"m{i}"] for i in range(values)]
    two = held.agg(*[_squares(i, F.lit(m)).alias(f"q{i}") for i, m in enumerate(means)]).first()
    return one.n, means, [two[f"q{i}"] / one.n if one[f"v{i}"] else 0.0 for i in range(values)]


def _squares(i: int, guess: Column) -> Column:
    return F.sum(F.col(f"s{i}") + F.col("n") * (F.col(f"m{i}") - guess) * (F.col(f"m{i}") - guess))


def squared_error(scored: DataFrame, i: int, prediction: str = "prediction") -> float:
    """Sum of the rows' squared differences from what is said of their cell."""
    return scored.agg(_squares(i, F.col(prediction)).alias("e")).first().e


def assembled(held: DataFrame, bins: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=bins, outputCol="_x").transform(held)


def fit(held: DataFrame, bins: list[str], i: int, trees: int, depth: int, seed: int):
    """The model of value ``i`` by bins, fitted on cells; it reads ``assembled`` ones."""
    merged = written(held.groupBy(*bins).agg(F.sum("n").cast("double").alias("_n"), (F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n")).alias("_y")), "fit")
    k = merged.count()
    shaped = assembled(merged, bins).select("_x", "_y", "_n").coalesce(1 + k // CELLS)
    # so many bins that no cell is left out where Spark looks for splits: it samples above their square
    return GBTRegressor(featuresCol="_x", labelCol="_y", weightCol="_n", maxIter=trees, maxDepth=depth, maxBins=max(BINS, isqrt(k) + 1), seed=seed).fit(shaped)


def classify(held: DataFrame, bins: list[str], trees: int, depth: int, seed: int):
    """The model of a class by bins, fitted on cells with ``ones`` and ``zeros`` rows; both classes weigh the same, however many rows they have.  None where one is absent."""
    merged = written(held.groupBy(*bins).agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")), "fit")
    one = merged.agg(F.count("*").alias("k"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).first()
    if not one.ones or not one.zeros:
        return None
    half = (one.ones + one.zeros) / 2
    sides = F.array(*[F.struct(F.lit(y).alias("_y"), (F.col(c) * (half / one[c])).alias("_n")) for y, c in ((1.0, "ones"), (0.0, "zeros"))])
    rows = merged.select(*bins, F.inline(sides)).where("_n > 0")
    shaped = assembled(rows, bins).select("_x", "_y", "_n").coalesce(1 + 2 * one.k // CELLS)
    return GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_n", maxIter=trees, maxDepth=depth, maxBins=max(BINS + 1, isqrt(2 * one.k) + 1), seed=seed).fit(shaped)
