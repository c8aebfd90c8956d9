"""Releases with a stated loss: bounds by the exponential mechanism, and a Gaussian from noised moments.

The unit is the entity: each is one point, its rows' mean.  Ranges and the norm to which
points are cut are given, never taken from the data.  Noise is a hash of a seed: whoever
knows the seed can take it off again, so it has to be as secret as the data and used once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.seeds import normal, uniform
from plumbline.operators.discovery import dp_quantile
from plumbline.operators.noise import gaussian_scale


def points(df: DataFrame, entity: str, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(entity, columns): each entity's mean of each column, put from the given range to -1 to 1 and cut to it; entities without a value in one of them are left out."""
    scaled = lambda c, low, high: F.when(F.avg(c).isNotNull(), F.greatest(F.least((F.avg(c) - low) * 2 / (high - low) - 1, F.lit(1.0)), F.lit(-1.0)))
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(*[scaled(c, low, high).alias(c) for c, (low, high) in ranges.items()]).dropna()


def private_bounds(df: DataFrame, entity: str, value: str, low: float, high: float, epsilon: float, seed: int, at: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(n, low, high): two quantiles of the entities' means, each with half of the loss, in their order."""
    per = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.avg(value).alias("_m"))
    draws = df.sparkSession.range(1).select(*[uniform(seed, value, i).alias(f"u{i}") for i in range(2)]).first()
    a, b = (dp_quantile(per, "_m", q, low, high, epsilon / 2, u) for q, u in zip(at, draws, strict=True))
    both = a.crossJoin(b.select(F.col("quantile").alias("other")))  # a row each
    return both.select("n", F.least("quantile", "other").alias("low"), F.greatest("quantile", "other").alias("high"))


@dataclass
class Gaussian:
    """A released normal distribution over columns put to -1 to 1; ``raised``: directions whose variance noise had left below the floor."""

    ranges: dict[str, tuple[float, float]]
    mean: np.ndarray
    cov: np.ndarray
    n: int
    raised: int


def moments(df: DataFrame, entity: str, ranges: dict[str, tuple[float, float]], clip: float, epsilon: float, delta: float, seed: int) -> DataFrame:
    """(n, i, j, sum): noised sums of the points (i = -1) and of products of their coordinates (i <= j), each half of the loss.

    Points are cut to the norm ``clip``, so one of them moves the sums by ``clip`` and the
    products by its square.  ``n`` is the number of points, which is published as it is.
    """
    names = list(ranges)
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in names[1:]), F.col(names[0]) * F.col(names[0])))
    cut = points(df, entity, ranges).withColumn("_cut", F.when(norm > clip, clip / norm).otherwise(1.0)).select(*[(F.col(c) * F.col("_cut")).alias(c) for c in names])
    half = gaussian_scale(epsilon / 2, delta / 2, 1)
    wanted = [(-1, j) for j in range(len(names))] + [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(F.col(names[j]) if i < 0 else F.col(names[i]) * F.col(names[j])) for i, j in wanted]
    one = cut.agg(F.count("*").alias("n"), *[s.alias(f"s{k}") for k, s in enumerate(sums)])
    noise = [half * (clip if i < 0 else clip * clip) * normal(seed, "moments", i, j) for i, j in wanted]
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(f"s{k}") + noise[k]).alias("sum")) for k, (i, j) in enumerate(wanted)])
    return one.select("n", F.explode(each).alias("r")).select("n", "r.*")


def private_gaussian(df: DataFrame, entity: str, ranges: dict[str, tuple[float, float]], clip: float, epsilon: float, delta: float, seed: int) -> Gaussian:
    """The normal distribution of those moments; a covariance that noise has left without a root is brought to the nearest one with its least variances raised to a floor."""
    d, rows = len(ranges), moments(df, entity, ranges, clip, epsilon, delta, seed).collect()  # columns squared
    n = rows[0].n
    if n < 2:
        raise ValueError("two points at least")
    mean, gram = np.zeros(d), np.zeros((d, d))
    for r in rows:
        if r.i < 0:
            mean[r.j] = r.sum / n
        else:
            gram[r.i, r.j] = gram[r.j, r.i] = r.sum / n
    values, vectors = np.linalg.eigh(gram - np.outer(mean, mean))
    floor = 1e-6 * max(float(np.abs(values).max()), 1.0)
    return Gaussian(ranges, mean, (vectors * np.maximum(values, floor)) @ vectors.T, n, int((values < floor).sum()))


def draw(rows: DataFrame, row: str, model: Gaussian, seed: int) -> DataFrame:
    """Adds a column for each of the model's, by hashed draws, in the columns' own units and ranges."""
    values, vectors = np.linalg.eigh(model.cov)
    root = vectors * np.sqrt(np.maximum(values, 0.0))
    shocks = rows.withColumns({f"_e{j}": normal(seed, F.col(row), f"private{j}") for j in range(len(model.mean))})
    made = {}
    for i, (c, (low, high)) in enumerate(model.ranges.items()):
        z = sum((float(root[i, j]) * F.col(f"_e{j}") for j in range(len(model.mean))), F.lit(float(model.mean[i])))
        made[c] = low + (F.greatest(F.least(z, F.lit(1.0)), F.lit(-1.0)) + 1) * (high - low) / 2
    return shocks.withColumns(made).drop(*[f"_e{j}" for j in range(len(model.mean))])
