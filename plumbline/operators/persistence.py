"""Series of entities that are as steady as was asked when they are measured again.

Steadiness has two parts: an entity's own level, seen in the intraclass correlation, and
drift from row to row, seen in the correlation of neighbours.  A latent normal series has
both: an anchor for each entity and an AR(1) around it.  What is asked for can't be used as
the anchor's weight: over a handful of rows an AR(1) doesn't average out, so its own mean
adds to what differs between entities.  ``solve_latent`` finds the weight and coefficient
that measure back as asked; ``calibrate`` does so for values that are made of the latent
series by whatever shape, by bisection on the correlation of generated rows, whose draws
are hashed and so the same in every trial.
"""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.seeds import normal
from plumbline.functions.stats import normal_cdf
from plumbline.operators.discovery import ar1
from plumbline.operators.dynamics import icc1, lag1

#: No series is steadier than this, and what is measured is rounded no finer than that.
MOST, CLOSE = 0.98, 1e-5
# Correlations below the first aren't asked to survive; at this share of the source's they have.
ASKED_FROM, KEPT_FROM = 0.2, 0.4


def mean_variance(rho: float, n: float) -> float:
    """Variance of the mean of ``n`` neighbours in an AR(1) of variance 1."""
    n = max(round(n), 1)
    if rho <= 0:
        return 1 / n
    # 1/n + 2/n**2 times the sum of (n - k) rho**k, summed in closed form
    if 1 - rho < 1e-9:
        return 1.0
    part = rho * (n * (1 - rho) - (1 - rho**n)) / (1 - rho) ** 2
    return 1 / n + 2 * part / n**2


def solve_latent(icc: float, lag: float, rows: float) -> tuple[float, float]:
    """(weight of the anchor, AR coefficient) of the series that measures back ``icc`` and ``lag`` over ``rows`` rows an entity.

    A mean over an entity's n rows has variance m = a + (1 - a) V(rho, n), of which mean
    squares make an intraclass correlation of (n m - 1) / (n - 1); neighbours correlate by
    a + (1 - a) rho.  For a given rho the latter gives a, so the former is one equation in
    rho, with one change of sign, found by halving.
    """
    icc, lag = (min(max(x, 0.0), MOST) for x in (icc, lag))

    def weight(rho: float) -> float:
        return min(max((lag - rho) / (1 - rho), 0.0), MOST)

    def measured(rho: float) -> float:
        a = weight(rho)
        mean = a + (1 - a) * mean_variance(rho, rows)
        return (rows * mean - 1) / (rows - 1) if rows > 1 else mean

    low, high = 0.0, lag  # from all anchor to all drift
    if measured(low) <= icc:
        return weight(low), low
    if measured(high) >= icc:
        return 0.0, lag
    while high - low > CLOSE / 100:
        mid = (low + high) / 2
        low, high = (mid, high) if measured(mid) > icc else (low, mid)
    return weight(low), low


def rows_per_entity(df: DataFrame, entity: str) -> float:
    return df.agg((F.count("*") / F.count_distinct(entity)).alias("n")).first().n or 1.0


def persistent(df: DataFrame, entity: str, order: list[str], anchor: float, rho: float, seed: int, into: str) -> DataFrame:
    """Adds a standard normal series: an anchor of each entity with a share of the variance, and an AR(1) with the rest."""
    series = ar1(df, entity, order, rho, seed).withColumnRenamed("x", "_drift")
    own = normal(seed, F.col(entity), "anchor")
    return series.withColumn(into, sqrt(anchor) * own + sqrt(1 - anchor) * F.col("_drift")).drop("_drift")


def persistent_uniform(df: DataFrame, entity: str, order: list[str], icc: float, lag: float, seed: int, into: str) -> DataFrame:
    """Adds a series in (0, 1) that leaves any marginal as it is, for it is even whatever the steadiness."""
    anchor, rho = solve_latent(icc, lag, rows_per_entity(df, entity))
    return persistent(df, entity, order, anchor, rho, seed, into).withColumn(into, normal_cdf(F.col(into)))


def steadiness(df: DataFrame, entity: str, order: list[str], value: str) -> tuple[float | None, float | None]:
    """(icc, lag 1) as measured; None where it can't be."""
    return icc1(df, entity, value).first().icc, lag1(df, entity, order, value).first().lag1


def calibrate(df: DataFrame, entity: str, order: list[str], shape: Callable[[Column], Column], icc: float, lag: float, seed: int, into: str, steps: int = 8, tolerance: float = 0.01) -> tuple[DataFrame, float, float | None]:
    """Adds values whose measured lag-1 correlation is ``lag``, the lag that was put in, and the one that came out.

    ``shape`` makes values of an even series (the marginal, and what the row's other
    columns add); it takes steadiness away, so more has to be put in, MOST at the most:
    if that falls short, the last number says so.
    """
    n = rows_per_entity(df, entity)

    def made(asked: float) -> DataFrame:
        anchor, rho = solve_latent(min(icc, asked), asked, n)
        return persistent(df, entity, order, anchor, rho, seed, "_even").withColumn(into, shape(normal_cdf(F.col("_even")))).drop("_even")

    low, high, asked, got = lag, MOST, lag, None
    for step in range(steps):
        got = lag1(made(asked), entity, order, into).first().lag1
        if got is None or abs(got - lag) <= tolerance:
            break
        if step == 0 and got > lag:
            low, high = 0.0, lag
        low, high = (asked, high) if got < lag else (low, asked)
        if step < steps - 1:
            asked = (low + high) / 2
    return made(asked), asked, got


def persistence_kept(source: DataFrame, made: DataFrame, entity: str, order: list[str], columns: list[str]) -> DataFrame:
    """(column_name, source, generated, kept): the lag-1 correlation of columns that had one, and whether enough of it is there."""
    out = None
    for c in columns:
        both = lag1(source, entity, order, c).select(F.col("lag1").alias("source")).crossJoin(lag1(made, entity, order, c).select(F.col("lag1").alias("generated")))  # a row each
        one = both.where(F.abs("source") >= ASKED_FROM).select(F.lit(c).alias("column_name"), "source", "generated", (F.abs("generated") >= KEPT_FROM * F.abs("source")).alias("kept")).where("generated is not null")
        out = one if out is None else out.union(one)
    return out
