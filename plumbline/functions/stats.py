"""Closed-form statistics as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def safe(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is zero."""
    return numerator / F.nullif(denominator.cast("double"), F.lit(0.0))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Interval of a proportion; (0, 1) where nothing was counted."""
    p, n = safe(k.cast("double"), n), n.cast("double")
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return (
        F.when(n > 0, F.greatest(centre - half, F.lit(0.0))).otherwise(0.0),
        F.when(n > 0, F.least(centre + half, F.lit(1.0))).otherwise(1.0),
    )


def hanley(auc: Column, positives: Column, negatives: Column) -> Column:
    """Standard error of an area under the curve."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    spread = auc * (1 - auc) + (positives - 1) * (q1 - auc * auc) + (negatives - 1) * (q2 - auc * auc)
    return F.sqrt(F.greatest(spread, F.lit(0.0)) / (positives * negatives))


def required_n(p: Column, gap: Column, z: float = Z95) -> Column:
    """Cases that would settle a gap between a proportion and its bar; null for no gap."""
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.when(F.abs(gap) >= 1e-9, F.ceil(z * z * q * (1 - q) / (gap * gap)).cast("long"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, to 1e-7: a polynomial in 1 / (1 + p |z|) times the density."""
    # The approximation's published coefficients.
    p, coefficients = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + p * F.abs(z))
    power = F.lit(0.0)
    for c in reversed(coefficients):
        power = (power + c) * t
    beyond = F.exp(-z * z / 2) * 0.3989422804014327 * power
    return F.when(z > 0, 1 - beyond).otherwise(beyond)
