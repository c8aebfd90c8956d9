"""What noise costs: counts released with Gaussian noise, items chosen above a raised floor, and the privacy that training steps spend.

Noise is a hash of a seed and the item, so that a release comes out the same wherever it is
made.  Whoever knows the seed can take the noise off again: it has to be kept as secret as
the data, and not be used for a second release.
"""

from __future__ import annotations

from math import exp, inf, lgamma, log, log1p, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.seeds import normal, uniform
from plumbline.operators.entities import laplace

ORDERS = range(2, 65)


def gaussian_scale(epsilon: float, delta: float, cap: int) -> float:
    """Deviation of the noise on counts to which an entity adds at most ``cap``: the classical bound by the square sum, which grows with the root of the cap and holds for an epsilon of 1 at most."""
    if cap < 1 or not 0 < delta < 1 or not 0 < epsilon <= 1:
        raise ValueError("cap at least 1, delta within 0 to 1, epsilon above 0 and 1 at most")
    return sqrt(cap) * sqrt(2 * log(1.25 / delta)) / epsilon


def capped_counts(df: DataFrame, entity: str, item: str, cap: int, seed: int) -> DataFrame:
    """(item, n): entities by item, of each entity ``cap`` items at most, chosen by a hash."""
    pairs = df.select(F.col(entity).alias("e"), F.col(item).alias("item")).dropna().distinct()
    first = Window.partitionBy("e").orderBy(uniform(seed, F.col("e"), F.col("item"), "cap"))
    return pairs.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= cap).groupBy("item").agg(F.count("*").alias("n"))


def gaussian_histogram(counts: DataFrame, epsilon: float, delta: float, cap: int, seed: int) -> DataFrame:
    """(item, noisy); ``seed`` has to be secret."""
    return counts.select("item", (F.col("n") + gaussian_scale(epsilon, delta, cap) * normal(seed, F.col("item"), "noise")).alias("noisy"))


def raised_floor(floor: float, epsilon: float, cap: int, tau: float = 1e-6) -> float:
    """The floor that a noisy count has to reach so that an item below ``floor`` passes with chance ``tau`` at most: the chosen set is a release too."""
    return floor + cap / epsilon * log(0.5 / tau) + cap


def select_above(counts: DataFrame, floor: float, epsilon: float, cap: int, seed: int, tau: float = 1e-6) -> DataFrame:
    """(item, noisy) of the items whose noisy count reaches the raised floor; ``seed`` has to be secret."""
    noisy: Column = F.col("n") + laplace(uniform(seed, F.col("item"), "noise"), cap / epsilon)
    return counts.select("item", noisy.alias("noisy")).where(F.col("noisy") >= raised_floor(floor, epsilon, cap, tau))


def renyi(q: float, sigma: float, order: int) -> float:
    """Rényi divergence of one step of the subsampled Gaussian, by the binomial bound for whole orders, summed in logarithms."""
    if q <= 0:
        return 0.0
    if q >= 1:
        return order / (2 * sigma * sigma)
    terms = [lgamma(order + 1) - lgamma(k + 1) - lgamma(order - k + 1) + (order - k) * log1p(-q) + k * log(q) + k * (k - 1) / (2 * sigma * sigma) for k in range(order + 1)]
    most = max(terms)
    return (most + log(sum(exp(t - most) for t in terms))) / (order - 1)


def spent(q: float, sigma: float, steps: int, delta: float = 1e-5) -> tuple[float, int]:
    """(epsilon, order): what so many steps spend, at the order that shows least."""
    return min((steps * renyi(q, sigma, a) + log(1 / delta) / (a - 1), a) for a in ORDERS)


def sigma_for(q: float, steps: int, epsilon: float, delta: float = 1e-5, low: float = 0.3, high: float = 400.0) -> float:
    """The least noise that spends ``epsilon`` at most; infinite if none up to ``high`` does."""
    if spent(q, high, steps, delta)[0] > epsilon:
        return inf
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if spent(q, mid, steps, delta)[0] > epsilon else (low, mid)
    return high
