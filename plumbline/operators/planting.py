"""Outcomes planted at a wanted prevalence and recovered, and tables drawn from a Gaussian copula."""

from __future__ import annotations

from math import exp
from statistics import NormalDist

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.seeds import normal, uniform
from plumbline.operators.fidelity import spearman
from plumbline.operators.ranks import exact_quantiles, with_ranks
from plumbline.sources.shared import written

CELLS = 4_096
#: Quantiles that a copula keeps of each column, and the normal scores that stand for its ends.
GRID = [0.0, 0.01, *[i / 20 for i in range(1, 20)], 0.99, 1.0]
FAR = 3.5


def _standard(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    one = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: F.coalesce((F.col(c) - one[f"m_{c}"]) / one[f"s_{c}"], F.lit(0.0)) if one[f"s_{c}"] else F.lit(0.0) for c in columns}


def intercept(df: DataFrame, z: Column, prevalence: float) -> float:
    """What to add to ``z`` for a mean chance of ``prevalence``: bisected over counts in a bounded number of cells."""
    ends = df.agg(F.min(z).alias("a"), F.max(z).alias("b")).first()
    if ends.a is None:
        return 0.0
    width = (ends.b - ends.a) / CELLS or 1.0
    cell = F.least(F.floor((z - ends.a) / width), F.lit(CELLS - 1))
    cells = df.select(z.alias("z"), cell.alias("cell")).groupBy("cell").agg(F.avg("z").alias("z"), F.count("*").alias("n")).collect()
    total, low, high = sum(r.n for r in cells), -50.0, 50.0
    for _ in range(60):
        mid = (low + high) / 2
        mean = sum(r.n / (1 + exp(-max(-50.0, min(50.0, r.z + mid)))) for r in cells) / total
        low, high = (mid, high) if mean < prevalence else (low, mid)
    return (low + high) / 2


def plant(df: DataFrame, row: str, effects: dict[str, float], prevalence: float, seed: int, into: str = "outcome") -> DataFrame:
    """Adds a logistic outcome of standardised columns at the wanted prevalence, with its true chance."""
    z = F.lit(0.0)
    for c, x in _standard(df, list(effects)).items():
        z = z + effects[c] * x
    scored = df.withColumn(f"{into}_p", 1 / (1 + F.exp(-(z + intercept(df, z, prevalence)))))
    return scored.withColumn(into, (uniform(seed, F.col(row), into) < F.col(f"{into}_p")).cast("int"))


def recovered(df: DataFrame, effects: dict[str, float], label: str = "outcome") -> DataFrame:
    """(name, requested, recovered): the effects that a logistic fit finds again."""
    shaped = VectorAssembler(inputCols=list(effects), outputCol="features").transform(df.select(F.col(label).cast("double").alias("y"), *[x.alias(c) for c, x in _standard(df, list(effects)).items()]))
    fitted = LogisticRegression(featuresCol="features", labelCol="y", maxIter=50, tol=1e-9).fit(shaped)
    rows = [(c, float(v), float(w)) for (c, v), w in zip(effects.items(), fitted.coefficients, strict=True)]
    return df.sparkSession.createDataFrame(rows, "name string, requested double, recovered double")


def rank_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pair, n, rho) of all pairs, each over the rows that have both columns.

    Columns without nulls share their rows, so each is ranked once and their pairs are one
    aggregate; a pair with a column that has gaps is ranked within its own rows; a pair
    with a column of nulls alone has no rows and no correlation.
    """
    one = df.agg(F.count("*").alias("rows"), *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    whole = [i for i in range(len(columns)) if one[f"n{i}"] == one.rows]
    out = df.sparkSession.createDataFrame([(f"{columns[j]}/{columns[i]}", 0, None) for i in range(len(columns)) for j in range(i) if not (one[f"n{i}"] and one[f"n{j}"])], "pair string, n long, rho double")
    if len(whole) > 1 and one.rows:
        out = out.union(_complete(df.select(*[F.col(columns[i]).cast("double").alias(f"_c{i}") for i in whole]), whole, columns))
    for i in range(len(columns)):
        for j in range(i):
            if one[f"n{i}"] and one[f"n{j}"] and not (i in whole and j in whole):
                pair = df.select(F.col(columns[j]).cast("double").alias("_a"), F.col(columns[i]).cast("double").alias("_b"))
                out = out.union(spearman(pair, "_a", "_b").select(F.lit(f"{columns[j]}/{columns[i]}"), "n", "rho"))
    return out


def _complete(known: DataFrame, at: list[int], columns: list[str]) -> DataFrame:
    ranked = known
    for i in at:
        ranked = with_ranks(ranked, f"_c{i}", f"_r{i}", known).drop(f"_c{i}")
    pairs = [(i, j) for i in at for j in at if j < i]
    one = ranked.agg(F.count("*").alias("n"), *[F.corr(f"_r{i}", f"_r{j}").alias(f"r{i}_{j}") for i, j in pairs])
    each = F.array(*[F.struct(F.lit(f"{columns[j]}/{columns[i]}").alias("pair"), F.round(f"r{i}_{j}", 6).alias("rho")) for i, j in pairs])
    return one.select("n", F.explode(each).alias("r")).select("r.pair", "n", "r.rho")


def cholesky(corr: np.ndarray) -> np.ndarray:
    """The lower root of a correlation matrix, brought back to one first if rounding has left it without a root."""
    try:
        return np.linalg.cholesky(corr)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(corr)
        near = vectors @ np.diag(np.clip(values, 1e-9, None)) @ vectors.T
        return np.linalg.cholesky(near / np.sqrt(np.outer(np.diag(near), np.diag(near))))


def copula(source: DataFrame, columns: list[str], rows: DataFrame, row: str, seed: int) -> DataFrame:
    """Adds numbers with the source's rank correlations and quantiles; what is learned is a few numbers a column and pair.

    The drawn table is written once, so that what reads it doesn't draw again.
    """
    n = len(columns)
    rho = {r.pair: r.rho or 0.0 for r in rank_correlations(source, columns).collect()}
    corr = np.eye(n)
    for i in range(n):
        for j in range(i):
            corr[i, j] = corr[j, i] = 2 * np.sin(np.pi * rho[f"{columns[j]}/{columns[i]}"] / 6)  # of the normals behind those ranks
    root = cholesky(corr)
    shocks = rows.withColumns({f"_e{j}": normal(seed, F.col(row), f"copula{j}") for j in range(n)})
    scores = {f"_z{i}": sum((float(root[i, j]) * F.col(f"_e{j}") for j in range(1, i + 1)), float(root[i, 0]) * F.col("_e0")) for i in range(n)}
    drawn = shocks.select(*rows.columns, *[F.least(F.greatest(z, F.lit(-FAR)), F.lit(FAR)).alias(k) for k, z in scores.items()])
    places = [-FAR, *[NormalDist().inv_cdf(q) for q in GRID[1:-1]], FAR]
    made = {}
    for i, c in enumerate(columns):
        at = exact_quantiles(source, c, GRID)
        made[c] = _between(F.col(f"_z{i}"), places, at) if at else F.lit(None).cast("double")
    return written(drawn.withColumns(made).drop(*scores), "copula")


def _between(z: Column, places: list[float], values: list[float]) -> Column:
    """The value at ``z``, linear between places; looked up in arrays, for nested cases of many knots are slow to plan."""
    p, v = (F.array(*[F.lit(float(x)) for x in xs]) for xs in (places, values))
    # the place is looked for once: the lambda only gives it a name
    at = F.transform(F.array(z), lambda x: F.least(F.size(F.filter(p, lambda y: y <= x)), F.lit(len(places) - 1)) - 1)
    value = F.transform(at, lambda i: F.get(v, i) + (z - F.get(p, i)) / (F.get(p, i + 1) - F.get(p, i)) * (F.get(v, i + 1) - F.get(v, i)))
    return F.get(value, F.lit(0))
