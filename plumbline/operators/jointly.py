"""What models learn from a table beside what they learn from its source: trained on one and tested on the other, column by column, and on products of three."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.seeds import uniform
from plumbline.functions.stats import Z95
from plumbline.operators import binned
from plumbline.operators.sampling import split

TREES, DEPTH, HELD_OUT = 20, 4, 0.3
# Rows below which nothing is scored, and the least gain of a product of three.
LEAST_ROWS, LEAST_GAIN = 300, 0.002


def _known(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """The entity and columns of rows that have all of them."""
    return df.select(F.col(entity).alias("_e"), *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(columns)]).dropna()


def _held(seed: int):
    return uniform(seed, F.col("_e")) < HELD_OUT  # the rows that ``sampling.split`` holds out


def _bins(edges: dict[str, list[float]], name: str) -> dict[str, Column]:
    return {f"{name}{i}": binned.place(F.col(c), e) for i, (c, e) in enumerate(edges.items())}


def utility(real: DataFrame, made: DataFrame, entity: str, target: str, features: list[str], seed: int = 0) -> DataFrame:
    """(target, n, real, made, retained, cost, low, high): explained shares on the same real rows, of entities that neither model has seen.

    The cost of training on the made table is the difference; its interval comes from the
    differences of both models' squared errors row by row.  Nulls below ``LEAST_ROWS``
    rows on a side, or if the target doesn't vary.  Rows are counted by the bins of both
    models: what a row adds follows from its cell.
    """
    rows, other = (_known(df, entity, [target, *features]) for df in (real, made))
    one, two = binned.thresholds(split(rows, "_e", HELD_OUT, seed)[1], features), binned.thresholds(other, features)
    by, of = _bins(one, "_r"), _bins(two, "_m")
    counted = binned.cells(rows, {"_held": _held(seed), **by, **of}, [target])
    test, train, others = counted.where("_held"), counted.where("not _held"), binned.cells(other, of, [target])
    n, _, (v,) = binned.spread(test, 1)
    shape = "target string, n long, real double, made double, retained double, cost double, low double, high double"
    if min(n, *(binned.spread(x, 1)[0] for x in (train, others))) < LEAST_ROWS * HELD_OUT or not v:
        return real.sparkSession.createDataFrame([(target, n, None, None, None, None, None, None)], shape)
    scored = test
    for name, rows_of, names in (("_pr", train, list(by)), ("_pm", others, list(of))):
        scored = binned.fit(rows_of, names, 0, TREES, DEPTH, seed).setPredictionCol(name).transform(binned.assembled(scored, names)).drop("_x")
    gap = F.col("_pm") - F.col("_pr")
    cost = gap * (F.col("_pm") + F.col("_pr") - 2 * F.col("m0")) / v  # the mean of a cell's rows, whose deviation is 2 |gap| / v times the target's
    error = {p: binned.squared_error(scored, 0, p) / (n * v) for p in ("_pr", "_pm")}
    mean = scored.agg((F.sum(F.col("n") * cost) / n).alias("c")).first().c
    sd = F.sqrt(F.sum(F.col("n") * (cost - mean) * (cost - mean) + 4 * gap * gap / (v * v) * F.col("s0")) / n)
    out = scored.agg(F.lit(n).cast("long").alias("n"), F.lit(1 - error["_pr"]).alias("real"), F.lit(1 - error["_pm"]).alias("made"), F.lit(mean).alias("cost"), sd.alias("sd"))
    half = Z95 * F.col("sd") / F.sqrt("n")
    return out.select(F.lit(target).alias("target"), "n", *[F.round(c, 6).alias(c) for c in ("real", "made")], F.round(F.when(F.col("real") > 0, F.col("made") / F.col("real")), 6).alias("retained"), F.round("cost", 6).alias("cost"), F.round(F.col("cost") - half, 6).alias("low"), F.round(F.col("cost") + half, 6).alias("high"))


def predictability(real: DataFrame, made: DataFrame, entity: str, columns: list[str], seed: int = 0) -> DataFrame:
    """(column_name, real, made, drivers): how well each column is learned from the others in its own table, on entities held out, and the correlation of what drives it in both.

    A table's rows are counted once, for all of its models.
    """
    sides = []
    for df in (real, made):
        known = _known(df, entity, columns)
        by = _bins(binned.thresholds(split(known, "_e", HELD_OUT, seed)[1], columns), "_b")
        counted = binned.cells(known, {"_held": _held(seed), **by}, columns)
        test, train = counted.where("_held"), counted.where("not _held")
        sides.append((test, train, list(by), binned.spread(test, len(columns)), binned.spread(train, len(columns))[0]))
    rows = []
    for i, c in enumerate(columns):
        skills, drivers = [], []
        for test, train, by, (n, _, v), trained in sides:
            if not v[i] or trained < LEAST_ROWS * (1 - HELD_OUT):
                break
            others = [b for b in by if b != by[i]]
            model = binned.fit(train, others, i, TREES, DEPTH, seed)
            skills.append(1 - binned.squared_error(model.transform(binned.assembled(test, others)), i) / (n * v[i]))
            drivers.append(model.featureImportances.toArray())
        if len(skills) == 2:
            same = float(np.corrcoef(drivers)[0, 1]) if len(columns) > 2 and min(np.std(d) for d in drivers) > 0 else None
            rows.append((c, round(skills[0], 6), round(skills[1], 6), None if same is None else round(same, 6)))
    return real.sparkSession.createDataFrame(rows, "column_name string, real double, made double, drivers double")


def product_gain(df: DataFrame, child: str, trio: list[str]) -> float | None:
    """What the product of three standardised columns explains of a child beyond all three and their pairs' products: a table of sums is all that is gathered."""
    known = df.select(*[F.col(c).cast("double").alias(c) for c in (child, *trio)]).dropna()
    one = known.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate((child, *trio)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if one.n < LEAST_ROWS or not all(one[f"s{i}"] for i in range(4)):
        return None
    z = [(F.col(c) - one[f"m{i}"]) / one[f"s{i}"] for i, c in enumerate((child, *trio))]
    terms = [F.lit(1.0), *z[1:], *[a * b for a, b in combinations(z[1:], 2)], z[1] * z[2] * z[3], z[0]]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    sums = known.agg(*[F.avg(terms[i] * terms[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((len(terms), len(terms)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"p{i}_{j}"]

    def explained(k: int) -> float:
        beta = np.linalg.lstsq(gram[:k, :k], gram[:k, -1], rcond=None)[0]
        return float(beta @ gram[:k, -1])

    return explained(8) - explained(7)  # of a child of variance 1


def three_way(real: DataFrame, made: DataFrame, entity: str, columns: list[str], seed: int = 0) -> DataFrame:
    """(child, trio, real, made): for each column its three main drivers' product, where it explains something in the real table; greatest first."""
    trios = {}
    if len(columns) > 4:  # of three others all three are the main ones
        known = _known(real, entity, columns)
        by = _bins(binned.thresholds(known, columns), "_b")
        counted = binned.cells(known, by, columns)
    for at, c in enumerate(columns):
        others = [x for x in columns if x != c]
        if len(others) < 3:
            continue
        weights = binned.fit(counted, [b for i, b in enumerate(by) if i != at], at, TREES, DEPTH, seed).featureImportances.toArray() if len(others) > 3 else [0] * 3
        trios[c] = sorted(others[i] for i in sorted(range(len(others)), key=lambda i: (-weights[i], others[i]))[:3])
    rows = []
    for c, trio in trios.items():
        gain = product_gain(real, c, trio)
        if gain is not None and gain > LEAST_GAIN:
            again = product_gain(made, c, trio)
            rows.append((c, "/".join(trio), round(gain, 6), None if again is None else round(again, 6)))
    return real.sparkSession.createDataFrame(sorted(rows, key=lambda r: -r[2]), "child string, trio string, real double, made double")
