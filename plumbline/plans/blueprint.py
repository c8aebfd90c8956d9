"""A table's published aggregates, and tables drawn from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import seeds
from plumbline.operators.entities import bounds_of
from plumbline.operators.entities import levels as level_table
from plumbline.operators.tails import k_knots
from plumbline.sources.shared import written

GRID = [0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


@dataclass
class Marginal:
    """Knots of a number's distribution, or levels and weights, and the share of rows that have a value."""

    coverage: float
    knots: list[tuple[float, float]] | None = None
    whole: bool = False
    levels: list[str] | None = None
    weights: list[float] | None = None


def fit(df: DataFrame, entity: str, numeric: list[str], levels: list[str], k: int = 10, most: int = 200) -> dict[str, Marginal]:
    """Marginals with nothing that fewer than k entities hold; a few numbers for each column.

    The ends of a number's grid are the means of the k smallest minima and k largest
    maxima of entities; each knot between them is a value that k entities hold, or the
    mean of the rows around its place that k entities are among.
    """
    out = {}
    if numeric:  # of all numbers at a time: entities are grouped once
        xs = [F.col(c).cast("double") for c in numeric]
        one = df.agg(*[f for i, x in enumerate(xs) for f in (F.avg(x.isNotNull().cast("double")).alias(f"p{i}"), F.bool_and(x == F.floor(x)).alias(f"w{i}"))]).first()
        per = written(df.groupBy(F.col(entity).alias("_e")).agg(*[f for i, x in enumerate(xs) for f in (F.min(x).alias(f"low{i}"), F.max(x).alias(f"high{i}"))]), "ends")
    for i, c in enumerate(numeric):
        ends = bounds_of(per.select(F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high")).where("low is not null"), k).first()
        if ends.low is None:
            continue  # too few entities to publish anything
        inner = {r.q: r.v for r in k_knots(df, entity, c, [entity], GRID[1:-1], k).collect()}
        values = [ends.low, *[min(max(inner[q], ends.low), ends.high) for q in GRID[1:-1]], ends.high]
        out[c] = Marginal(one[f"p{i}"], list(zip(GRID, values, strict=True)), bool(one[f"w{i}"]))
    for c in levels:
        rows = level_table(df, entity, c, k).orderBy(F.desc("n_rows"), "level").limit(most).collect()
        if rows:
            p = df.agg(F.avg(F.col(c).isNotNull().cast("double"))).first()[0]
            out[c] = Marginal(p, levels=[str(r.level) for r in rows], weights=[float(r.n_rows) for r in rows])
    return out


def draw(rows: DataFrame, row: str, marginals: dict[str, Marginal], seed: int) -> DataFrame:
    """Adds a column for each marginal; each cell depends on its row's key and column only."""
    made, names = {}, {c: f"_u_{c}" for c in marginals}
    # a hash is taken once for each cell, not at each knot that it is compared with
    rows = rows.withColumns({n: seeds.uniform(seed, F.col(row), c, "value") for c, n in names.items()})
    for c, m in marginals.items():
        u = F.col(names[c])
        if m.knots:
            x = seeds.quantile_draw(u, m.knots)
            x = F.bround(x).cast("double") if m.whole else x
        else:
            x = seeds.pick(m.levels, m.weights, u)
        made[c] = x if m.coverage >= 1 else F.when(seeds.uniform(seed, F.col(row), c, "present") < m.coverage, x)  # draws are below 1
    return rows.withColumns(made).drop(*names.values())


def sticky(df: DataFrame, entity: str, order: list[str], levels: list[str], weights: list[float], stay: float, seed: int, into: str) -> DataFrame:
    """A level that each row keeps from the one before with chance ``stay``, and draws anew otherwise."""
    key = [F.col(entity), *[F.col(o).cast("string") for o in order]]
    w = Window.partitionBy(entity).orderBy(*order)
    anew = (F.row_number().over(w) == 1) | (seeds.uniform(seed, *key, "stay") >= stay)
    fresh = F.when(anew, seeds.pick(levels, weights, seeds.uniform(seed, *key, "draw")))
    return df.withColumn("_fresh", fresh).withColumn(into, F.last("_fresh", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def token_set(row: Column, tokens: list[str], weights: list[float], size: Column, seed: int) -> Column:
    """``size`` tokens without repeats, likelier by weight: those of smallest -ln(u) / weight."""
    keys = F.array(*[F.struct((-F.log(seeds.uniform(seed, row, t)) / w).alias("k"), F.lit(t).alias("t")) for t, w in zip(tokens, weights, strict=True)])
    return F.transform(F.slice(F.array_sort(keys), F.lit(1), size), lambda x: x["t"])


def enforce(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Orderings a <= b put right by changing places, so that neither column's values change as a whole."""
    for a, b in pairs:
        swap = F.col(a) > F.col(b)
        df = df.withColumns({a: F.when(swap, F.col(b)).otherwise(F.col(a)), b: F.when(swap, F.col(a)).otherwise(F.col(b))})
    return df


def in_order(df: DataFrame, entity: str, order: list[str], value: str) -> DataFrame:
    """Each entity's values of a column put ascending down its rows."""
    rows = df.withColumn("_at", F.row_number().over(Window.partitionBy(entity).orderBy(*order)))
    sorted_ = df.select(F.col(entity).alias("_e"), F.col(value).alias("_v"), F.row_number().over(Window.partitionBy(entity).orderBy(F.col(value).asc_nulls_last(), *order)).alias("_k"))
    return rows.join(sorted_, (F.col(entity) == F.col("_e")) & (F.col("_at") == F.col("_k"))).withColumn(value, F.col("_v")).drop("_at", "_e", "_v", "_k")


def outcome(df: DataFrame, row: str, effects: dict[str, float], intercept: float, seed: int, into: str = "outcome") -> DataFrame:
    """Adds a logistic outcome of standardised columns, its true probability first."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in effects for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = F.lit(float(intercept))
    for c, beta in effects.items():
        z = z + beta * F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0))
    scored = df.crossJoin(stats).withColumn(f"{into}_p", 1 / (1 + F.exp(-z)))  # stats: one row
    return scored.withColumn(into, (seeds.uniform(seed, F.col(row), into) < F.col(f"{into}_p")).cast("int")).drop(*stats.columns)
