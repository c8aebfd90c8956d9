"""Networks of level columns: which earlier columns a column depends on, its distribution under each of their values, draws and likelihoods.

Every column is text by then (numbers binned); a missing value is a level of its own.
Nothing that fewer than ``k`` entities hold is kept: a setting of the parents with less
support falls back to fewer parents, and in the end to the column's own distribution.
Tables have a row for each setting, bounded by the columns' levels, not by the rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.seeds import uniform
from plumbline.operators.metrics import auroc
from plumbline.sources.shared import written
from plumbline.sources.sinks import load_run, write_run

#: A missing value's level.
MISSING = "(missing)"
#: A column of more levels is refused: bin it first.
MAX_LEVELS = 64
#: Chance of a level that a setting never showed.
LEAST_P = 1e-9


@dataclass
class Net:
    """``parents`` by column, in an order in which parents come first; ``tables`` by column, those of most parents first."""

    parents: dict[str, list[str]]
    tables: dict[str, list[DataFrame]] = field(default_factory=dict)


def levels_of(df: DataFrame, columns: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in columns]


def critical(alpha: float, dof: float) -> float:
    """Upper quantile of chi squared, by Wilson and Hilferty."""
    if dof <= 0:
        return float("inf")
    a = 2 / (9 * dof)
    return dof * (1 - a + NormalDist().inv_cdf(1 - alpha) * a**0.5) ** 3


def _gains(counts: DataFrame, child: str, parents: list[str], candidates: list[str]) -> DataFrame:
    """(name, information, dof, n): what each candidate says of the child within the strata of its parents, from counts ``_w`` of settings; one pass for all."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("y")) for c in candidates]))
    z = F.array(*[F.col(p) for p in parents]) if parents else F.array().cast("array<string>")
    cells = counts.select(F.col(child).alias("x"), z.alias("z"), "_w", each.alias("e")).groupBy("e.name", "z", "x", "e.y").agg(F.sum("_w").alias("n"))
    of = lambda *keys: F.sum("n").over(Window.partitionBy("name", "z", *keys))  # noqa: E731 - over at most MAX_LEVELS squared cells
    parts = cells.withColumns({"nx": of("x"), "ny": of("y"), "nz": of()})
    g = F.sum(F.col("n") * F.log(F.col("n") * F.col("nz") / (F.col("nx") * F.col("ny")).cast("double")))
    strata = parts.groupBy("name", "z").agg(g.alias("g"), F.sum("n").alias("n"), ((F.count_distinct("x") - 1) * (F.count_distinct("y") - 1)).alias("dof"))
    return strata.groupBy("name").agg((F.sum("g") / F.sum("n")).alias("information"), F.sum("dof").alias("dof"), F.sum("n").alias("n"))


def search(df: DataFrame, entity: str, columns: list[str], max_parents: int = 3, alpha: float = 0.01) -> dict[str, list[str]]:
    """Parents of each column among those before it: the one that says most is added as long as a G test over entities, not rows, is passed."""
    rows = df.select(F.col(entity).alias("_e"), *levels_of(df, columns))
    sizes = rows.agg(F.count("*").alias("_n"), F.count_distinct("_e").alias("_m"), *[F.count_distinct(c).alias(c) for c in columns]).first()
    if wide := [c for c in columns if sizes[c] > MAX_LEVELS]:
        raise ValueError(f"more than {MAX_LEVELS} levels: {', '.join(wide)}")
    counts = written(rows.groupBy(*columns).agg(F.count("*").alias("_w")), "counts")  # rows are read once, whatever the number of tests
    found: dict[str, list[str]] = {}
    for i, child in enumerate(columns):
        own: list[str] = []
        room = sizes["_n"] / max(1, sizes[child])  # rows for each cell of the table to be
        while len(own) < max_parents:
            left = [c for c in columns[:i] if c not in own and 0 < sizes[c] <= room]
            if not left:
                break
            best = max(_gains(counts, child, own, left).collect(), key=lambda r: (r.information, r.name))  # a row a candidate
            if 2 * sizes["_m"] * best.information < critical(alpha / len(left), best.dof):
                break
            own.append(best.name)
            room /= sizes[best.name]
        found[child] = own
    return found


def _dist(cells: DataFrame, by: list[str], p: Column) -> DataFrame:
    """(by, dist): levels with their chances and running sums, in order of level."""
    w = Window.partitionBy(*by).orderBy("_x")  # a level's row each
    rows = cells.withColumn("_p", p).withColumn("_c", F.sum("_p").over(w))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("_x").alias("x"), F.col("_p").alias("p"), F.col("_c").alias("c")))).alias("dist"))


def table(df: DataFrame, entity: str, child: str, parents: list[str], k: int = 10) -> list[DataFrame]:
    """The child's distribution by all parents, by ever fewer of them (the plain mean over the settings that agree), and by none."""
    rows = df.select(F.col(entity).alias("_e"), *levels_of(df, [*parents, child])).withColumnRenamed(child, "_x")
    cells = rows.groupBy(*parents, "_x").agg(F.count("*").alias("_n"))
    whole = _dist(cells.groupBy("_x").agg(F.sum("_n").alias("_n")).withColumn("_all", F.lit(0)), ["_all"], F.col("_n") / F.sum("_n").over(Window.partitionBy("_all")))
    if not parents:
        return [whole.select("dist")]
    held = rows.groupBy(*parents).agg(F.count_distinct("_e").alias("_m")).where(F.col("_m") >= k).drop("_m")
    shares = cells.join(held, parents).withColumn("_p", F.col("_n") / F.sum("_n").over(Window.partitionBy(*parents)))
    shares = written(shares.select(*parents, "_x", "_p"), "shares")
    out = [_dist(shares, parents, F.col("_p"))]
    for j in range(len(parents) - 1, 0, -1):
        some = parents[:j]
        settings = shares.select(*parents).distinct().groupBy(*some).agg(F.count("*").alias("_k"))
        out.append(_dist(shares.groupBy(*some, "_x").agg(F.sum("_p").alias("_s")).join(settings, some), some, F.col("_s") / F.col("_k")))
    return [*out, whole.select("dist")]


def fit(df: DataFrame, entity: str, parents: dict[str, list[str]], k: int = 10) -> Net:
    """The tables of a given structure; they are written to the shared folder, for each is read again by every draw."""
    return Net(parents, {c: [written(t, "table") for t in table(df, entity, c, own, k)] for c, own in parents.items()})


def learn(df: DataFrame, entity: str, columns: list[str], k: int = 10, max_parents: int = 3, alpha: float = 0.01) -> Net:
    return fit(df, entity, search(df, entity, columns, max_parents, alpha), k)


def look_up(df: DataFrame, net: Net, child: str, into: str) -> DataFrame:
    """Adds the child's distribution under the row's own parents, which are levels already."""
    own, names = net.parents[child], []
    for j, t in zip(range(len(own), 0, -1), net.tables[child], strict=False):
        names.append(f"_d{j}")
        df = df.join(t.withColumnRenamed("dist", names[-1]), own[:j], "left")
    df = df.join(net.tables[child][-1].withColumnRenamed("dist", "_d0"), F.lit(True), "left")  # one row, or none if nothing was learned
    return df.withColumn(into, F.coalesce(*names, "_d0")).drop(*names, "_d0")


def draw(rows: DataFrame, row: str, net: Net, seed: int) -> DataFrame:
    """Adds a column for each of the net's; each cell depends on its row's key and its parents' cells only."""
    made = rows
    for child in net.parents:
        u = uniform(seed, F.col(row), child, "net")
        made = look_up(made, net, child, "_dist")
        # the outer lambda names the draw, so that a hash is taken for each row, not for each level
        hit = F.get(F.transform(F.array(u), lambda v: F.filter("_dist", lambda d: d["c"] >= v)), F.lit(0))
        made = made.withColumn(child, F.coalesce(F.get(hit, F.lit(0))["x"], F.element_at("_dist", -1)["x"])).drop("_dist")
    return made.withColumns({c: F.when(F.col(c) != MISSING, F.col(c)) for c in net.parents})


def log_likelihood(df: DataFrame, net: Net, into: str = "log_likelihood") -> DataFrame:
    """Adds the sum of the logarithms of each column's chance given its parents."""
    names = list(net.parents)
    made = df.select(*[c for c in df.columns if c not in names], *levels_of(df, names)).withColumn(into, F.lit(0.0))
    for child in names:
        made = look_up(made, net, child, "_dist")
        p = F.get(F.filter("_dist", lambda d: d["x"] == F.col(child)), F.lit(0))["p"]
        made = made.withColumn(into, F.col(into) + F.log(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(LEAST_P)))).drop("_dist")
    return made


def membership(net: Net, members: DataFrame, others: DataFrame) -> DataFrame:
    """How well the likelihood tells those the net was learned from, with the verdict on it."""
    both = members.withColumn("_y", F.lit(1)).unionByName(others.withColumn("_y", F.lit(0)))
    one = auroc(log_likelihood(both, net, "_s"), "_s", "_y")
    return one.withColumn("verdict", F.when(F.col("auroc") < 0.6, "PASS").when(F.col("auroc") < 0.7, "MARGINAL").otherwise("FAIL"))


def _retold(t: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """A table whose chances are weighed anew; ``weight`` is a column of _x and _p (and _p0, the chance under no parent, if it is there)."""
    at = by or ["_all"]
    cells = t if by else t.withColumn("_all", F.lit(0))
    return _dist(cells.withColumn("_w", weight), at, F.col("_w") / F.sum("_w").over(Window.partitionBy(*at))).select(*by, "dist")


def _cells(t: DataFrame) -> tuple[DataFrame, list[str]]:
    by = [c for c in t.columns if c != "dist"]
    return t.select(*by, F.explode("dist").alias("_d")).select(*by, F.col("_d.x").alias("_x"), F.col("_d.p").alias("_p")), by


def amplify(net: Net, child: str, gain: float) -> Net:
    """The same network with a child that follows its parents more (gain above 1) or less: chances move from those under no parent by that power."""
    alone = _cells(net.tables[child][-1])[0].select("_x", F.col("_p").alias("_p0"))
    tables = []
    for t in net.tables[child]:
        cells, by = _cells(t)
        tables.append(_retold(cells.join(alone, "_x"), by, F.col("_p0") * F.pow(F.col("_p") / F.col("_p0"), gain)) if by else t)
    return Net(net.parents, {**net.tables, child: tables})


def set_marginal(net: Net, child: str, wanted: dict[str, float]) -> Net:
    """The same network with levels of a child as likely as wanted where it has no parents, and by the same factors under each setting."""
    alone = {r["_x"]: r["_p"] for r in _cells(net.tables[child][-1])[0].collect()}  # a row a level
    factor = F.coalesce(*[F.when(F.col("_x") == x, F.lit(float(w / alone[x]))) for x, w in wanted.items() if alone.get(x)], F.lit(1.0))
    return Net(net.parents, {**net.tables, child: [_retold(*_cells(t), F.col("_p") * factor) for t in net.tables[child]]})


def save(net: Net, folder: str) -> None:
    """The tables as a run with its manifest, the structure beside it as JSON."""
    write_run({f"{c}-{i}": t for c, ts in net.tables.items() for i, t in enumerate(ts)}, f"{folder}/tables")
    spark = next(iter(net.tables.values()))[0].sparkSession
    spark.createDataFrame([(json.dumps(list(net.parents.items())),)], "value string").coalesce(1).write.text(f"{folder}/net")


def load(spark: SparkSession, folder: str) -> Net:
    """What ``save`` wrote; refused if a table isn't what was written."""
    parents = dict(json.loads(spark.read.text(f"{folder}/net").first().value))
    tables = load_run(spark, f"{folder}/tables")
    return Net(parents, {c: [tables[f"{c}-{i}"] for i in range(len(own) + 1)] for c, own in parents.items()})
