"""Audits over whole tables: what k costs, which columns nothing explains, identities between columns, changes between runs, samples that can be drawn again."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.seeds import uniform
from plumbline.functions.stats import safe
from plumbline.operators.ranks import exact_quantiles

# Words that stand for true and false.
TRUE = ["true", "t", "yes", "y", "1"]
FALSE = ["false", "f", "no", "n", "0"]


def price_of_k(df: DataFrame, entity: str, level: str, ks: list[int]) -> DataFrame:
    """(k, levels, kept_levels, kept_rows): what is left of a level column where a level needs k entities, for several k in one pass."""
    per = df.where(F.col(level).isNotNull()).groupBy(level).agg(F.count("*").alias("n"), F.count_distinct(entity).alias("e"))
    one = per.agg(F.count("*").alias("levels"), F.sum("n").alias("rows"), *[c for k in ks for c in (F.count_if(F.col("e") >= k).alias(f"l{k}"), F.sum(F.when(F.col("e") >= k, F.col("n")).otherwise(0)).alias(f"r{k}"))])
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("kept_levels"), F.round(safe(F.col(f"r{k}"), F.col("rows")), 6).alias("kept_rows")) for k in ks])
    return one.select("levels", F.explode(each).alias("r")).select("r.k", "levels", "r.kept_levels", "r.kept_rows")


def unexplained(df: DataFrame, columns: list[str], bar: float = 0.1) -> DataFrame:
    """(column_name, strongest): numbers whose correlation with every other stays below the bar, all pairs from one pass."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.abs(F.corr(F.col(a).cast("double"), F.col(b).cast("double"))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    strongest = [F.struct(F.lit(c).alias("column_name"), F.greatest(*[F.coalesce(f"c{i}", F.lit(0.0)) for i, p in enumerate(pairs) if c in p], F.lit(0.0)).alias("strongest")) for c in columns]
    return one.select(F.explode(F.array(*strongest)).alias("r")).select("r.column_name", F.round("r.strongest", 6).alias("strongest")).where(F.col("r.strongest") < bar)


def identities(df: DataFrame, columns: list[str], tolerance: float = 0.01) -> DataFrame:
    """(identity, residual): sums and differences of two columns that a third one is, up to ``tolerance`` of its deviation; all triples from one pass.

    A sum a + b = c and its difference c - b = a are the same identity and given once.
    """
    cases = [(c, a, b, F.col(a) + F.col(b)) for c in columns for a, b in combinations([x for x in columns if x != c], 2)]
    one = df.agg(*[f.alias(f"{n}{i}") for i, (c, _, _, made) in enumerate(cases) for n, f in (("r", F.stddev_pop(F.col(c) - made)), ("s", F.stddev_pop(c)))])
    rows = F.array(*[F.struct(F.lit(f"{c} = {a} + {b}").alias("identity"), safe(F.col(f"r{i}"), F.col(f"s{i}")).alias("residual")) for i, (c, a, b, _) in enumerate(cases)])
    return one.select(F.explode(rows).alias("r")).where(F.col("r.residual") < tolerance).select("r.identity", F.round("r.residual", 6).alias("residual"))


def run_difference(before: DataFrame, after: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """(keys, before, after, change) of measures that two runs don't share or that differ by ``least`` or more."""
    one = before.select(*keys, F.col(value).alias("before"))
    two = after.select(*keys, F.col(value).alias("after"))
    both = one.join(two, keys, "full")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.abs(F.col("after") - F.col("before")) >= least, "moved")
    return both.withColumn("change", change).where("change is not null")


def seeded_sample(df: DataFrame, row: str, n: int, seed: int) -> DataFrame:
    """The n rows whose hashes are smallest: the same ones however the table is split or sorted; a top-k in each task."""
    return df.withColumn("_u", uniform(seed, F.col(row), "sample")).orderBy("_u", row).limit(n).drop("_u")


def balanced(df: DataFrame, row: str, label: str, seed: int) -> DataFrame:
    """As many rows of each label as the rarest has, in expectation, by hash."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    least = sizes.agg(F.min("_n").alias("_least"))
    kept = df.join(sizes.crossJoin(least), label)  # least: one row
    return kept.where(uniform(seed, F.col(row), "balance") < F.col("_least") / F.col("_n")).drop("_n", "_least")


def cut_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Inner edges of equal shares, without repeats: what binning learns of a number."""
    return sorted(set(exact_quantiles(df, value, [i / bins for i in range(1, bins)])))


def bin_of(value: Column, edges: list[float]) -> Column:
    """The number of edges below a value; null for null."""
    return F.when(value.isNotNull(), F.aggregate(F.array(*[F.lit(float(e)) for e in edges]), F.lit(0), lambda n, e: n + (value > e).cast("int")))


def grams(df: DataFrame, key: str, text: str, n: int, least: int) -> DataFrame:
    """(gram, docs): runs of n words, in lower case, and the texts that have them, for those in ``least`` texts or more."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")
    starts = F.filter(F.transform(words, lambda w, i: F.array_join(F.slice(words, i + 1, n), " ")), lambda g: F.size(F.split(g, " ")) == n)
    return df.select(F.col(key).alias("k"), F.explode(F.array_distinct(starts)).alias("gram")).groupBy("gram").agg(F.count_distinct("k").alias("docs")).where(F.col("docs") >= least)


def clean_flag(c: Column) -> Column:
    """True or false of the words that mean so; null for others."""
    word = F.lower(F.trim(c))
    return F.when(word.isin(TRUE), True).when(word.isin(FALSE), False)


def clean_day(c: Column, formats: list[str]) -> Column:
    """The day by the first format that reads it."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(c), F.lit(f))) for f in formats])


def shape_gap(one: DataFrame, two: DataFrame, at: str, value: str, edges: list[float], least: int = 5) -> DataFrame:
    """(points, gap): how far a table's curve strays from a source's, in deviations, at the source's points within the table's range.

    Curves are means by bin; the table's is read at the source's mean places by straight
    lines between its own points.  Null below three points on either side.
    """
    def curve(df: DataFrame) -> DataFrame:
        known = df.where(F.col(at).isNotNull() & F.col(value).isNotNull())
        return known.groupBy(bin_of(F.col(at), edges).alias("b")).agg(F.avg(at).alias("x"), F.avg(value).alias("y"), F.count("*").alias("n")).where(F.col("n") >= least)

    path = curve(two).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("p"))  # a point a bin
    spread = one.agg(F.stddev_samp(value).alias("sd"))
    points = curve(one).crossJoin(path).crossJoin(spread)  # a row each
    left = F.element_at(F.filter("p", lambda q: q["x"] <= F.col("x")), -1)
    right = F.get(F.filter("p", lambda q: q["x"] >= F.col("x")), F.lit(0))
    there = F.when(right["x"] == left["x"], left["y"]).otherwise(left["y"] + (F.col("x") - left["x"]) / (right["x"] - left["x"]) * (right["y"] - left["y"]))
    inside = (F.size(F.filter("p", lambda q: q["x"] <= F.col("x"))) > 0) & right.isNotNull()
    gaps = points.select(F.size("p").alias("m"), F.when(inside, F.abs(there - F.col("y")) / F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0))).alias("g"))
    return gaps.agg(F.count("*").alias("points"), F.max("g").alias("g"), F.max("m").alias("m")).select("points", F.round(F.when((F.col("points") >= 3) & (F.col("m") >= 3), F.col("g")), 6).alias("gap"))


def shape_floor(df: DataFrame, entity: str, at: str, value: str, edges: list[float], splits: int = 5, seed: int = 0, least: int = 5) -> DataFrame:
    """(splits, floor): the gap that a faithful table would show: ``shape_gap`` itself between halves of the entities, averaged over splits; null where no split has a gap."""
    known = df.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    gaps = None
    for i in range(splits):
        left = uniform(seed + i, F.col(entity), "half") < 0.5
        one = shape_gap(known.where(left), known.where(~left), at, value, edges, least).select("gap")
        gaps = one if gaps is None else gaps.union(one)
    return gaps.agg(F.count("gap").alias("splits"), F.round(F.avg("gap"), 6).alias("floor"))
