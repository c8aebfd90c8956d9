"""What a release gives away about those in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import safe
from plumbline.sources.shared import written

# Shapes of identifiers in text.
SHAPES = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "url": r"https?://[^\s]+",
    "ip": r"\b(\d{1,3}\.){3}\d{1,3}\b",
    "phone": r"\(\d{3}\)\s?\d{3}-\d{4}|\b\d{3}-\d{3}-\d{4}\b",
}


#: What a text must hold for a shape to be looked for at all: most texts are then never searched.
HINTS = {"email": "@", "url": "://", "ip": ".", "ssn": "-", "phone": "-"}


def shapes(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """For each group and shape of identifier: texts that hold one, and how many there are.  A text is searched once a shape."""
    c = F.coalesce(F.col(text), F.lit(""))
    found = df.select(*by, *[F.when(F.contains(c, F.lit(HINTS[k])), F.regexp_count(c, F.lit(p))).otherwise(0).alias(f"_{k}") for k, p in SHAPES.items()])
    cells = [F.struct(F.lit(k).alias("kind"), F.count_if(F.col(f"_{k}") > 0).alias("texts"), F.sum(f"_{k}").cast("long").alias("matches")) for k in SHAPES]
    return found.groupBy(*by).agg(F.count("*").alias("n"), F.array(*cells).alias("x")).select(*by, "n", F.explode("x").alias("x")).select(*by, "x.kind", "n", "x.texts", "x.matches")


def redact(c: Column) -> Column:
    """The text with identifiers named by their kind instead."""
    return reduce(lambda t, kv: F.when(F.contains(t, F.lit(HINTS[kv[0]])), F.regexp_replace(t, kv[1], f"[{kv[0]}]")).otherwise(t), SHAPES.items(), c)


def generalise(df: DataFrame, date: str | None = None, age: str | None = None, zip_code: str | None = None) -> DataFrame:
    """Dates to years, ages above 90 to 90, ZIP codes to three digits."""
    if date:
        df = df.withColumn(date, F.year(date))
    if age:
        df = df.withColumn(age, F.least(F.col(age), F.lit(90)))
    return df.withColumn(zip_code, F.substring(zip_code, 1, 3)) if zip_code else df


def linkage(members: DataFrame, others: DataFrame, released: DataFrame, quasi: list[str], sensitive: str, least: int = 5) -> DataFrame:
    """Error, in standard deviations, of guessing a sensitive number from the release's mean over equal quasi-identifiers; for those in it and for others."""
    groups = released.groupBy(*quasi).agg(F.avg(sensitive).alias("_mean"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    both = members.select(*quasi, sensitive, F.lit("member").alias("arm")).union(others.select(*quasi, sensitive, F.lit("other").alias("arm")))
    sd = both.agg(F.stddev_pop(sensitive).alias("_sd"))
    errors = both.join(groups, quasi).crossJoin(sd)  # sd: one row
    return errors.groupBy("arm").agg(F.count("*").alias("scored"), F.round(F.avg(safe(F.abs(F.col("_mean") - F.col(sensitive)), F.col("_sd"))), 6).alias("error"))


#: Pairs a query that are looked at one by one in the end, levels at most, and how much a bound may be off by rounding.
LEAF, LEVELS, SLACK = 32, 40, 1e-9


def nearest(queries: DataFrame, key: str, targets: DataFrame, numeric: dict[str, float]) -> DataFrame:
    """For each key the distance to the nearest target over scaled columns; null where a column is null or there is no target.

    Targets are put on grids, each half as wide as the one before.  A place (queries of one
    place are one) goes down with the cells that may hold its nearest target: those whose
    box begins no further away than the nearest box ends.  So a place far from all targets
    meets those that face it, not all of them.  It ends when what is left is a few targets
    a place; these are measured one by one.
    """
    names = [f"_x{i}" for i in range(len(numeric))]
    scaled = [(F.col(c).cast("double") / s).alias(n) for n, (c, s) in zip(names, numeric.items(), strict=True)]
    points = written(targets.select(*scaled).dropna().distinct(), "points")
    rows = queries.select(F.col(key).alias("_k"), *scaled)
    ends = points.agg(F.count("*").alias("n"), *[f(x).alias(f"{k}{x}") for x in names for k, f in (("a", F.min), ("b", F.max))]).first()
    if not ends.n:
        return rows.groupBy(F.col("_k").alias(key)).agg(F.lit(None).cast("double").alias("distance"))
    wide = max(ends[f"b{x}"] - ends[f"a{x}"] for x in names) or 1.0
    cell = lambda level: [F.floor((F.col(x) - ends[f"a{x}"]) / (wide / 2**level)).alias(f"_c{i}") for i, x in enumerate(names)]
    cells = [f"_c{i}" for i in range(len(names))]
    places = written(rows.select(*names).dropna().distinct(), "places")
    total = places.count()
    met = places.withColumns({c: F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")) for c in cells})  # a target at the far end is in cell 1
    for level in range(1, LEVELS):
        grid = points.select(*cell(level), *names).groupBy(*cells).agg(F.count("*").alias("_n"), *[f(x).alias(f"{k}{x}") for x in names for k, f in (("_a", F.min), ("_b", F.max))])
        above = grid.withColumns({f"_p{i}": F.floor(F.col(c) / 2) for i, c in enumerate(cells)})
        held = met.select(*names, *[F.col(c).alias(f"_p{i}") for i, c in enumerate(cells)]).join(above, [f"_p{i}" for i in range(len(names))])
        near = [F.greatest(F.col(f"_a{x}") - F.col(x), F.col(x) - F.col(f"_b{x}"), F.lit(0.0)) for x in names]
        far = [F.greatest(F.abs(F.col(x) - F.col(f"_a{x}")), F.abs(F.col(x) - F.col(f"_b{x}"))) for x in names]
        length = lambda xs: F.sqrt(sum((x * x for x in xs[1:]), xs[0] * xs[0]))
        bounded = held.select(*names, *cells, "_n", length(near).alias("_low"), length(far).alias("_high"))
        least = bounded.groupBy(*names).agg(F.min("_high").alias("_most"))
        met = written(bounded.join(least, names).where(F.col("_low") <= F.col("_most") * (1 + SLACK) + SLACK).select(*names, *cells, "_n"), "met")
        size = met.agg(F.sum("_n").alias("pairs"), F.max("_n").alias("most")).first()
        if (size.pairs or 0) <= LEAF * total or size.most == 1:
            break
    leaves = points.select(*cell(level), *[F.col(x).alias(f"_t{x}") for x in names])
    apart = length([F.col(x) - F.col(f"_t{x}") for x in names])
    found = met.join(leaves, cells).groupBy(*names).agg(F.min(apart).alias("distance"))
    return rows.join(found, names, "left").groupBy(F.col("_k").alias(key)).agg(F.min("distance").alias("distance"))
