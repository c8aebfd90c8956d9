"""What the columns of an all-text table hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import parse
from plumbline.functions.stats import safe
from plumbline.operators.relate import cells


def census(df: DataFrame) -> DataFrame:
    """For each column: rows, present, distinct, share of numbers, and its role: identifier, numeric or category."""
    x = F.col("cell").try_cast("double")
    s = cells(df).groupBy(F.col("name").alias("column_name")).agg(F.count("*").alias("n_rows"), F.count("cell").alias("present"), F.count_distinct("cell").alias("distinct_values"), F.count(x).alias("numeric"), F.bool_and(x == F.floor(x)).alias("whole"))
    numeric = F.col("numeric") >= 0.99 * F.col("present")
    unique = (F.col("present") >= 0.99 * F.col("n_rows")) & (F.col("distinct_values") >= 0.99 * F.col("present"))
    return s.select("column_name", "n_rows", "present", "distinct_values", F.round(safe(F.col("numeric"), F.col("present")), 6).alias("numeric_share"), F.when(unique & (~numeric | F.col("whole")), "identifier").when(numeric, "numeric").otherwise("category").alias("role"))


def date_formats(df: DataFrame, formats: list[str]) -> DataFrame:
    """For each column and format: how many present cells parse, and whether that is nine in ten."""
    got = [F.struct(F.lit(f).alias("fmt"), F.count(F.try_to_timestamp("cell", F.lit(f))).alias("parsed")) for f in formats]
    per = cells(df).groupBy(F.col("name").alias("column_name")).agg(F.count("cell").alias("present"), F.array(*got).alias("x"))
    return per.select("column_name", "present", F.explode("x").alias("x")).select("column_name", "x.fmt", "x.parsed", "present", (F.col("x.parsed") >= 0.9 * F.col("present")).alias("accepted"))


def set_test(df: DataFrame, column: str, sep: str = ";") -> DataFrame:
    known = df.select(F.nullif(F.trim(F.col(column)), F.lit("")).alias("c")).where("c is not null")
    one = known.agg(F.count("*").alias("filled"), F.avg(F.contains("c", F.lit(sep)).cast("double")).alias("w"), F.avg(F.size(F.split("c", f"\\Q{sep}\\E"))).alias("m"))
    return one.select("filled", F.round("w", 6).alias("with_separator"), F.round("m", 6).alias("mean_size"), ((F.col("filled") >= 50) & (F.col("w") >= 0.3) & (F.col("m") >= 1.2)).alias("is_set"))


def expand(df: DataFrame, column: str, published: list[str], sep: str = ";") -> DataFrame:
    """Adds the set's size and a 0/1 column for each token; null only where the set is unknown."""
    held = parse.tokens(F.col(column), sep)
    flags = {f"{column}__has__{t}": F.when(held.isNotNull(), F.array_contains(held, t).cast("double")) for t in published}
    return df.withColumns({f"{column}__n": F.size(held).cast("long"), **flags})


def as_strings(df: DataFrame) -> DataFrame:
    """Every column as text, nulls empty; a number column that is whole throughout has no decimals."""
    numeric = [c for c, k in df.dtypes if k in ("double", "float") or k.startswith("decimal")]
    whole = df.agg(*[F.bool_and(F.col(c) == F.floor(c)).alias(c) for c in numeric]).first().asDict() if numeric else {}
    return df.select(*[F.coalesce((F.col(c).cast("long") if whole.get(c) else F.col(c)).cast("string"), F.lit("")).alias(c) for c in df.columns])


def typed(df: DataFrame, entity: str | None = None, max_levels: int = 200) -> tuple[DataFrame, dict[str, str]]:
    """A typed table and each column's role: numbers as doubles, dates as day numbers, the rest as levels, the rare ones pooled."""
    roles = {r.column_name: r.role for r in census(df).collect()}
    dates = {r.column_name: r.fmt for r in date_formats(df, parse.DATE_FORMATS).where("accepted").collect()[::-1]}
    out = []
    for c in df.columns:
        x = parse.blank(F.col(c).cast("string"))
        if c == entity:
            out.append(F.col(c))
        elif roles[c] == "numeric":
            out.append(x.try_cast("double").alias(c))
        elif c in dates:
            roles[c] = "date"
            out.append(parse.day_number(x, dates[c]).alias(c))
        elif roles[c] == "category":
            top = [r[0] for r in df.groupBy(c).count().orderBy(F.desc("count"), c).limit(max_levels).collect()]
            out.append(F.when(x.isNull() | x.isin([t for t in top if t is not None]), x).otherwise("__other__").alias(c))
    return df.select(*out), roles
