"""Keys, links and couplings measured from values; names decide nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import parse
from plumbline.functions.stats import safe

MIN_DISTINCT = 8
OVERLAP = 0.8


def cells(df: DataFrame) -> DataFrame:
    """(name, cell): every cell of a table as text, null where blank."""
    return df.select(*[parse.blank(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns]).unpivot([], df.columns, "name", "cell")


def primary_keys(frames: dict[str, DataFrame]) -> DataFrame:
    """Columns that are present on 99 % of rows, unique, of eight values or more, and no measurement."""
    x = F.col("cell").try_cast("double")
    out = []
    for name, df in frames.items():
        stats = cells(df).groupBy("name").agg(
            F.count("*").alias("n_rows"), F.count("cell").alias("present"), F.count_distinct("cell").alias("distinct_values"), F.count(x).alias("numeric"), F.sum((x != F.floor(x)).cast("int")).alias("fractional")
        )
        out.append(stats.select(F.lit(name).alias("table_name"), F.col("name").alias("column_name"), "n_rows", "present", "distinct_values", "numeric", F.coalesce("fractional", F.lit(0)).alias("fractional")))
    every = reduce(DataFrame.union, out)
    measured = (F.col("numeric") >= 0.9 * F.col("present")) & (F.col("fractional") > 0.05 * F.col("numeric"))
    return every.select("table_name", "column_name", "n_rows", "distinct_values", ((F.col("present") >= 0.99 * F.col("n_rows")) & (F.col("distinct_values") == F.col("present")) & (F.col("distinct_values") >= MIN_DISTINCT) & ~measured).alias("is_key"))


def overlap(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """How many of a column's values are keys of another table."""
    values = child.select(F.col(fk).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    keys = parent.select(F.col(pk).alias("k")).where("k is not null").distinct()
    found = values.join(keys, F.col("v") == F.col("k"), "left")
    return found.agg(F.sum("n").alias("n_values"), F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0)).alias("n_found")).withColumn("share", F.round(safe(F.col("n_found"), F.col("n_values")), 6)).withColumn("is_link", F.col("share") >= OVERLAP)


def integrity(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows, rows with a parent, orphans (present but without one) and blanks of a link.

    Values are counted before they meet the keys, so blanks are one row and not a task's share of the join.
    """
    keys = parent.select(F.col(pk).alias("_k")).distinct()
    held = child.select(F.col(fk).alias("_v")).groupBy("_v").agg(F.count("*").alias("_n")).join(keys, F.col("_v") == F.col("_k"), "left")
    rows = lambda kind: F.coalesce(F.sum(F.when(kind, F.col("_n"))), F.lit(0))
    found, blank = F.col("_k").isNotNull(), F.col("_v").isNull()
    return held.agg(rows(F.lit(True)).alias("n_rows"), rows(found).alias("with_parent"), rows(~blank & ~found).alias("orphans"), rows(blank).alias("blank"))


def inherit(child: DataFrame, parent: DataFrame, fk: str, pk: str, columns: list[str], path: str | None = None) -> DataFrame:
    """The child's rows with a parent's columns, named by the way they came."""
    via = parent.select(F.col(pk).alias("_pk"), *[F.col(c).alias(f"__via__{path or fk}__{c}") for c in columns])
    return child.join(via, child[fk] == via["_pk"], "left").drop("_pk")


def interval_join(left: DataFrame, right: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """Pairs of the same entity whose interval holds the time."""
    return left.join(right, on).where(F.col(at).between(F.col(start), F.col(end)))


def cohort(df: DataFrame, members: DataFrame, on: str) -> DataFrame:
    return df.join(members.select(on).distinct(), on, "left_semi")


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order given."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each column of both: whether they hold the same values as often, in whatever order."""
    left, right = (cells(d).groupBy("name", "cell").agg(F.count("*").alias(n)) for d, n in ((a, "na"), (b, "nb")))
    both = left.join(right, left["name"].eqNullSafe(right["name"]) & left["cell"].eqNullSafe(right["cell"]), "full")
    return both.groupBy(F.coalesce(left["name"], right["name"]).alias("column_name")).agg(F.sum(F.abs(F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0)))).alias("n_differing")).withColumn("same_values", F.col("n_differing") == 0)
