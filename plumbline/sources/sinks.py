"""Runs written so that a reader can tell they are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(df: DataFrame) -> DataFrame:
    """Rows and an order-free sum of row hashes."""
    row = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in df.columns])
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def write_run(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Each table as Parquet, then a manifest of their digests; without the manifest the run isn't whole."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    parts = [digest(spark.read.parquet(f"{folder}/{name}")).select(F.lit(name).alias("name"), "*") for name in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out.coalesce(1).write.mode(mode).json(f"{folder}/manifest")


def load_run(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a run; refuses one that differs from its manifest."""
    found = {}
    for r in spark.read.json(f"{folder}/manifest").collect():
        df = spark.read.parquet(f"{folder}/{r['name']}")
        now = digest(df).first()
        if (now.n_rows, now.digest) != (r["n_rows"], r["digest"]):
            raise ValueError(f"{folder}/{r['name']} is not what was written")
        found[r["name"]] = df
    return found


def append_trial(df: DataFrame, folder: str, trial: int) -> None:
    """Results are added, never written over."""
    df.withColumn("trial", F.lit(trial)).write.mode("append").partitionBy("trial").parquet(folder)


def publish(tables: dict[str, DataFrame], allowed: set[str], folder: str) -> None:
    """All or nothing: one name off the list and nothing is written."""
    if off := sorted(set(tables) - allowed):
        raise ValueError(f"not to be published: {', '.join(off)}")
    write_run(tables, folder)
