"""Tables as texts: every format is read without typing, and blanks stay blank."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.typing import as_strings


class IntakeError(ValueError):
    """A file that can't be read, and why."""


def _by_line(spark: SparkSession, path: str) -> bool:
    """Whether the first line is a record by itself, so that each is; otherwise the file is one document, as a list."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    try:
        return first is None or isinstance(json.loads(first.value), dict)
    except ValueError:
        return False


def read_table(spark: SparkSession, path: str, kind: str | None = None) -> tuple[DataFrame, str]:
    """The table and a note of how it was read."""
    kind = (kind or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind in ("csv", "txt", "tsv"):
        sep = "\t" if kind == "tsv" else ","
        df = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', inferSchema=False, nullValue="\u0000", emptyValue="", mode="PERMISSIVE")
        df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in df.columns])
        note = f"{kind}, separated by {'tabs' if sep == chr(9) else 'commas'}"
    elif kind in ("jsonl", "ndjson", "json"):
        df = spark.read.json(path, primitivesAsString=True, multiLine=kind == "json" and not _by_line(spark, path))
        if "_corrupt_record" in df.columns and kind == "json":
            df = spark.read.json(path, primitivesAsString=True)
        df, note = as_strings(df), "JSON records"
    elif kind == "parquet":
        df, note = as_strings(spark.read.parquet(path)), "Parquet, as text"
    elif kind == "orc":
        df, note = as_strings(spark.read.orc(path)), "ORC, as text"
    else:
        raise IntakeError(f"{path}: no reader for .{kind}; there are csv, tsv, txt, json, jsonl, ndjson, parquet and orc")
    if not df.columns:
        raise IntakeError(f"{path}: it has no columns")
    return df, note


def supported(spark: SparkSession) -> DataFrame:
    rows = [("csv", "text"), ("tsv", "text"), ("txt", "text"), ("json", "records"), ("jsonl", "records"), ("ndjson", "records"), ("parquet", "columns"), ("orc", "columns")]
    return spark.createDataFrame(rows, "extension string, layout string")
