"""Tables written in every format and read again, whole runs, and trials that add up."""

import uuid

from pyspark.sql import functions as F

from plumbline.registry import query, table
from plumbline.sources import readers, sinks
from plumbline.sources.shared import shared_folder

WRITERS = {"csv": lambda df, p: df.write.csv(p, header=True), "tsv": lambda df, p: df.write.csv(p, header=True, sep="\t"), "jsonl": lambda df, p: df.write.json(p), "json": lambda df, p: df.write.json(p), "parquet": lambda df, p: df.write.parquet(p), "orc": lambda df, p: df.write.orc(p)}


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("formats_round_trip", f"SELECT kind, n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation, (VALUES {', '.join(f'({k!r})' for k in WRITERS)}) AS v(kind)")
def formats_round_trip(spark, sf):
    """Nations written in each format, and read as texts."""
    nation, out = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), None
    for kind, write in WRITERS.items():
        folder = _folder(spark, kind)
        write(nation, folder)
        one = readers.read_table(spark, folder, kind)[0].select(F.lit(kind).alias("kind"), *nation.columns)
        out = one if out is None else out.union(one)
    return out


@query("supported_formats", "SELECT * FROM (VALUES ('csv', 'text'), ('tsv', 'text'), ('txt', 'text'), ('json', 'records'), ('jsonl', 'records'), ('ndjson', 'records'), ('parquet', 'columns'), ('orc', 'columns')) AS v(extension, layout)")
def supported_formats(spark, sf):
    return readers.supported(spark)


@query("run_round_trip", "SELECT 'orders' AS name, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders UNION ALL SELECT 'customer', count(*), sum(c_custkey)::BIGINT FROM customer")
def run_round_trip(spark, sf):
    """A run with its manifest, published by list and read again."""
    folder, tables = _folder(spark, "run"), {"orders": table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), "customer": table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))}
    sinks.publish(tables, {"orders", "customer"}, folder)
    found = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("k").alias("keys")) for name, df in sinks.load_run(spark, folder).items()]
    return found[0].union(found[1])


@query("refused_publication", "SELECT 'secret' AS refused, 0 AS n_written")
def refused_publication(spark, sf):
    """One table off the list, and nothing is written."""
    folder = _folder(spark, "refused")
    try:
        sinks.publish({"nation": table(spark, sf, "nation"), "secret": table(spark, sf, "region")}, {"nation"}, folder)
        refused = "nothing"
    except ValueError as e:
        refused = str(e).rsplit(" ", 1)[-1]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.createDataFrame([(refused, int(there))], "refused string, n_written int")


@query("trials", "SELECT trial, event_type, count(*) AS n FROM events, (VALUES (1), (2)) AS t(trial) WHERE user_id % 3 = trial GROUP BY ALL")
def trials(spark, sf):
    """Results of two trials, added one after the other."""
    folder, events = _folder(spark, "trials"), table(spark, sf, "events")
    for trial in (1, 2):
        sinks.append_trial(events.where(F.col("user_id") % 3 == trial).groupBy("event_type").agg(F.count("*").alias("n")), folder, trial)
    return spark.read.parquet(folder).select("trial", "event_type", "n")
