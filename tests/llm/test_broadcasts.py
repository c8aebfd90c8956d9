"""What a task makes many rows of, or a file holds compressed, isn't sent whole to all tasks, though Spark takes it for small."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from plumbline.llm import components, linededup, simhash


def _depth(line):
    return len(line) - len(line.lstrip(" :+-*"))


def broadcast(plan):
    """What is below each broadcast of a plan that ran, down to exchanges whose rows Spark has sized when they were made."""
    lines = plan.rpartition("== Final Plan ==")[2].partition("== Initial Plan ==")[0].split("\n\n")[0].split("\n")
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            kept, known = [], None
            for x in lines[i + 1 :]:
                if _depth(x) <= _depth(line):
                    break
                known = None if known is not None and _depth(x) <= known else known
                if known is None:
                    kept.append(x)
                    known = _depth(x) if "ShuffleQueryStage" in x else None
            yield "\n".join(kept)


@contextmanager
def sent(spark):
    """Gets what is sent to all tasks meanwhile."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    began, out = store.executionsCount(), []
    yield out
    bus.waitUntilEmpty(30_000)
    ran = store.executionsList()
    out += [x for i in range(began, ran.size()) for x in broadcast(ran.apply(i).physicalPlanDescription())]


@pytest.fixture(autouse=True)
def usual(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_broadcasts_are_seen(spark):
    with sent(spark) as out:
        spark.range(9).join(spark.range(3).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), "id").write.format("noop").mode("overwrite").save()
    assert len(out) == 1 and "Generate" in out[0]


@pytest.mark.parametrize("busy", [64, 1])
def test_signatures_and_edges(spark, busy):
    points = spark.range(500).select(F.shiftright(F.col("id"), 1).bitwiseXOR(F.shiftleft("id", 40)).alias("fp")).distinct()
    with sent(spark) as out:
        groups = components.components(simhash.links(points, busy=busy)).count()
    assert not out and groups


def test_stages_send_no_rows_made_by_tasks(spark, sf):
    """Lines and salts, signatures, bands and their heads: each in its own join."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    crowd = spark.range(60).select((F.col("id") + 10**6).alias("doc_id"), F.concat(F.lit(" ".join(f"w{i}" for i in range(60)) + " "), F.concat_ws(" ", *[F.concat(F.lit("v"), F.floor(F.col("id") / d).cast("string")) for d in (1, 2, 8)])).alias("text"))
    docs = docs.select("doc_id", "text").union(crowd)
    with sent(spark) as out:
        linededup.dedup(docs).write.format("noop").mode("overwrite").save()
        kept = simhash.keep_similar(docs).count()
    assert 0 < kept < docs.count()
    assert not [x for x in out if "Generate" in x or "MapInArrow" in x]
