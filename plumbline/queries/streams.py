"""Streams drained to a table, held against the same measure of the table at rest."""

import uuid

from pyspark.sql import functions as F

from plumbline.registry import query, table
from plumbline.sources.shared import shared_folder
from plumbline.streaming import events as s


def _updated(spark, sf, shape, name, by):
    """All windows, also those that no watermark has closed yet: each batch writes those it has changed, and the last word on a window counts.

    State is dropped behind the watermark.  A batch that is tried again takes its own place.
    """
    out = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    stream = shape(s.source(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema))
    done = stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    done.awaitTermination()
    every = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(out)
    rest = [c for c in stream.columns if c not in by]
    return every.groupBy(*by).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def _update(spark, sf, shape, name):
    """As ``_updated`` for sessions, which Spark gives in complete mode or once closed only: each batch's complete table takes the place of the last, so state holds all sessions; ``stream_session_closed`` is the form for streams without end."""
    schema = table(spark, sf, "events").schema
    out = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    stream = shape(s.source(spark, f"{sf}/events.parquet*", schema))
    done = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_tumbling", "SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    out = _updated(spark, sf, s.tumbling, "tumbling", ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_session", """
WITH m AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_session(spark, sf):
    out = _update(spark, sf, s.sessions, "sessions")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def _closed(spark, sf, shape, name):
    """Windows that the watermark has closed, each written once: state is dropped as time goes on."""
    out = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    stream = shape(s.source(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema))
    s.drain(stream, out, f"{out}-state")
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_tumbling_closed", "SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 7 DAY FROM events)")
def stream_tumbling_closed(spark, sf):
    out = _closed(spark, sf, s.tumbling, "tumbling-closed")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_session_closed", """
WITH m AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 12 HOUR, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 7 DAY FROM events)""")
def stream_session_closed(spark, sf):
    out = _closed(spark, sf, s.sessions, "sessions-closed")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
