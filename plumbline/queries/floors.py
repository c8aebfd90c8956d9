"""Noise floors and the verdicts that respect them, on halves of the events."""

from pyspark.sql import functions as F

from plumbline.operators import floors as f
from plumbline.registry import query, table


def _u(key):
    return f"((('0x' || substr(sha256({key}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"


def halves(spark, sf):
    events = table(spark, sf, "events")
    return events.where("user_id % 2 = 0"), events.where("user_id % 2 = 1")


@query("noise_floor", """
WITH c AS (SELECT event_type, count(*) FILTER (WHERE user_id % 2 = 0) AS a, count(*) FILTER (WHERE user_id % 2 = 1) AS b FROM events GROUP BY 1), s AS (SELECT sum(a)::BIGINT AS n, sum(b)::BIGINT AS m FROM c),
t AS (SELECT n, m, sum(abs(a / n::DOUBLE - b / m::DOUBLE)) / 2 AS tvd FROM c, s GROUP BY n, m), r AS (SELECT *, 1.6::DOUBLE * sqrt(0.5::DOUBLE * (1.0::DOUBLE / n + 1.0::DOUBLE / m)) AS floor FROM t)
SELECT n, m, round(tvd, 6) AS tvd, round(floor, 6) AS floor, round(greatest(0.05, 2 * floor), 6) AS bar, CASE WHEN floor >= 0.05 THEN 'UNREADABLE' WHEN tvd > greatest(0.05, 2 * floor) THEN 'DEPARTS' ELSE 'HOLDS' END AS verdict FROM r""")
def noise_floor(spark, sf):
    return f.level_floors(*halves(spark, sf), "event_type")


@query("gap_blame", """
WITH g AS (SELECT event_type, avg(value) FILTER (WHERE user_id % 3 = 0) AS s, avg(value) FILTER (WHERE user_id % 3 = 1) AS g, avg(value) FILTER (WHERE user_id % 3 = 2) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1), d AS (SELECT event_type, abs(s - g) / sd AS ds, abs(g - m) / sd AS dg FROM g)
SELECT event_type, round(ds, 6) AS grid_source, round(dg, 6) AS grid_made, CASE WHEN ds > 0.05 AND dg > 0.05 THEN 'BOTH' WHEN ds > 0.05 THEN 'CONTRACT' WHEN dg > 0.05 THEN 'GENERATION' ELSE 'CLEAR' END AS blame FROM d""")
def gap_blame(spark, sf):
    """Means of three thirds of the users stand for source, grid and table."""
    third = [F.avg(F.when(F.col("user_id") % 3 == i, F.col("value"))) for i in range(3)]
    g = table(spark, sf, "events").groupBy("event_type").agg((F.abs(third[0] - third[1]) / F.stddev_samp("value")).alias("ds"), (F.abs(third[1] - third[2]) / F.stddev_samp("value")).alias("dg"))
    return g.select("event_type", F.round("ds", 6).alias("grid_source"), F.round("dg", 6).alias("grid_made"), f.blame(F.col("ds"), F.col("dg")).alias("blame"))


@query("judge_cells", """
WITH x AS (SELECT event_type, hour(ts) // 6 AS part, avg(value) FILTER (WHERE user_id % 2 = 0) AS m1, count(value) FILTER (WHERE user_id % 2 = 0) AS n1, avg(value) FILTER (WHERE user_id % 2 = 1) AS m2, count(value) FILTER (WHERE user_id % 2 = 1) AS n2 FROM events GROUP BY 1, 2),
s AS (SELECT stddev_samp(value) AS sd FROM events WHERE user_id % 2 = 0), j AS (SELECT abs(m1 - m2) / sd AS gap, 2.3::DOUBLE * sqrt(1.0::DOUBLE / n1 + 1.0::DOUBLE / n2) AS floor FROM x, s WHERE n1 > 0 AND n2 > 0), b AS (SELECT *, greatest(0.35, 2 * floor) AS bar, floor < 0.35 AS ok FROM j)
SELECT CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN count(*) FILTER (WHERE ok AND gap > bar) = 0 END AS tracks, round(max(gap) FILTER (WHERE ok), 6) AS gap, round(coalesce(arg_max(floor, gap) FILTER (WHERE ok), min(floor)), 6) AS floor, round(arg_max(bar, gap) FILTER (WHERE ok), 6) AS bar, count(*) FILTER (WHERE ok) AS cells FROM b""")
def judge_cells(spark, sf):
    one, two = (h.withColumn("part", F.floor(F.hour("ts") / 6)) for h in halves(spark, sf))
    return f.judge_cells(one, two, ["event_type", "part"], "value")


@query("curve_floor", f"""
WITH r AS (SELECT user_id, event_type, value, s, {_u("s::VARCHAR || ':' || user_id::VARCHAR || ':half'")} < 0.5 AS l FROM events, range(5) AS t(s)), c AS (SELECT event_type, s, avg(value) FILTER (WHERE l) - avg(value) FILTER (WHERE NOT l) AS d FROM r GROUP BY 1, 2), g AS (SELECT s, max(abs(d)) AS gap FROM c GROUP BY 1)
SELECT count(*) AS splits, round(avg(gap) / (SELECT stddev_samp(value) FROM events), 6) AS floor FROM g WHERE gap IS NOT NULL""")
def curve_floor(spark, sf):
    return f.curve_floor(table(spark, sf, "events"), "user_id", "event_type", "value")


@query("ks_tolerance", "SELECT event_type, count(*) FILTER (WHERE user_id % 2 = 0) AS n, count(*) FILTER (WHERE user_id % 2 = 1) AS m, round(greatest(0.03, 1.63::DOUBLE * sqrt(count(*)::DOUBLE / (count(*) FILTER (WHERE user_id % 2 = 0) * count(*) FILTER (WHERE user_id % 2 = 1))::DOUBLE)), 6) AS tolerance FROM events GROUP BY 1")
def ks_tolerance(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("user_id") % 2 == 0).alias("n"), F.count_if(F.col("user_id") % 2 == 1).alias("m"))
    return g.select("*", F.round(f.ks_tolerance(F.col("n"), F.col("m")), 6).alias("tolerance"))


@query("additive_departure", """
WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) >= 5), ma AS (SELECT o_orderpriority AS a, avg(o_totalprice) AS x FROM orders GROUP BY 1), mb AS (SELECT o_orderstatus AS b, avg(o_totalprice) AS y FROM orders GROUP BY 1), w AS (SELECT avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd FROM orders),
d AS (SELECT n, abs(m - (x + y - mean)) / sd AS stray FROM c JOIN ma USING (a) JOIN mb USING (b), w)
SELECT count(*) AS cells, round(max(stray), 6) AS greatest, round(sqrt(sum(n * stray * stray) / sum(n)), 6) AS departure FROM d""")
def additive_departure(spark, sf):
    return f.additive_departure(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice")


@query("size_advice", """
WITH e AS (SELECT count(DISTINCT o_custkey) AS n FROM orders), r AS (SELECT s AS requested, round(least(1.0, n / s::DOUBLE), 6) AS ratio FROM e, (VALUES (100::BIGINT), (1500::BIGINT), (10000::BIGINT), (1000000::BIGINT)) AS t(s))
SELECT *, CASE WHEN ratio >= 1 THEN 'WITHIN' WHEN ratio >= 0.5 THEN 'STRETCHED' ELSE 'BEYOND' END AS verdict FROM r""")
def size_advice(spark, sf):
    """What tables of several sizes would rest on, given the customers that have orders."""
    n = table(spark, sf, "orders").agg(F.count_distinct("o_custkey")).first()[0]
    return spark.range(1).select(F.explode(f.advise(n, [100, 1_500, 10_000, 1_000_000])).alias("r")).select("r.*")


def _shape(value):
    return f"""WITH c AS (SELECT event_type, hour(ts) // 3 AS b, avg({value}) AS m FROM events GROUP BY 1, 2), p AS (SELECT event_type, min_by(m, b) AS f, max_by(m, b) AS l, min(m) AS low, max(m) AS high FROM c GROUP BY 1), d AS (SELECT event_type, (l - f) / 10.0::DOUBLE AS rise, (least(f, l) - low) / 10.0::DOUBLE AS dip, (high - greatest(f, l)) / 10.0::DOUBLE AS bump, (high - low) / 10.0::DOUBLE AS span FROM p)
SELECT event_type, CASE WHEN span < 0.1 THEN 'flat' WHEN dip >= 0.35 AND dip >= bump THEN 'u-shaped' WHEN bump >= 0.35 THEN 'peaked' WHEN rise > 0 THEN 'rising' ELSE 'falling' END AS shape, round(rise, 6) AS rise, round(dip, 6) AS dip, round(bump, 6) AS bump FROM d"""


@query("curve_shapes", _shape("value"))
def curve_shapes(spark, sf):
    """Mean value by time of day, named for each type of event."""
    curves = table(spark, sf, "events").groupBy("event_type", F.floor(F.hour("ts") / 3).alias("b")).agg(F.avg("value").alias("m"))
    kinds = [r.event_type for r in curves.select("event_type").distinct().collect()]  # a few types
    return f.union([f.curve_shape(curves.where(F.col("event_type") == k), "b", "m", 10.0).select(F.lit(k).alias("event_type"), "*") for k in sorted(kinds)])
