"""Rows of an entity in their order: events by user, orders by customer."""

from pyspark.sql import functions as F

from plumbline.operators import dynamics as d
from plumbline.operators import entities as e
from plumbline.registry import query, table

ORDER = ["ts", "event_id"]


def gappy(spark, sf):
    """Events with every fifth value taken away."""
    return table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))


GAPPY = "(SELECT * REPLACE (CASE WHEN event_id % 5 <> 0 THEN value END AS value) FROM events)"
PAIRS = f"(SELECT value AS x, lag(value) OVER w AS p, row_number() OVER w > 1 AS has FROM {GAPPY} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query("lag_last_observed", f"""
SELECT event_id, round(prev, 6) AS value__prev, round(value - prev, 6) AS value__delta FROM (
  SELECT event_id, value, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {GAPPY})""")
def lag_last_observed(spark, sf):
    out = d.last_observed(gappy(spark, sf), "user_id", ORDER, "value", "value")
    return out.select("event_id", F.round("value__prev", 6).alias("value__prev"), F.round("value__delta", 6).alias("value__delta"))


@query("pooled_lag1", f"SELECT count(*) AS n_pairs, round(least(greatest(corr(p, x), -0.98), 0.98), 6) AS lag1 FROM {PAIRS} WHERE x IS NOT NULL AND p IS NOT NULL")
def pooled_lag1(spark, sf):
    return d.lag1(gappy(spark, sf), "user_id", ORDER, "value")


@query("missing_clustering", f"""
SELECT count(*) AS n_pairs, count(*) FILTER (WHERE p IS NOT NULL) AS n_present, count(*) FILTER (WHERE p IS NULL) AS n_absent,
  round(CASE WHEN count(*) >= 30 AND count(*) FILTER (WHERE p IS NOT NULL) >= 15 AND count(*) FILTER (WHERE p IS NULL) >= 15 THEN
    least(greatest(avg(CASE WHEN p IS NOT NULL THEN (x IS NOT NULL)::INT END) - avg(CASE WHEN p IS NULL THEN (x IS NOT NULL)::INT END), 0), 0.98) ELSE 0 END, 6) AS clustering
FROM {PAIRS} WHERE has""")
def missing_clustering(spark, sf):
    return d.missing_clustering(gappy(spark, sf), "user_id", ORDER, "value")


@query("stickiness", """
WITH s AS (SELECT count(*) AS n_pairs, avg((x = p)::INT) AS stays FROM (SELECT event_type AS x, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL),
c AS (SELECT sum(n * n) / (sum(n) * sum(n))::DOUBLE AS chance FROM (SELECT count(*)::DOUBLE AS n FROM events GROUP BY event_type))
SELECT n_pairs, round(stays, 6) AS stays, round(chance, 6) AS chance, round((stays - chance) / (1 - chance), 6) AS stickiness FROM s, c""")
def stickiness(spark, sf):
    return d.stickiness(table(spark, sf, "events"), "user_id", ORDER, "event_type")


@query("icc1", """
WITH per AS (SELECT user_id, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM events GROUP BY user_id),
w AS (SELECT sum(n) AS n, count(*) AS g, sum(ss) AS ssw, sum(n * n) AS n2, sum(n * m) / sum(n) AS mean, sum(n * m * m) AS nm2 FROM per),
x AS (SELECT n, g, (nm2 - n * mean * mean) / (g - 1) AS msb, ssw / (n - g) AS msw, (n - n2 / n) / (g - 1) AS k0 FROM w)
SELECT n::BIGINT AS n, g, round(k0, 6) AS k0, round(least(greatest((msb - msw) / (msb + (k0 - 1) * msw), 0), 0.98), 6) AS icc, NULL::VARCHAR AS reason FROM x""")
def icc1(spark, sf):
    return d.icc1(table(spark, sf, "events"), "user_id", "value")


@query("within_from", f"""
WITH per AS (SELECT user_id, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM events GROUP BY user_id),
w AS (SELECT sum(n) AS n, count(*) AS g, sum(ss) AS ssw, sum(n * n) AS n2, sum(n * m) / sum(n) AS mean, sum(n * m * m) AS nm2 FROM per),
x AS (SELECT (nm2 - n * mean * mean) / (g - 1) AS msb, ssw / (n - g) AS msw, (n - n2 / n) / (g - 1) AS k0 FROM w),
i AS (SELECT round(least(greatest((msb - msw) / (msb + (k0 - 1) * msw), 0), 0.98), 6) AS icc FROM x),
l AS (SELECT round(corr(p, x), 6) AS lag1 FROM (SELECT value AS x, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NOT NULL)
SELECT lag1, icc, round((lag1 - icc) / (1 - icc), 5) AS within_lag FROM i, l""")
def within_from(spark, sf):
    events = table(spark, sf, "events")
    both = d.lag1(events, "user_id", ORDER, "value").select("lag1").crossJoin(d.icc1(events, "user_id", "value").select("icc"))
    return both.select("lag1", "icc", F.round(d.within(F.col("lag1"), F.col("icc")), 5).alias("within_lag"))


@query("returned_within_n", """
SELECT o_orderkey, days_to_next, coalesce((days_to_next BETWEEN 0 AND 30)::INT, 0) AS returned, (days_to_next IS NULL)::INT AS is_last FROM (
  SELECT o_orderkey, date_diff('day', o_orderdate::DATE, lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey)) AS days_to_next FROM orders)""")
def returned_within_n(spark, sf):
    orders = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return d.returned_within(orders, "o_custkey", "day", ["o_orderkey"], 30).select("o_orderkey", "days_to_next", "returned", "is_last")


@query("time_axis_monotone", """
SELECT count(*) AS entities, round(avg(ok::INT), 6) AS monotone FROM (SELECT user_id, bool_and(ok) AS ok FROM (
  SELECT user_id, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), true) AS ok FROM events) GROUP BY user_id)""")
def time_axis_monotone(spark, sf):
    return d.monotone_share(table(spark, sf, "events"), "user_id", ["event_id"], "ts")


@query("varies_within", "SELECT count(*) AS entities, round(avg((d > 1)::INT), 6) AS varies_within FROM (SELECT count(DISTINCT o_orderpriority) AS d FROM orders GROUP BY o_custkey)")
def varies_within(spark, sf):
    return d.varies_within(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@query("within_stay_trend", """
WITH per AS (SELECT user_id, event_type, count(*) AS n, count(DISTINCT ts) AS times, count(DISTINCT value) AS vals FROM events GROUP BY ALL)
SELECT event_type, count(*) AS visits, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE times > 1) AS timed, count(*) FILTER (WHERE times > 1 AND vals > 1) AS moving, round(median(n), 6) AS median_points FROM per GROUP BY event_type""")
def within_stay_trend(spark, sf):
    return d.within_visit(table(spark, sf, "events"), "user_id", "event_type", "ts", "value")


@query("k_safe_bounds", """
WITH per AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_custkey)
SELECT (SELECT count(*) FROM per) AS entities, round((SELECT avg(low) FROM (SELECT low FROM per ORDER BY low LIMIT 10)), 6) AS low, round((SELECT avg(high) FROM (SELECT high FROM per ORDER BY high DESC LIMIT 10)), 6) AS high""")
def k_safe_bounds(spark, sf):
    return e.safe_bounds(table(spark, sf, "orders"), "o_custkey", "o_totalprice")


@query("k_levels", """
WITH per AS (SELECT event_type AS level, count(*) AS n_rows, count(DISTINCT user_id) AS entities FROM events GROUP BY event_type HAVING count(DISTINCT user_id) >= 10)
SELECT level, n_rows, entities, round(n_rows::DOUBLE / sum(n_rows) OVER (), 6) AS share FROM per""")
def k_levels(spark, sf):
    return e.levels(table(spark, sf, "events"), "user_id", "event_type")


@query("numeric_marginal", """
WITH k AS (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q, unnest(quantile_cont(o_totalprice, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])) AS v FROM orders)
SELECT q::DOUBLE AS q, round(v, 6) AS v, (SELECT round(avg(o_totalprice), 6) FROM orders) AS mean, (SELECT round(stddev_pop(o_totalprice), 6) FROM orders) AS sd, (SELECT bool_and(o_totalprice = floor(o_totalprice)) FROM orders) AS integral, (SELECT round(avg((o_totalprice = 0)::INT), 6) FROM orders) AS zeros FROM k""")
def numeric_marginal(spark, sf):
    return e.numeric_marginal(table(spark, sf, "orders"), "o_totalprice")


def order_sets(spark, sf):
    """Each order with the joined set of its lines' modes; an order of flag N only has an empty one."""
    lines = table(spark, sf, "lineitem")
    mode = F.concat(F.col("l_returnflag"), F.col("l_linestatus"), (F.col("l_quantity") % 4).cast("int").cast("string"))
    sets = lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(mode)), ";").alias("modes"))
    return table(spark, sf, "orders").join(sets, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "modes")


HELD = "(SELECT DISTINCT o_orderkey AS r, o_custkey AS e, l_returnflag || l_linestatus || (l_quantity % 4)::INT::VARCHAR AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query("set_vocabulary_k", f"SELECT t AS token, count(*) AS n_rows, count(DISTINCT e) AS entities, round(count(*)::DOUBLE / (SELECT count(DISTINCT r) FROM {HELD}), 6) AS share FROM {HELD} GROUP BY t HAVING count(DISTINCT e) >= 10")
def set_vocabulary_k(spark, sf):
    return e.vocabulary(order_sets(spark, sf), "o_custkey", "modes")


@query("set_cooccurrence_lift", f"""
WITH h AS {HELD}, n AS (SELECT count(DISTINCT r)::DOUBLE AS n FROM h), c AS (SELECT t, count(*)::DOUBLE AS k FROM h GROUP BY t),
j AS (SELECT a.t AS a, b.t AS b, count(*) AS joint, count(DISTINCT a.e) AS entities FROM h a JOIN h b ON a.r = b.r AND a.t <> b.t GROUP BY ALL HAVING count(DISTINCT a.e) >= 10)
SELECT a, b, joint, entities, round((joint / ca.k) / (cb.k / n), 6) AS lift,
  round((joint / n - ca.k / n * cb.k / n) / sqrt(ca.k / n * (1 - ca.k / n) * cb.k / n * (1 - cb.k / n)), 6) AS phi
FROM j JOIN c ca ON ca.t = a JOIN c cb ON cb.t = b, n WHERE ca.k >= 30""")
def set_cooccurrence_lift(spark, sf):
    return e.cooccurrence(order_sets(spark, sf), "o_custkey", "o_orderkey", "modes")


PERSON = "(SELECT o_custkey, count(*) AS encounters, count(DISTINCT o_orderpriority) AS levels, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS span_days FROM orders GROUP BY o_custkey)"


@query("person_stats", " UNION ALL ".join(f"SELECT '{m}' AS measure, count(*) AS entities, round(avg({m}), 6) AS mean, round(median({m}), 6) AS median, round(stddev_pop({m}), 6) AS sd, round((SELECT avg({m}) FROM (SELECT {m} FROM {PERSON} ORDER BY {m} LIMIT 10)), 6) AS low, round((SELECT avg({m}) FROM (SELECT {m} FROM {PERSON} ORDER BY {m} DESC LIMIT 10)), 6) AS high FROM {PERSON}" for m in ("encounters", "levels", "span_days")))
def person_stats(spark, sf):
    return e.person_stats(table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate")), "o_custkey", "day", "o_orderpriority")


@query("census_forecast", """
WITH l AS (SELECT o_custkey AS e, 'o_orderpriority' AS column_name, o_orderpriority AS level FROM orders UNION ALL SELECT o_custkey, 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT o_custkey, 'o_orderkey', o_orderkey::VARCHAR FROM orders),
p AS (SELECT column_name, level, count(*) AS n, count(DISTINCT e) AS entities FROM l GROUP BY ALL),
o AS (SELECT column_name, count(*) AS n_levels, count(*) FILTER (WHERE entities >= 10) AS n_kept, round(coalesce(sum(n) FILTER (WHERE entities >= 10), 0)::DOUBLE / sum(n), 6) AS mass_kept FROM p GROUP BY column_name)
SELECT *, CASE WHEN mass_kept >= 0.9 THEN 'RICH' WHEN mass_kept >= 0.5 THEN 'WORKABLE' ELSE 'SPARSE' END AS verdict FROM o""")
def census_forecast(spark, sf):
    return e.census(table(spark, sf, "orders"), "o_custkey", ["o_orderpriority", "o_orderstatus", "o_orderkey"])
