"""Knots, tails and presence that k entities stand behind."""

from pyspark.sql import functions as F

from plumbline.operators import tails as t
from plumbline.operators.ranks import exact_quantiles
from plumbline.registry import query, table

KNOTS = [0.01, 0.25, 0.5, 0.9, 0.99]


def _knots(source, value, order):
    ends = " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round_even({q}::DOUBLE * (n - 1), 0)::BIGINT AS spot FROM s" for q in KNOTS)
    return f"""WITH p AS MATERIALIZED (SELECT {value}::DOUBLE AS v, e, row_number() OVER (ORDER BY {value}, {order}) - 1 AS p FROM {source} WHERE {value} IS NOT NULL), s AS (SELECT count(*) AS n FROM p), k AS ({ends}),
t AS MATERIALIZED (SELECT q, v, e, CASE WHEN p <= spot THEN 2 * (spot - p) - (p < spot)::BIGINT ELSE 2 * (p - spot) END AS turn FROM p, k), h AS (SELECT q, v AS raw FROM t WHERE turn = 0), c AS (SELECT h.q, count(DISTINCT p.e) AS holders FROM h JOIN p ON p.v = h.raw GROUP BY 1),
f AS (SELECT q, e, min(turn) AS turn FROM t GROUP BY 1, 2), l AS (SELECT q, max(turn) AS last FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY turn) AS i FROM f) WHERE i <= 10 GROUP BY 1), m AS (SELECT q, avg(v) AS mean FROM t JOIN l USING (q) WHERE turn <= last GROUP BY 1)
SELECT q, round(CASE WHEN holders >= 10 THEN raw ELSE mean END, 6) AS v, holders >= 10 AS raw FROM h JOIN c USING (q) JOIN m USING (q)"""


@query("k_knots", _knots("(SELECT *, o_custkey AS e FROM orders)", "o_totalprice", "o_orderkey"))
def k_knots(spark, sf):
    return t.k_knots(table(spark, sf, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"], KNOTS)


@query("k_knots_shared", _knots("(SELECT *, l_suppkey AS e FROM lineitem)", "l_quantity", "l_orderkey, l_linenumber"))
def k_knots_shared(spark, sf):
    """Quantities are few, so most knots are values that many suppliers share."""
    return t.k_knots(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity", ["l_orderkey", "l_linenumber"], KNOTS)


CUT = "(SELECT quantile_cont(o_totalprice, 0.9) FROM orders)"


@query("tail_moments", f"""
WITH p AS (SELECT o_custkey, avg(o_totalprice) AS m, avg(least(o_totalprice, 480000)) AS h FROM orders WHERE o_totalprice >= {CUT} GROUP BY 1)
SELECT count(*) AS entities, round(CASE WHEN count(*) >= 10 THEN avg(m) END, 6) AS mean, round(CASE WHEN count(*) >= 10 AND stddev_samp(h) > 0 THEN stddev_samp(h) END, 6) AS sd FROM p""")
def tail_moments(spark, sf):
    orders = table(spark, sf, "orders")
    return t.tail(orders, "o_custkey", "o_totalprice", exact_quantiles(orders, "o_totalprice", [0.9])[0], bound=480_000.0)


@query("tail_moments_low", """
WITH p AS (SELECT o_custkey, avg(o_totalprice) AS m, avg(greatest(o_totalprice, 2000)) AS h FROM orders WHERE o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.1) FROM orders) GROUP BY 1)
SELECT count(*) AS entities, round(CASE WHEN count(*) >= 10 THEN avg(m) END, 6) AS mean, round(CASE WHEN count(*) >= 10 AND stddev_samp(h) > 0 THEN stddev_samp(h) END, 6) AS sd FROM p""")
def tail_moments_low(spark, sf):
    orders = table(spark, sf, "orders")
    return t.tail(orders, "o_custkey", "o_totalprice", exact_quantiles(orders, "o_totalprice", [0.1])[0], upper=False, bound=2_000.0)


@query("tail_bands", f"""
WITH p AS (SELECT o_custkey AS e, avg(o_totalprice) AS m, count(*) AS n FROM orders WHERE o_totalprice >= {CUT} GROUP BY 1), c AS (SELECT least(4, count(*) // 10) AS bands FROM p),
b AS (SELECT least((row_number() OVER (ORDER BY m DESC, e DESC) - 1) // 10, bands - 1) AS band, m, n FROM p, c), g AS (SELECT band, sum(n)::BIGINT AS n, avg(m) AS v FROM b GROUP BY 1), q AS (SELECT band, v, 0.9::DOUBLE + 0.1::DOUBLE * (sum(n) OVER (ORDER BY band DESC))::DOUBLE / (sum(n) OVER ())::DOUBLE AS q FROM g)
SELECT round(q, 6) AS q, round(v, 6) AS v FROM q WHERE band > 0 AND q > 0.9 AND q < 1""")
def tail_bands(spark, sf):
    orders = table(spark, sf, "orders")
    return t.tail_bands(orders, "o_custkey", "o_totalprice", exact_quantiles(orders, "o_totalprice", [0.9])[0], 0.9)


@query("presence_model", """
WITH r AS (SELECT l_suppkey AS e, CASE WHEN l_quantity > 20 OR l_linenumber % 3 = 0 THEN l_tax END IS NOT NULL AS has, l_quantity AS q, l_extendedprice AS x FROM lineitem), d AS (SELECT e, has, 'l_quantity' AS driver, q AS v FROM r UNION ALL SELECT e, has, 'l_extendedprice', x FROM r),
c AS (SELECT driver, list_distinct(quantile_cont(v, [1/6.0::DOUBLE, 2/6.0::DOUBLE, 3/6.0::DOUBLE, 4/6.0::DOUBLE, 5/6.0::DOUBLE])) AS cuts FROM d GROUP BY 1),
b AS (SELECT driver, len(list_filter(cuts, lambda k: d.v > k)) AS bin, e, has FROM d JOIN c USING (driver)), g AS (SELECT driver, bin, count(DISTINCT e) AS entities, avg(has::INT) AS rate FROM b GROUP BY 1, 2),
s AS (SELECT driver, max(rate) - min(rate) AS spread FROM g GROUP BY 1 HAVING min(entities) >= 10 AND max(rate) - min(rate) >= 0.1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT driver, bin::BIGINT AS bin, entities, round(rate, 6) AS rate FROM g SEMI JOIN s USING (driver)""")
def presence_model(spark, sf):
    """A tax that is known where quantities are large, and its best driver of two."""
    lines = table(spark, sf, "lineitem").withColumn("tax", F.when((F.col("l_quantity") > 20) | (F.col("l_linenumber") % 3 == 0), F.col("l_tax")))
    return t.presence_model(lines, "l_suppkey", "tax", ["l_quantity", "l_extendedprice"])
