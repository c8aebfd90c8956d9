"""Models and mechanisms: rows and tests rather than SQL stand behind most of these."""

from pyspark.sql import functions as F

from plumbline.operators import discovery as d
from plumbline.operators import dynamics
from plumbline.registry import query, table


@query("discover_parents")
def discover_parents(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("row", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    out = d.explain(lines, "l_orderkey", "row", "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return out.select("parent", F.round("skill", 4).alias("skill"), F.round("importance", 4).alias("importance"), "claimed")


@query("distinguishability")
def distinguishability(spark, sf):
    """Lines of even and odd orders: how well boosted trees tell them apart, within the range of the odd ones as well, and by which columns."""
    lines = table(spark, sf, "lineitem").withColumn("row", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    out = d.distinguishable(lines.where("l_orderkey % 2 = 0"), lines.where("l_orderkey % 2 = 1"), ["l_quantity", "l_extendedprice", "l_discount"], "row")
    return out.withColumns({c: F.round(c, 4) for c in ("blame", "beyond")})


@query("ar1_generate")
def ar1_generate(spark, sf):
    """The lag-1 correlation that comes of asking for 0.6."""
    made = d.ar1(table(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], 0.6)
    return dynamics.lag1(made, "user_id", ["ts", "event_id"], "x")


@query("dp_quantile_det", """
WITH c AS (SELECT least(greatest(floor((o_totalprice - 0) / (600000.0::DOUBLE / 1024)), 0), 1023)::INT AS cell, count(*)::DOUBLE AS n FROM orders GROUP BY 1),
g AS (SELECT r::INT AS cell, coalesce(n, 0) AS n FROM range(1024) t(r) LEFT JOIN c ON c.cell = r),
s AS (SELECT cell, -abs(sum(n) OVER (ORDER BY cell) - n / 2 - 0.5 * sum(n) OVER ()) * 1.0 / 2 AS s, sum(n) OVER () AS total FROM g),
p AS (SELECT cell, total, exp(s - max(s) OVER ()) AS p FROM s), q AS (SELECT cell, total, sum(p) OVER (ORDER BY cell) / sum(p) OVER () AS c FROM p)
SELECT max(total)::BIGINT AS n, round((min(cell) + 0.5) * (600000.0::DOUBLE / 1024), 6) AS quantile FROM q WHERE c >= 0.37""")
def dp_quantile_det(spark, sf):
    return d.dp_quantile(table(spark, sf, "orders"), "o_totalprice", 0.5, 0.0, 600_000.0, 1.0, 0.37)
