"""Draws from marginals, repairs, notes and their readers."""

from pyspark.sql import functions as F

from plumbline.functions import seeds
from plumbline.operators import dynamics, fidelity
from plumbline.operators.metrics import auroc
from plumbline.plans import blueprint as b
from plumbline.plans import notes
from plumbline.registry import query, table


def _u(key):
    return f"((('0x' || substr(sha256({key}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"


@query("blueprint_generate")
def blueprint_generate(spark, sf):
    """Orders drawn from their own published marginals, held against them."""
    orders = table(spark, sf, "orders")
    marginals = b.fit(orders, "o_custkey", ["o_totalprice"], ["o_orderpriority", "o_orderstatus"])
    made = b.draw(orders.select("o_orderkey"), "o_orderkey", marginals, 5)
    gaps = [fidelity.tvd_numeric(orders, made, "o_totalprice").select(F.lit("o_totalprice").alias("column_name"), "tvd"), *[fidelity.tvd_levels(orders, made, c).select(F.lit(c).alias("column_name"), "tvd") for c in ("o_orderpriority", "o_orderstatus")]]
    return gaps[0].union(gaps[1]).union(gaps[2])


@query("sticky_levels", f"""
WITH r AS (SELECT event_id, user_id, row_number() OVER w AS rn, {_u("'3:' || user_id::VARCHAR || ':' || event_id::VARCHAR || ':stay'")} AS s, {_u("'3:' || user_id::VARCHAR || ':' || event_id::VARCHAR || ':draw'")} AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, CASE WHEN rn = 1 OR s >= 0.6 THEN CASE WHEN d < 0.5 THEN 'low' WHEN d < 0.8 THEN 'mid' ELSE 'high' END END AS fresh FROM r)
SELECT event_id, last_value(fresh IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS level FROM f""")
def sticky_levels(spark, sf):
    return b.sticky(table(spark, sf, "events"), "user_id", ["event_id"], ["low", "mid", "high"], [0.5, 0.3, 0.2], 0.6, 3, "level").select("event_id", "level")


@query("token_sets", f"""
WITH t AS (SELECT c_custkey, t.t, -ln({_u("'9:' || c_custkey::VARCHAR || ':' || t.t")}) / t.w AS k FROM customer, (VALUES ('a', 5.0::DOUBLE), ('b', 3.0::DOUBLE), ('c', 1.0::DOUBLE), ('d', 1.0::DOUBLE)) AS t(t, w)),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY k, t) AS rn FROM t)
SELECT c_custkey, string_agg(t, ';' ORDER BY rn) AS tokens FROM r WHERE rn <= 1 + c_custkey % 3 GROUP BY c_custkey""")
def token_sets(spark, sf):
    drawn = b.token_set(F.col("c_custkey"), list("abcd"), [5.0, 3.0, 1.0, 1.0], (1 + F.col("c_custkey") % 3).cast("int"), 9)
    return table(spark, sf, "customer").select("c_custkey", F.array_join(drawn, ";").alias("tokens"))


@query("enforce_orderings", "SELECT l_orderkey, l_linenumber, round(least(l_discount, l_tax), 6) AS l_discount, round(greatest(l_discount, l_tax), 6) AS l_tax FROM lineitem")
def enforce_orderings(spark, sf):
    return b.enforce(table(spark, sf, "lineitem"), [("l_discount", "l_tax")]).select("l_orderkey", "l_linenumber", F.round("l_discount", 6).alias("l_discount"), F.round("l_tax", 6).alias("l_tax"))


@query("values_in_visit_order", """
WITH a AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), v AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k FROM orders)
SELECT o_orderkey, o_totalprice FROM a JOIN v USING (o_custkey, k)""")
def values_in_visit_order(spark, sf):
    return b.in_order(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"], "o_totalprice").select("o_orderkey", "o_totalprice")


Z = "(0.2::DOUBLE + 1.5::DOUBLE * (l_quantity - mq) / sq - 0.5::DOUBLE * (l_discount - md) / sd)"


@query("gen_outcome", f"""
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem)
SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-{Z})), 6) AS p, ({_u("'4:' || l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || ':outcome'")} < 1 / (1 + exp(-{Z})))::INT AS outcome FROM lineitem, s""")
def gen_outcome(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("row", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    made = b.outcome(lines, "row", {"l_quantity": 1.5, "l_discount": -0.5}, 0.2, 4)
    return made.select("l_orderkey", "l_linenumber", F.round("outcome_p", 6).alias("p"), "outcome")


@query("ceiling_auroc")
def ceiling_auroc(spark, sf):
    """The best any reader of these columns can do: the AUROC of the true probabilities."""
    lines = table(spark, sf, "lineitem").withColumn("row", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return auroc(b.outcome(lines, "row", {"l_quantity": 1.5, "l_discount": -0.5}, 0.2, 4), "outcome_p", "outcome")


FACTS = {"high_price": "o_totalprice > 300000", "urgent_order": "o_orderpriority = '1-URGENT'", "open_order": "o_orderstatus = 'O'"}


def written(spark, sf):
    return notes.write(table(spark, sf, "orders"), "o_orderkey", {k: F.expr(v) for k, v in FACTS.items()}, 0.3, 8)


def _grade(claimed):
    rows = " UNION ALL ".join(f"SELECT {_u(chr(39) + '8:' + chr(39) + ' || o_orderkey::VARCHAR || ' + chr(39) + f':{f}:trap' + chr(39))} AS u FROM orders WHERE {c}" for f, c in FACTS.items())
    return f"""WITH x AS ({rows}), t AS (SELECT CASE WHEN u < 0.3 THEN ['negation', 'hedge', 'history'][floor(u / 0.3::DOUBLE * 3)::INT + 1] ELSE 'clean' END AS trap FROM x),
c AS (SELECT trap, count(*) FILTER (WHERE trap = 'clean') AS stated, count(*) FILTER (WHERE trap = 'clean') AS found, count(*) FILTER (WHERE trap <> 'clean') AS trapped, count(*) FILTER (WHERE trap <> 'clean' AND {claimed}) AS fell FROM t GROUP BY trap)
SELECT *, round(found / nullif(stated, 0)::DOUBLE, 6) AS recall, round(fell / nullif(trapped, 0)::DOUBLE, 6) AS false_positive_rate FROM c"""


@query("note_grading_naive", _grade("true"))
def note_grading_naive(spark, sf):
    return notes.grade(written(spark, sf).withColumn("claims", notes.naive_reader(F.col("note"), list(FACTS))), "claims")


@query("note_grading_careful", _grade("false"))
def note_grading_careful(spark, sf):
    return notes.grade(written(spark, sf).withColumn("claims", notes.careful_reader(F.col("note"), list(FACTS))), "claims")


@query("grounding_census", """
SELECT CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'both' WHEN o_orderkey % 2 = 0 THEN 'text_only' WHEN o_orderkey % 3 = 0 THEN 'record_only' ELSE 'ungrounded' END AS support, count(*) AS claims FROM orders GROUP BY 1""")
def grounding_census(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    return notes.grounding(orders, orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 3 = 0"), ["o_orderkey", "label"])


@query("run_consistency", "SELECT count(*) FILTER (WHERE o_orderkey % 4 <> 0 OR o_orderkey % 5 <> 0) AS n_claims, count(*) FILTER (WHERE o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0) AS agreed, round(count(*) FILTER (WHERE o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0)::DOUBLE / count(*) FILTER (WHERE o_orderkey % 4 <> 0 OR o_orderkey % 5 <> 0), 6) AS agreement FROM orders")
def run_consistency(spark, sf):
    orders = table(spark, sf, "orders")
    return notes.consistency(orders.where("o_orderkey % 4 <> 0"), orders.where("o_orderkey % 5 <> 0"), ["o_orderkey"])


@query("autoclean", "SELECT o_orderkey AS row_id, o_orderpriority AS priority, o_orderkey > min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS duplicate FROM orders")
def autoclean(spark, sf):
    """Priorities with their case and spaces spoiled on a third of the rows, cleaned again."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    dirty = table(spark, sf, "orders").select(k.alias("row_id"), F.when(k % 7 == 0, F.lower(p)).when(k % 5 == 0, F.concat(F.lit("  "), p, F.lit(" "))).otherwise(p).alias("priority"))
    return notes.autoclean(dirty, ["priority"])


@query("lag_curve", """
WITH p AS (SELECT o_totalprice AS x, lag(o_totalprice) OVER w AS p, date_diff('day', lag(o_orderdate::DATE) OVER w, o_orderdate::DATE) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey))
SELECT CASE WHEN gap < 30 THEN 30 WHEN gap < 90 THEN 90 WHEN gap < 365 THEN 365 ELSE 10000 END AS within_days, count(*) AS n_pairs, round(corr(p, x), 6) AS r FROM p WHERE p IS NOT NULL GROUP BY 1""")
def lag_curve(spark, sf):
    """Correlation of neighbouring orders of a customer by the days between them."""
    from pyspark.sql import Window

    day = F.to_date("o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy(day, "o_orderkey")
    pairs = table(spark, sf, "orders").select(F.col("o_totalprice").alias("x"), F.lag("o_totalprice").over(w).alias("p"), F.datediff(day, F.lag(day).over(w)).alias("gap")).where("p is not null")
    bucket = F.when(F.col("gap") < 30, 30).when(F.col("gap") < 90, 90).when(F.col("gap") < 365, 365).otherwise(10_000)
    return pairs.groupBy(bucket.alias("within_days")).agg(F.count("*").alias("n_pairs"), F.round(F.corr("p", "x"), 6).alias("r"))
