"""One half of a table held against the other, and associations within one."""

from pyspark.sql import functions as F

from plumbline.operators import fidelity as f
from plumbline.operators import metrics as m
from plumbline.registry import query, table


def halves(spark, sf):
    events = table(spark, sf, "events")
    return events.where("user_id % 2 = 0"), events.where("user_id % 2 = 1")


EDGES = "(SELECT list_sort(list_distinct(quantile_cont({x}, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1.0])))[2:-2] AS e FROM {t})"
A, B = "(SELECT * FROM events WHERE user_id % 2 = 0)", "(SELECT * FROM events WHERE user_id % 2 = 1)"


def _tvd(a, b):
    return f"SELECT count(*) AS n_cells, round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS tvd FROM (SELECT k, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM {a} GROUP BY k) FULL JOIN (SELECT k, count(*)::DOUBLE / sum(count(*)) OVER () AS q FROM {b} GROUP BY k) USING (k)"


def _binned(t, x, edges):
    return f"(SELECT len(list_filter(e, lambda v: v <= {x})) AS k FROM {t}, {edges})"


E1 = EDGES.format(x="value", t=A)


@query("tvd_univariate", _tvd(_binned(A, "value", E1), _binned(B, "value", E1)))
def tvd_univariate(spark, sf):
    return f.tvd_numeric(*halves(spark, sf), "value")


@query("tvd_levels", _tvd(f"(SELECT event_type AS k FROM {A})", f"(SELECT event_type AS k FROM {B})"))
def tvd_levels(spark, sf):
    return f.tvd_levels(*halves(spark, sf), "event_type")


LA, LB = "(SELECT * FROM lineitem WHERE l_orderkey % 2 = 0)", "(SELECT * FROM lineitem WHERE l_orderkey % 2 = 1)"


def _pair(t):
    ex, ey = (EDGES.format(x=x, t=LA).replace(" AS e ", f" AS {n} ") for x, n in (("l_quantity", "ex"), ("l_extendedprice", "ey")))
    return f"(SELECT (len(list_filter(ex, lambda v: v <= l_quantity)), len(list_filter(ey, lambda v: v <= l_extendedprice))) AS k FROM {t}, {ex}, {ey})"


@query("tvd_bivariate", _tvd(_pair(LA), _pair(LB)))
def tvd_bivariate(spark, sf):
    lines = table(spark, sf, "lineitem")
    return f.tvd_pair(lines.where("l_orderkey % 2 = 0"), lines.where("l_orderkey % 2 = 1"), "l_quantity", "l_extendedprice")


@query("ks_distance", """
WITH u AS (SELECT o_totalprice AS x, (o_custkey % 2 = 0)::INT AS s FROM orders),
c AS (SELECT x, sum(sum(s)) OVER (ORDER BY x) AS a, sum(sum(1 - s)) OVER (ORDER BY x) AS b FROM u GROUP BY x),
t AS (SELECT sum(s) AS na, sum(1 - s) AS nb FROM u)
SELECT na::BIGINT AS n_source, nb::BIGINT AS n_other, round(max(abs(a::DOUBLE / na - b::DOUBLE / nb)), 6) AS ks FROM c, t GROUP BY ALL""")
def ks_distance(spark, sf):
    orders = table(spark, sf, "orders")
    return f.ks(orders.where("o_custkey % 2 = 0"), orders.where("o_custkey % 2 = 1"), "o_totalprice")


@query("marginal_bands", """
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]))) AS e FROM orders WHERE o_custkey % 2 = 0),
b AS (SELECT len(list_filter(e, lambda v: v < o_totalprice)) AS band, (o_custkey % 2 = 0)::INT AS s FROM orders, e),
c AS (SELECT band, sum(s) AS a, sum(1 - s) AS b FROM b GROUP BY band)
SELECT band::INT AS band, round(a::DOUBLE / sum(a) OVER (), 6) AS share_source, round(b::DOUBLE / sum(b) OVER (), 6) AS share_other FROM c""")
def marginal_bands(spark, sf):
    orders = table(spark, sf, "orders")
    return f.marginal_bands(orders.where("o_custkey % 2 = 0"), orders.where("o_custkey % 2 = 1"), "o_totalprice")


@query("cond_curve", """
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [i / 12.0 for i in range(13)])))[2:-2] AS e FROM lineitem)
SELECT len(list_filter(e, lambda v: v <= l_quantity))::INT AS bin, round(avg(l_quantity), 6) AS x, round(avg(l_extendedprice), 6) AS y, count(*) AS n, round(stddev_samp(l_extendedprice), 6) AS sd, count(DISTINCT l_orderkey) AS entities
FROM lineitem, e GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT l_orderkey) >= 10""".replace("[i / 12.0 for i in range(13)]", "[" + ", ".join(repr(i / 12) for i in range(13)) + "]"))
def cond_curve(spark, sf):
    return f.cond_curve(table(spark, sf, "lineitem"), "l_orderkey", "l_quantity", "l_extendedprice")


@query("surface_grid", """
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0, .25, .5, .75, 1.0])))[2:-2] AS ex, list_sort(list_distinct(quantile_cont(l_discount, [0, .25, .5, .75, 1.0])))[2:-2] AS ey FROM lineitem)
SELECT len(list_filter(ex, lambda v: v <= l_quantity))::INT AS bx, len(list_filter(ey, lambda v: v <= l_discount))::INT AS by, count(*) AS n, round(avg(l_extendedprice), 6) AS mean FROM lineitem, e GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 10""")
def surface_grid(spark, sf):
    return f.surface(table(spark, sf, "lineitem"), "l_orderkey", "l_quantity", "l_discount", "l_extendedprice")


@query("cramers_v", """
WITH c AS (SELECT event_type AS a, user_id % 4 AS b, count(*)::DOUBLE AS n FROM events GROUP BY ALL), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY a), cb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b),
w AS (SELECT sum(n)::BIGINT AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM c), q AS (SELECT sum(n * n / (na * nb)) AS q FROM c JOIN ra USING (a) JOIN cb USING (b))
SELECT n, r, c, round(sqrt(greatest(q - 1, 0) / (least(r, c) - 1)), 6) AS v FROM w, q""")
def cramers_v(spark, sf):
    return f.cramers_v(table(spark, sf, "events").withColumn("part", F.col("user_id") % 4), "event_type", "part")


@query("eta_squared", """
WITH p AS (SELECT o_orderpriority, count(*)::DOUBLE AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS ss FROM orders GROUP BY 1),
o AS (SELECT sum(n) AS n, sum(ss) AS ssw, sum(n * m * m) AS nm2, sum(n * m) / sum(n) AS mean FROM p)
SELECT n::BIGINT AS n, round((nm2 - n * mean * mean) / (nm2 - n * mean * mean + ssw), 6) AS eta_squared, round(sqrt((nm2 - n * mean * mean) / (nm2 - n * mean * mean + ssw)), 6) AS eta FROM o""")
def eta_squared(spark, sf):
    return f.eta(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")


def _mi(given):
    c = given or "0"
    return f"""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, {c} AS c, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL)
SELECT sum(n)::BIGINT AS n, round(sum(n / t * ln(n * nc / (na * nb))), 6) AS information FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a, c) AS na, sum(n) OVER (PARTITION BY b, c) AS nb, sum(n) OVER (PARTITION BY c) AS nc FROM c)"""


@query("mutual_information", _mi(None))
def mutual_information(spark, sf):
    return f.mutual_information(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("conditional_mutual_information", _mi("l_linenumber"))
def conditional_mutual_information(spark, sf):
    return f.mutual_information(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


ORDERED = ["l_linenumber", "l_quantity", "double_quantity", "l_extendedprice"]


@query("ordering_constraints", "WITH l AS (SELECT *, l_quantity * 2 AS double_quantity FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(min({b} - {a}), 6) AS min_gap FROM l HAVING count(*) >= 100 AND bool_and({a} <= {b}) AND min({b} - {a}) <= 2 * least(stddev_pop({a}), stddev_pop({b}))" for a in ORDERED for b in ORDERED if a != b))
def ordering_constraints(spark, sf):
    return f.orderings(table(spark, sf, "lineitem").withColumn("double_quantity", F.col("l_quantity") * 2), ORDERED)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs(df):
    """(a, b, r) of all pairs of numeric columns in one pass."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def pair_table(spark, sf):
    lines = table(spark, sf, "lineitem")
    s, g = (_pairs(lines.where(f"l_orderkey % 2 = {i}")).withColumnRenamed("r", n) for i, n in ((0, "source"), (1, "other")))
    return s.join(g, ["a", "b"])


PAIR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) FILTER (WHERE l_orderkey % 2 = 0) AS source, corr({a}, {b}) FILTER (WHERE l_orderkey % 2 = 1) AS other FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :])


@query("pair_fidelity", f"SELECT a, b, round(source, 6) AS source, round(other, 6) AS other, abs(source - other) <= 0.2 AS close FROM ({PAIR_SQL})")
def pair_fidelity(spark, sf):
    return pair_table(spark, sf).select("a", "b", F.round("source", 6).alias("source"), F.round("other", 6).alias("other"), (F.abs(F.col("source") - F.col("other")) <= 0.2).alias("close"))


@query("gate_assess", f"""SELECT count(*) AS n_pairs, round(avg((source * other > 0)::INT), 6) AS direction, round(avg((abs(source - other) <= 0.2)::INT), 6) AS close, count(*) FILTER (WHERE source * other < 0 AND abs(other) >= 0.1) AS inverted,
CASE WHEN count(*) = 0 THEN 'NO_PAIRS' WHEN avg((source * other > 0)::INT) >= 0.939 AND avg((abs(source - other) <= 0.2)::INT) >= 0.879 AND count(*) FILTER (WHERE source * other < 0 AND abs(other) >= 0.1) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({PAIR_SQL}) WHERE abs(source) >= 0.1""")
def gate_assess(spark, sf):
    return f.gate(pair_table(spark, sf))


def graded(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"), "quality", (F.least("n_chars", F.lit(4000)) / 4000.0).alias("p"))


GRADED = "(SELECT n_chars::DOUBLE AS score, quality, least(n_chars, 4000) / 4000.0::DOUBLE AS p FROM documents JOIN labels USING (doc_id))"


@query("auroc", f"""
WITH k AS (SELECT quality AS y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM {GRADED}),
a AS (SELECT sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS n, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE AS a FROM k),
s AS (SELECT *, sqrt((a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)) / (p * n)::DOUBLE) AS se FROM a)
SELECT p AS positives, n AS negatives, round(a, 6) AS auroc, round(greatest(a - 1.96::DOUBLE * se, 0), 6) AS low, round(least(a + 1.96::DOUBLE * se, 1), 6) AS high FROM s""")
def auroc(spark, sf):
    return m.auroc(graded(spark, sf), "score", "quality")


@query("brier", f"SELECT count(*) AS n, round(avg((p - quality) * (p - quality)), 6) AS brier FROM {GRADED}")
def brier(spark, sf):
    return m.brier(graded(spark, sf), "p", "quality")


@query("at_threshold", f"""
WITH c AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND quality = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND quality = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND quality = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND quality = 0) AS tn FROM {GRADED}),
w AS (SELECT *, tp::DOUBLE / (tp + fn) AS r, (tp + fn)::DOUBLE AS n, 1.96::DOUBLE AS z FROM c)
SELECT tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(r, 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1,
  round(greatest((r + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(r * (1 - r) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0), 6) AS recall_low, round(least((r + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(r * (1 - r) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1), 6) AS recall_high FROM w""")
def at_threshold(spark, sf):
    return m.at_threshold(graded(spark, sf), "p", "quality")


@query("ordinal_c", """
WITH c AS (SELECT l_linenumber % 3 AS l, l_quantity AS s, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
p AS (SELECT a.l AS la, b.l AS lb, sum(a.n * b.n) AS w, sum(a.n * b.n * CASE WHEN b.s > a.s THEN 1.0 WHEN b.s = a.s THEN 0.5 ELSE 0 END) / sum(a.n * b.n) AS auc FROM c a JOIN c b ON a.l < b.l GROUP BY ALL)
SELECT sum(w)::BIGINT AS n_pairs, round(sum(w * auc) / sum(w), 5) AS ordinal_c FROM p""")
def ordinal_c(spark, sf):
    return m.ordinal_c(table(spark, sf, "lineitem").withColumn("level", F.col("l_linenumber") % 3), "l_quantity", "level")


@query("regression_ceiling", """
SELECT count(*) AS n, round(1 - sum((o_totalprice - p) * (o_totalprice - p)) / (var_pop(o_totalprice) * count(*)), 6) AS r2, round(sqrt(sum((o_totalprice - p) * (o_totalprice - p)) / count(*)), 6) AS rmse, round(avg(abs(o_totalprice - p)), 6) AS mae, round(least(var_pop(s) / var_pop(o_totalprice), 1), 6) AS ceiling_r2
FROM (SELECT o_totalprice, o_totalprice * 0.9::DOUBLE + (o_custkey % 10) * 100 AS p, o_totalprice * 0.95::DOUBLE AS s FROM orders)""")
def regression_ceiling(spark, sf):
    orders = table(spark, sf, "orders").select("o_totalprice", (F.col("o_totalprice") * 0.9 + (F.col("o_custkey") % 10) * 100).alias("p"), (F.col("o_totalprice") * 0.95).alias("s"))
    return m.regression(orders, "o_totalprice", "s", "p")
