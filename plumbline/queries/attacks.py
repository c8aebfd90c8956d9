"""Rows scored by published marginals, attributes guessed, links with a control; private moments; statements that can't all be true."""

from pyspark.sql import functions as F

from plumbline.operators import attacks, contradictions, private
from plumbline.operators.noise import gaussian_scale
from plumbline.operators.ranks import exact_quantiles
from plumbline.plans.blueprint import Marginal
from plumbline.queries.related import _u
from plumbline.registry import query, table

DECILES = [i / 10 for i in range(11)]


@query("blueprint_likelihood", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice * 1.01::DOUBLE END AS x, o_orderstatus AS s FROM orders),
k AS (SELECT unnest(range(11)) AS i, unnest(quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS v FROM orders),
g AS (SELECT a.i, a.v AS v0, b.v AS v1 FROM k a JOIN k b ON b.i = a.i + 1), n AS (SELECT s, ln(count(*)::DOUBLE / (SELECT count(*) FROM orders)) AS p FROM o GROUP BY s),
f AS (SELECT o.o_orderkey, arg_min(ln(greatest(0.1::DOUBLE / (v1 - v0), 1e-12)), i) AS d FROM o JOIN g ON o.x BETWEEN v0 AND v1 GROUP BY 1)
SELECT o_orderkey, round(CASE WHEN x IS NULL THEN ln(0.1::DOUBLE) ELSE ln(0.9::DOUBLE) + coalesce(d, -12) END + p + ln(1.0::DOUBLE), 6) AS log_likelihood FROM o JOIN n USING (s) LEFT JOIN f USING (o_orderkey)""")
def blueprint_likelihood(spark, sf):
    """Orders by the deciles of prices and the shares of states; some without a price, some with one beyond all that is published."""
    orders = table(spark, sf, "orders")
    knots = list(zip(DECILES, exact_quantiles(orders, "o_totalprice", DECILES), strict=True))
    levels = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).collect()  # a few states
    marginals = {"x": Marginal(0.9, knots), "s": Marginal(1.0, levels=[r.o_orderstatus for r in levels], weights=[float(r.n) for r in levels])}
    rows = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") * 1.01).alias("x"), F.col("o_orderstatus").alias("s"))
    return attacks.blueprint_likelihood(rows, marginals).select("o_orderkey", F.round("log_likelihood", 6).alias("log_likelihood"))


def _people(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", F.floor(F.col("o_totalprice") / 50_000).alias("price"), F.month("o_orderdate").alias("month"), "o_orderstatus", F.col("o_totalprice").alias("exact"))
    return orders.where("o_custkey % 2 = 0"), orders.where("o_custkey % 2 = 1")


@query("attribute_disclosure")
def attribute_disclosure(spark, sf):
    """How much better orders' states are guessed from the members' own rows than from other customers'."""
    members, others = _people(spark, sf)
    return attacks.attribute_disclosure(members, others, members, ["price", "month"], "o_orderstatus")


@query("linkage_with_control", """
WITH o AS (SELECT o_custkey % 2 AS arm, floor(o_totalprice / 50000)::BIGINT AS price, month(o_orderdate::DATE) AS month, o_totalprice AS x FROM orders),
sd AS (SELECT stddev_pop(x) AS sd FROM o), r AS (SELECT price, month, 1.1::DOUBLE * x AS x FROM o WHERE arm = 1),
h AS (SELECT price, month, avg(x) AS m FROM r GROUP BY ALL HAVING count(*) >= 5), c AS (SELECT price, month, avg(x) AS m FROM o WHERE arm = 0 GROUP BY ALL HAVING count(*) >= 5),
eh AS (SELECT arm, round(avg(abs(m - x) / sd), 6) AS e FROM o JOIN h USING (price, month), sd GROUP BY arm), ec AS (SELECT arm, round(avg(abs(m - x) / sd), 6) AS e FROM o JOIN c USING (price, month), sd GROUP BY arm),
e AS (SELECT (SELECT e FROM eh WHERE arm = 1) - (SELECT e FROM eh WHERE arm = 0) AS honest, (SELECT e FROM ec WHERE arm = 1) - (SELECT e FROM ec WHERE arm = 0) AS control),
s AS (SELECT *, CASE WHEN control >= 0.02 AND honest > 0 THEN honest / control WHEN control >= 0.02 AND honest IS NOT NULL THEN 0.0::DOUBLE END AS share FROM e)
SELECT round(honest, 6) AS honest, round(control, 6) AS control, round(share, 6) AS share, CASE WHEN share IS NULL THEN 'UNREADABLE' WHEN share <= 0 THEN 'CLEAN' WHEN share >= 0.5 THEN 'LEAK' ELSE 'PARTIAL' END AS verdict FROM s""")
def linkage_with_control(spark, sf):
    """Prices of members and others guessed from a release made of the others, and from the members' own rows."""
    members, others = _people(spark, sf)
    released = others.withColumn("exact", F.col("exact") * 1.1)
    return attacks.with_control(members, others, released, ["price", "month"], "exact")


RANGES, SCALE = {"price": (0.0, 600_000.0), "day": (0.0, 2_600.0)}, gaussian_scale(0.5, 5e-6, 1)


def _noise(i, j):
    a, b = (_u(f"'52:moments:{i}:{j}:{x}'") for x in "ab")
    return f"{SCALE!r}::DOUBLE * sqrt(-2.0 * ln({a})) * cos(6.283185307179586 * {b})"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_custkey", F.col("o_totalprice").alias("price"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("day"))


@query("private_moments", f"""
WITH p AS (SELECT o_custkey, greatest(least(avg(o_totalprice) * 2 / 600000 - 1, 1), -1) AS a, greatest(least(avg(date_diff('day', DATE '1992-01-01', o_orderdate::DATE)) * 2 / 2600 - 1, 1), -1) AS b FROM orders GROUP BY 1),
c AS (SELECT a * k AS a, b * k AS b FROM (SELECT *, CASE WHEN sqrt(a * a + b * b) > 1 THEN 1 / sqrt(a * a + b * b) ELSE 1 END AS k FROM p))
""" + " UNION ALL ".join(f"SELECT count(*) AS n, {i} AS i, {j} AS j, round(sum({x}) + {_noise(i, j)}, 6) AS sum FROM c" for i, j, x in ((-1, 0, "a"), (-1, 1, "b"), (0, 0, "a * a"), (0, 1, "a * b"), (1, 1, "b * b"))))
def private_moments(spark, sf):
    """Noised sums and products of customers' mean prices and days."""
    made = private.moments(_orders(spark, sf), "o_custkey", RANGES, 1.0, 1.0, 1e-5, 52)
    return made.select("n", "i", "j", F.round("sum", 6).alias("sum"))


@query("private_gaussian", "SELECT * FROM (VALUES ('price', true), ('day', true)) AS v(column_name, within)")
def private_gaussian(spark, sf):
    """Customers drawn from the released normal distribution: their means within the given ranges and three deviations of the released ones."""
    model = private.private_gaussian(_orders(spark, sf), "o_custkey", RANGES, 1.0, 1.0, 1e-5, 52)
    made = private.draw(table(spark, sf, "customer").select("c_custkey"), "c_custkey", model, 53)
    ends = made.agg(*[f(c).alias(f"{n}_{c}") for c in RANGES for n, f in (("low", F.min), ("mean", F.avg), ("high", F.max))]).first()
    rows = []
    for i, (c, (low, high)) in enumerate(RANGES.items()):
        centre, spread = low + (model.mean[i] + 1) * (high - low) / 2, model.cov[i, i] ** 0.5 * (high - low) / 2
        rows.append((c, bool(low <= ends[f"low_{c}"] and ends[f"high_{c}"] <= high and abs(ends[f"mean_{c}"] - min(max(centre, low), high)) <= 3 * spread)))
    return spark.createDataFrame(rows, "column_name string, within boolean")


@query("private_bounds")
def private_bounds(spark, sf):
    """Bounds of customers' mean prices, each end with half of the loss."""
    return private.private_bounds(_orders(spark, sf), "o_custkey", "price", 0.0, 600_000.0, 2.0, 54, (0.02, 0.98))


CLAIMS = [("l_discount", "l_linenumber", False), ("l_linenumber", "l_quantity", False), ("l_quantity", "l_extendedprice", True), ("l_extendedprice", "o_totalprice", False), ("o_totalprice", "c_acctbal", False), ("early", "late", True), ("late", "early", False), ("here", "there", False), ("there", "here", False)]


@query("contradictions", """
WITH RECURSIVE o(a, b, strict) AS (VALUES """ + ", ".join(f"('{a}', '{b}', {int(s)})" for a, b, s in CLAIMS) + """),
b AS (SELECT 'l_discount' AS name, min(l_discount)::DOUBLE AS low, max(l_discount)::DOUBLE AS high FROM lineitem UNION ALL SELECT 'l_linenumber', min(l_linenumber), max(l_linenumber) FROM lineitem UNION ALL SELECT 'l_quantity', min(l_quantity), max(l_quantity) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem UNION ALL SELECT 'o_totalprice', min(o_totalprice), max(o_totalprice) FROM orders UNION ALL SELECT 'c_acctbal', min(c_acctbal), min(o_totalprice) - 1 FROM customer, orders),
c(a, b, strict) AS (SELECT * FROM o UNION SELECT c.a, o.b, greatest(c.strict, o.strict) FROM c JOIN o ON c.b = o.a),
n AS (SELECT name, greatest(low, (SELECT max(x.low) FROM c JOIN b x ON x.name = c.a WHERE c.b = b.name)) AS low, least(high, (SELECT min(x.high) FROM c JOIN b x ON x.name = c.b WHERE c.a = b.name)) AS high FROM b)
SELECT 'circle' AS rule, a AS name, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM c WHERE a = b GROUP BY a HAVING max(strict) = 1 UNION ALL SELECT 'bounds', name, low, high FROM n WHERE low > high""")
def contradictions_found(spark, sf):
    """Orderings that were claimed, held against each other and against bounds: two names in a strict circle, two that are merely equal, and a chain whose end has no room."""
    ends = lambda t, c: table(spark, sf, t).agg(F.lit(c).alias("name"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"))
    bounds = ends("orders", "o_totalprice")
    for c in ("l_discount", "l_linenumber", "l_quantity", "l_extendedprice"):
        bounds = bounds.union(ends("lineitem", c))
    tight = table(spark, sf, "customer").agg(F.min("c_acctbal").cast("double").alias("low")).crossJoin(table(spark, sf, "orders").agg((F.min("o_totalprice") - 1).cast("double").alias("high")))  # a row each
    bounds = bounds.union(tight.select(F.lit("c_acctbal"), "low", "high"))
    return contradictions.find(bounds, spark.createDataFrame(CLAIMS, "a string, b string, strict boolean"))


@query("implied_means", """
WITH k AS (SELECT unnest(['even', 'heavy']) AS name, unnest([quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0]), quantile_cont(pow(o_totalprice / 1000, 3), [0.0, 0.25, 0.5, 0.75, 1.0])]) AS v FROM orders),
m AS (SELECT 'even' AS name, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS sd FROM orders UNION ALL SELECT 'heavy', avg(pow(o_totalprice / 1000, 3)), NULL FROM orders),
i AS (SELECT name, (v[1] / 2 + v[2] + v[3] + v[4] + v[5] / 2) / 4 AS implied FROM k),
g AS (SELECT *, CASE WHEN sd > 0 THEN abs(implied - mean) / sd / 0.1 ELSE abs(implied - mean) / abs(mean) / 0.05 END AS gap FROM m JOIN i USING (name))
SELECT name, round(mean, 6) AS mean, round(implied, 6) AS implied, round(gap, 6) AS gap FROM g WHERE gap > 1""")
def implied_means(spark, sf):
    """Quartiles as a blueprint would publish them: fair for prices, far off for their cubes."""
    orders = table(spark, sf, "orders").select(F.col("o_totalprice").alias("even"), F.pow(F.col("o_totalprice") / 1000, F.lit(3)).alias("heavy"))
    at = [0.0, 0.25, 0.5, 0.75, 1.0]
    knots = spark.createDataFrame([(c, q, v) for c in ("even", "heavy") for q, v in zip(at, exact_quantiles(orders, c, at), strict=True)], "name string, q double, v double")
    one = lambda c, sd: orders.agg(F.lit(c).alias("name"), F.avg(c).alias("mean"), sd.alias("sd"))
    return contradictions.implied_means(knots, one("even", F.stddev_pop("even")).union(one("heavy", F.lit(None).cast("double"))))
