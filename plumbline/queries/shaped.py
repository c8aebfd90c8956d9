"""Steady series, curves, surfaces and tails in what is drawn."""

from math import ceil, log

from pyspark.sql import functions as F

from plumbline.functions import seeds
from plumbline.functions.stats import normal_cdf
from plumbline.operators import persistence, planting
from plumbline.operators.ranks import exact_quantiles
from plumbline.plans import blueprint, shaped
from plumbline.queries.related import _u
from plumbline.registry import query, table
from plumbline.sources.shared import written


def _normal(key):
    a, b = (_u(f"{key} || ':{x}'") for x in "ab")
    return f"(sqrt(-2.0 * ln({a})) * cos(6.283185307179586 * {b}))"


ICC, LAG, SEED, ROWS = 0.3, 0.6, 41, 10.0
ANCHOR, RHO = persistence.solve_latent(ICC, LAG, ROWS)
REACH = ceil(log(1e-12) / log(RHO))


@query("persistent_draws", f"""
WITH e AS (SELECT user_id, event_id, {_normal(f"'{SEED}:' || user_id::VARCHAR || ':' || event_id::VARCHAR")} AS e, {_normal(f"'{SEED}:' || user_id::VARCHAR || ':anchor'")} AS own FROM events),
w AS (SELECT event_id, own, list_reduce(list(e) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {REACH} PRECEDING AND CURRENT ROW), lambda s, x: {RHO!r}::DOUBLE * s + {(1 - RHO * RHO) ** 0.5!r}::DOUBLE * x) AS drift FROM e),
z AS (SELECT event_id, {ANCHOR**0.5!r}::DOUBLE * own + {(1 - ANCHOR) ** 0.5!r}::DOUBLE * drift AS z FROM w),
t AS (SELECT event_id, z, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM z),
b AS (SELECT event_id, z, exp(-z * z / 2) * 0.3989422804014327::DOUBLE * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) AS b FROM t)
SELECT event_id, round(CASE WHEN z > 0 THEN 1 - b ELSE b END, 6) AS u FROM b""")
def persistent_draws(spark, sf):
    """An even series for each user's events, with an anchor and an AR(1) that measure back an intraclass correlation of 0.3 and neighbours' correlation of 0.6 over ten rows."""
    events = table(spark, sf, "events").select("user_id", "event_id")
    made = persistence.persistent(events, "user_id", ["event_id"], ANCHOR, RHO, SEED, "z")
    return made.select("event_id", F.round(normal_cdf(F.col("z")), 6).alias("u"))


@query("persistence_calibrated", "SELECT * FROM (VALUES ('draw', 'lag1', 0.5::DOUBLE, true), ('draw', 'icc', 0.3::DOUBLE, true), ('child', 'lag1', 0.5::DOUBLE, true)) AS v(what, statistic, asked, met)")
def persistence_calibrated(spark, sf):
    """What is asked of a series comes out when it is measured, within 0.02 and the sampling error of so many customers; also of a skewed child that half depends on something without steadiness."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    plain = persistence.persistent_uniform(orders, "o_custkey", ["o_orderkey"], 0.3, 0.5, 42, "u")
    icc, lag = persistence.steadiness(plain, "o_custkey", ["o_orderkey"], "u")
    shape = lambda u: F.pow(u, F.lit(2)) + 0.4 * seeds.uniform(43, F.col("o_orderkey"), "parent")
    _, _, got = persistence.calibrate(orders, "o_custkey", ["o_orderkey"], shape, 0.3, 0.5, 42, "child")
    near = 0.02 + orders.agg(F.count_distinct("o_custkey").alias("n")).first().n ** -0.5
    rows = [("draw", "lag1", 0.5, lag), ("draw", "icc", 0.3, icc), ("child", "lag1", 0.5, got)]
    return spark.createDataFrame([(w, s, a, g is not None and abs(g - a) <= near) for w, s, a, g in rows], "what string, statistic string, asked double, met boolean")


@query("persistence_kept", """
WITH e AS (SELECT user_id, event_id, value, (event_id * 7919) % 1009 AS mixed, user_id % 50 + 0.1::DOUBLE * (event_id % 7) AS steady FROM events),
p AS (SELECT *, lag(value) OVER w AS v, lag(mixed) OVER w AS m, lag(steady) OVER w AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT greatest(-0.98, least(0.98, corr(s, steady))) AS source, greatest(-0.98, least(0.98, corr(m, mixed))) AS generated FROM p)
SELECT 'steady' AS column_name, round(source, 6) AS source, round(generated, 6) AS generated, abs(round(generated, 6)) >= 0.4 * abs(round(source, 6)) AS kept FROM r WHERE abs(round(source, 6)) >= 0.2""")
def persistence_kept(spark, sf):
    """A steady column against one of the same name that isn't; a column that never was steady isn't asked."""
    events = table(spark, sf, "events").select("user_id", "event_id", "value", (F.col("user_id") % 50 + 0.1 * (F.col("event_id") % 7)).alias("steady"))
    made = events.withColumn("steady", F.col("event_id") * 7919 % 1009)
    return persistence.persistence_kept(events, made, "user_id", ["event_id"], ["steady"])


CURVE = shaped.Curve([1_000.0, 50_000.0, 120_000.0, 200_000.0], [10.0, 30.0, 25.0, 60.0], 28.0)
LEVELS = shaped.Curve(["F", "O", "P"], [5.0, 20.0, 12.0], 13.0)
SURFACE = shaped.Surface([10_000.0, 100_000.0, 180_000.0], [100.0, 900.0], [[1.0, -2.0], [3.0, 8.0], [-4.0, 0.5]], 1.5)
PRESENCE = shaped.Curve([], [7.0], 6.4, missing=4.0)
RELATED = shaped.Relation("made", {"o_totalprice": CURVE, "o_orderstatus": LEVELS, "gap": PRESENCE}, {("o_totalprice", "o_custkey"): SURFACE}, 0.36, 0.8)
ALONE = shaped.Relation("made", {"o_totalprice": CURVE}, {}, 0.5)


@query("related_draws", f"""
WITH o AS (SELECT o_orderkey, o_totalprice AS x, o_custkey AS c, o_orderstatus AS s, CASE WHEN o_orderkey % 5 <> 0 THEN 1 END AS gap, 20 + 30 * {_u("'44:' || o_orderkey::VARCHAR || ':own'")} AS own FROM orders),
d AS (SELECT *, CASE WHEN x <= 1000 THEN 10.0 WHEN x < 50000 THEN 10 + 20 * (x - 1000) / 49000 WHEN x < 120000 THEN 30 - 5 * (x - 50000) / 70000 WHEN x < 200000 THEN 25 + 35 * (x - 120000) / 80000 ELSE 60 END - 28 AS curve,
  CASE s WHEN 'F' THEN -8.0 WHEN 'O' THEN 7.0 WHEN 'P' THEN -1.0 ELSE 0 END AS level, CASE WHEN gap IS NULL THEN -2.4 ELSE 0.6 END AS present,
  CASE WHEN x > 140000 THEN CASE WHEN c > 500 THEN -1.0 ELSE -5.5 END WHEN x > 55000 THEN CASE WHEN c > 500 THEN 6.5 ELSE 1.5 END ELSE CASE WHEN c > 500 THEN -3.5 ELSE -0.5 END END AS surface FROM o)
SELECT o_orderkey, round(35 + 0.8 * (surface + level + present) + sqrt(1 - 0.36 * 0.8) * (own - 35), 6) AS full_draw, round(35 + curve + sqrt(0.5) * (own - 35), 6) AS curve_draw FROM d""")
def related_draws(spark, sf):
    """A child of four parents: a surface stands for its two, a curve over levels, one about presence; and one that follows a bent curve alone."""
    gap = F.when(F.col("o_orderkey") % 5 != 0, F.lit(1))
    rows = table(spark, sf, "orders").withColumn("gap", gap).withColumn("own", 20 + 30 * seeds.uniform(44, F.col("o_orderkey"), "own"))
    return rows.select("o_orderkey", F.round(shaped.related_number(F.col("own"), 35.0, RELATED), 6).alias("full_draw"), F.round(shaped.related_number(F.col("own"), 35.0, ALONE), 6).alias("curve_draw"))


MOVED = shaped.Relation("priority", {"o_totalprice": shaped.Curve([0.0, 200_000.0], [0.1, 0.7], 0.3)}, level="high")


@query("related_levels", f"""
WITH o AS (SELECT o_orderkey, o_totalprice AS x, {_u("'45:' || o_orderkey::VARCHAR || ':own'")} AS o, {_u("'45:' || o_orderkey::VARCHAR || ':moved'")} AS u, {_u("'45:' || o_orderkey::VARCHAR || ':other'")} AS w FROM orders),
d AS (SELECT *, CASE WHEN x < 200000 THEN 0.1::DOUBLE + 0.6::DOUBLE * x / 200000 ELSE 0.7::DOUBLE END - 0.3::DOUBLE AS delta FROM o)
SELECT o_orderkey, CASE WHEN abs(delta) <= 1e-9 THEN CASE WHEN o < 0.5 THEN 'low' WHEN o < 0.8 THEN 'mid' ELSE 'high' END
  WHEN u < greatest(least(0.2::DOUBLE + delta, 0.999), 0.001) THEN 'high' WHEN w < 0.625 THEN 'low' ELSE 'mid' END AS priority FROM d""")
def related_levels(spark, sf):
    """Levels whose high class is likelier for dear orders, the others in their old proportion."""
    u = lambda what: seeds.uniform(45, F.col("o_orderkey"), what)
    levels, weights = ["low", "mid", "high"], [0.5, 0.3, 0.2]
    return table(spark, sf, "orders").select("o_orderkey", shaped.related_level(seeds.pick(levels, weights, u("own")), levels, weights, MOVED, u("moved"), u("other")).alias("priority"))


@query("related_table", "SELECT * FROM (VALUES ('l_quantity/l_extendedprice', true), ('l_extendedprice/tax', true), ('l_discount/tax', true), ('spread of l_extendedprice', true), ('spread of tax', true)) AS v(what, met)")
def related_table(spark, sf):
    """A table drawn from what the lines publish: rank correlations within 0.1 of the source's, deviations within a fifth."""
    source = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", (F.col("l_extendedprice") * (0.2 - F.col("l_discount"))).alias("tax"))
    numeric = ["l_quantity", "l_extendedprice", "l_discount", "tax"]
    marginals = blueprint.fit(source, "l_orderkey", numeric, [])
    means = source.agg(*[F.avg(c).alias(c) for c in numeric]).first().asDict()
    price = shaped.Relation("l_extendedprice", {"l_quantity": shaped.fit_curve(source, "l_orderkey", "l_quantity", F.col("l_extendedprice"))})
    tax = shaped.Relation("tax", {}, {("l_extendedprice", "l_discount"): shaped.fit_surface(source, "l_orderkey", "l_extendedprice", "l_discount", F.col("tax"), 6)})
    for r in (price, tax):
        r.explained = shaped.explained(source, F.col(r.child), r)
    rows = source.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row"))
    made = written(shaped.draw(rows, "row", marginals, [tax, price], means, 46).select(*numeric), "made")
    here, there = ({r.pair: r.rho for r in planting.rank_correlations(d, numeric).collect()} for d in (source, made))  # a row a pair
    out = [(f"{a}/{b}", abs(here[f"{a}/{b}"] - there[f"{a}/{b}"]) <= 0.1) for a, b in (("l_quantity", "l_extendedprice"), ("l_extendedprice", "tax"), ("l_discount", "tax"))]
    sd = lambda d: d.agg(*[F.stddev_pop(c).alias(c) for c in numeric]).first()
    was, now = sd(source), sd(made)
    out += [(f"spread of {c}", abs(now[c] / was[c] - 1) <= 0.2) for c in ("l_extendedprice", "tax")]
    return spark.createDataFrame(out, "what string, met boolean")


@query("tail_draws", """
WITH k AS (SELECT quantile_cont(o_totalprice, 0.9) AS a, max(o_totalprice) AS b FROM orders)
SELECT 'mean' AS what, round(avg(o_totalprice), 2) AS asked, true AS met FROM orders, k WHERE o_totalprice >= a UNION ALL SELECT 'deviation', round(stddev_pop(o_totalprice), 2), true FROM orders, k WHERE o_totalprice >= a
UNION ALL SELECT 'lowest', round(a, 2), true FROM k UNION ALL SELECT 'highest', round(b, 2), true FROM k""")
def tail_draws(spark, sf):
    """The top tenth of drawn prices: its mean and deviation within four standard errors of a mean of so many, and no price beyond the ends."""
    prices = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    at = [0.0, 0.5, 0.9, 1.0]
    knots = list(zip(at, exact_quantiles(prices, "o_totalprice", at), strict=True))
    a, b = knots[2][1], knots[3][1]
    top = lambda d: d.where(F.col("o_totalprice") >= a).agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s"), F.count("*").alias("n")).first()
    was = top(prices)
    drawn = prices.select("o_orderkey", shaped.bent_draw(seeds.uniform(47, F.col("o_orderkey"), "price"), knots, (was.m, was.s)).alias("o_totalprice"))
    now, ends = top(drawn), drawn.where(F.col("o_totalprice") >= a).agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")).first()
    near = lambda x, y: abs(x - y) <= 4 * was.s / now.n**0.5
    rows = [("mean", was.m, near(was.m, now.m)), ("deviation", was.s, near(was.s, now.s)), ("lowest", a, ends.low >= a), ("highest", b, ends.high <= b)]
    return spark.createDataFrame([(w, round(x, 2), bool(m)) for w, x, m in rows], "what string, asked double, met boolean")


@query("whole_draws", f"""
WITH x AS (SELECT o_orderkey, 6 * pow({_u("'48:' || o_orderkey::VARCHAR || ':count'")}, 3) AS x FROM orders), h AS (SELECT (1 - (1.2::DOUBLE - avg(floor(x)))) * (count(*) - 1) AS h FROM x), p AS (SELECT x - floor(x) AS p, row_number() OVER (ORDER BY x - floor(x)) - 1 AS i FROM x),
c AS (SELECT any_value(a.p) + (any_value(h) - floor(any_value(h))) * (any_value(b.p) - any_value(a.p)) AS cut FROM h JOIN p a ON a.i = floor(h) JOIN p b ON b.i = ceil(h))
SELECT o_orderkey, CASE WHEN x - floor(x) >= cut THEN floor(x) + 1 ELSE floor(x) END AS n FROM x, c""")
def whole_draws(spark, sf):
    """Counts cut so that their mean is 1.2, where rounding would give another."""
    rows = table(spark, sf, "orders").select("o_orderkey", (6 * F.pow(seeds.uniform(48, F.col("o_orderkey"), "count"), F.lit(3))).alias("n"))
    return shaped.whole_numbers(rows, "n", 1.2)
