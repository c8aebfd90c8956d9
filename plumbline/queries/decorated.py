"""Decorated numbers and days, declared properties and conditions, on texts made of the orders."""

from pyspark.sql import functions as F

from plumbline.operators import decorated as d
from plumbline.registry import query, table


def _u(key):
    return f"((('0x' || substr(sha256({key}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"


K = "o_orderkey"
#: Texts as expressions that both engines read, and the number that each should give.
MONEY_TEXT = f"CASE WHEN {K} % 3 = 0 THEN concat('-$', {K} % 900, '.50') WHEN {K} % 3 = 1 THEN concat(' $1,', lpad(CAST({K} % 1000 AS {{text}}), 3, '0'), ' ') ELSE concat('$', {K} % 77) END"
MONEY_VALUE = f"CASE WHEN {K} % 3 = 0 THEN -({K} % 900 + 0.5) WHEN {K} % 3 = 1 THEN 1000 + {K} % 1000 ELSE {K} % 77 END"
CLOCK_TEXT = f"CASE WHEN {K} % 5 = 0 THEN '36:20' ELSE concat({K} % 24, ':', lpad(CAST({K} % 60 AS {{text}}), 2, '0'), CASE WHEN {K} % 2 = 0 THEN ':30' ELSE '' END) END"
CLOCK_VALUE = f"CASE WHEN {K} % 5 = 0 THEN NULL ELSE ({K} % 24) * 60 + {K} % 60 + CASE WHEN {K} % 2 = 0 THEN 0.5 ELSE 0 END END"
PERCENT_TEXT = f"CASE WHEN {K} % 4 = 0 THEN concat({K} % 100, '%') ELSE concat('-', {K} % 10, '.25 %') END"
PERCENT_VALUE = f"CASE WHEN {K} % 4 = 0 THEN {K} % 100 ELSE -({K} % 10 + 0.25) END"


@query("quantity_values", f"SELECT {K}, round(({MONEY_VALUE})::DOUBLE, 6) AS money, round(({CLOCK_VALUE})::DOUBLE, 6) AS clock, round(({PERCENT_VALUE})::DOUBLE, 6) AS percent, CASE o_orderstatus WHEN 'O' THEN 0.0 WHEN 'P' THEN 1.0 END AS rank FROM orders")
def quantity_values(spark, sf):
    """Signs before or after the symbol, thousands, percent and clocks; 36:20 is no time of day, and F no level of the order."""
    texts = table(spark, sf, "orders").selectExpr(K, "o_orderstatus", *[f"{t.format(text='STRING')} AS {n}" for n, t in (("m", MONEY_TEXT), ("c", CLOCK_TEXT), ("p", PERCENT_TEXT))])
    return texts.select(K, F.round(d.money(F.col("m")), 6).alias("money"), F.round(d.clock(F.col("c")), 6).alias("clock"), F.round(d.percent(F.col("p")), 6).alias("percent"), d.ordinal(F.col("o_orderstatus"), ["O", "P"]).alias("rank"))


@query("quantity_kinds", f"""
SELECT * FROM (VALUES ('money', 'currency', 2, true, NULL, 0.0::DOUBLE), ('percent', 'percent', 2, NULL, NULL, 0.0::DOUBLE), ('late', 'clock', NULL, NULL, true, (SELECT round(count(*) FILTER (WHERE {K} % 50 = 0) / count(*)::DOUBLE, 6) FROM orders))) AS v(column_name, kind, decimals, thousands, seconds, unparsed)""")
def quantity_kinds(spark, sf):
    texts = table(spark, sf, "orders").selectExpr(f"{MONEY_TEXT.format(text='STRING')} AS money", f"{PERCENT_TEXT.format(text='STRING')} AS percent", f"CASE WHEN {K} % 50 = 0 THEN 'soon' ELSE concat({K} % 24, ':00:15') END AS late", "o_orderpriority AS plain")
    return d.kinds(texts)


@query("quantity_texts", f"""
SELECT {K}, CASE WHEN x < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', abs(x)) AS money, printf('%.1f', y) || '%' AS percent, lpad((m // 60)::VARCHAR, 2, '0') || ':' || lpad((m % 60)::VARCHAR, 2, '0') AS clock, ['low', 'mid', 'high'][least(greatest(z, 0), 2) + 1] AS level
FROM (SELECT {K}, ({K} % 2001 - 1000) * 1.25::DOUBLE AS x, ({K} % 400) / 4.0::DOUBLE + 0.03::DOUBLE AS y, ({K} * 7) % 1440 AS m, ({K} % 5)::INT - 1 AS z FROM orders)""")
def quantity_texts(spark, sf):
    k = F.col(K)
    return table(spark, sf, "orders").select(
        K, d.show_money((k % 2001 - 1000) * 1.25).alias("money"), d.show_percent((k % 400) / 4.0 + 0.03, 1).alias("percent"), d.show_clock(((k * 7) % 1440).cast("double")).alias("clock"), d.show_ordinal((k % 5 - 1).cast("double"), ["low", "mid", "high"]).alias("level")
    )


@query("day_labels", f"SELECT {K}, CASE WHEN {K} % 9 = 0 THEN 'missing' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS label, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS day FROM orders")
def day_labels(spark, sf):
    day = d.from_timestamp(F.col("o_orderdate"))
    return table(spark, sf, "orders").select(K, d.day_label(F.when(F.col(K) % 9 != 0, day), "dd/MM/yyyy").alias("label"), day.alias("day"))


@query("day_formats", f"""
SELECT * FROM (VALUES ('iso', 'yyyy-MM-dd', (SELECT round(count(*) FILTER (WHERE {K} % 40 = 0) / count(*)::DOUBLE, 6) FROM orders), false), ('timed', 'yyyy-MM-dd HH:mm', 0.0::DOUBLE, false), ('dotted', 'dd.MM.yyyy', 0.0::DOUBLE, false), ('either', 'dd/MM/yyyy', 0.0::DOUBLE, true)) AS v(column_name, fmt, unparsed, ambiguous)""")
def day_formats(spark, sf):
    """A few spoiled days, a time of day, dots, and days and months that could be either."""
    day = F.to_date("o_orderdate")
    return d.day_formats(table(spark, sf, "orders").select(
        F.when(F.col(K) % 40 == 0, "soon").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("iso"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 08:30")).alias("timed"), F.date_format(day, "dd.MM.yyyy").alias("dotted"),
        F.date_format(F.make_date(F.year(day), F.month(day), F.dayofmonth(day) % 12 + 1), "dd/MM/yyyy").alias("either"), F.col("o_orderpriority").alias("plain"),
    ))


@query("declared_properties", """
WITH c AS (SELECT count(*) FILTER (WHERE lo <> hi) AS n FROM (SELECT min(l_returnflag) AS lo, max(l_returnflag) AS hi FROM lineitem GROUP BY l_orderkey)),
w AS (SELECT count(*) FILTER (WHERE abs(l_extendedprice - round_even(l_extendedprice, 0)) > 1e-6) AS n, count(*) FILTER (WHERE l_quantity < 2 - 1e-6 OR l_quantity > 45 + 1e-6) AS b FROM lineitem)
SELECT * FROM (SELECT 'l_returnflag' AS column_name, 'constant' AS declared, n AS violations FROM c UNION ALL SELECT 'l_extendedprice', 'whole', n FROM w UNION ALL SELECT 'l_quantity', 'bounds', b FROM w) WHERE violations > 0""")
def declared_properties(spark, sf):
    return d.declared(table(spark, sf, "lineitem"), "l_orderkey", ["l_returnflag", "l_orderkey"], ["l_extendedprice", "l_linenumber"], {"l_quantity": (2.0, 45.0), "l_linenumber": (0.0, 100.0)})


TEXTS = {"orders.mean >= 0.5": (">=", 0.5), "recall < 2": ("<", 2.0), "x == 0.25": ("==", 0.25), "no condition": None, "a.b.c > .5": (">", 0.5), "margin > -0.5": (">", -0.5), "recall > 1.2.3": None, "two words <= 1": None}


@query("conditions", f"""
WITH t(text, op, x) AS (VALUES {", ".join(f"('{t}', {repr(c[0]) if c else 'NULL'}, {c[1] if c else 'NULL'}::DOUBLE)" for t, c in TEXTS.items())})
SELECT o_orderpriority, text, CASE op WHEN '>=' THEN m >= x WHEN '<' THEN m < x WHEN '>' THEN m > x WHEN '==' THEN abs(m - x) < 1e-9 END AS holds FROM t, (SELECT o_orderpriority, round(avg((o_orderstatus = 'F')::INT), 2) AS m FROM orders GROUP BY 1)""")
def conditions(spark, sf):
    """Conditions held against the share of finished orders of each priority; no condition, no verdict."""
    shares = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 2).alias("m"))
    asked = d.conditions(spark.createDataFrame([(t,) for t in TEXTS], "text string"), "text")
    both = shares.crossJoin(F.broadcast(asked))  # a few conditions
    return both.select("o_orderpriority", "text", F.when(F.col("op").isNotNull(), d.holds(F.col("m"), F.col("op"), F.col("threshold"))).alias("holds"))


@query("clustered_presence", f"""
WITH r AS (SELECT event_id, user_id, row_number() OVER w AS rn, {_u("'51:' || user_id::VARCHAR || ':' || event_id::VARCHAR || ':keep'")} AS k, {_u("'51:' || user_id::VARCHAR || ':' || event_id::VARCHAR || ':has'")} AS h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), f AS (SELECT *, CASE WHEN rn = 1 OR k >= 0.5 THEN h < 0.4 END AS fresh FROM r)
SELECT event_id, last_value(fresh IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS present FROM f""")
def clustered_presence(spark, sf):
    return d.two_state(table(spark, sf, "events"), "user_id", ["event_id"], 0.4, 0.5, 51, "present").select("event_id", "present")


@query("product_features", """
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq * (l_discount - md) / sd, 6) AS l_quantity__x__l_discount FROM lineitem, s""")
def product_features(spark, sf):
    made = d.products(table(spark, sf, "lineitem"), [("l_quantity", "l_discount")])
    return made.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in d.product_sources(made.columns)])
