"""Profiles of columns and entities, over whole tables."""

from pyspark.sql import functions as F

from plumbline.operators import profiles as p
from plumbline.registry import query, table

SETS = "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN ' ' ELSE o_orderpriority || '; ' || o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN ';rare' ELSE '' END END"


def sets(spark, sf):
    return table(spark, sf, "orders").withColumn("tags", F.expr(SETS))


@query("visit_histogram", """
WITH p AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT * FROM (VALUES ('1', 1, 1), ('2', 2, 2), ('3-5', 3, 5), ('6-10', 6, 10), ('11+', 11, 1000000000)) AS v(visits, low, high))
SELECT visits, count(n) AS persons, round(count(n) / (SELECT count(*) FROM p)::DOUBLE, 6) AS share FROM b LEFT JOIN p ON n BETWEEN low AND high GROUP BY visits""")
def visit_histogram(spark, sf):
    return p.visit_histogram(table(spark, sf, "orders"), "o_custkey")


@query("counted_quantiles", """
WITH c AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT v, sum(n) OVER (ORDER BY v) AS upto, sum(n) OVER () AS total FROM c)
SELECT q, (SELECT min(v) FROM r WHERE upto >= q * total) AS v FROM (VALUES (0.01::DOUBLE), (0.5::DOUBLE), (0.99::DOUBLE)) AS t(q)""")
def counted_quantiles(spark, sf):
    return p.counted_quantiles(table(spark, sf, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n")), "l_quantity", "n", [0.01, 0.5, 0.99])


def _profile(table_name, value):
    """Both families are in the SQL, chosen by its own skewness."""
    skew = "(sum(power(y - m, 3)) / count(*)) / power(var_pop(y), 1.5)"
    return f"""WITH x AS MATERIALIZED (SELECT {value}::DOUBLE AS x FROM {table_name} WHERE {value} IS NOT NULL), z AS (SELECT count(*) FILTER (WHERE x = 0) / count(*)::DOUBLE AS zeros, bool_and(x = floor(x)) AS whole FROM x),
b AS MATERIALIZED (SELECT x AS y FROM x, z WHERE NOT (zeros > 0.2 AND x = 0)), sb AS (SELECT min(y) AS low, {skew} AS skew FROM b, (SELECT avg(y) AS m FROM b)), sx AS (SELECT {skew} AS skew FROM (SELECT x AS y FROM x), (SELECT avg(x) AS m FROM x)),
f AS (SELECT low > 0 AND skew > 0.75 AS lg FROM sb), s AS MATERIALIZED (SELECT CASE WHEN lg THEN ln(CASE WHEN y > 0 THEN y END) ELSE y END AS y FROM b, f), q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS c FROM s),
k AS (SELECT y, NOT (c > a) OR y BETWEEN a - 2.5 * (c - a) AND c + 2.5 * (c - a) AS inside FROM s, q)
SELECT CASE WHEN any_value(lg) THEN 'lognormal' ELSE 'normal' END AS family, round(avg(y) FILTER (WHERE inside), 6) AS location, round(stddev_samp(y) FILTER (WHERE inside), 6) AS scale, round(count(*) FILTER (WHERE NOT inside) / count(*)::DOUBLE, 6) AS outlier_rate, any_value(round(zeros, 6)) AS zero_share, any_value(whole) AS integral, any_value(round(sx.skew, 6)) AS skew FROM k, f, z, sx"""


@query("profile_price", _profile("orders", "o_totalprice"))
def profile_price(spark, sf):
    return p.profile_numeric(table(spark, sf, "orders"), "o_totalprice")


@query("profile_skewed", _profile("(SELECT CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END AS n FROM documents)", "n"))
def profile_skewed(spark, sf):
    """Lengths of documents with a third of zeros: the body is what isn't zero, in logarithms."""
    return p.profile_numeric(table(spark, sf, "documents").select(F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("n_chars")).alias("n")), "n")


COLUMNS = {"event_id": "event_id + 20000", "user_id": "user_id", "event_type": "event_type", "day": "CAST(CAST(ts AS DATE) AS {text})", "flag": "user_id % 2", "blank": "''", "one": "'same'", "tags": "CASE WHEN user_id % 2 = 0 THEN 'a;b' ELSE 'a' END"}


def _classes():
    long = " UNION ALL ".join(f"SELECT '{n}' AS column_name, CAST({e.format(text='VARCHAR')} AS VARCHAR) AS v FROM events" for n, e in COLUMNS.items())
    return f"""WITH l AS (SELECT column_name, CASE WHEN trim(v) <> '' THEN trim(v) END AS v FROM ({long})),
s AS (SELECT column_name, count(v) AS n, count(DISTINCT v) AS u, count(*) FILTER (WHERE contains(v, ';')) AS lists, count(try_cast(v AS DOUBLE)) AS numbers, count(*) FILTER (WHERE v IN ('0', '1')) AS bits, coalesce(bool_and(try_cast(v AS DOUBLE) = floor(try_cast(v AS DOUBLE))), false) AS whole, min(try_cast(v AS DOUBLE)) AS low, count(try_cast(v AS DATE)) AS dates FROM l GROUP BY 1)
SELECT column_name, CASE WHEN n = 0 THEN 'empty' WHEN lists > 0 THEN 'list' WHEN numbers = n THEN CASE WHEN u <= 2 AND bits = n THEN 'binary' WHEN u > greatest(20, 0.5 * n) AND n >= 20 AND whole AND low > 10000 THEN 'identifier' ELSE 'numeric' END WHEN dates > 0.9 * n THEN 'date' WHEN n >= 20 AND u / n::DOUBLE > 0.5 THEN 'identifier' WHEN u = 1 THEN 'constant' ELSE 'categorical' END AS kind FROM s"""


@query("column_classes", _classes())
def column_classes(spark, sf):
    return p.classify(table(spark, sf, "events").selectExpr(*[f"{e.format(text='STRING')} AS {n}" for n, e in COLUMNS.items()]), list(COLUMNS))


@query("within_visit", """
WITH c AS (SELECT user_id, event_type, count(*) AS n, count(DISTINCT value) AS u FROM events GROUP BY 1, 2), v AS (SELECT user_id, sum(n) AS n, max(n) AS most, max(u) AS u FROM c GROUP BY 1)
SELECT sum(n)::BIGINT AS rows, count(*) AS visits, count(*) FILTER (WHERE most >= 2) AS visits_repeated, count(*) FILTER (WHERE u >= 2) AS visits_moving FROM v""")
def within_visit(spark, sf):
    return p.within_visit(table(spark, sf, "events"), "user_id", "event_type", "value")


@query("top_measures", """
WITH t AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) AS i FROM events GROUP BY 1)
SELECT user_id, round(avg(value) FILTER (WHERE i = 1), 6) AS m1, round(avg(value) FILTER (WHERE i = 2), 6) AS m2, round(avg(value) FILTER (WHERE i = 3), 6) AS m3 FROM events JOIN t USING (event_type) GROUP BY 1""")
def top_measures(spark, sf):
    return p.top_measures(table(spark, sf, "events"), "user_id", "event_type", "value", 3)


@query("level_entropy", """
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), t AS (SELECT *, n / sum(n) OVER (PARTITION BY o_orderstatus) AS p FROM c)
SELECT o_orderstatus, count(*) AS levels, round(abs(-sum(p * ln(p))), 6) AS entropy FROM t GROUP BY 1""")
def level_entropy(spark, sf):
    return p.entropy(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("lag_decay", """
WITH l AS (SELECT i AS lag, value AS x, lag(value, i::INT) OVER (PARTITION BY user_id, i ORDER BY ts, event_id) AS p FROM events, range(1, 4) AS t(i)), r AS (SELECT lag::INT AS lag, count(*) FILTER (WHERE x IS NOT NULL AND p IS NOT NULL) AS n_pairs, corr(x, p) AS r FROM l GROUP BY 1)
SELECT lag, n_pairs, round(r, 6) AS r, round(r / (SELECT r FROM r WHERE lag = 1), 6) AS of_first FROM r""")
def lag_decay(spark, sf):
    return p.decay(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 3)


def _side(name, where):
    return f"(SELECT 'l_quantity' AS column_name, round(count(l_quantity) / count(*)::DOUBLE, 6) AS coverage_{name}, round(avg(l_quantity), 6) AS mean_{name}, round(stddev_samp(l_quantity), 6) AS sd_{name} FROM lineitem WHERE {where} UNION ALL SELECT 'l_extendedprice', round(count(l_extendedprice) / count(*)::DOUBLE, 6), round(avg(l_extendedprice), 6), round(stddev_samp(l_extendedprice), 6) FROM lineitem WHERE {where})"


@query("compare_columns", f"SELECT * FROM {_side('source', 'l_suppkey % 2 = 0')} JOIN {_side('made', 'l_suppkey % 2 = 1')} USING (column_name)")
def compare_columns(spark, sf):
    lines = table(spark, sf, "lineitem")
    return p.compare(lines.where("l_suppkey % 2 = 0"), lines.where("l_suppkey % 2 = 1"), ["l_quantity", "l_extendedprice"])


@query("token_signal", f"""
WITH d AS (SELECT o_orderkey, {SETS} AS tags, o_totalprice AS a, o_custkey::DOUBLE AS b FROM orders), k AS (SELECT * FROM d WHERE tags IS NOT NULL), h AS (SELECT DISTINCT o_orderkey, trim(t) AS token FROM k, unnest(string_split(tags, ';')) AS u(t) WHERE trim(t) <> ''), v AS (SELECT DISTINCT token FROM h),
x AS (SELECT v.token, k.a, k.b, (h.token IS NOT NULL)::INT AS has FROM v CROSS JOIN k LEFT JOIN h ON h.token = v.token AND h.o_orderkey = k.o_orderkey), r AS (SELECT token, round(abs(corr(has, a)), 6) AS ra, round(abs(corr(has, b)), 6) AS rb FROM x GROUP BY 1)
SELECT token, CASE WHEN ra > rb OR (ra = rb AND 'o_totalprice' > 'o_custkey') THEN ra ELSE rb END AS signal, CASE WHEN ra > rb OR (ra = rb AND 'o_totalprice' > 'o_custkey') THEN 'o_totalprice' ELSE 'o_custkey' END AS driver FROM r""")
def token_signal(spark, sf):
    return p.token_signal(sets(spark, sf), "tags", ["o_totalprice", "o_custkey"])


@query("publishable_sizes", f"""
WITH d AS (SELECT o_orderkey, list_filter(list_transform(string_split({SETS}, ';'), lambda t: trim(t)), lambda t: t <> '') AS t FROM orders)
SELECT o_orderkey, CASE WHEN t IS NULL THEN NULL WHEN len(t) = 0 THEN 0 ELSE greatest(1, len(list_filter(t, lambda x: x IN ('F', 'rare'))))::INT END AS size FROM d""")
def publishable_sizes(spark, sf):
    return sets(spark, sf).select("o_orderkey", p.publishable_sizes(F.col("tags"), ["F", "rare"]).alias("size"))


@query("two_valued", """
WITH l AS (SELECT 'toxic' AS column_name, toxic::DOUBLE AS v FROM labels UNION ALL SELECT 'quality', quality::DOUBLE FROM labels UNION ALL SELECT 'doc_id', doc_id::DOUBLE FROM labels)
SELECT column_name, min(v) AS low, max(v) AS high FROM l GROUP BY 1 HAVING count(DISTINCT v) = 2""")
def two_valued(spark, sf):
    return p.two_valued(table(spark, sf, "labels"), ["toxic", "quality", "doc_id"])


@query("fit_tightness", """
WITH c AS (SELECT count(*) AS n, corr(l_extendedprice, l_quantity) AS r1, corr(l_extendedprice, l_discount) AS r2, corr(l_quantity, l_discount) AS r12 FROM lineitem)
SELECT n, round(1 - sqrt(1 - (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12)), 6) AS tightness FROM c""")
def fit_tightness(spark, sf):
    return p.tightness(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
