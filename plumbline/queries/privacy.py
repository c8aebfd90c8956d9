"""Attacks on halves of the driver tables, identifiers in texts, and counts with noise."""

from pyspark.sql import functions as F

from plumbline.functions.seeds import uniform
from plumbline.operators import entities as e
from plumbline.operators import privacy as p
from plumbline.registry import query, table


def _re(k):
    return p.SHAPES[k].replace("'", "''")


@query("phi_shapes", " UNION ALL ".join(f"SELECT lang, '{k}' AS kind, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '{_re(k)}')) AS texts, sum(len(regexp_extract_all(text, '{_re(k)}')))::BIGINT AS matches FROM documents GROUP BY lang" for k in p.SHAPES))
def phi_shapes(spark, sf):
    return p.shapes(table(spark, sf, "documents"), "text", ["lang"])


def _redacted(c):
    for k in p.SHAPES:
        c = f"regexp_replace({c}, '{_re(k)}', '[{k}]', 'g')"
    return c


@query("phi_redact", f"SELECT conv_id, turn, sha256({_redacted('text')}) AS redacted FROM conversations UNION ALL SELECT -doc_id - 1, 0, sha256({_redacted('text')}) FROM documents")
def phi_redact(spark, sf):
    talk = table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(p.redact(F.col("text")), 256).alias("redacted"))
    return talk.union(table(spark, sf, "documents").select(-F.col("doc_id") - 1, F.lit(0), F.sha2(p.redact(F.col("text")), 256)))


@query("quasi_linkage", """
WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer), r AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS m FROM c WHERE c_custkey % 2 = 0 GROUP BY ALL HAVING count(*) >= 5)
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'member' ELSE 'other' END AS arm, count(*) AS scored, round(avg(abs(m - c_acctbal) / (SELECT stddev_pop(c_acctbal) FROM c)), 6) AS error FROM c JOIN r USING (c_nationkey, c_mktsegment) GROUP BY 1""")
def quasi_linkage(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    members, others = c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 <> 0")
    return p.linkage(members, others, members, ["c_nationkey", "c_mktsegment"], "c_acctbal")


@query("nearest_neighbour", "SELECT s_suppkey, round(min(sqrt(pow(s_acctbal / 1000 - p_retailprice / 1000, 2) + pow(s_nationkey / 10.0::DOUBLE - p_size / 10.0::DOUBLE, 2))), 6) AS distance FROM supplier, part GROUP BY s_suppkey")
def nearest_neighbour(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_retailprice").alias("x"), F.col("p_size").alias("y"))
    suppliers = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_nationkey").alias("y"))
    return p.nearest(suppliers, "s_suppkey", parts, {"x": 1000.0, "y": 10.0}).select("s_suppkey", F.round("distance", 6).alias("distance"))


U = "((('0x' || substr(sha256('11:' || level), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"


@query("dp_histogram_det", f"""
WITH k AS (SELECT event_type AS level FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn <= 8),
c AS (SELECT level, count(*) AS n FROM k GROUP BY level)
SELECT level, n, round(n - 8.0::DOUBLE * sign({U} - 0.5) * ln(1 - 2 * abs({U} - 0.5)), 6) AS noisy FROM c""")
def dp_histogram_det(spark, sf):
    return e.dp_histogram(table(spark, sf, "events"), "user_id", "event_type", [F.col("ts"), F.col("event_id")], 1.0, 8, lambda level: uniform(11, level))
