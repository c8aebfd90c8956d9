"""Keys, links and joins over the driver tables."""

from pyspark.sql import functions as F

from plumbline.operators import relate as r
from plumbline.operators.fidelity import spearman
from plumbline.registry import query, table


def _keys_sql(t, columns):
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(DISTINCT {c}::VARCHAR) AS distinct_values, count({c}) >= 0.99 * count(*) AND count(DISTINCT {c}::VARCHAR) = count({c}) AND count(DISTINCT {c}::VARCHAR) >= 8"
        f" AND NOT (count(try_cast({c}::VARCHAR AS DOUBLE)) >= 0.9 * count({c}) AND coalesce(sum((try_cast({c}::VARCHAR AS DOUBLE) <> floor(try_cast({c}::VARCHAR AS DOUBLE)))::INT), 0) > 0.05 * count(try_cast({c}::VARCHAR AS DOUBLE))) AS is_key FROM {t}"
        for c in columns
    )


SUPPLIER = ["s_suppkey", "s_name", "s_nationkey"]
NATION = ["n_nationkey", "n_name", "n_regionkey"]


@query("pk_candidates", _keys_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]) + " UNION ALL " + _keys_sql("nation", NATION))
def pk_candidates(spark, sf):
    return r.primary_keys({"orders": table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "nation": table(spark, sf, "nation").select(*NATION)})


LINKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("lineitem", "l_linenumber", "supplier", "s_suppkey"), ("lineitem", "l_orderkey", "customer", "c_custkey")]


def _each(links, one):
    from functools import reduce

    return reduce(lambda a, b: a.union(b), [one(*x).select(F.lit(f"{x[0]}.{x[1]}>{x[2]}").alias("link"), "*") for x in links])


@query("fk_overlap", " UNION ALL ".join(f"SELECT '{c}.{f}>{p}' AS link, count(*) AS n_values, count(k) AS n_found, round(count(k)::DOUBLE / count(*), 6) AS share, round(count(k)::DOUBLE / count(*), 6) >= 0.8 AS is_link FROM {c} LEFT JOIN (SELECT DISTINCT {k} AS k FROM {p}) ON {f} = k WHERE {f} IS NOT NULL" for c, f, p, k in LINKS))
def fk_overlap(spark, sf):
    return _each(LINKS, lambda c, f, p, k: r.overlap(table(spark, sf, c), f, table(spark, sf, p), k))


@query("integrity_orphans", " UNION ALL ".join(f"SELECT '{c}.{f}>{p}' AS link, count(*) AS n_rows, count(k) AS with_parent, count(*) FILTER (WHERE v IS NOT NULL AND k IS NULL) AS orphans, count(*) FILTER (WHERE v IS NULL) AS blank FROM (SELECT CASE WHEN {f} % 7 = 0 THEN NULL WHEN {f} % 11 = 0 THEN -{f} ELSE {f} END AS v FROM {c}) LEFT JOIN (SELECT DISTINCT {k} AS k FROM {p}) ON v = k" for c, f, p, k in LINKS[:2]))
def integrity_orphans(spark, sf):
    """Links with every seventh key blanked and every eleventh turned into an orphan."""

    def one(c, f, p, k):
        broken = table(spark, sf, c).withColumn(f, F.when(F.col(f) % 7 == 0, None).when(F.col(f) % 11 == 0, -F.col(f)).otherwise(F.col(f)))
        return r.integrity(broken, f, table(spark, sf, p), k)

    return _each(LINKS[:2], one)


@query("inherit_three_hops", """
SELECT l_orderkey, l_linenumber, o_totalprice AS __via__l_orderkey__o_totalprice, o_custkey AS __via__l_orderkey__o_custkey, c_acctbal AS "__via__l_orderkey>o_custkey__c_acctbal", c_nationkey AS "__via__l_orderkey>o_custkey__c_nationkey", n_regionkey AS "__via__l_orderkey>o_custkey>c_nationkey__n_regionkey"
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def inherit_three_hops(spark, sf):
    one = r.inherit(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, sf, "orders"), "l_orderkey", "o_orderkey", ["o_totalprice", "o_custkey"])
    two = r.inherit(one, table(spark, sf, "customer"), "__via__l_orderkey__o_custkey", "c_custkey", ["c_acctbal", "c_nationkey"], "l_orderkey>o_custkey")
    return r.inherit(two, table(spark, sf, "nation"), "__via__l_orderkey>o_custkey__c_nationkey", "n_nationkey", ["n_regionkey"], "l_orderkey>o_custkey>c_nationkey")


@query("cross_coupling_spearman", """
WITH j AS (SELECT l_extendedprice AS x, o_totalprice AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j)
SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k""")
def cross_coupling_spearman(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return spearman(joined, "l_extendedprice", "o_totalprice")


def spans(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("start"), F.max("l_shipdate").alias("end"))
    return table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.col("o_orderkey").alias("active_key"), "start", "end")


SPANS = "(SELECT o_custkey, o_orderkey AS active_key, s, e FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"


@query("interval_join_active", f"SELECT o.o_orderkey, count(*) AS active FROM orders o JOIN {SPANS} s ON o.o_custkey = s.o_custkey AND o.o_orderdate BETWEEN s.s AND s.e GROUP BY 1")
def interval_join_active(spark, sf):
    pairs = r.interval_join(table(spark, sf, "orders"), spans(spark, sf), ["o_custkey"], "o_orderdate", "start", "end")
    return pairs.groupBy("o_orderkey").agg(F.count("*").alias("active"))


@query("wrangle_tidy", """
WITH l AS (SELECT l_orderkey, count(*) AS line_count, string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag) AS flags, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_custkey, c_mktsegment, n_name, o_orderdate::DATE AS visit_day, coalesce(line_count, 0) AS line_count, coalesce(flags, '') AS flags, quantity
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN l ON o_orderkey = l_orderkey""")
def wrangle_tidy(spark, sf):
    """One row a visit: the order, who made it, and what its lines add up to."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("line_count"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "; ").alias("flags"), F.round(F.sum("l_quantity"), 4).alias("quantity"))
    out = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", "o_custkey", "c_mktsegment", "n_name", F.to_date("o_orderdate").alias("visit_day"), F.coalesce("line_count", F.lit(0)).alias("line_count"), F.coalesce("flags", F.lit("")).alias("flags"), "quantity")


@query("cohort_semi", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cohort_semi(spark, sf):
    members = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return r.cohort(table(spark, sf, "orders"), members, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("first_visit_wins", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def first_visit_wins(spark, sf):
    return r.first_by(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("last_value_wins", "SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def last_value_wins(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("permutation_check", """
WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 100 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders),
c AS (SELECT 'o_orderkey' AS n, o_orderkey::VARCHAR AS v, 1 AS s FROM orders UNION ALL SELECT 'o_orderkey', o_orderkey::VARCHAR, -1 FROM b UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR, 1 FROM orders UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR, -1 FROM b UNION ALL SELECT 'o_orderstatus', o_orderstatus, 1 FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus, -1 FROM b)
SELECT n AS column_name, sum(d)::BIGINT AS n_differing, sum(d) = 0 AS same_values FROM (SELECT n, v, abs(sum(s)) AS d FROM c GROUP BY n, v) GROUP BY n""")
def permutation_check(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return r.same_rows(a, a.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 100 == 0, "X").otherwise(F.col("o_orderstatus"))))


@query("pivot_long_mean", "SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{t}'), 6) AS {t}" for t in ("click", "view", "purchase")) + " FROM events GROUP BY user_id")
def pivot_long_mean(spark, sf):
    types = ["click", "view", "purchase"]
    wide = table(spark, sf, "events").groupBy("user_id").pivot("event_type", types).agg(F.avg("value"))
    return wide.select("user_id", *[F.round(t, 6).alias(t) for t in types])


@query("stratified_largest_remainder", """
WITH s AS (SELECT c_mktsegment AS stratum, count(*) AS n FROM customer GROUP BY 1), q AS (SELECT stratum, n, 300.0::DOUBLE * n / sum(n) OVER () AS quota FROM s),
f AS (SELECT *, floor(quota) AS base, row_number() OVER (ORDER BY quota - floor(quota) DESC, stratum) AS place FROM q),
k AS (SELECT stratum, base + (place <= 300 - (SELECT sum(base) FROM f))::INT AS take FROM f),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7:' || c_custkey::VARCHAR), c_custkey) AS rn FROM customer)
SELECT c_custkey, c_mktsegment FROM r JOIN k ON c_mktsegment = stratum WHERE rn <= take""")
def stratified_largest_remainder(spark, sf):
    from plumbline.operators.sampling import stratified

    return stratified(table(spark, sf, "customer"), "c_mktsegment", "c_custkey", 300, 7).select("c_custkey", "c_mktsegment")
