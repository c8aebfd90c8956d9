"""Related tables: orders that draw their customers, break their references and get new keys."""

from pyspark.sql import functions as F

from plumbline.operators import related as r
from plumbline.registry import query, table


def _u(key):
    return f"((('0x' || substr(sha256({key}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"


PLACES = "(SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)"
DRAWN = f"""(SELECT o_orderkey, c_custkey AS fk FROM (SELECT o_orderkey, floor({_u("'21:' || o_orderkey::VARCHAR || ':fk'")} * (SELECT count(*) FROM customer))::BIGINT AS i FROM orders) JOIN {PLACES} USING (i))"""


def drawn(spark, sf):
    return r.draw_parents(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", table(spark, sf, "customer"), "c_custkey", 21, "fk")


@query("relational_tables", f"SELECT o_orderkey, fk FROM {DRAWN}")
def relational_tables(spark, sf):
    return drawn(spark, sf)


def _broken(style):
    def part(what):
        return _u(f"'22:' || o_orderkey::VARCHAR || ':key:{what}'")

    if style == "random":
        fake = f"'C' || (1000000 + floor({part('fake')} * 9000000)::BIGINT)::VARCHAR"
        tried = "b AS (SELECT *, CASE WHEN orphan THEN fake END AS f FROM a)"
    else:
        fake = "NULL"
        tried = f"""t AS (SELECT o_orderkey, key, turn, (floor({part('fake')} * 5)::INT + turn) % 5 AS spot FROM a, range(5) AS r(turn) WHERE orphan),
s AS (SELECT o_orderkey, key, turn, 'C' || substr(substr(key, 2), 1, spot) || substr(substr(key, 2), spot + 2, 1) || substr(substr(key, 2), spot + 1, 1) || substr(substr(key, 2), spot + 3) AS swap FROM t),
m AS (SELECT o_orderkey, min_by(swap, turn) AS f FROM s WHERE swap <> key AND swap NOT IN (SELECT 'C' || lpad(c_custkey::VARCHAR, 6, '0') FROM customer) GROUP BY 1),
b AS (SELECT a.*, m.f FROM a LEFT JOIN m USING (o_orderkey))"""
    return f"""WITH a AS (SELECT o_orderkey, 'C' || lpad(fk::VARCHAR, 6, '0') AS key, {part('orphan')} < 0.1 AS orphan, {part('drift')} < 0.2 AS drifts, floor({part('how')} * 3)::INT AS how, {fake} AS fake FROM {DRAWN}),
{tried},
c AS (SELECT o_orderkey, key, f, f IS NULL AND NOT orphan AND drifts AS d, CASE how WHEN 0 THEN lower(key) WHEN 1 THEN ' ' || key ELSE key || '  ' END AS spelled FROM b)
SELECT o_orderkey, key, coalesce(f, CASE WHEN d THEN spelled END, key) AS dirty, CASE WHEN f IS NOT NULL THEN 'orphan' WHEN d AND spelled <> key THEN 'drift' END AS mess FROM c"""


def broken(spark, sf, style):
    keyed = drawn(spark, sf).select("o_orderkey", r.key_text(F.col("fk"), "C", 6).alias("key"))
    parents = table(spark, sf, "customer").select(r.key_text(F.col("c_custkey"), "C", 6).alias("parent"))
    return r.break_references(keyed, "o_orderkey", "key", parents, "parent", "C", 6, 0.1, 0.2, style, 22)


@query("relational_orphans", _broken("random"))
def relational_orphans(spark, sf):
    return broken(spark, sf, "random")


@query("relational_near_orphans", _broken("near"))
def relational_near_orphans(spark, sf):
    return broken(spark, sf, "near")


@query("relational_drift", f"SELECT mess, count(*) AS n, count(*) FILTER (WHERE p.k IS NOT NULL) AS n_found FROM ({_broken('random')}) AS d LEFT JOIN (SELECT 'C' || lpad(c_custkey::VARCHAR, 6, '0') AS k FROM customer) AS p ON upper(trim(d.dirty)) = p.k GROUP BY mess")
def relational_drift(spark, sf):
    """References by their mess, and how many still name a parent once trimmed and in capitals."""
    parents = table(spark, sf, "customer").select(r.key_text(F.col("c_custkey"), "C", 6).alias("k"))
    dirty = broken(spark, sf, "random")
    return dirty.join(parents, F.upper(F.trim("dirty")) == F.col("k"), "left").groupBy("mess").agg(F.count("*").alias("n"), F.count("k").alias("n_found"))


@query("assigned_keys", f"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN -o_custkey ELSE o_custkey END AS fk FROM orders), s AS (SELECT avg((fk NOT IN (SELECT c_custkey FROM customer))::INT) AS share FROM o),
d AS (SELECT o_orderkey, floor({_u("'23:' || o_orderkey::VARCHAR || ':_drawn'")} * (SELECT count(*) FROM customer))::BIGINT AS n, {_u("'23:' || o_orderkey::VARCHAR || ':orphan'")} AS u FROM o)
SELECT o_orderkey, CASE WHEN u < share THEN 'X' ELSE 'K' END || n::VARCHAR AS new_key FROM d, s""")
def assigned_keys(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("fk"))
    return r.assign_keys(orders, "o_orderkey", "fk", table(spark, sf, "customer"), "c_custkey", 23).select("o_orderkey", "new_key")


TABLES = {"nation": ["n_name", "n_nationkey"], "orders": ["o_orderdate", "o_orderkey"], "customer": ["c_custkey", "c_name"], "labels": ["doc_id"], "lineitem": ["l_orderkey", "l_linenumber"]}


@query("picked_keys", """
SELECT 'nation' AS table_name, CASE WHEN count(DISTINCT n_nationkey) = count(*) THEN 'n_nationkey' WHEN count(DISTINCT n_name) = count(*) THEN 'n_name' END AS key_column FROM nation
UNION ALL SELECT 'orders', CASE WHEN count(DISTINCT o_orderkey) = count(*) THEN 'o_orderkey' WHEN count(DISTINCT o_orderdate) = count(*) THEN 'o_orderdate' END FROM orders
UNION ALL SELECT 'customer', CASE WHEN count(DISTINCT c_custkey) = count(*) THEN 'c_custkey' WHEN count(DISTINCT c_name) = count(*) THEN 'c_name' END FROM customer
UNION ALL SELECT 'labels', CASE WHEN count(DISTINCT doc_id) = count(*) THEN 'doc_id' END FROM labels
UNION ALL SELECT 'lineitem', CASE WHEN count(DISTINCT l_orderkey) = count(*) THEN 'l_orderkey' WHEN count(DISTINCT l_linenumber) = count(*) THEN 'l_linenumber' END FROM lineitem""")
def picked_keys(spark, sf):
    """Columns whose values never repeat, one for each table by its name; null where none is unique alone."""
    rows = [(t, r.pick_key(t, r.unique_columns(table(spark, sf, t), cs))) for t, cs in TABLES.items()]
    return spark.createDataFrame(rows, "table_name string, key_column string")


@query("link_order", "SELECT * FROM (VALUES (0, 'part'), (1, 'region'), (2, 'nation'), (3, 'customer'), (4, 'orders'), (5, 'supplier'), (6, 'lineitem')) AS v(place, table_name)")
def link_order(spark, sf):
    links = [("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier"), ("orders", "customer"), ("customer", "nation"), ("supplier", "nation"), ("nation", "region")]
    return spark.createDataFrame(list(enumerate(r.link_order(links))), "place int, table_name string")


NAMES = ["drug__has_aspirin", "value__prev", "plain", "x__n", "x_n", "total__delta"]


@query("scaffolding_names", "SELECT name, regexp_matches(name, '__(has|n|prev|delta)($|_)') AS scaffolding FROM (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ") AS v(name)")
def scaffolding_names(spark, sf):
    return spark.createDataFrame([(n, n in r.collisions(NAMES)) for n in NAMES], "name string, scaffolding boolean")
