"""Customers, parcels and claims from one spec, as many as there are customers and orders."""

from plumbline.plans import generate as g
from plumbline.plans import relational as r
from plumbline.queries.related import _u
from plumbline.registry import query, table

PARCELS, CLAIMS = (r.seed_of(31, f"link:{t}:{c}") for t, c in (("parcels", "owner"), ("claims", "parcel")))
DUPLICATES, ORPHANS, DRIFT = 0.08, 0.1, 0.2


def spec(spark, sf):
    people = g.Spec("people", [g.Col("person", "str_id", "sequence", {"prefix": "P", "start": 100})], table(spark, sf, "customer").count())
    n = table(spark, sf, "orders").count()
    parcels = g.Spec("parcels", [g.Col("parcel", "str_id", "sequence", {"prefix": "L", "start": 1000}), g.Col("weight", "int", "uniform", {"low": 1, "high": 90}, g.Mess(missing=0.1))], n, duplicate_rate=DUPLICATES)
    claims = g.Spec("claims", [g.Col("claim", "str_id", "sequence", {"prefix": "C"})], n // 2)
    return r.Relational("post", {"people": people, "parcels": parcels, "claims": claims}, [r.Link("parcels", "people", "person", "owner", ORPHANS, "random", DRIFT), r.Link("claims", "parcels", "parcel", "parcel", ORPHANS, "near", DRIFT)], 31)


def _broken(seed, style, prefix):
    """From a (row_id, key, w): the digits of the largest key."""
    u = lambda what: _u(f"'{seed}:' || row_id::VARCHAR || ':_key:{what}'")
    marked = f"SELECT *, {u('orphan')} < {ORPHANS} AS orphan, {u('drift')} < {DRIFT} AS drifts, floor({u('how')} * 3)::INT AS how, {u('fake')} AS fake FROM a"
    if style == "random":
        faked = f"SELECT *, CASE WHEN orphan THEN '{prefix}' || (pow(10, w)::BIGINT + floor(fake * (9 * pow(10, w)))::BIGINT) END AS f FROM m"
    else:
        faked = f"""SELECT m.*, s.f FROM m LEFT JOIN (SELECT row_id, min_by(swap, turn) AS f FROM (SELECT row_id, key, turn, '{prefix}' || substr(body, 1, spot) || substr(body, spot + 2, 1) || substr(body, spot + 1, 1) || substr(body, spot + 3) AS swap
  FROM (SELECT row_id, key, substr(key, 2) AS body, turn, (floor(fake * (w - 1))::INT + turn) % (w - 1) AS spot FROM m, range(12) AS t(turn) WHERE orphan AND turn < w - 1)) WHERE swap <> key AND swap NOT IN (SELECT '{prefix}' || (i + 1000) FROM n, range((SELECT count(*) FROM orders)) AS p(i)) GROUP BY row_id) s USING (row_id)"""
    return f"""m AS ({marked}), b AS ({faked}), c AS (SELECT row_id, key, f, f IS NULL AND NOT orphan AND drifts AS d, CASE how WHEN 0 THEN lower(key) WHEN 1 THEN ' ' || key ELSE key || '  ' END AS spelled FROM b)
SELECT row_id, key AS true_key, CASE WHEN f IS NOT NULL THEN f ELSE spelled END AS dirty, CASE WHEN f IS NOT NULL THEN 'orphan' ELSE 'drift' END AS mess FROM c WHERE f IS NOT NULL OR d AND spelled <> key"""


def _drawn(seed, row, count):
    key = f"'{seed}:' || {row}::VARCHAR || ':_parent'"
    return f"floor({_u(key)} * {count})::BIGINT"


N = "n AS (SELECT (SELECT count(*) FROM customer) AS people, (SELECT count(*) FROM orders) AS parcels)"
AGAIN = _u(f"'{r.seed_of(31, 'parcels')}:' || i::VARCHAR || ':row:duplicate'")
EACH = "range((SELECT count(*) FROM orders)) AS t(i)"
ROWS = f"(SELECT i AS row_id, i AS source FROM {EACH} UNION ALL SELECT i + parcels, i FROM n, {EACH} WHERE {AGAIN} < {DUPLICATES})"


@query("relational_plan", f"""
SELECT 'parcels' AS child, 'owner' AS fk, * FROM (WITH {N}, a AS (SELECT row_id, 'P' || ({_drawn(PARCELS, 'source', 'people')} + 100) AS key, greatest(length((people + 99)::VARCHAR), 2) AS w FROM {ROWS}, n), {_broken(PARCELS, 'random', 'P')})
UNION ALL SELECT 'claims', 'parcel', * FROM (WITH {N}, a AS (SELECT i AS row_id, 'L' || ({_drawn(CLAIMS, 'i', 'parcels')} + 1000) AS key, greatest(length((parcels + 999)::VARCHAR), 2) AS w FROM n, range((SELECT count(*) // 2 FROM orders)) AS t(i)), {_broken(CLAIMS, 'near', 'L')})""")
def relational_plan(spark, sf):
    """The ledger of references: orphans of either kind and drifted keys, repeated parcels among them."""
    return r.plan(spark, spec(spark, sf)).references


@query("relational_plan_dirty", f"""
WITH {N}, k AS (SELECT row_id, 'P' || ({_drawn(PARCELS, 'source', 'people')} + 100) AS key FROM {ROWS}, n), x AS (SELECT row_id, dirty FROM (WITH {N}, a AS (SELECT row_id, 'P' || ({_drawn(PARCELS, 'source', 'people')} + 100) AS key, greatest(length((people + 99)::VARCHAR), 2) AS w FROM {ROWS}, n), {_broken(PARCELS, 'random', 'P')}))
SELECT row_id, coalesce(x.dirty, key) AS owner FROM k LEFT JOIN x USING (row_id)""")
def relational_plan_dirty(spark, sf):
    """Parcels as they are handed out: each with the key that it names, as it is spelled."""
    return r.plan(spark, spec(spark, sf)).dirty["parcels"].select("row_id", "owner")
