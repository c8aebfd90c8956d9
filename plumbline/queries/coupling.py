"""Orders that are given to customers so that totals and balances go together."""

from pyspark.sql import functions as F

from plumbline.operators import coupling
from plumbline.operators.related import draw_parents
from plumbline.queries.related import DRAWN, _u
from plumbline.registry import query, table

ASKED, STEPS, TOLERANCE, SEED = 0.6, 8, 0.01, 25


def _normal(parts):
    a, b = (_u(f"{parts} || ':{x}'") for x in "ab")
    return f"(sqrt(-2.0 * ln({a})) * cos(6.283185307179586 * {b}))"


def _oracle():
    """The same bisection, a few common table expressions for each step; a step after the last that was needed repeats it."""
    row = f"'{SEED}:' || o_orderkey::VARCHAR || ':fk:"
    out = [
        f"slots AS MATERIALIZED (SELECT o_orderkey, fk, c_acctbal FROM {DRAWN.replace('21:', f'{SEED}:')} JOIN customer ON fk = c_custkey)",
        "kid_ranks AS (SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS r FROM orders)",
        f"kids AS MATERIALIZED (SELECT o_orderkey, (r - avg(r) OVER ()) / stddev_pop(r) OVER () AS z, {_normal(row + 'mix' + chr(39))} AS noise, 1e-9::DOUBLE * {_u(row + 'apart' + chr(39))} AS apart FROM kid_ranks)",
        "slot_ranks AS (SELECT *, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0::DOUBLE AS r FROM slots)",
        f"seats AS MATERIALIZED (SELECT fk, z, row_number() OVER (ORDER BY z + 1e-9::DOUBLE * {_u(row + 'seat' + chr(39))}, o_orderkey) AS place FROM (SELECT o_orderkey, fk, (r - avg(r) OVER ()) / stddev_pop(r) OVER () AS z FROM slot_ranks))",
        "b0 AS (SELECT 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0.5::DOUBLE AS mix, NULL::DOUBLE AS got)",
    ]
    for k in range(STEPS):
        out.append(f"t{k} AS (SELECT corr(kids.z, seats.z) AS got FROM (SELECT z, row_number() OVER (ORDER BY mix * z + sqrt(1 - mix * mix) * noise + apart, o_orderkey) AS place FROM kids, b{k}) AS kids JOIN seats USING (place))")
        done = f"b{k}.got IS NOT NULL AND abs(b{k}.got / {ASKED} - 1) * {ASKED} <= {TOLERANCE}"
        out.append(f"s{k} AS MATERIALIZED (SELECT low, high, mix, CASE WHEN {done} THEN b{k}.got ELSE t{k}.got END AS got FROM b{k}, t{k})")
        within = f"abs(got / {ASKED} - 1) * {ASKED} <= {TOLERANCE}"
        last = "true" if k == STEPS - 1 else within
        out.append(f"b{k + 1} AS MATERIALIZED (SELECT l AS low, h AS high, CASE WHEN {last} THEN mix ELSE (l + h) / 2 END AS mix, got FROM (SELECT *, CASE WHEN NOT {within} AND got < {ASKED} THEN mix ELSE low END AS l, CASE WHEN NOT {within} AND got >= {ASKED} THEN mix ELSE high END AS h FROM s{k}))")
    return f"""WITH {', '.join(out)}
SELECT o_orderkey, fk FROM (SELECT o_orderkey, row_number() OVER (ORDER BY mix * z + sqrt(1 - mix * mix) * noise + apart, o_orderkey) AS place FROM kids, b{STEPS}) JOIN seats USING (place)"""


def coupled(spark, sf):
    return coupling.couple(table(spark, sf, "orders"), "o_orderkey", ["o_totalprice"], table(spark, sf, "customer"), "c_custkey", ["c_acctbal"], [[ASKED]], SEED, "fk", STEPS, TOLERANCE)


@query("coupled_keys", _oracle())
def coupled_keys(spark, sf):
    """Each order's customer, by exact places in two orders, at the mix whose correlation is the one asked for."""
    return coupled(spark, sf).rows.select("o_orderkey", "fk")


MINE, THEIRS = ["o_totalprice", "day"], ["c_acctbal", "rank"]
JOINT = [[0.5, 0.4], [0.4, 0.32]]


@query("coupled_keys_joint", "SELECT * FROM (VALUES " + ", ".join(f"('{c}/{p}', {JOINT[i][j]}::DOUBLE, true)" for i, c in enumerate(MINE) for j, p in enumerate(THEIRS)) + ", ('orders of each customer', NULL, true)) AS v(what, asked, holds)")
def coupled_keys_joint(spark, sf):
    """Orders are given to customers so that four pairs of columns go together as asked within 0.05, though columns of one side go together as well; and no customer's number of orders changes."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")) + F.col("o_totalprice") / 200).alias("day"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal", (F.col("c_acctbal") / 5 + F.col("c_custkey") * 7_919 % 1_000).alias("rank"))
    made = coupling.couple(orders, "o_orderkey", MINE, customers, "c_custkey", THEIRS, JOINT, 26, "fk")
    drawn = draw_parents(orders.select("o_orderkey"), "o_orderkey", customers.select("c_custkey"), "c_custkey", 26, "fk")
    counts = lambda d, n: d.groupBy("fk").agg(F.count("*").alias(n))
    same = counts(made.rows, "a").join(counts(drawn, "b"), "fk", "full").agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("holds"))
    met = spark.createDataFrame([(f"{c}/{p}", asked, abs(got - asked) <= 0.05) for c, p, asked, got in made.pairs], "what string, asked double, holds boolean")
    return met.union(same.select(F.lit("orders of each customer"), F.lit(None).cast("double"), "holds"))
