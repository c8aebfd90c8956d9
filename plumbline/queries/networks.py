"""Networks of level columns, planted outcomes, a copula, and intervals of proportions."""

import uuid
from statistics import NormalDist

from pyspark.sql import functions as F

from plumbline.functions.parse import VIN_VALUES, VIN_WEIGHTS, vin_valid
from plumbline.functions.stats import safe, wilson
from plumbline.operators import condnet as c
from plumbline.operators import fidelity, planting
from plumbline.registry import ORACLES, query, table
from plumbline.sources.shared import shared_folder, written

STRUCTURE = {"band": [], "status": ["band"], "priority": ["band", "status"]}


def rows(spark, sf):
    band = F.floor(F.col("o_totalprice") / 25_000).cast("int").cast("string")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", band.alias("band"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


R = "r AS (SELECT o_custkey AS e, floor(o_totalprice / 25000)::INT::VARCHAR AS b, o_orderstatus AS s, o_orderpriority AS p FROM orders)"
K2 = "k2 AS (SELECT b, s FROM r GROUP BY b, s HAVING count(DISTINCT e) >= 10)"
P2 = "p2 AS (SELECT b, s, p, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY b, s) AS x FROM r SEMI JOIN k2 USING (b, s) GROUP BY b, s, p)"
P1 = "p1 AS (SELECT b, p, sum(x) / any_value(m) AS x FROM p2 JOIN (SELECT b, count(*) AS m FROM k2 GROUP BY b) USING (b) GROUP BY b, p)"


@query("condnet_table", f"""
WITH {R}, {K2}, {P2}, {P1}, p0 AS (SELECT p, count(*)::DOUBLE / sum(count(*)) OVER () AS x FROM r GROUP BY p)
SELECT 2 AS n_parents, b AS band, s AS status, p AS level, round(x, 6) AS p FROM p2 UNION ALL SELECT 1, b, NULL, p, round(x, 6) FROM p1 UNION ALL SELECT 0, NULL, NULL, p, round(x, 6) FROM p0""")
def condnet_table(spark, sf):
    """Priorities under band and status, with what stands in for settings that few customers are in."""
    out = None
    for n, t in zip((2, 1, 0), c.table(rows(spark, sf), "o_custkey", "priority", STRUCTURE["priority"]), strict=True):
        band, status = (F.col(x) if x in t.columns else F.lit(None).cast("string").alias(x) for x in ("band", "status"))
        one = t.select(F.lit(n).alias("n_parents"), band, status, F.explode("dist").alias("d")).select("n_parents", "band", "status", F.col("d.x").alias("level"), F.round("d.p", 6).alias("p"))
        out = one if out is None else out.union(one)
    return out


@query("condnet_likelihood", f"""
WITH {R}, {K2}, {P2}, {P1}, p0 AS (SELECT p, count(*)::DOUBLE / sum(count(*)) OVER () AS x FROM r GROUP BY p),
b0 AS (SELECT b, count(*)::DOUBLE / sum(count(*)) OVER () AS x FROM r GROUP BY b), k1 AS (SELECT b FROM r GROUP BY b HAVING count(DISTINCT e) >= 10),
s1 AS (SELECT b, s, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY b) AS x FROM r SEMI JOIN k1 USING (b) GROUP BY b, s), s0 AS (SELECT s, count(*)::DOUBLE / sum(count(*)) OVER () AS x FROM r GROUP BY s),
g AS (SELECT b, s, p, count(*) AS n FROM r GROUP BY b, s, p)
SELECT g.b AS band, g.s AS status, g.p AS priority, g.n, round(ln(greatest(b0.x, 1e-9)) + ln(greatest(coalesce(s1.x, s0.x), 1e-9))
  + ln(greatest(coalesce(p2.x, CASE WHEN g.b IN (SELECT b FROM k2) THEN coalesce(p1.x, 0) END, p0.x), 1e-9)), 6) AS log_likelihood
FROM g JOIN b0 USING (b) JOIN s0 USING (s) JOIN p0 USING (p) LEFT JOIN s1 USING (b, s) LEFT JOIN p2 USING (b, s, p) LEFT JOIN p1 USING (b, p)""")
def condnet_likelihood(spark, sf):
    orders = rows(spark, sf)
    cells = orders.groupBy("band", "status", "priority").agg(F.count("*").alias("n"))
    return c.log_likelihood(cells, c.fit(orders, "o_custkey", STRUCTURE)).select("band", "status", "priority", "n", F.round("log_likelihood", 6).alias("log_likelihood"))


@query("condnet_reloaded", ORACLES["condnet_likelihood"])
def condnet_reloaded(spark, sf):
    """The same likelihoods by a network that was saved and read again."""
    orders, folder = rows(spark, sf), f"{shared_folder(spark)}/net-{uuid.uuid4().hex}"
    c.save(c.fit(orders, "o_custkey", STRUCTURE), folder)
    cells = orders.groupBy("band", "status", "priority").agg(F.count("*").alias("n"))
    return c.log_likelihood(cells, c.load(spark, folder)).select("band", "status", "priority", "n", F.round("log_likelihood", 6).alias("log_likelihood"))


P0 = "p0 AS (SELECT p, count(*)::DOUBLE / sum(count(*)) OVER () AS x FROM r GROUP BY p)"


@query("condnet_amplified", f"""
WITH {R}, {K2}, {P2}, {P0}, w AS (SELECT b, s, p, p0.x * power(p2.x / p0.x, 2) AS w FROM p2 JOIN p0 USING (p))
SELECT b AS band, s AS status, p AS level, round(w / sum(w) OVER (PARTITION BY b, s), 6) AS p FROM w""")
def condnet_amplified(spark, sf):
    """Priorities that follow band and status twice as much."""
    told = c.amplify(c.fit(rows(spark, sf), "o_custkey", STRUCTURE), "priority", 2.0).tables["priority"][0]
    return told.select("band", "status", F.explode("dist").alias("d")).select("band", "status", F.col("d.x").alias("level"), F.round("d.p", 6).alias("p"))


@query("condnet_marginal_set", f"""
WITH {R}, {K2}, {P2}, {P0}, w AS (SELECT b, s, p, p2.x * CASE WHEN p = '1-URGENT' THEN 0.5 / p0.x ELSE 1 END AS w FROM p2 JOIN p0 USING (p))
SELECT b AS band, s AS status, p AS level, round(w / sum(w) OVER (PARTITION BY b, s), 6) AS p FROM w""")
def condnet_marginal_set(spark, sf):
    """Priorities where urgent ones are to weigh a half."""
    told = c.set_marginal(c.fit(rows(spark, sf), "o_custkey", STRUCTURE), "priority", {"1-URGENT": 0.5}).tables["priority"][0]
    return told.select("band", "status", F.explode("dist").alias("d")).select("band", "status", F.col("d.x").alias("level"), F.round("d.p", 6).alias("p"))


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row"), "l_orderkey", F.floor(F.col("l_quantity") / 10).cast("int").alias("quantity"), F.floor(F.col("l_extendedprice") / 10_000).cast("int").alias("price"), F.round(F.col("l_discount") * 100).cast("int").alias("discount"), F.col("l_returnflag").alias("flag"))


COLUMNS = ["quantity", "discount", "flag", "price"]


@query("condnet_search")
def condnet_search(spark, sf):
    found = c.search(lines(spark, sf), "l_orderkey", COLUMNS)
    return spark.createDataFrame([(k, ",".join(v), len(v)) for k, v in found.items()], "child string, parents string, n_parents int")


@query("condnet_sample")
def condnet_sample(spark, sf):
    """Lines drawn from the network that they teach, held against them: each column and the pair that depends most."""
    source = lines(spark, sf)
    made = written(c.draw(source.select("row"), "row", c.learn(source, "l_orderkey", COLUMNS), 17).select(*COLUMNS), "made")  # five comparisons read it
    text = source.withColumns({x: F.col(x).cast("string") for x in COLUMNS})
    both = F.concat_ws("/", "quantity", "price")
    out = [fidelity.tvd_levels(text, made, x).select(F.lit(x).alias("column_name"), "tvd") for x in COLUMNS]
    out.append(fidelity.tvd_levels(text.select(both.alias("pair")), made.select(both.alias("pair")), "pair").select(F.lit("quantity/price").alias("column_name"), "tvd"))
    whole = out[0]
    for o in out[1:]:
        whole = whole.union(o)
    return whole


@query("condnet_membership")
def condnet_membership(spark, sf):
    """A network of one half of the customers' orders, attacked with both halves."""
    orders = rows(spark, sf)
    members, others = orders.where("o_custkey % 2 = 0"), orders.where("o_custkey % 2 = 1")
    return c.membership(c.fit(members, "o_custkey", STRUCTURE), members, others)


@query("plant_recovered")
def plant_recovered(spark, sf):
    """Effects asked for and found again, at one case in ten."""
    effects = {"l_quantity": 0.8, "l_discount": -0.5}
    rows = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row"), *effects)
    return planting.recovered(planting.plant(rows, "row", effects, 0.1, 6), effects)


COPULA = ["l_quantity", "l_extendedprice", "l_discount"]


def _copula():
    def u(j, half):
        return f"((('0x' || substr(sha256('12:' || row || ':copula{j}:{half}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"

    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r{i}" for i, c in enumerate(COPULA))
    shocks = ", ".join(f"sqrt(-2.0::DOUBLE * ln({u(j, 'a')})) * cos(2.0::DOUBLE * pi() * {u(j, 'b')}) AS e{j}" for j in range(3))
    places = [-planting.FAR, *[NormalDist().inv_cdf(q) for q in planting.GRID[1:-1]], planting.FAR]
    listed = "[" + ", ".join(f"{x!r}::DOUBLE" for x in places) + "]"
    knots = ", ".join(f"(SELECT quantile_cont({c}, [{', '.join(f'{q}::DOUBLE' for q in planting.GRID)}]) FROM lineitem) AS v{i}" for i, c in enumerate(COPULA))
    spot = "least(len(list_filter(p, lambda x: x <= z{i})), len(p) - 1)"
    drawn = ", ".join(f"v{i}[{spot.format(i=i)}] + (z{i} - p[{spot.format(i=i)}]) / (p[{spot.format(i=i)} + 1] - p[{spot.format(i=i)}]) * (v{i}[{spot.format(i=i)} + 1] - v{i}[{spot.format(i=i)}]) AS {c}" for i, c in enumerate(COPULA))
    pairs = [(i, j) for i in range(3) for j in range(i)]
    return f"""WITH s AS (SELECT {ranks} FROM lineitem), c AS (SELECT {", ".join(f"round(corr(r{i}, r{j}), 6) AS s{i}{j}" for i, j in pairs)} FROM s),
n AS (SELECT {", ".join(f"2 * sin(pi() * s{i}{j} / 6) AS c{i}{j}" for i, j in pairs)} FROM c), l AS (SELECT c10 AS l10, sqrt(1 - c10 * c10) AS l11, c20 AS l20, (c21 - c20 * c10) / sqrt(1 - c10 * c10) AS l21, sqrt(1 - c20 * c20 - power((c21 - c20 * c10) / sqrt(1 - c10 * c10), 2)) AS l22 FROM n),
e AS (SELECT {shocks} FROM (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS row FROM lineitem)), z AS (SELECT greatest(least(e0, 3.5::DOUBLE), -3.5::DOUBLE) AS z0, greatest(least(l10 * e0 + l11 * e1, 3.5::DOUBLE), -3.5::DOUBLE) AS z1, greatest(least(l20 * e0 + l21 * e1 + l22 * e2, 3.5::DOUBLE), -3.5::DOUBLE) AS z2 FROM e, l),
k AS (SELECT {listed} AS p, {knots}), m AS MATERIALIZED (SELECT {drawn} FROM z, k), t AS (SELECT {ranks} FROM m), d AS (SELECT {", ".join(f"round(corr(r{i}, r{j}), 6) AS m{i}{j}" for i, j in pairs)} FROM t)
""" + " UNION ALL ".join(f"SELECT '{COPULA[j]}/{COPULA[i]}' AS pair, s{i}{j} AS source, m{i}{j} AS made FROM c, d" for i, j in pairs)


@query("copula_generate", _copula())
def copula_generate(spark, sf):
    """Rank correlations of lines and of lines drawn from their copula."""
    source = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row"), *COPULA)
    made = planting.copula(source, COPULA, source.select("row"), "row", 12)
    one, two = (planting.rank_correlations(df, COPULA).select("pair", F.col("rho").alias(name)) for df, name in ((source, "source"), (made, "made")))
    return one.join(two, "pair")


@query("wilson_interval", """
WITH g AS (SELECT lang, count(*) AS n, sum(toxic)::BIGINT AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang), w AS (SELECT *, k::DOUBLE / n AS p, 1.96::DOUBLE AS z FROM g)
SELECT lang, n, k, round(p, 6) AS share, round(greatest(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n::DOUBLE))) / (1 + z * z / n), 0), 6) AS low, round(least(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n::DOUBLE))) / (1 + z * z / n), 1), 6) AS high FROM w""")
def wilson_interval(spark, sf):
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    by = both.groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return by.select("lang", "n", "k", F.round(safe(F.col("k"), F.col("n")), 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


V = f"list_sum(list_transform(range(1, 18), lambda i: (CASE WHEN v[i] BETWEEN '0' AND '9' THEN v[i]::INT ELSE {[VIN_VALUES[c] for c in 'ABCDEF']}[ascii(v[i]) - 64] END) * {VIN_WEIGHTS}[i])) % 11"


@query("vin_check", f"""
WITH c AS (SELECT c_custkey, upper(substr(sha256(c_custkey::VARCHAR), 1, 17)) AS v FROM customer)
SELECT c_custkey, ({V}) = (CASE WHEN v[9] BETWEEN '0' AND '9' THEN v[9]::INT ELSE -1 END) AS valid FROM c""")
def vin_check(spark, sf):
    """Made-up vehicle numbers of hexadecimal digits: about one in seventeen checks out."""
    made = F.upper(F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 17))
    return table(spark, sf, "customer").select("c_custkey", vin_valid(made).alias("valid"))
