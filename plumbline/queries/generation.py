"""Generated tables, planted corruption, and the grading of tools against it."""

from pyspark.sql import functions as F

from plumbline.functions import parse, seeds
from plumbline.plans import exam
from plumbline.plans import generate as g
from plumbline.registry import query, table


def _u(key):
    return f"((('0x' || substr(sha256({key}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"


@query("gen_uniform", f"SELECT o_orderkey, round({_u(chr(39) + '7:' + chr(39) + ' || o_orderkey::VARCHAR || ' + chr(39) + ':price:value' + chr(39))}, 9) AS u FROM orders")
def gen_uniform(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(seeds.uniform(7, F.col("o_orderkey"), "price", "value"), 9).alias("u"))


#: Parcels of the driver's orders: as many rows as there are orders.
COLUMNS = [
    g.Col("parcel", "str_id", "sequence", {"prefix": "L", "start": 1000}, g.Mess(missing=0.03)),
    g.Col("quantity", "int", "uniform", {"low": 1, "high": 50}, g.Mess(missing=0.1, outlier=0.04)),
    g.Col("ship_mode", "category", "categorical", {"levels": ["Rail", "Truck", "Air Freight"], "weights": [0.6, 0.25, 0.15]}, g.Mess(typo=0.08, case=0.12, space=0.06)),
    g.Col("price", "float", "quantiles", {"knots": [(0.0, 900.0), (0.5, 36000.0), (1.0, 105000.0)]}, g.Mess(wrong=0.07)),
    g.Col("ship_date", "date", "date_range", {"start": "1995-03-01", "days": 700}, g.Mess(format=0.2)),
    g.Col("returned", "bool", "bernoulli", {"p": 0.25}, g.Mess(case=0.3)),
]
DUPLICATES = 0.08


def spec(spark, sf):
    return g.Spec("parcels", COLUMNS, rows=table(spark, sf, "orders").count(), duplicate_rate=DUPLICATES)


def _cell(column, op="value", row="i"):
    return _u(f"'7:' || {row}::VARCHAR || ':{column}:{op}'")


CLEAN = f"""(SELECT i AS row_id, 'L' || (i + 1000) AS parcel, round_even(1 + 49 * {_cell('quantity')}, 0)::BIGINT::VARCHAR AS quantity,
  CASE WHEN {_cell('ship_mode')} < 0.6 THEN 'Rail' WHEN {_cell('ship_mode')} < 0.85 THEN 'Truck' ELSE 'Air Freight' END AS ship_mode,
  printf('%.4f', round(CASE WHEN {_cell('price')} <= 0.5 THEN 900 + 35100 * {_cell('price')} / 0.5 ELSE 36000 + 69000 * ({_cell('price')} - 0.5) / 0.5 END, 4)) AS price,
  strftime(DATE '1995-03-01' + floor({_cell('ship_date')} * 701)::INT, '%Y-%m-%d') AS ship_date,
  CASE WHEN {_cell('returned')} < 0.25 THEN 'True' ELSE 'False' END AS returned FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS i))"""


@query("gen_clean_table", f"SELECT * FROM {CLEAN}")
def gen_clean_table(spark, sf):
    return g.plan_table(spark, spec(spark, sf))[0]


def _ledger():
    """One SELECT for each column: the first operation that fires and changes the text."""
    parts = []
    for c in COLUMNS:
        x, how = c.name, lambda op, n=c.name: _cell(n, op + ".how", "row_id")
        made = {
            "missing": f"CASE WHEN {how('missing')} < 0.25 THEN '' WHEN {how('missing')} < 0.5 THEN 'NULL' WHEN {how('missing')} < 0.75 THEN 'N/A' ELSE '?' END", "wrong": f"reverse({x})", "outlier": f"(try_cast({x} AS DOUBLE) * 10)::VARCHAR" if c.ctype in ("int", "float") else x,
            "format": f"substr({x}, 6, 2) || '/' || substr({x}, 9, 2) || '/' || substr({x}, 1, 4)" if c.ctype == "date" else x, "case": f"CASE WHEN {how('case')} < 0.5 THEN upper({x}) ELSE lower({x}) END", "space": f"' ' || {x} || '  '", "typo": f"substr({x}, 2) || substr({x}, 1, 1)",
        }
        fired = [(op, f"{_cell(c.name, op, 'row_id')} < {rate}" + ("" if op == "missing" else f" AND {made[op]} <> {x}")) for op in g.OPS if (rate := getattr(c.mess, op))]
        named, spoiled = (" ".join(f"WHEN {test} THEN " + (f"'{op}'" if k == 0 else made[op]) for op, test in fired) for k in (0, 1))
        parts.append(f"SELECT row_id, '{c.name}' AS column_name, CASE {named} END AS op, {x} AS clean, CASE {spoiled} END AS dirty FROM {CLEAN}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE op IS NOT NULL"


LEDGER = _ledger()


@query("mess_ledger", LEDGER)
def mess_ledger(spark, sf):
    return g.plan_table(spark, spec(spark, sf))[2]


@query("mess_ledger_format", f"SELECT * FROM ({LEDGER}) WHERE op = 'format'")
def mess_ledger_format(spark, sf):
    return g.plan_table(spark, spec(spark, sf))[2].where("op = 'format'")


ASKED = [(c.name, op, r) for c in COLUMNS for op in g.OPS if (r := getattr(c.mess, op))]


@query("requested_vs_achieved", f"WITH a AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {chr(39)}{op}{chr(39)}, {r}::DOUBLE)' for c, op, r in ASKED)}) AS v(column_name, op, requested)), l AS ({LEDGER}) SELECT column_name, op, requested, round(count(l.row_id) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS achieved FROM a LEFT JOIN l USING (column_name, op) GROUP BY 1, 2, 3")
def requested_vs_achieved(spark, sf):
    """Share of cells each operation really corrupted, beside the rate asked for."""
    made = spec(spark, sf)
    ledger = g.plan_table(spark, made)[2].groupBy("column_name", "op").agg(F.count("*").alias("n"))
    return spark.createDataFrame(ASKED, "column_name string, op string, requested double").join(ledger, ["column_name", "op"], "left").select("column_name", "op", "requested", F.round(F.coalesce("n", F.lit(0)) / made.rows, 6).alias("achieved"))


@query("duplicate_rows", f"SELECT row_id + (SELECT count(*) FROM orders) AS row_id, row_id AS duplicate_of FROM {CLEAN} WHERE {_cell('row', 'duplicate', 'row_id')} < {DUPLICATES}")
def duplicate_rows(spark, sf):
    return g.plan_table(spark, spec(spark, sf))[1].where("duplicate_of is not null").select("row_id", "duplicate_of")


NAMES = {"given": ["Ada", "Bo", "Chen", "Dina", "Eino"], "family": ["Okafor", "Lund", "Sato", "Reyes"]}


def _z(column, op):
    return f"(sqrt(-2.0::DOUBLE * ln({_cell(column, op + ':a')})) * cos(2 * pi() * {_cell(column, op + ':b')}))"


@query("gen_more_kinds", f"""
SELECT o_orderkey AS i, [{', '.join(repr(n) for n in NAMES['given'])}][floor({_cell('who', 'given', 'o_orderkey')} * 5)::INT + 1] || ' ' || [{', '.join(repr(n) for n in NAMES['family'])}][floor({_cell('who', 'family', 'o_orderkey')} * 4)::INT + 1] AS who,
  round(list_sort([{', '.join(_cell('load', f'draw{k}', 'o_orderkey') for k in range(4))}])[2] * 100, 4) AS load, round(5 + 2 * z1, 4) AS weight, round(exp(greatest(least(1 + 0.5 * z2, 700), -700)), 4) AS size, round(CASE WHEN {_cell('mix', 'part', 'o_orderkey')} < 0.7 THEN 0 + 1 * z3 ELSE 20 + 3 * z3 END, 4) AS mix
FROM (SELECT *, {_z('weight', 'value').replace('i::VARCHAR', 'o_orderkey::VARCHAR')} AS z1, {_z('size', 'value').replace('i::VARCHAR', 'o_orderkey::VARCHAR')} AS z2, {_z('mix', 'value').replace('i::VARCHAR', 'o_orderkey::VARCHAR')} AS z3 FROM orders)""")
def gen_more_kinds(spark, sf):
    """Names, and the other distributions of numbers, by order."""
    columns = [g.Col("who", "person_name", "full_name", NAMES), g.Col("load", "float", "beta", {"a": 2, "b": 3, "scale": 100.0}), g.Col("weight", "float", "normal", {"mean": 5.0, "sd": 2.0}), g.Col("size", "float", "lognormal", {"mean": 1.0, "sd": 0.5}), g.Col("mix", "float", "mixture", {"parts": [(0.7, 0.0, 1.0), (0.3, 20.0, 3.0)]})]
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), *[g.value(c, F.col("o_orderkey"), 7).alias(c.name) for c in columns])


@query("generation_rules", f"""
SELECT o_orderkey, strftime(o_orderdate::DATE + (3 + floor({_u("'31:' || o_orderkey::VARCHAR || ':due:rule'")} * 8)::INT), '%Y-%m-%d') AS due, strftime(o_orderdate::DATE + (o_custkey % 10)::INT, '%Y-%m-%d') AS sent,
  round(o_totalprice * 0.1::DOUBLE * exp(0.2::DOUBLE * sqrt(-2.0::DOUBLE * ln({_u("'31:' || o_orderkey::VARCHAR || ':fee:rule:a'")})) * cos(2 * pi() * {_u("'31:' || o_orderkey::VARCHAR || ':fee:rule:b'")})), 4) AS fee, (o_orderstatus = 'F')::INT::DOUBLE AS f_done, o_totalprice AS f_price FROM orders""")
def generation_rules(spark, sf):
    """Dates so many days later, by draw and by another column, a noisy multiple, and the values of coefficients' keys."""
    orders = table(spark, sf, "orders").withColumn("wait", F.col("o_custkey") % 10)
    made = g.date_after(orders, "o_orderkey", "o_orderdate", "due", 31, 3, 10)
    made = g.date_after(made, "o_orderkey", "o_orderdate", "sent", 31, days_from="wait")
    made = g.derived(made, "o_orderkey", "o_totalprice", "fee", 0.1, 31, 0.2)
    return made.select("o_orderkey", F.col("due").cast("string").alias("due"), F.col("sent").cast("string").alias("sent"), "fee", g.feature(made, "o_orderstatus=F").alias("f_done"), g.feature(made, "o_totalprice").alias("f_price"))


def clean_orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


@query("cleaning_eval", """
WITH c AS (SELECT o_orderkey AS id, o_orderpriority AS truth, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'case' WHEN o_orderkey % 3 = 0 THEN 'space' END AS op,
  CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN o_orderpriority WHEN o_orderkey % 11 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS answer FROM orders),
p AS (SELECT coalesce(op, 'none') AS op, count(*) AS cells, count(*) FILTER (WHERE truth = answer) AS ok FROM c GROUP BY 1),
w AS (SELECT op, cells, ok, ok::DOUBLE / cells AS r, cells::DOUBLE AS n, 1.96::DOUBLE AS z FROM p)
SELECT op, cells, ok AS right, round(r, 6) AS rate, round(greatest((r + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(r * (1 - r) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0), 6) AS low,
  round(least((r + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(r * (1 - r) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1), 6) AS high FROM w""".replace("AS right", 'AS "right"'))
def cleaning_eval(spark, sf):
    """A cleaner that restores case and space, misses blanks, and lowers some sound cells."""
    clean = clean_orders(spark, sf).select("row_id", "priority")
    k, p = F.col("row_id"), F.col("priority")
    op = F.when(k % 7 == 0, "missing").when(k % 5 == 0, "case").when(k % 3 == 0, "space")
    dirty = clean.select("row_id", F.when(k % 7 == 0, "").when(k % 5 == 0, F.upper(p)).when(k % 3 == 0, F.concat(F.lit("  "), p)).otherwise(p).alias("priority"))
    cleaned = clean.select("row_id", F.when(k % 7 == 0, "").when(k % 5 == 0, p).when(k % 11 == 0, F.lower(p)).when(k % 3 == 0, F.concat(F.lit(" "), p)).otherwise(p).alias("priority"))
    ledger = clean.select("row_id", F.lit("priority").alias("column_name"), op.alias("op")).where("op is not null")
    return exam.cleaning(clean, dirty, cleaned, ledger, ["priority"])


@query("link_eval", """
WITH t AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 13 = 0), f AS (SELECT o_orderkey AS j FROM orders WHERE o_orderkey % 26 = 0 OR o_orderkey % 101 = 0)
SELECT count(k) AS planted, count(j) AS flagged, count(*) FILTER (WHERE k IS NOT NULL AND j IS NOT NULL) AS found, round(count(*) FILTER (WHERE k IS NOT NULL AND j IS NOT NULL)::DOUBLE / count(k), 6) AS recall, round(count(*) FILTER (WHERE k IS NOT NULL AND j IS NOT NULL)::DOUBLE / count(j), 6) AS precision FROM t FULL JOIN f ON k = j""")
def link_eval(spark, sf):
    orders = table(spark, sf, "orders")
    return exam.links(orders.where("o_orderkey % 13 = 0"), orders.where("o_orderkey % 26 = 0 or o_orderkey % 101 = 0"), "o_orderkey")


@query("extraction_recall", """
WITH t AS (SELECT DISTINCT conv_id AS doc, role AS category, lower(trim(regexp_replace(left(text, 30), '\\s+', ' ', 'g'))) AS needle FROM conversations WHERE text <> ''),
c AS (SELECT conv_id AS doc, role AS category, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS claim FROM conversations WHERE turn % 3 <> 0),
h AS (SELECT t.doc, t.category, needle, max(coalesce(contains(claim, needle), false)::INT) AS hit FROM t LEFT JOIN c USING (doc, category) GROUP BY ALL),
p AS (SELECT category, count(*) AS planted, sum(hit)::BIGINT AS found, sum(hit)::DOUBLE / count(*) AS r, count(*)::DOUBLE AS n, 1.96::DOUBLE AS z FROM h GROUP BY category)
SELECT category, planted, found, round(r, 6) AS recall, round(greatest((r + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(r * (1 - r) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0), 6) AS low,
  round(least((r + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(r * (1 - r) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1), 6) AS high FROM p""")
def extraction_recall(spark, sf):
    talk = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("role").alias("category"), "turn", "text")
    return exam.extraction(talk.where("text <> ''").withColumn("needle", F.substring("text", 1, 30)), talk.where("turn % 3 <> 0"))


@query("size_ladder", """
WITH p AS (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM lineitem GROUP BY l_quantity, l_discount), m AS (SELECT unnest([0.25, 0.5, 1, 2, 5, 10, 20])::DOUBLE AS multiple)
SELECT multiple, round(1000 * multiple)::BIGINT AS n_rows, round(avg((p * 1000 * multiple >= 5)::INT), 6) AS coverage, avg((p * 1000 * multiple >= 5)::INT) >= 0.7 AS offered FROM p, m GROUP BY multiple""")
def size_ladder(spark, sf):
    """How many patterns of a table a sample of each size would show five times or more."""
    cells = table(spark, sf, "lineitem").groupBy("l_quantity", "l_discount").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"))
    multiples = F.array(*[F.lit(x) for x in (0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0)])
    each = cells.crossJoin(total).select((F.col("n") / F.col("t")).alias("p"), F.explode(multiples).alias("multiple"))  # total: one row
    good = F.avg((F.col("p") * 1000 * F.col("multiple") >= 5).cast("double"))
    return each.groupBy("multiple").agg(F.round(F.first("multiple") * 1000).cast("long").alias("n_rows"), F.round(good, 6).alias("coverage"), (good >= 0.7).alias("offered"))


@query("identity_residual", "SELECT count(*) AS n, round(stddev_pop(d - s), 6) AS residual, round(stddev_pop(d), 6) AS spread, stddev_pop(d - s) < 0.01 * stddev_pop(d) AS identity FROM (SELECT l_extendedprice * (1 - l_discount) AS d, l_extendedprice - l_extendedprice * l_discount AS s FROM lineitem)")
def identity_residual(spark, sf):
    """Whether one column is a sum of two others."""
    lines = table(spark, sf, "lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("d"), (F.col("l_extendedprice") - F.col("l_extendedprice") * F.col("l_discount")).alias("s"))
    r, s = F.stddev_pop(F.col("d") - F.col("s")), F.stddev_pop("d")
    return lines.agg(F.count("*").alias("n"), F.round(r, 6).alias("residual"), F.round(s, 6).alias("spread"), (r < 0.01 * s).alias("identity"))
