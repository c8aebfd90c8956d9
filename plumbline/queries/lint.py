"""A spec with rules and outcomes, as large as the orders, and what its own table says of it."""

from pyspark.sql import functions as F

from plumbline.plans import generate as g
from plumbline.plans.lint import lint_table
from plumbline.queries.related import _u
from plumbline.registry import query, table


def spec(spark, sf):
    columns = [
        g.Col("admitted", "date", "date_range", {"start": "2001-01-01", "days": 300}), g.Col("discharged", "date", "date_range", {"start": "2001-01-01", "days": 1}), g.Col("billed", "date", "date_range", {"start": "2001-01-01", "days": 1}),
        g.Col("stay", "int", "uniform", {"low": 0, "high": 20}, g.Mess(missing=0.1)), g.Col("price", "float", "uniform", {"low": 1.0, "high": 9.0}), g.Col("total", "float", "uniform", {"low": 0.0, "high": 1.0}), g.Col("nothing", "int", "uniform", {"low": 0, "high": 1}),
    ]
    rules = [g.Rule("date_after", "admitted", "discharged", days_from="stay"), g.Rule("date_after", "admitted", "billed", 3, 30), g.Rule("derived", "price", "total", factor=1e13), g.Rule("derived", "price", "nothing", factor=0.0)]
    outcomes = [g.Outcome("back", {"stay": 1.5}, -1.0, (0.3, 0.4)), g.Outcome("rare", {"price": 0.5}, -7.0), g.Outcome("often", {"stay": 0.5}, 0.2, (0.1, 0.2))]
    return g.Spec("stays", columns, table(spark, sf, "orders").count(), 61, rules=rules, outcomes=outcomes)


def _cell(column, what="value"):
    return _u(f"'61:' || i::VARCHAR || ':{column}:{what}'")


CELLS = f"""c AS (SELECT i, round_even(20 * {_cell('stay')}, 0) AS stay, round(1 + 8 * {_cell('price')}, 4) AS price FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS i)),
w AS (SELECT avg(stay) AS ms, stddev_pop(stay) AS ss, avg(price) AS mp, stddev_pop(price) AS sp FROM c)"""


@query("rules_in_spec", f"""
WITH {CELLS}, d AS (SELECT i, DATE '2001-01-01' + floor({_cell('admitted')} * 301)::INT AS a, stay, price FROM c)
SELECT i AS row_id, strftime(a, '%Y-%m-%d') AS admitted, strftime(a + greatest(stay, 0)::INT, '%Y-%m-%d') AS discharged, strftime(a + (3 + floor({_cell('billed', 'rule')} * 28)::INT), '%Y-%m-%d') AS billed, round(price * 1e13::DOUBLE / 1e9, 3) AS total FROM d""")
def rules_in_spec(spark, sf):
    """Days after days and derived columns, declared in the spec."""
    made = g.clean_table(spark, spec(spark, sf))
    return made.select("row_id", *[made[c].cast("string").alias(c) for c in ("admitted", "discharged", "billed")], F.round(F.col("total") / 1e9, 3).alias("total"))


@query("lint_table", f"""
WITH {CELLS}, o AS (SELECT avg(({_cell('back', 'outcome')} < 1 / (1 + exp(-(-1 + 1.5::DOUBLE * (stay - ms) / ss))))::INT) AS back, avg(({_cell('rare', 'outcome')} < 1 / (1 + exp(-(-7 + 0.5::DOUBLE * (price - mp) / sp))))::INT) AS rare, avg(({_cell('often', 'outcome')} < 1 / (1 + exp(-(0.2::DOUBLE + 0.5::DOUBLE * (stay - ms) / ss))))::INT) AS often FROM c, w)
SELECT CASE WHEN back BETWEEN 0.3 AND 0.4 THEN 'INFO' ELSE 'WARN' END AS level, 'prevalence' AS code, 'back' AS subject, round(back, 6) AS figure FROM o UNION ALL SELECT 'WARN', 'one class', 'rare', round(rare, 6) FROM o UNION ALL SELECT CASE WHEN often BETWEEN 0.1 AND 0.2 THEN 'INFO' ELSE 'WARN' END, 'prevalence', 'often', round(often, 6) FROM o
UNION ALL SELECT 'WARN', 'derived size', 'total', max(round(price * 1e13::DOUBLE, 4)) FROM c UNION ALL SELECT 'WARN', 'derived zeros', 'nothing', 0 UNION ALL SELECT 'INFO', 'overwritten distribution', unnest(['discharged', 'billed', 'total', 'nothing']), NULL UNION ALL SELECT 'WARN', 'asked and not declared', 'typo', NULL""")
def lint_of_table(spark, sf):
    return lint_table(spark, spec(spark, sf), "Stays with some missing lengths and a few typos in names")
