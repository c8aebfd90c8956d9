"""Noisy releases and what they spend."""

from pyspark.sql import functions as F

from plumbline.operators import noise as n
from plumbline.registry import query, table


def _u(key):
    return f"((('0x' || substr(sha256({key}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"


CAPPED = f"""(SELECT item, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY {_u("'41:' || e::VARCHAR || ':' || item || ':cap'")}) AS i FROM (SELECT DISTINCT user_id AS e, event_type AS item FROM events)) WHERE i <= 2 GROUP BY 1)"""


def counts(spark, sf):
    return n.capped_counts(table(spark, sf, "events"), "user_id", "event_type", 2, 41)


@query("gaussian_histogram", f"""
SELECT item, round(n + {n.gaussian_scale(0.5, 1e-5, 2)!r}::DOUBLE * sqrt(-2.0::DOUBLE * ln({_u("'42:' || item || ':noise:a'")})) * cos(2.0::DOUBLE * pi() * {_u("'42:' || item || ':noise:b'")}), 6) AS noisy FROM {CAPPED}""")
def gaussian_histogram(spark, sf):
    return n.gaussian_histogram(counts(spark, sf), 0.5, 1e-5, 2, 42).select("item", F.round("noisy", 6).alias("noisy"))


@query("select_above", f"""
WITH x AS (SELECT item, n - 2.0::DOUBLE * sign({_u("'43:' || item || ':noise'")} - 0.5) * ln(1 - 2 * abs({_u("'43:' || item || ':noise'")} - 0.5)) AS noisy FROM {CAPPED})
SELECT item, round(noisy, 6) AS noisy FROM x WHERE noisy >= 10 + 2.0::DOUBLE * ln(0.5 / 1e-6) + 2""")
def select_above(spark, sf):
    return n.select_above(counts(spark, sf), 10, 1.0, 2, 43).select("item", F.round("noisy", 6).alias("noisy"))


CASES = [(0.01, 1.0, 1_000), (0.05, 2.0, 500), (0.2, 4.0, 100)]


@query("privacy_spent", f"""
WITH c AS (SELECT * FROM (VALUES {', '.join(f'({q}::DOUBLE, {s}::DOUBLE, {t})' for q, s, t in CASES)}) AS v(q, sigma, steps)), a AS (SELECT q, sigma, steps, a.a AS a, k.k AS k FROM c, range(2, 65) AS a(a), range(0, 65) AS k(k) WHERE k.k <= a.a),
t AS (SELECT q, sigma, steps, a, lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1) + (a - k) * ln(1 - q) + k * ln(q) + k * (k - 1) / (2 * sigma * sigma) AS t FROM a), m AS (SELECT q, sigma, steps, a, max(t) AS m FROM t GROUP BY ALL), r AS (SELECT q, sigma, steps, a, (max(m) + ln(sum(exp(t - m)))) / (a - 1) AS r FROM t JOIN m USING (q, sigma, steps, a) GROUP BY q, sigma, steps, a),
e AS (SELECT q, sigma, steps, a, steps * r + ln(1 / 1e-5) / (a - 1) AS e FROM r)
SELECT q, sigma, steps, round(min(e), 6) AS epsilon, arg_min(a, e) AS "order" FROM e GROUP BY q, sigma, steps""")
def privacy_spent(spark, sf):
    rows = []
    for q, sigma, steps in CASES:
        epsilon, order = n.spent(q, sigma, steps)
        rows.append((q, sigma, steps, round(epsilon, 6), order))
    return spark.createDataFrame(rows, "q double, sigma double, steps int, epsilon double, `order` long")
