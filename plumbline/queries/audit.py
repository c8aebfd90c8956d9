"""Audits of the driver tables."""

from pyspark.sql import functions as F

from plumbline.operators import audit as a
from plumbline.registry import query, table


def _u(key):
    return f"((('0x' || substr(sha256({key}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"


KS = [2, 5, 10, 20]


@query("price_of_k", f"""
WITH p AS (SELECT l_quantity * 100 + l_linenumber AS v, count(*) AS n, count(DISTINCT l_suppkey) AS e FROM lineitem GROUP BY 1)
SELECT k, count(*) AS levels, count(*) FILTER (WHERE e >= k) AS kept_levels, round(coalesce(sum(n) FILTER (WHERE e >= k), 0) / sum(n)::DOUBLE, 6) AS kept_rows FROM p, (VALUES {', '.join(f'({k})' for k in KS)}) AS t(k) GROUP BY k""")
def price_of_k(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("v", F.col("l_quantity") * 100 + F.col("l_linenumber"))
    return a.price_of_k(lines, "l_suppkey", "v", KS)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "net", "cut"]
LINES = "(SELECT *, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * l_discount AS cut FROM lineitem)"


def lines(spark, sf):
    price, share = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf, "lineitem").withColumns({"net": price * (1 - share), "cut": price * share})


def _strongest(c):
    return "greatest(" + ", ".join(f"coalesce(abs(corr({c}, {o})), 0)" for o in NUMBERS if o != c) + ")"


@query("unexplained_columns", "SELECT column_name, round(s, 6) AS strongest FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {_strongest(c)} AS s FROM {LINES}" for c in NUMBERS) + ") WHERE s < 0.1")
def unexplained_columns(spark, sf):
    return a.unexplained(lines(spark, sf), NUMBERS)


@query("column_identities", f"SELECT 'l_extendedprice = net + cut' AS identity, round(stddev_pop(l_extendedprice - (net + cut)) / stddev_pop(l_extendedprice), 6) AS residual FROM {LINES}")
def column_identities(spark, sf):
    """Of all triples of columns the one sum that holds."""
    return a.identities(lines(spark, sf), ["l_extendedprice", "net", "cut", "l_quantity"])


@query("run_difference", """
WITH b AS (SELECT user_id, event_type, count(*) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2), c AS (SELECT user_id, event_type, count(*) AS v FROM events WHERE event_id % 4 <> 0 GROUP BY 1, 2), j AS (SELECT user_id, event_type, b.v AS before, c.v AS after FROM b FULL JOIN c USING (user_id, event_type)),
d AS (SELECT *, CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'gone' WHEN abs(after - before) >= 3 THEN 'moved' END AS change FROM j)
SELECT * FROM d WHERE change IS NOT NULL""")
def run_difference(spark, sf):
    events = table(spark, sf, "events")
    one, two = (events.where(w).groupBy("user_id", "event_type").agg(F.count("*").alias("v")) for w in ("event_id % 3 <> 0", "event_id % 4 <> 0"))
    return a.run_difference(one, two, ["user_id", "event_type"], "v", 3)


@query("seeded_sample", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_u(chr(39) + '61:' + chr(39) + ' || o_orderkey::VARCHAR || ' + chr(39) + ':sample' + chr(39))}, o_orderkey LIMIT 200")
def seeded_sample(spark, sf):
    return a.seeded_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 200, 61)


@query("balanced_rows", f"""
WITH s AS (SELECT toxic, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1)
SELECT doc_id, toxic FROM labels JOIN s USING (toxic) WHERE {_u("'62:' || doc_id::VARCHAR || ':balance'")} < (SELECT min(n) FROM s) / n::DOUBLE""")
def balanced_rows(spark, sf):
    return a.balanced(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 62).select("doc_id", "toxic")


@query("learned_bins", """
WITH q AS (SELECT list_distinct(quantile_cont(o_totalprice, [0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE])) AS e FROM orders), b AS (SELECT len(list_filter(e, lambda x: o_totalprice > x)) AS bin, o_totalprice AS v FROM orders, q)
SELECT bin::INT AS bin, count(*) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high FROM b GROUP BY 1""")
def learned_bins(spark, sf):
    orders = table(spark, sf, "orders")
    edges = a.cut_edges(orders, "o_totalprice", 5)
    return orders.groupBy(a.bin_of(F.col("o_totalprice"), edges).alias("bin")).agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 6).alias("low"), F.round(F.max("o_totalprice"), 6).alias("high"))


@query("text_grams", """
WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM conversations), g AS (SELECT conv_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS gram FROM w)
SELECT gram, count(DISTINCT conv_id) AS docs FROM g GROUP BY 1 HAVING count(DISTINCT conv_id) >= 3""")
def text_grams(spark, sf):
    """Runs of three words that three conversations share."""
    return a.grams(table(spark, sf, "conversations"), "conv_id", "text", 3, 3)


@query("clean_values", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderdate::DATE AS VARCHAR) END AS day FROM orders""")
def clean_values(spark, sf):
    """Flags and days in several spellings."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    flag = F.when(k % 5 == 0, " Yes").when(k % 5 == 1, "FALSE").when(k % 5 == 2, "1").when(k % 5 == 3, "n ").otherwise("maybe")
    text = F.when(k % 6 == 0, "soon").when(k % 6 < 3, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", a.clean_flag(flag).alias("flag"), a.clean_day(text, ["yyyy-MM-dd", "dd.MM.yyyy"]).cast("string").alias("day"))


@query("shape_gap", """
WITH l AS (SELECT l_suppkey % 2 AS h, l_quantity AS x, l_extendedprice AS y, (l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 30)::INT + (l_quantity > 40)::INT AS b FROM lineitem), c AS (SELECT h, b, avg(x) AS x, avg(y) AS y FROM l GROUP BY 1, 2 HAVING count(*) >= 5), s AS (SELECT stddev_samp(y) AS sd FROM l WHERE h = 0),
j AS (SELECT o.x, o.y, max_by(struct_pack(x := t.x, y := t.y), t.x) FILTER (WHERE t.x <= o.x) AS a, min_by(struct_pack(x := t.x, y := t.y), t.x) FILTER (WHERE t.x >= o.x) AS b FROM c AS o, c AS t WHERE o.h = 0 AND t.h = 1 GROUP BY o.x, o.y)
SELECT count(*) AS points, round(max(abs(CASE WHEN b.x = a.x THEN a.y ELSE a.y + (j.x - a.x) / (b.x - a.x) * (b.y - a.y) END - j.y) / sd) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL), 6) AS gap FROM j, s""")
def shape_gap(spark, sf):
    """Price along quantity, lines of odd suppliers against those of even ones."""
    both = table(spark, sf, "lineitem")
    return a.shape_gap(both.where("l_suppkey % 2 = 0"), both.where("l_suppkey % 2 = 1"), "l_quantity", "l_extendedprice", [10.0, 20.0, 30.0, 40.0])


@query("shape_floor", f"""
WITH l AS (SELECT s, CASE WHEN {_u("s::VARCHAR || ':' || l_orderkey::VARCHAR || ':half'")} < 0.5 THEN 0 ELSE 1 END AS h, l_quantity AS x, l_extendedprice AS y, (l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 30)::INT + (l_quantity > 40)::INT AS b FROM lineitem, range(5) AS t(s)),
c AS (SELECT s, h, b, avg(x) AS x, avg(y) AS y FROM l GROUP BY ALL HAVING count(*) >= 5), d AS (SELECT s, stddev_samp(y) AS sd FROM l WHERE h = 0 GROUP BY s),
j AS (SELECT o.s, o.x, o.y, max_by(struct_pack(x := t.x, y := t.y), t.x) FILTER (WHERE t.x <= o.x) AS a, min_by(struct_pack(x := t.x, y := t.y), t.x) FILTER (WHERE t.x >= o.x) AS b FROM c AS o JOIN c AS t USING (s) WHERE o.h = 0 AND t.h = 1 GROUP BY o.s, o.x, o.y),
g AS (SELECT s, round(max(abs(CASE WHEN b.x = a.x THEN a.y ELSE a.y + (j.x - a.x) / (b.x - a.x) * (b.y - a.y) END - j.y) / sd) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL), 6) AS gap FROM j JOIN d USING (s) GROUP BY s)
SELECT count(gap) AS splits, round(avg(gap), 6) AS floor FROM g""")
def shape_floor(spark, sf):
    """What price along quantity strays between halves of the orders, in five splits."""
    return a.shape_floor(table(spark, sf, "lineitem"), "l_orderkey", "l_quantity", "l_extendedprice", [10.0, 20.0, 30.0, 40.0])
