"""Texts to types, and sets to columns."""

from pyspark.sql import functions as F

from plumbline.functions import parse
from plumbline.operators import relate, typing as t
from plumbline.registry import query, table

CENSUS = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], "events": ["event_type", "value", "user_id"]}


@query("typing_census", " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS present, count(DISTINCT {c}::VARCHAR) AS distinct_values, round(count(try_cast({c}::VARCHAR AS DOUBLE))::DOUBLE / count({c}), 6) AS numeric_share, CASE WHEN count({c}) >= 0.99 * count(*) AND count(DISTINCT {c}::VARCHAR) >= 0.99 * count({c}) AND (count(try_cast({c}::VARCHAR AS DOUBLE)) < 0.99 * count({c}) OR bool_and(try_cast({c}::VARCHAR AS DOUBLE) = floor(try_cast({c}::VARCHAR AS DOUBLE)))) THEN 'identifier' WHEN count(try_cast({c}::VARCHAR AS DOUBLE)) >= 0.99 * count({c}) THEN 'numeric' ELSE 'category' END AS role FROM {n}" for n, cs in CENSUS.items() for c in cs))
def typing_census(spark, sf):
    from functools import reduce

    return reduce(lambda a, b: a.union(b), [t.census(table(spark, sf, n).select(*cs)).select(F.lit(n).alias("table_name"), "*") for n, cs in CENSUS.items()])


@query("date_kind_formats", """
SELECT 'iso' AS column_name, f AS fmt, count(*) FILTER (WHERE f = 'yyyy-MM-dd') AS parsed, count(*) AS present, (count(*) FILTER (WHERE f = 'yyyy-MM-dd')) >= 0.9 * count(*) AS accepted FROM orders, (SELECT unnest(['yyyy-MM-dd', 'MM/dd/yyyy', 'dd/MM/yyyy']) AS f) GROUP BY f
UNION ALL SELECT 'us', f, count(CASE f WHEN 'MM/dd/yyyy' THEN 1 WHEN 'dd/MM/yyyy' THEN CASE WHEN day(o_orderdate) <= 12 THEN 1 END END), count(*), count(CASE f WHEN 'MM/dd/yyyy' THEN 1 WHEN 'dd/MM/yyyy' THEN CASE WHEN day(o_orderdate) <= 12 THEN 1 END END) >= 0.9 * count(*) FROM orders, (SELECT unnest(['yyyy-MM-dd', 'MM/dd/yyyy', 'dd/MM/yyyy']) AS f) GROUP BY f""")
def date_kind_formats(spark, sf):
    day = F.to_date("o_orderdate")
    shown = table(spark, sf, "orders").select(F.date_format(day, "yyyy-MM-dd").alias("iso"), F.date_format(day, "MM/dd/yyyy").alias("us"))
    return t.date_formats(shown, parse.DATE_FORMATS[:3])


@query("date_ordinal_roundtrip", "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS day_number, strftime(o_orderdate, '%m/%d/%Y') AS back FROM orders")
def date_ordinal_roundtrip(spark, sf):
    shown = table(spark, sf, "orders").select("o_orderkey", F.date_format(F.to_date("o_orderdate"), "MM/dd/yyyy").alias("d"))
    n = shown.withColumn("day_number", parse.day_number(F.col("d"), "MM/dd/yyyy"))
    return n.select("o_orderkey", "day_number", parse.from_day_number(F.col("day_number"), "MM/dd/yyyy").alias("back"))


@query("quantity_currency_parse", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS currency, round(l_discount * 100, 1) AS percent FROM lineitem")
def quantity_currency_parse(spark, sf):
    shown = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("c"), F.format_string("%.1f%%", F.col("l_discount") * 100).alias("p"))
    return shown.select("l_orderkey", "l_linenumber", parse.quantity(F.col("c")).alias("currency"), parse.quantity(F.col("p")).alias("percent"))


@query("clock_to_minutes", "SELECT event_id, (hour(ts) * 60 + minute(ts))::DOUBLE AS minutes FROM events")
def clock_to_minutes(spark, sf):
    shown = table(spark, sf, "events").select("event_id", F.date_format("ts", "HH:mm").alias("clock"))
    return shown.select("event_id", parse.quantity(F.col("clock")).alias("minutes"))


@query("norm_key", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey::VARCHAR END AS key FROM orders")
def norm_key(spark, sf):
    """Keys written with quotes, leading zeros and the word nan, read back."""
    n = F.col("o_custkey").cast("string")
    shown = F.when(F.col("o_orderkey") % 9 == 0, "nan").when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("'00"), n, F.lit("'"))).otherwise(F.lpad(n, 8, "0"))
    return table(spark, sf, "orders").select("o_orderkey", parse.norm_key(shown).alias("key"))


@query("snake_names", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def snake_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", parse.snake(F.col("p_name")).alias("name"))


MODES = ["A", "N", "R"]


@query("set_expand", "SELECT l_orderkey, count(DISTINCT l_returnflag) AS flags__n, " + ", ".join(f"bool_or(l_returnflag = '{m}')::DOUBLE AS flags__has__{m}" for m in MODES) + " FROM lineitem GROUP BY l_orderkey")
def set_expand(spark, sf):
    sets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), " ; ").alias("flags"))
    return t.expand(sets, "flags", MODES).select("l_orderkey", "flags__n", *[f"flags__has__{m}" for m in MODES])


@query("looks_like_set", """
WITH s AS (SELECT count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS filled, round(avg((n > 1)::INT), 6) AS with_separator, round(avg(n), 6) AS mean_size, count(*) >= 50 AND avg((n > 1)::INT) >= 0.3 AND avg(n) >= 1.2 AS is_set FROM s""")
def looks_like_set(spark, sf):
    sets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ";").alias("flags"))
    return t.set_test(sets, "flags")


@query("as_strings", "SELECT p_partkey::VARCHAR AS p_partkey, p_size::VARCHAR AS p_size FROM part")
def as_strings(spark, sf):
    """Numbers that are whole throughout have no decimals as text."""
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    return t.as_strings(parts)
