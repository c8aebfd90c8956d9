import datetime
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import parse, seeds, stats
from plumbline.operators import ranks
from plumbline.plans import generate


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,value", [("$1,234.50", 1234.5), ("-$5", -5.0), ("(€7)", -7.0), ("12%", 12.0), ("7 £", 7.0), ("14:30", 870.0), ("09:05:30", 545.5), ("24:00", None), ("abc", None), ("", None), (None, None), ("5", None)])
def test_quantity(spark, text, value):
    assert one(spark, parse.quantity(F.col("t")), t=text) == value if text is not None else one(spark, parse.quantity(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("text,value", [("1,234 €", 1234.0), ("- $ 5", -5.0), ("$-5.25", -5.25), ("($1,000.5)", -1000.5), ("¥12", 12.0), ("$1,23", None), ("$1,2345", None), ("$12345", 12345.0), ("$.5", None), ("$5.", None), ("$", None), ("$5 $", None), ("$5%", None), ("-($5)", None), ("(-$5)", None), ("$1.2.3", None), ("5 $ 5", None)])
def test_money(spark, text, value):
    assert one(spark, parse.money(F.col("t")), t=text) == value


@pytest.mark.parametrize("text,value", [("-1,000.5 %", -1000.5), ("%5", None), ("5%%", None), (" 7% ", 7.0), ("1 2%", None)])
def test_percent(spark, text, value):
    assert one(spark, parse.percent(F.col("t")), t=text) == value


@pytest.mark.parametrize("text,value", [("7:05", 425.0), (" 23:59:59 ", 1439 + 59 / 60), ("23:60", None), ("7:5", None), ("12:00:00:00", None), ("-1:00", None), ("1:00:7", None), ("12:", None)])
def test_clock(spark, text, value):
    assert one(spark, parse.clock(F.col("t")), t=text) == value


@pytest.mark.parametrize("text,key", [("007", "7"), ("'012'", "12"), ("000", "0"), ("nan", None), (" ", None), ("A0", "A0")])
def test_norm_key(spark, text, key):
    assert one(spark, parse.norm_key(F.lit(text))) == key


def test_tokens_know_unknown_from_empty(spark):
    assert one(spark, parse.tokens(F.lit(" a ; b;; "))) == ["a", "b"]
    assert one(spark, parse.tokens(F.lit(""))) == [] and one(spark, parse.tokens(F.lit(None).cast("string"))) is None


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    u = seeds.uniform(1, F.col("id"), "c")
    a, b = ({r.id: r.u for r in d.select("id", u.alias("u")).collect()} for d in (df.repartition(1), df.repartition(7)))
    assert a == b and all(0 < x < 1 for x in a.values()) and abs(sum(a.values()) / 500 - 0.5) < 0.05


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3), st.integers()), max_size=40))
def test_average_ranks(spark, values):
    values = [None if v is None else float(v % 1_000_003) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None)
    want = {v: (sum(k for k, x in enumerate(known, 1) if x == v) / known.count(v), known.count(v)) for v in set(known)}
    assert {r.v: (r["rank"], r.n) for r in ranks.average_ranks(df, "v").collect()} == want


def test_wilson_and_required_n(spark):
    low, high = stats.wilson(F.lit(8), F.lit(10))
    assert math.isclose(one(spark, low), 0.490162, abs_tol=1e-5) and math.isclose(one(spark, high), 0.943318, abs_tol=1e-5)
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0.0, 1.0)
    assert one(spark, stats.required_n(F.lit(0.5), F.lit(0.1))) == 97 and one(spark, stats.required_n(F.lit(0.5), F.lit(0.0))) is None


def spec(**more):
    return generate.Spec("t", [generate.Col("id", "str_id", "sequence"), generate.Col("x", "float", "normal", {"mean": 5, "sd": 2, "min": 0}, generate.Mess(missing=0.2, outlier=0.1))], 200, **more)


def test_a_column_more_changes_no_other_and_rows_only_add(spark):
    base = generate.plan_table(spark, spec())[1]
    wide = spec()
    wide.columns.append(generate.Col("y", "int", "uniform", {"low": 0, "high": 9}))
    long = spec()
    long.rows = 300
    rows = lambda d: {r.row_id: (r.id, r.x) for r in d.collect()}
    assert rows(generate.plan_table(spark, wide)[1]) == rows(base)
    assert {k: v for k, v in rows(generate.plan_table(spark, long)[1]).items() if k < 200} == rows(base)


def test_ledger_holds_every_difference(spark):
    clean, dirty, ledger = generate.plan_table(spark, spec(duplicate_rate=0.1))
    a, b = ({(r.row_id, c): r[c] for r in d.collect() if r.row_id < 200 for c in ("id", "x")} for d in (clean, dirty))
    assert {k for k in a if a[k] != b[k]} == {(r.row_id, r.column_name) for r in ledger.collect()}
    assert all(r.duplicate_of == r.row_id - 200 for r in dirty.where("row_id >= 200").collect())


def test_a_spec_tells_all_its_problems(spark):
    bad = generate.Spec("t", [generate.Col("a", "int", "categorical"), generate.Col("a", "float", "uniform", {"low": 2, "high": 1}, generate.Mess(typo=2))], -1, duplicate_rate=0.9)
    assert len(bad.problems()) == 6
    with pytest.raises(ValueError, match="declared twice"):
        generate.clean_table(spark, bad)


def test_day_numbers(spark):
    assert one(spark, parse.day_number(F.lit("2024-02-29"), "yyyy-MM-dd")) == (datetime.date(2024, 2, 29) - datetime.date(1970, 1, 1)).days
    assert one(spark, parse.day_number(F.lit("2023-02-29"), "yyyy-MM-dd")) is None


def test_vehicle_numbers(spark):
    texts = ["1M8GDM9AXKP042788", "1m8gdm9axkp042788 ", "1M8GDM9A1KP042788", "11111111111111111", "IM8GDM9AXKP042788", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(parse.vin_valid(F.col("t"))).collect()] == [True, True, False, True, False, False, None]
