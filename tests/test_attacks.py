"""Attacks, private releases and contradictions against the same without Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.seeds import uniform
from plumbline.operators import attacks, contradictions, private
from plumbline.plans.blueprint import Marginal


def test_disclosure_sees_a_republish_and_not_the_population(spark):
    people = spark.range(4000).select("id", *[F.floor(uniform(i, F.col("id"), "q") * 12).alias(f"q{i}") for i in range(3)])
    people = people.withColumn("s", F.when(uniform(9, F.col("q0"), F.col("q1"), F.col("q2"), F.col("id") % 2) < 0.5, "yes").otherwise("no"))  # both halves have rules of their own
    members, others = people.where("id % 2 = 0"), people.where("id % 2 = 1")
    leak = attacks.attribute_disclosure(members, others, members, ["q0", "q1", "q2"], "s").first()
    none = attacks.attribute_disclosure(members, others, others, ["q0", "q1", "q2"], "s").first()
    assert leak.n == 2000 and leak.excess > 0.03 and leak.low > 0 and none.excess == 0 and abs(leak.marginal - 0.5) < 0.06
    few = attacks.attribute_disclosure(members.limit(10), others, members, ["q0"], "s").first()
    assert few.n == 10 and few.excess is None


def test_likelihood_of_rows(spark):
    m = {"x": Marginal(0.8, [(0.0, 0.0), (0.5, 1.0), (0.5, 1.0), (1.0, 3.0)]), "s": Marginal(1.0, levels=["a", "b"], weights=[3.0, 1.0])}
    rows = [(0.5, "a"), (1.0, "b"), (2.0, "c"), (9.0, "a"), (None, "a"), (0.5, None)]
    got = [r.p for r in attacks.blueprint_likelihood(spark.createDataFrame(rows, "x double, s string").coalesce(1), m, "p").collect()]
    inside = np.log([0.5, 0.5, 0.25])
    want = [np.log(0.8) + inside[0] + np.log(0.75), np.log(0.8) + inside[1] + np.log(0.25), np.log(0.8) + inside[2] + np.log(1e-6), np.log(0.8) - 12 + np.log(0.75), np.log(0.2) + np.log(0.75), np.log(0.8) + inside[0] + np.log(1e-6)]
    assert np.allclose(got, want)


def test_control_decides_what_can_be_read(spark):
    rows = spark.range(3000).select("id", F.floor(uniform(1, F.col("id"), "q") * 300).alias("q"), (100 * uniform(1, F.col("id"), "x")).alias("x"))
    members, others = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    assert attacks.with_control(members, others, members, ["q"], "x").first().verdict == "LEAK"
    assert attacks.with_control(members, others, others, ["q"], "x").first().verdict == "CLEAN"
    assert attacks.with_control(members, others, others, ["id"], "x").first().verdict == "UNREADABLE"


def test_private_gaussian(spark):
    rng = np.random.default_rng(0)
    e = np.repeat(np.arange(5000), 3)
    z = rng.multivariate_normal([0, 0, 0], [[0.09, 0.05, 0], [0.05, 0.09, 0], [0, 0, 0.01]], 5000)[e] + rng.normal(0, 0.02, (15_000, 3))
    rows = [(int(i), *map(float, 50 + 50 * r)) for i, r in zip(e, z, strict=True)] + [(None, 1.0, 1.0, 1.0), (7_000, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "e long, a double, b double, c double").repartition(3)
    ranges = dict.fromkeys("abc", (0.0, 100.0))
    x = np.array([np.clip(z[e == i].mean(0), -1, 1) for i in range(5000)])
    x *= np.minimum(1, 1.2 / np.linalg.norm(x, axis=1))[:, None]
    model = private.private_gaussian(df, "e", ranges, 1.2, 1.0, 1e-5, 3)
    noise = {(r.i, r.j): r.sum for r in private.moments(df, "e", ranges, 1.2, 1.0, 1e-5, 3).collect()}
    assert model.n == 5000 and np.allclose([noise[-1, j] / 5000 for j in range(3)], model.mean)
    assert np.abs(model.mean - x.mean(0)).max() < 0.02 and np.abs(model.cov - np.cov(x.T)).max() < 0.02 and model.raised == 0
    made = private.draw(spark.range(4000), "id", model, 5).toPandas()
    assert made[["a", "b", "c"]].min().min() >= 0 and made[["a", "b", "c"]].max().max() <= 100
    assert abs(made.a.corr(made.b) - model.cov[0, 1] / np.sqrt(model.cov[0, 0] * model.cov[1, 1])) < 0.06
    small = private.private_gaussian(df.where("e < 12"), "e", ranges, 1.2, 0.05, 1e-5, 3)
    assert small.raised > 0 and np.linalg.eigvalsh(small.cov).min() > 0
    with pytest.raises(ValueError):
        private.private_gaussian(df.where("e < 1"), "e", ranges, 1.2, 1.0, 1e-5, 3)


def test_private_bounds_surround_most(spark):
    df = spark.range(6000).select((F.col("id") % 2000).alias("e"), (100 + 200 * uniform(1, F.col("id") % 2000, "x")).alias("x"))
    got = private.private_bounds(df, "e", "x", 0.0, 1000.0, 4.0, 8, (0.05, 0.95)).first()
    assert got.n == 2000 and abs(got.low - 110) < 8 and abs(got.high - 290) < 8


def brute_closure(orders):
    found = dict.fromkeys([])
    found = {(a, b): s for a, b, s in orders}
    while True:
        new = dict(found)
        for (a, b), s in found.items():
            for (c, d), t in found.items():
                if b == c:
                    new[a, d] = new.get((a, d), False) or s or t
        if new == found:
            return found
        found = new


def test_closure_and_circles(spark):
    rng = np.random.default_rng(4)
    for n in (6, 12):
        orders = [(f"n{a}", f"n{b}", bool(s)) for a, b, s in {(int(a), int(b)): (int(a), int(b), int(s)) for a, b, s in zip(rng.integers(0, n, n), rng.integers(0, n, n), rng.integers(0, 2, n), strict=True)}.values()]
        closed = contradictions.closure(spark.createDataFrame(orders, "a string, b string, strict boolean"))
        assert {(r.a, r.b): r.strict for r in closed.collect()} == brute_closure(orders)
        assert {(r.name, r.strict) for r in contradictions.circles(closed).collect()} == {(a, s) for (a, b), s in brute_closure(orders).items() if a == b}
    assert contradictions.closure(spark.createDataFrame([], "a string, b string, strict boolean")).count() == 0


def test_bounds_through_sums(spark):
    bounds = spark.createDataFrame([("total", 0.0, 10.0), ("a", 4.0, None), ("b", 3.0, 20.0), ("c", 4.0, 5.0), ("x", 1.0, 2.0)], "name string, low double, high double")
    orders = spark.createDataFrame([("x", "c", False)], "a string, b string, strict boolean")
    sums = spark.createDataFrame([("total", p) for p in "abc"], "total string, part string")
    got = {(r.rule, r["name"]) for r in contradictions.find(bounds, orders, sums).collect()}
    assert ("bounds", "total") in got and not any(n == "x" for _, n in got)
    fine = contradictions.find(bounds.where("name <> 'a'").union(spark.createDataFrame([("a", 1.0, None)], "name string, low double, high double")), orders, sums)
    assert fine.count() == 0
    narrowed = {r["name"]: (r.low, r.high) for r in contradictions.summed(spark.createDataFrame([("total", 0.0, 10.0), ("a", 1.0, None), ("b", 3.0, 20.0), ("c", 4.0, 5.0)], "name string, low double, high double"), sums).collect()}
    assert narrowed["b"] == (3.0, 5.0) and narrowed["a"] == (1.0, 3.0) and narrowed["total"][0] == 8.0
