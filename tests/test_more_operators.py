import math
import random

import numpy as np
import pytest

from plumbline.operators import decorated, floors, noise, planting, privacy, profiles, related, tails
from plumbline.plans import generate as g
from pyspark.sql import functions as F


def test_keys_and_links_by_name():
    assert related.pick_key("visits", ["seen", "visit_id", "other_id"]) == "visit_id"
    assert related.pick_key("visits", ["a", "b"]) == "a" and related.pick_key("visits", []) is None
    order = related.link_order([("c", "b"), ("b", "a"), ("d", "a"), ("x", "y"), ("y", "x")])
    assert order.index("a") < order.index("b") < order.index("c") and set(order[-2:]) == {"x", "y"}
    assert related.collisions(["a__has__b", "a_has_b", "x__prev"]) == ["a__has__b", "x__prev"]


def test_near_orphans_name_no_parent(spark):
    parents = spark.createDataFrame([(f"P{i:04d}",) for i in range(0, 3_000, 7)], "k string")
    rows = parents.withColumn("row", F.xxhash64("k"))
    out = related.break_references(rows, "row", "k", parents, "k", "P", 4, 1.0, 0.0, "near", 3).collect()
    known = {r.k for r in out}
    assert len(out) == len(known)
    broken = [r for r in out if r.mess == "orphan"]
    assert len(broken) > 300 and all(r.dirty not in known and sorted(r.dirty) == sorted(r.k) for r in broken)
    assert all(r.dirty == r.k for r in out if r.mess is None)


def brute_knot(rows, q, k):
    rows = sorted(rows)
    at = max(0, min(len(rows) - 1, round(q * (len(rows) - 1))))
    if len({e for v, _, e in rows if v == rows[at][0]}) >= k:
        return rows[at][0]
    lo = hi = at
    seen = {rows[at][2]}
    while len(seen) < k and (lo > 0 or hi < len(rows) - 1):
        if lo > 0:
            lo -= 1
            seen.add(rows[lo][2])
        if len(seen) < k and hi < len(rows) - 1:
            hi += 1
            seen.add(rows[hi][2])
    return sum(v for v, _, _ in rows[lo : hi + 1]) / (hi - lo + 1)


@pytest.mark.parametrize("k", [2, 5])
def test_knots_against_widening_step_by_step(spark, k):
    rng = random.Random(k)
    rows = [(float(rng.choice([rng.randrange(40), 7, 7.5])), i, rng.randrange(12)) for i in range(150)]
    df = spark.createDataFrame(rows, "v double, i int, e int")
    got = {r.q: r.v for r in tails.k_knots(df, "e", "v", ["i"], [0.0, 0.03, 0.5, 0.97, 1.0], k).collect()}
    assert got == {q: pytest.approx(brute_knot(rows, q, k), abs=1e-6) for q in got} and len(got) == 5
    assert tails.k_knots(df.limit(0), "e", "v", ["i"], [0.5], k).count() == 0


def test_tails_below_k_say_nothing(spark):
    df = spark.createDataFrame([(float(i), i % 5) for i in range(50)], "v double, e int")
    r = tails.tail(df, "e", "v", 45.0).first()
    assert r.entities == 5 and r["mean"] is None and r.sd is None
    assert tails.tail_bands(df, "e", "v", 45.0, 0.9).count() == 0
    assert tails.presence_model(df, "e", "v", ["v"]).count() == 0


def test_noise_accounting():
    eps, order = noise.spent(0.01, 1.0, 1_000)
    assert 1 < eps < 5 and order in noise.ORDERS
    sigma = noise.sigma_for(0.01, 1_000, 1.0)
    assert noise.spent(0.01, sigma, 1_000)[0] <= 1.0 < noise.spent(0.01, sigma * 0.99, 1_000)[0]
    assert noise.sigma_for(0.5, 10**9, 0.01) == math.inf
    assert noise.renyi(1.0, 2.0, 4) == pytest.approx(0.5) and noise.renyi(0.0, 2.0, 4) == 0
    with pytest.raises(ValueError):
        noise.gaussian_scale(1.0, 1e-5, 0)


def test_roots_of_correlations():
    good = np.array([[1, 0.5], [0.5, 1]])
    assert np.allclose(planting.cholesky(good) @ planting.cholesky(good).T, good)
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    root = planting.cholesky(bad)
    assert np.allclose((root @ root.T).diagonal(), 1)


def test_nearest_against_all_pairs(spark):
    rng = random.Random(4)
    targets = [(rng.random() * 10, rng.random() * 3) for _ in range(80)] + [(500.0, 500.0)]
    queries = [(i, rng.random() * 12, rng.random() * 3) for i in range(60)] + [(90, 400.0, 1.0), (91, None, 1.0), (90, 400.0, 1.0)]
    df = spark.createDataFrame(queries, "k int, x double, y double")
    to = spark.createDataFrame([*targets, (None, 1.0)], "x double, y double")
    got = {r.k: r.distance for r in privacy.nearest(df, "k", to, {"x": 2.0, "y": 1.0}).collect()}
    for k, x, y in queries:
        want = None if x is None else min(math.hypot((x - a) / 2, y - b) for a, b in targets)
        assert got[k] == (None if want is None else pytest.approx(want))
    assert all(r.distance is None for r in privacy.nearest(df, "k", to.limit(0), {"x": 2.0, "y": 1.0}).collect())
    assert privacy.nearest(df.limit(0), "k", to, {"x": 2.0, "y": 1.0}).count() == 0


def test_samplers_declare_their_types():
    assert g.TYPES["int"] == g.TYPES["float"] and "sequence" in g.TYPES["str_id"]
    spec = g.Spec("t", [g.Col("a", "int", "categorical"), g.Col("b", "float", "beta", {"a": 1.5, "b": 2})], 5)
    assert len(spec.problems()) == 2


def test_cells_without_power_have_no_verdict(spark):
    few = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 9.0)], "c string, v double")
    r = floors.judge_cells(few, few, ["c"], "v").first()
    assert r.tracks is None and r.gap is None and r.cells == 0 and r.floor > 0.35


def test_shapes_of_curves(spark):
    for ys, want in (([1, 1, 1], "flat"), ([1, 2, 3], "rising"), ([3, 2, 1], "falling"), ([3, 0, 3], "u-shaped"), ([0, 3, 0], "peaked")):
        df = spark.createDataFrame([(i, float(y)) for i, y in enumerate(ys)], "x int, y double")
        assert floors.curve_shape(df, "x", "y", 1.0).first()["shape"] == want


def test_profiles_of_little(spark):
    empty = spark.createDataFrame([], "e int, v double")
    assert profiles.profile_numeric(empty, "v").count() == 0
    assert {r.visits: r.persons for r in profiles.visit_histogram(empty, "e").collect()} == {"1": 0, "2": 0, "3-5": 0, "6-10": 0, "11+": 0}
    same = spark.createDataFrame([(1, 2.0)] * 30, "e int, v double")
    r = profiles.profile_numeric(same, "v").first()
    assert (r.family, r.location, r["scale"], r.outlier_rate) == ("normal", 2.0, 0.0, 0.0)


def test_decorations(spark):
    df = spark.createDataFrame([("$1,234.50",), ("-$5",), ("$ -5.5",), ("$12,34",), ("24:00",), ("23:59:30",), ("7.5%",), (None,)], "t string")
    got = {r.t: (r.m, r.c, r.p) for r in df.select("t", decorated.money(F.col("t")).alias("m"), decorated.clock(F.col("t")).alias("c"), decorated.percent(F.col("t")).alias("p")).collect()}
    assert got == {"$1,234.50": (1234.5, None, None), "-$5": (-5.0, None, None), "$ -5.5": (-5.5, None, None), "$12,34": (None, None, None), "24:00": (None, None, None), "23:59:30": (None, 1439.5, None), "7.5%": (None, None, 7.5), None: (None, None, None)}
