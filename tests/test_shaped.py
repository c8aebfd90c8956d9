"""What is drawn from relations, tails and steadiness, against the same by numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.seeds import normal, uniform
from plumbline.functions.stats import normal_cdf
from plumbline.operators import persistence
from plumbline.plans import shaped


def column(df, c):
    return np.array([np.nan if r.x is None else r.x for r in df.select(c.alias("x")).collect()], float)


def test_normal_cdf(spark):
    from statistics import NormalDist

    got = {r.z: r.p for r in spark.createDataFrame([(z / 4,) for z in range(-24, 25)], "z double").withColumn("p", normal_cdf(F.col("z"))).collect()}
    assert all(abs(p - NormalDist().cdf(z)) < 1e-7 for z, p in got.items())


@pytest.mark.parametrize("rho,n", [(0.0, 5), (0.6, 1), (0.6, 7), (0.95, 30), (-0.0, 3)])
def test_variance_of_a_mean(rho, n):
    corr = rho ** np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    assert abs(persistence.mean_variance(rho, n) - corr.mean()) < 1e-9


@pytest.mark.parametrize("icc,lag,n", [(0.3, 0.6, 10), (0.5, 0.5, 8), (0.1, 0.1, 20), (0.7, 0.8, 5), (0.0, 0.4, 12)])
def test_solved_series_measures_back(icc, lag, n):
    a, rho = persistence.solve_latent(icc, lag, n)
    rng = np.random.default_rng(1)
    z = np.empty((20_000, n))
    z[:, 0] = rng.standard_normal(20_000)
    for t in range(1, n):
        z[:, t] = rho * z[:, t - 1] + np.sqrt(1 - rho * rho) * rng.standard_normal(20_000)
    x = np.sqrt(a) * rng.standard_normal((20_000, 1)) + np.sqrt(1 - a) * z
    msb, msw = n * x.mean(1).var(ddof=1), x.var(1, ddof=1).mean()
    assert abs(np.corrcoef(x[:, :-1].ravel(), x[:, 1:].ravel())[0, 1] - lag) < 0.02
    if icc > 0:  # drift alone has some
        assert abs((msb - msw) / (msb + (n - 1) * msw) - icc) < 0.03 or rho in (0.0, lag)


def test_calibration_gives_back_what_a_shape_takes(spark):
    rows = spark.range(6000).select(F.col("id"), (F.col("id") % 600).alias("e"))
    shape = lambda u: F.pow(u, F.lit(4)) + uniform(1, F.col("id"), "rest")
    made, put_in, got = persistence.calibrate(rows, "e", ["id"], shape, 0.2, 0.4, 7, "x")
    assert put_in > 0.45 and abs(got - 0.4) <= 0.02 and abs(persistence.steadiness(made, "e", ["id"], "x")[1] - got) < 1e-6
    _, put_in, got = persistence.calibrate(rows, "e", ["id"], lambda u: u + 20 * uniform(1, F.col("id"), "rest"), 0.2, 0.4, 7, "x", steps=4)
    assert got < 0.2  # more than there is can't be given, and is said


def test_curves_and_surfaces(spark):
    df = spark.createDataFrame([(float(x),) for x in np.linspace(-5, 15, 81)] + [(None,)], "x double").coalesce(1)
    x = column(df, F.col("x"))
    curve = shaped.Curve([0.0, 1.0, 4.0, 10.0], [2.0, -1.0, 5.0, 3.0], 2.5)
    want = np.where(np.isnan(x), 0, np.interp(np.nan_to_num(x), curve.grid, curve.response) - 2.5)
    assert np.allclose(column(df, shaped.curve_delta(F.col("x"), curve)), want)
    surface = shaped.Surface([0.0, 3.0, 9.0], [-1.0, 2.0], [[1, 2], [3, 4], [5, 6]], 3.0)
    a = np.abs(np.nan_to_num(x)[:, None] - np.array(surface.grid_a)).argmin(1)
    b = np.abs(-np.nan_to_num(x)[:, None] - np.array(surface.grid_b)).argmin(1)
    got = column(df, shaped.surface_delta(F.col("x"), -F.col("x"), surface))
    assert np.allclose(got, np.where(np.isnan(x), 0, np.array(surface.response)[a, b] - 3.0))
    assert column(df, shaped.curve_delta(F.col("x"), shaped.Curve([], [], 0.0))).any() == False  # noqa: E712


def test_parents_come_first_and_circles_are_cut():
    c = shaped.Curve([0.0, 1.0], [0.0, 1.0], 0.5)
    chain = [shaped.Relation("c", {"b": c}), shaped.Relation("b", {"a": c}), shaped.Relation("d", {}, {("c", "a"): shaped.Surface([0.0], [0.0], [[1.0]], 1.0)})]
    order, dropped = shaped.in_order(chain)
    assert [r.child for r in order] == ["b", "c", "d"] and not dropped and order[2].surfaces
    ring = [shaped.Relation("a", {"c": c}, explained=0.5), shaped.Relation("b", {"a": c, "z": c}, explained=0.1), shaped.Relation("c", {"b": c}, explained=0.9)]
    order, dropped = shaped.in_order(ring)
    assert dropped == [("a", "b")] and [r.child for r in order] == ["b", "c", "a"] and list(order[0].curves) == ["z"]


@pytest.mark.parametrize("mean,sd", [(3.0, None), (3.0, 3.0), (2.0, 2.5), (8.0, 2.6), (5.0, 0.5)])
def test_tails_have_their_moments(spark, mean, sd):
    power, capped = shaped.solve_tail(1.0, 11.0, mean, sd)
    t = (np.arange(200_000) + 0.5) / 200_000
    x = np.where(t < 1 - capped, 1 + 10 * np.minimum(t / (1 - capped), 1) ** power, 11.0)
    assert abs(x.mean() - mean) < 1e-2
    if sd and sd > 1.5:
        assert abs(x.std() - sd) < 2e-2
    u = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
    drawn = column(u, shaped.bent_draw(F.col("u"), [(0.0, -1.0), (0.25, 1.0), (1.0, 11.0)], (mean, sd), -0.2))
    at = (np.arange(2000) + 0.5) / 2000
    assert np.all(np.diff(drawn[np.argsort(at)]) >= 0) and drawn.min() >= -1 and drawn.max() <= 11
    assert abs(drawn[at >= 0.25].mean() - mean) < 0.05 and abs(drawn[at < 0.25].mean() + 0.2) < 0.02


def test_a_mean_outside_is_left_alone():
    assert shaped.solve_tail(1.0, 2.0, 3.0) is None and shaped.solve_tail(1.0, 2.0, 1.0, 0.5) is None


def test_whole_numbers_keep_their_mean(spark):
    df = spark.range(5000).select("id", (3 * uniform(4, F.col("id"), "x")).alias("x"))
    for mean in (1.05, 1.5, 1.99):
        got = column(shaped.whole_numbers(df, "x", mean), F.col("x"))
        assert abs(got.mean() - mean) < 1e-3 and np.all(got == np.floor(got))
    assert column(shaped.whole_numbers(df, "x", 0.1), F.col("x")).max() == 2  # less than all cut down can't be had
    assert shaped.whole_numbers(df.limit(0), "x", 1.0).count() == 0


def test_a_drawn_child_follows_its_published_curve(spark):
    source = spark.range(8000).withColumn("x", 10 * uniform(5, F.col("id"), "x")).withColumn("y", F.abs(F.col("x") - 5) * 4 + normal(5, F.col("id"), "y"))
    r = shaped.Relation("y", {"x": shaped.fit_curve(source, "id", "x", F.col("y"))})
    r.explained = shaped.explained(source, F.col("y"), r)
    assert 0.9 < r.explained < 0.99
    marginals = {c: shaped.Marginal(1.0, [(i / 10, v) for i, v in enumerate(np.quantile(column(source, F.col(c)), np.linspace(0, 1, 11)).tolist())]) for c in ("x", "y")}
    made = shaped.draw(source.select("id"), "id", marginals, [r], {"x": 5.0, "y": source.agg(F.avg("y")).first()[0]}, 9)
    again = shaped.fit_curve(made, "id", "x", F.col("y"))
    assert np.abs(np.interp(r.curves["x"].grid, again.grid, again.response) - np.array(r.curves["x"].response)).max() < 2.0
    assert abs(column(made, F.col("y")).std() / column(source, F.col("y")).std() - 1) < 0.15
