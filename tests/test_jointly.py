"""Models across tables, on planted structure and against least squares by numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.seeds import normal, uniform
from plumbline.operators import jointly


@pytest.fixture(scope="module")
def sides(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 800).alias("e"), *[(uniform(i, F.col("id"), "x") * 2 - 0.7).alias(f"x{i}") for i in range(3)])
    rows = rows.withColumn("y", F.col("x0") * 3 + F.col("x0") * F.col("x1") * F.col("x2") * 6 + 0.3 * normal(5, F.col("id"), "e"))
    mixed = rows.withColumn("y", normal(6, F.col("id"), "e") * 2)
    return rows.cache(), mixed.cache()


def test_training_on_noise_costs_all_and_on_the_like_nothing(sides):
    real, mixed = sides
    like = jointly.utility(real, real.where("id % 2 = 0"), "e", "y", ["x0", "x1", "x2"]).first()
    noise = jointly.utility(real, mixed, "e", "y", ["x0", "x1", "x2"]).first()
    assert like.real > 0.75 and like.retained > 0.9 and like.low <= like.cost <= like.high
    assert noise.made < 0.1 and noise.low > 0.5 and noise.real == like.real
    few = jointly.utility(real.limit(50), real, "e", "y", ["x0"]).first()
    assert few.real is None and few.n < 50


def test_predictability_and_drivers(sides):
    real, mixed = sides
    got = {r.column_name: r for r in jointly.predictability(real, mixed, "e", ["y", "x0", "x1"]).collect()}
    assert got["y"].real > 0.5 > 0.1 > got["y"].made and got["x0"].real > got["x0"].made


def test_gain_of_a_product_against_least_squares(sides):
    real, mixed = sides
    for df in sides:
        d = df.select("y", "x0", "x1", "x2").toPandas().to_numpy()
        z = (d - d.mean(0)) / d.std(0)
        y, a, b, c = z.T
        pairs = np.column_stack([np.ones(len(z)), a, b, c, a * b, a * c, b * c])
        r2 = lambda m: 1 - ((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).mean()
        want = r2(np.column_stack([pairs, a * b * c])) - r2(pairs)
        assert abs(jointly.product_gain(df, "y", ["x0", "x1", "x2"]) - want) < 1e-8
    assert jointly.product_gain(real.limit(20), "y", ["x0", "x1", "x2"]) is None
    found = jointly.three_way(real, mixed, "e", ["y", "x0", "x1", "x2"]).collect()
    top = next(r for r in found if r.child == "y")
    assert top.trio == "x0/x1/x2" and top.real > 0.05 > 0.01 > top.made
