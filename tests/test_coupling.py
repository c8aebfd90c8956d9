"""Keys given so that both sides go together, against the same computed without Spark."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.seeds import normal, uniform
from plumbline.operators import coupling, ranks


@pytest.fixture(scope="module")
def tables(spark):
    parents = spark.range(200).select(F.col("id").alias("k"), (F.floor(uniform(1, F.col("id"), "p") * 50)).alias("p"), normal(1, F.col("id"), "q").alias("noise")).withColumn("q", F.col("p") + 10 * F.col("noise"))
    children = spark.range(4000).select(F.col("id").alias("row"), F.floor(uniform(2, F.col("id"), "c") * 30).alias("c")).withColumn("d", F.when(F.col("row") % 50 != 0, F.col("c") + 8 * normal(2, F.col("row"), "d")))
    return children.repartition(3).cache(), parents.cache()


def reached(made, children, parents, c, p):
    both = made.rows.select("row", "fk").join(children.select("row", c), "row").join(parents.select(F.col("k").alias("fk"), p), "fk").toPandas().dropna()
    return both[c].rank().corr(both[p].rank())


@pytest.mark.parametrize("asked", [0.7, -0.4, 0.05])
def test_one_pair_comes_out_as_asked(tables, asked):
    children, parents = tables
    made = coupling.couple(children, "row", ["c"], parents, "k", ["p"], [[asked]], 3, "fk", steps=12)
    assert abs(reached(made, children, parents, "c", "p") - asked) < 0.02 and abs(made.pairs[0][3] - asked) <= 0.01
    slots = coupling.draw_parents(children.select("row"), "row", parents.select("k"), "k", 3, "fk").toPandas()
    got = made.rows.toPandas()
    assert sorted(got.fk) == sorted(slots.fk) and sorted(got.row) == sorted(slots.row)


def test_several_pairs_together(tables):
    children, parents = tables
    asked = [[0.5, 0.45], [0.45, 0.405]]
    made = coupling.couple(children, "row", ["c", "d"], parents, "k", ["p", "q"], asked, 4, "fk", steps=10)
    assert made.joint and made.carried > 0.999 and not made.left_out
    for i, c in enumerate("cd"):
        for j, p in enumerate("pq"):
            assert abs(reached(made, children, parents, c, p) - asked[i][j]) < 0.06


def test_what_one_choice_cannot_carry_is_named(tables):
    children, parents = tables
    made = coupling.couple(children, "row", ["c", "d"], parents, "k", ["p", "q"], [[0.6, 0.0], [0.0, 0.5]], 5, "fk")
    assert not made.joint and made.left_out == [("d", "q")] and abs(reached(made, children, parents, "c", "p") - 0.6) < 0.02


def test_few_rows_and_nothing_asked(tables):
    children, parents = tables
    few = coupling.couple(children.where("row < 20"), "row", ["c"], parents, "k", ["p"], [[0.9]], 6, "fk")
    assert few.rows.count() == 20 and few.pairs == [] and few.rows.where("fk is null").count() == 0
    assert coupling.couple(children, "row", ["c"], parents, "k", ["p"], [[0.0]], 6, "fk").pairs == []
    assert coupling.couple(children.limit(0), "row", ["c"], parents, "k", ["p"], [[0.9]], 6, "fk").rows.count() == 0


def test_weights():
    corr, asked = np.array([[1.0, 0.89], [0.89, 1.0]]), np.outer([0.6, 0.3], [0.9, 0.5])
    u, v, carried = coupling.leading(asked)
    assert abs(carried - 1) < 1e-9 and u[0] > 0 and np.allclose(u[0] / u[1], 2) and np.allclose(v[0] / v[1], 1.8)
    w = coupling.whitened(corr, u)
    assert np.allclose((corr @ w) / np.linalg.norm(corr @ w), u / np.linalg.norm(u))
    assert np.array_equal(coupling.whitened(np.ones((2, 2)), u), u)
    assert coupling.leading(np.diag([0.9, 0.9]))[2] < 0.8 and coupling.leading(-asked)[1][0] < 0


def test_places_and_standard_ranks(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 3.0, 1.0]
    df = spark.createDataFrame(list(enumerate(values)), "row long, x double")
    got = {r.row: r.at for r in ranks.row_places(df, "x", "row", "at").collect()}
    order = sorted((v, i) for i, v in enumerate(values) if v is not None)
    assert got == {i: at for at, (_, i) in enumerate(order, 1)}
    z = {r.row: r.z for r in ranks.standard_ranks(df, "x", "z").collect()}
    r = pd.Series(values).rank()
    assert all(abs(z[i] - (0 if np.isnan(a) else a)) < 1e-9 for i, a in enumerate((r - r.mean()) / r.std(ddof=0)))
    assert {r.z for r in ranks.standard_ranks(spark.createDataFrame([(1, 5.0), (2, 5.0)], "row long, x double"), "x", "z").collect()} == {0.0}
