"""Trees fitted on counted cells against Spark's own on the rows."""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from plumbline.functions.seeds import normal, uniform
from plumbline.operators import binned, jointly
from plumbline.operators.sampling import split


def _rows(spark, n):
    x = {"a": uniform(1, F.col("id")) * 2, "b": F.floor(uniform(2, F.col("id")) * 50) / 4, "c": F.floor(uniform(3, F.col("id")) * 7)}
    rows = spark.range(n).select("id", (F.col("id") % (n // 5)).alias("e"), *[v.cast("double").alias(k) for k, v in x.items()])
    return rows.withColumn("y", F.col("a") * F.col("b") + F.sin(F.col("c")) + 0.2 * normal(4, F.col("id"))).localCheckpoint()


def test_the_model_is_that_of_the_rows(spark):
    rows, by = _rows(spark, 4_000), ["a", "b", "c"]
    edges = binned.thresholds(rows, by)
    places = {f"_b{i}": binned.place(F.col(c), edges[c]) for i, c in enumerate(by)}
    held = binned.cells(rows, places, ["y"])
    got = binned.fit(held, list(places), 0, 20, 4, 3)
    shape = VectorAssembler(inputCols=by, outputCol="features")
    want = GBTRegressor(labelCol="y", maxIter=20, maxDepth=4, seed=3).fit(shape.transform(rows))
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-6)
    both = want.setPredictionCol("w").transform(shape.transform(got.transform(binned.assembled(rows.withColumns(places), list(places)))))
    assert both.agg(F.max(F.abs(F.col("w") - F.col("prediction")))).first()[0] < 1e-8
    n, (mean,), (v,) = binned.spread(held, 1)
    one = rows.agg(F.avg("y"), F.var_pop("y")).first()
    assert n == 4_000 and np.allclose((mean, v), tuple(one))
    error = both.agg(F.sum((F.col("y") - F.col("w")) ** 2)).first()[0]
    assert abs(binned.squared_error(got.transform(binned.assembled(held, list(places))), 0) - error) < 1e-6 * error


def test_thresholds_of_many_values(spark, monkeypatch):
    """Parts of the order are as good as all values, to a part; few values are taken one by one."""
    rows = _rows(spark, 4_000)
    exact = binned.thresholds(rows, ["a", "b"])
    monkeypatch.setattr(binned, "PARTS", 256)
    near = binned.thresholds(rows, ["a", "b"])
    assert near["b"] == exact["b"] and len(near["a"]) == len(exact["a"]) == 31
    upto = [[rows.where(F.col("a") <= x).count() for x in e["a"][::10]] for e in (exact, near)]
    assert max(abs(x - y) for x, y in zip(*upto, strict=True)) <= 4_000 / 256
    assert binned.thresholds(rows.limit(0), ["a"]) == {"a": []} and binned.thresholds(rows.withColumn("a", F.lit(0.1)), ["a"]) == {"a": []}


def _fitted(monkeypatch):
    """Rows that each model is fitted on."""
    kept, own = [], binned.GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df: kept.append(df.count()) or own(self, df))
    return kept


def test_utility_and_predictability_are_those_of_the_rows(spark, monkeypatch):
    """Models see no more rows than there are cells, and the figures are those of models fitted on rows."""
    rows = _rows(spark, 6_000)
    real, made = rows.where("id % 3 > 0"), rows.where("id % 3 = 0").withColumn("y", F.col("y") * 0.8)
    shape = VectorAssembler(inputCols=["b", "c"], outputCol="_x")
    test, train = split(real, "e", 0.3, 0)
    model = lambda df: GBTRegressor(featuresCol="_x", labelCol="y", maxIter=20, maxDepth=4, seed=0).fit(shape.transform(df))
    both = model(made).setPredictionCol("m").transform(model(train).setPredictionCol("r").transform(shape.transform(test))).select("y", "r", "m").toPandas()
    v = both.y.var(ddof=0)
    cost = ((both.y - both.m) ** 2 - (both.y - both.r) ** 2) / v
    half = 1.96 * cost.std(ddof=0) / len(cost) ** 0.5
    kept = _fitted(monkeypatch)
    got = jointly.utility(real, made, "e", "y", ["b", "c"]).first()
    want = (1 - ((both.y - both.r) ** 2).mean() / v, 1 - ((both.y - both.m) ** 2).mean() / v, cost.mean(), cost.mean() - half, cost.mean() + half)
    assert got.n == len(cost) and np.allclose((got.real, got.made, got.cost, got.low, got.high), want, atol=2e-6)
    assert len(kept) == 2 and max(kept) <= 32 * 7
    skill = {r.column_name: r.real for r in jointly.predictability(real, made, "e", ["y", "b", "c"]).collect()}
    assert len(kept) == 8 and max(kept) <= 32 * 32
    assert abs(skill["y"] - want[0]) < 2e-6
    flat = jointly.predictability(real.withColumn("c", F.lit(0.1)), made, "e", ["y", "b", "c"]).collect()
    assert sorted(r.column_name for r in flat) == ["b", "y"]
