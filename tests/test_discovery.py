"""What explains what, against models fitted on rows and values that change places row by row."""

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from plumbline.functions.seeds import normal, uniform
from plumbline.operators import discovery, metrics
from plumbline.operators.sampling import split

PARENTS, TREES = ["a", "b", "c"], 4


def _rows(spark, n):
    x = {"a": uniform(1, F.col("id")) * 2, "b": F.floor(uniform(2, F.col("id")) * 50) / 4, "c": F.floor(uniform(3, F.col("id")) * 7)}
    rows = spark.range(n).select((F.col("id") % (n // 5)).alias("e"), F.concat(F.lit("r"), "id").alias("r"), "id", *[v.cast("double").alias(k) for k, v in x.items()])
    return rows.withColumn("y", F.col("a") * F.col("b") + 0.2 * normal(4, F.col("id"))).localCheckpoint()


def _brute(rows):
    """Model and moves by rows, in pandas."""
    test, train = split(rows, "e", 0.3, discovery.SEED)
    shape = VectorAssembler(inputCols=PARENTS, outputCol="features")
    model = GBTRegressor(labelCol="y", maxIter=TREES, maxDepth=4, seed=discovery.SEED).fit(shape.transform(train))
    places = [c for p in PARENTS for c in (F.floor(uniform(discovery.SEED, F.col("r"), p) * 64).alias(f"s_{p}"), F.xxhash64("r", F.lit(p)).alias(f"h_{p}"))]
    held, base = test.select("r", "y", *PARENTS, *places).toPandas(), train.agg(F.avg("y")).first()[0]

    def skill(frame):
        said = model.transform(shape.transform(rows.sparkSession.createDataFrame(frame[["y", *PARENTS]])))
        return 1 - said.agg(F.sum((F.col("y") - F.col("prediction")) ** 2)).first()[0] / ((held.y - base) ** 2).sum()

    whole, out = skill(held), {}
    for p in PARENTS:
        moved = held.sort_values([f"s_{p}", f"h_{p}"]).copy()
        stripes = moved.groupby(f"s_{p}")[p]
        moved[p] = stripes.shift(-1).fillna(stripes.transform("first"))
        out[p] = (whole, whole - skill(moved))
    return out


def test_explained_as_by_rows(spark, monkeypatch):
    """However many ranges a stripe is parted into; the model sees no more rows than there are cells."""
    rows = _rows(spark, 6_000)
    want = _brute(rows)
    kept, own = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df: kept.append(df.count()) or own(self, df))
    for size in (50_000, 5):
        monkeypatch.setattr(discovery, "RANGE", size, raising=False)
        got = {r.parent: r for r in discovery.explain(rows, "e", "r", "y", PARENTS, trees=TREES).collect()}
        assert list(got) == PARENTS
        assert all(abs(got[p].skill - w) < 1e-6 and abs(got[p].importance - i) < 1e-6 for p, (w, i) in want.items())
        assert [got[p].claimed for p in PARENTS] == [True, True, False]
    few = discovery.explain(rows, "e", "r", "y", ["b", "c"], trees=TREES).first()
    assert few.claimed and kept[-1] <= 32 * 7


def test_moves_keep_all_values(spark, monkeypatch):
    """Few rows a stripe, or none: the last takes the first's."""
    rows = _rows(spark, 400).withColumn("_y", F.col("y")).withColumn("_r", F.col("r")).withColumn("_b0", F.col("c").cast("int"))
    for size in (50_000, 1):
        monkeypatch.setattr(discovery, "RANGE", size)
        n, values = rows.count(), sorted(x.c for x in rows.select("c").collect())
        moved = discovery._moved(rows, ["_b0"], ["c"], n).select("_b0", "n").collect()
        assert sorted(x["_b0"] for x in moved for _ in range(x.n)) == values
    assert discovery._moved(rows.limit(0), ["_b0"], ["c"], 0).count() == 0


def test_rows_of_one_key_in_any_layout(spark):
    rows = _rows(spark, 3_000).withColumn("r", F.col("e").cast("string"))
    one, other = (discovery.explain(rows.repartition(k, F.col(by)), "e", "r", "y", PARENTS, trees=TREES).collect() for k, by in ((1, "id"), (7, "c")))
    assert all(abs(a.importance - b.importance) < 1e-9 and a.skill > 0.9 for a, b in zip(one, other, strict=True))


def test_nothing_to_explain(spark):
    flat = discovery.explain(_rows(spark, 500).withColumn("y", F.lit(0.1)), "e", "r", "y", PARENTS, trees=TREES).collect()
    assert [(r.skill, r.importance, r.claimed) for r in flat] == [(0.0, 0.0, False)] * 3


def _sides(spark, n=4_000):
    """Alike but for how ``a`` and ``b`` go together, and for ends of ``c`` that only the first has."""
    x = {k: F.floor(uniform(i, F.col("id")) * 8).cast("double") for i, k in enumerate(PARENTS, 5)}
    rows = spark.range(2 * n).select(F.concat(F.lit("r"), "id").alias("r"), (F.col("id") % 2 == 0).alias("real"), *[v.alias(k) for k, v in x.items()])
    rows = rows.withColumns({"b": F.when(F.col("real"), F.when((F.col("a") < 4) == (F.col("b") < 4), F.col("b")).otherwise(7 - F.col("b"))).otherwise(F.col("b")), "c": F.when(F.col("real") & (F.col("c") == 7), 20.0).otherwise(F.col("c"))}).localCheckpoint()
    return rows.where("real"), rows.where("not real").limit(n // 2).localCheckpoint()


def test_tables_told_apart_as_by_rows(spark):
    """What no column shows alone is found; ends that only one side has count in one figure and not in the other."""
    real, made = _sides(spark)
    got = {r.column_name: r for r in discovery.distinguishable(real, made, PARENTS, "r", 8, 4).collect()}
    whole = got.pop(None)
    shape = VectorAssembler(inputCols=PARENTS, outputCol="x")
    test, train = split(real.withColumn("y", F.lit(1)).union(made.withColumn("y", F.lit(0))), "r", 0.3, discovery.SEED)
    weigh = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    train = train.withColumn("w", F.when(F.col("y") == 1, F.lit(sum(weigh.values()) / 2 / weigh[1])).otherwise(sum(weigh.values()) / 2 / weigh[0]))
    rows = GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=8, maxDepth=5, seed=discovery.SEED).fit(shape.transform(train))
    want = metrics.auroc(rows.transform(shape.transform(test)).withColumn("p", vector_to_array("probability")[1]), "p", "y").first()
    assert (whole.positives, whole.negatives) == (want.positives, want.negatives) and abs(whole.auroc - want.auroc) < 0.01
    assert whole.auroc > whole.within + 0.01 > 0.7 and whole.verdict == "distinguishable"
    assert all(abs(got[p].within - 0.5) < 0.05 for p in "abc")
    assert abs(sum(r.blame for r in got.values()) - 1) < 1e-9 and min(got["a"].blame, got["b"].blame) > got["c"].blame
    assert got["a"].beyond == 0 and abs(got["c"].beyond - 1 / 8) < 0.02


def test_missing_values_and_empty_sides(spark):
    real, made = _sides(spark, 600)
    gone = discovery.distinguishable(real.withColumn("a", F.when(F.col("b") > 1, F.col("a"))), made, ["a"], "r", 4, 4).collect()
    assert all(0.56 < r.within < 0.7 for r in gone)  # a quarter is missing and gone[0].positives + gone[0].negatives > 200
    none = discovery.distinguishable(real, made.limit(0), ["a"], "r", 4, 4).collect()
    assert [(r.auroc, r.within, r.verdict) for r in none] == [(None, None, None)] * 2


def test_counted_scores_as_rows(spark):
    rows = spark.range(500).select((F.col("id") % 37 % 11).alias("p"), (F.col("id") % 3 == F.col("id") % 5).cast("int").alias("y"))
    cells = rows.groupBy("p", (F.col("p") % 2).alias("z")).agg(F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros"))
    assert metrics.counted_auroc(cells, "p", "ones", "zeros").first() == metrics.auroc(rows, "p", "y").first()
