"""Work that grows no faster than the rows: what a plan evaluates, and the same results as by brute force."""

import random

from pyspark.sql import functions as F

from plumbline.functions import seeds
from plumbline.operators import condnet, decorated, entities, privacy, ranks
from plumbline.plans import blueprint, notes
from plumbline.sources import shared


def _average(values):
    at = sorted(values)
    return {v: (at.index(v) + 1 + len(at) - at[::-1].index(v)) / 2 for v in set(values)}


def test_ranks_of_rows(spark):
    r = random.Random(5)
    plain = [r.random() for _ in range(3_000)] + [0.25, 0.25, -1.0, float("inf")]
    tied = [float(r.randrange(7)) for _ in range(3_000)]
    for values in (plain, tied, [3.0], [2.0, 2.0]):
        df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(3)
        want = _average(values)
        assert {(x.i, x.r) for x in ranks.with_ranks(df, "v", "r").collect()} == {(i, want[v]) for i, v in enumerate(values)}
        order = sorted(range(len(values)), key=lambda i: (values[i], i))
        assert {x.i: x.p for x in ranks.row_places(df, "v", "i", "p").collect()} == {i: p for p, i in enumerate(order, 1)}


def test_stripes_are_looked_up_by_halving(spark):
    """Not by a look at each of 255 edges."""
    plan = ranks.average_ranks(spark.range(10).selectExpr("id * 1.5D AS v"), "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "filter(edges" not in plan


def test_a_cell_is_hashed_once(spark):
    knots = [(q, 10 * q) for q in blueprint.GRID]
    made = blueprint.draw(spark.range(3).withColumnRenamed("id", "row"), "row", {"a": blueprint.Marginal(1.0, knots), "b": blueprint.Marginal(0.5, knots)}, 7)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 4  # a value and a presence for each
    alone = made.select("row", seeds.quantile_draw(seeds.uniform(7, made["row"], "a", "value"), knots).alias("w"), "a")
    assert all(x.a == x.w for x in alone.collect())


def test_far_places_do_not_meet_all_targets(spark, monkeypatch):
    """Most suppliers are further from all parts than parts from each other."""
    kept = {}

    def counted(df, name):
        out = shared.written(df, name)
        kept.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(privacy, "written", counted)
    r = random.Random(8)
    targets = [(r.random(), r.random()) for _ in range(2_000)]
    queries = [(i, 3 + 6 * r.random(), 3 * r.random() - 1) for i in range(100)]
    got = privacy.nearest(spark.createDataFrame(queries, "k int, x double, y double"), "k", spark.createDataFrame(targets, "x double, y double"), {"x": 1.0, "y": 1.0}).collect()
    want = {k: min(((x - a) ** 2 + (y - b) ** 2) ** 0.5 for a, b in targets) for k, x, y in queries}
    assert all(abs(row.distance - want[row.k]) < 1e-9 for row in got) and len(got) == 100
    assert max(df.agg({"_n": "sum"}).first()[0] for df in kept["met"][-1:]) <= 100 * 64  # of 200,000 pairs


def test_a_network_is_searched_over_counts(spark, monkeypatch):
    """Rows are counted by setting once; what each column says of another is had from the counts."""
    kept = []
    monkeypatch.setattr(condnet, "written", lambda df, name: kept.append((name, shared.written(df, name))) or kept[-1][1])
    rows = [(i, str(i % 2), str(i % 2), str(i // 2 % 3)) for i in range(1_200)]
    found = condnet.search(spark.createDataFrame(rows, "e int, a string, b string, c string"), "e", ["a", "b", "c"])
    assert found == {"a": [], "b": ["a"], "c": []}
    assert [name for name, _ in kept] == ["counts"] and kept[0][1].count() == 6


def test_a_note_is_written_once_for_its_reader(spark):
    facts = {"old_age": F.col("id") > 2, "low_price": F.col("id") % 2 == 0, "far": F.col("id") < 0}
    made = notes.write(spark.range(40), "id", facts, 0.5, 8)
    for reader in (notes.naive_reader, notes.careful_reader):
        graded = notes.grade(made.withColumn("claims", reader(F.col("note"), list(facts))), "claims")
        plan = graded._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sha2(") == 3 and plan.count("array_join(") == 1
        claimed = sum(r.found + r.fell for r in graded.collect())
        assert claimed == made.where("id > 2").count() + made.where("id % 2 = 0").count() if reader is notes.naive_reader else claimed < 57


def test_equal_cells_are_read_once(spark):
    texts = ["$1,200.50", "-$3", "soon", None, " $4 "]
    df = spark.createDataFrame([(texts[0 if i % 20 else i // 20 % 5],) for i in range(400)], "t string")
    found = decorated.kinds(df)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    read = next(i for i, x in enumerate(lines) if "try_cast" in x or "tryCast" in x or "is_money" in x and "AS is_money" in x)
    assert any("Aggregate [column_name" in x and ", c#" in x for x in lines[read:])  # below the reading
    r = found.first()
    assert (r.kind, r.decimals, r.thousands, r.unparsed) == ("currency", 2, True, round(4 / 396, 6))


def test_a_pair_of_tokens_is_made_one_way(spark):
    """Counted once by entity, and told both ways."""
    df = spark.createDataFrame([(i, None if i == 0 else i % 5, "a;b;c" if i % 2 else "b;a;a") for i in range(40)], "r int, e int, s string")
    found = entities.cooccurrence(df, "e", "r", "s", k=5)
    assert "countdistinct" not in (plan := found._jdf.queryExecution().analyzed().toString().lower()) and "count(distinct" not in plan
    got = {(r.a, r.b): (r.joint, r.entities) for r in found.collect()}
    assert got == {("a", "b"): (40, 5), ("b", "a"): (40, 5), ("a", "c"): (20, 5), ("b", "c"): (20, 5)}  # c has too few rows to be told of


def test_marginals_group_entities_once_and_draw_no_needless_presence(spark, monkeypatch):
    """Ends of all columns come from one table of entities and are those of each column alone; a column without gaps draws values only."""
    rows = spark.range(600).select((F.col("id") % 40).alias("e"), F.concat(F.lit("r"), "id").alias("row"), (F.col("id") % 97).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") * 1.5).alias("b"), F.lit(None).cast("double").alias("c"))
    grouped, own = [], blueprint.written
    monkeypatch.setattr(blueprint, "written", lambda df, name: grouped.append(name) or own(df, name))
    found = blueprint.fit(rows, "e", ["a", "b", "c"], [])
    assert grouped == ["ends"] and list(found) == ["a", "b"] and (found["a"].coverage, found["b"].coverage) == (1.0, 0.8)
    for c in "ab":
        ends = entities.safe_bounds(rows, "e", c).first()
        assert (found[c].knots[0][1], found[c].knots[-1][1]) == (ends.low, ends.high)
    made = blueprint.draw(rows.select("row"), "row", found, 7)
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "a:present" not in plan.replace(", ", ":") and "b:present" in plan.replace(", ", ":")
    was = seeds.uniform(7, F.col("row"), "a", "present") < 1.0
    assert made.where(~was | F.col("a").isNull()).count() == 0 and 0 < made.where("b is null").count() < 200
