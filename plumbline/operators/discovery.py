"""Which columns explain which, on entities that the model has not seen."""

from __future__ import annotations

from math import ceil, log, log2
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.seeds import normal, uniform
from plumbline.functions.stats import safe
from plumbline.operators import binned
from plumbline.operators.metrics import counted_auroc
from plumbline.sources.shared import written

SEED = 20_260_731
MIN_SKILL = 0.02


# Stripes of a hash within which values change places, and the rows of a stripe's range in expectation.
STRIPES, RANGE = 64, 50_000
# Of the models that tell tables apart: trees on all columns and on one, depth (31 leaves), made values of a column that has a range, models fitted at a time, and what is told apart.
TOLD_TREES, ALONE_TREES, TOLD_DEPTH, LEAST_RANGE, AT_A_TIME = 120, 40, 5, 20, 4
VERDICTS = (0.6, "indistinguishable"), (0.8, "distinguishable"), (None, "trivially separable")


def explain(df: DataFrame, entity: str, row: str, target: str, parents: list[str], holdout: float = 0.3, trees: int = 20) -> DataFrame:
    """(parent, skill, importance): the model's skill on held-out entities, and what of it is lost when a parent's values change places.

    Values change places in their order by a hash, among held-out rows, so the answer
    depends on keys, values and the seed alone.  Rows are counted by the bins that trees
    tell apart: the model is fitted and judged on cells.
    """
    held = uniform(SEED, F.col("_e")) < holdout  # the rows that ``split`` holds out
    known = df.select(F.col(entity).alias("_e"), F.col(row).alias("_r"), F.col(target).cast("double").alias("_y"), *[F.col(p).cast("double").alias(p) for p in parents]).dropna()
    rows = written(known.select("_y", *parents, held.alias("_held"), F.when(held, F.col("_r")).alias("_r")), "rows")  # read three times
    edges = binned.thresholds(rows.where("not _held"), parents)
    by = {f"_b{i}": binned.place(F.col(p), edges[p]) for i, p in enumerate(parents)}
    counted = binned.cells(rows, {"_held": F.col("_held"), **by}, ["_y"])
    test, train = counted.where("_held"), counted.where("not _held")
    model = binned.fit(train, list(by), 0, trees, 4, SEED)
    n, base, varies = binned.spread(test, 1)[0], binned.spread(train, 1)[1][0], binned.spread(counted, 1)[2][0]
    total = binned.squared_error(test.withColumn("prediction", F.lit(base)), 0) if varies else 0.0

    def skill(cells: DataFrame) -> float:
        return 1 - binned.squared_error(model.transform(binned.assembled(cells, list(by))), 0) / total if total else 0.0

    whole, moved = skill(test), _moved(rows.where("_held").withColumns(by), list(by), parents, n)
    out = [(p, whole, whole - skill(moved.where(F.col("_p") == i))) for i, p in enumerate(parents)]
    return df.sparkSession.createDataFrame(out, "parent string, skill double, importance double").withColumn("claimed", (F.col("skill") >= MIN_SKILL) & (F.col("importance") >= 0.002))


def _moved(rows: DataFrame, bins: list[str], parents: list[str], n: int) -> DataFrame:
    """Cells of all ``n`` rows for each parent, ``_p``, whose bin is that of the row that follows by a hash, within stripes of another; a stripe's last row takes its first one's.

    Stripes are parted into ranges of the hash, the more the more rows: a range's last row
    alone looks beyond it, at the first one of the next.  Rows of one key are in the order
    of a hash of their values.
    """
    bits = max(0, ceil(log2(max(1, n) / (STRIPES * RANGE))))
    draws = [F.struct(F.lit(i).alias("_p"), F.floor(uniform(SEED, F.col("_r"), p) * STRIPES).alias("_stripe"), F.xxhash64(F.col("_r"), F.lit(p)).alias("_h"), F.xxhash64("_y", *parents, F.lit(p)).alias("_t"), F.col(b).alias("_own")) for i, (p, b) in enumerate(zip(parents, bins, strict=True))]
    each = rows.select("_y", *bins, F.inline(F.array(*draws))).withColumn("_range", F.shiftright("_h", 64 - bits) if bits else F.lit(0).cast("long"))
    w = Window.partitionBy("_p", "_stripe", "_range").orderBy("_h", "_t")
    near = each.withColumns({"_next": F.lead("_own").over(w), "_first": F.first("_own").over(w)})
    end = F.when(F.col("_next").isNull(), F.struct("_stripe", "_range", "_first"))
    turned = {b: F.when(F.col("_p") == i, F.col("_next")).otherwise(F.col(b)) for i, b in enumerate(bins)}
    counted = binned.cells(near, {"_p": F.col("_p"), "_end": end, **turned}, ["_y"])
    ends = Window.partitionBy("_p", "_end._stripe").orderBy("_end._range")  # a row a range
    beyond = F.coalesce(F.lead("_end._first").over(ends), F.first("_end._first").over(ends))
    last = counted.where("_end is not null").withColumn("_next", beyond)
    return counted.where("_end is null").unionByName(last.withColumns({b: F.coalesce(b, "_next") for b in bins}).drop("_next"))


def ar1(df: DataFrame, entity: str, order: list[str], rho: float, seed: int = SEED) -> DataFrame:
    """Adds a standard normal series of each entity with lag-1 correlation ``rho``, from hashed draws in row order.

    A row's value is the recursion over the draws behind it, as far back as they weigh
    1e-12 or more: a bounded frame, however many rows an entity has.
    """
    if not 0 <= rho < 1:
        raise ValueError("rho: 0 or more, below 1")
    reach = ceil(log(1e-12) / log(rho)) if rho else 0
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(-reach, 0)
    shocks = df.withColumn("_e", normal(seed, F.col(entity), *[F.col(o).cast("string") for o in order]))
    step = lambda s, e: F.when(s.isNull(), e).otherwise(rho * s + (1 - rho * rho) ** 0.5 * e)
    return shocks.withColumn("x", F.aggregate(F.collect_list("_e").over(w), F.lit(None).cast("double"), step)).drop("_e")


def distinguishable(real: DataFrame, made: DataFrame, columns: list[str], row: str, trees: int = TOLD_TREES, alone: int = ALONE_TREES) -> DataFrame:
    """How well two tables can be told apart on rows that the model has not seen (0.5 is not at all), and which columns give it away.

    A row of all columns (``column_name`` null): ``auroc`` of boosted trees on the tables as
    they are; ``within``, that of trees for which the real values are moved into the made
    ones' range, since bounds that protect the real rows' ends alone tell the tables apart; and
    a verdict on the latter.  A row a column: ``within`` of trees on that column alone;
    ``blame``, its share of what the model on all columns loses of its accuracy when the
    column's values change places, in the mean over all orders; ``beyond``, the share of
    real values that were moved.  A missing value is a place of its own below all others.

    Both tables weigh the same, and all rows count: they are counted by the bins that trees
    tell apart, and models are fitted and judged on those cells.
    """
    number = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_c{i}") for i, c in enumerate(columns)}
    raw, moved, bins = [f"_c{i}" for i in range(len(columns))], [f"_m{i}" for i in range(len(columns))], [f"_b{i}" for i in range(len(columns))]
    held = uniform(SEED, F.col(row)) < 0.3  # the rows that ``split`` holds out
    sides = [df.select(*number.values(), held.alias("_held"), F.lit(y).alias("_real")) for df, y in ((real, 1), (made, 0))]
    both = sides[0].union(sides[1])
    ends = sides[1].agg(*[f(c).alias(f"{k}{c}") for c in raw for k, f in (("low", F.min), ("high", F.max), ("n", F.count))]).first()
    ranged = [c for c in raw if ends[f"n{c}"] >= LEAST_RANGE]
    inside = {c: F.greatest(F.least(F.col(c), F.lit(ends[f"high{c}"])), F.lit(ends[f"low{c}"])) for c in ranged}
    rows = written(both.withColumns({m: F.when(F.col("_real") == 1, F.when(F.col(c).isNotNull(), inside[c])).otherwise(F.col(c)) if c in ranged else F.col(c) for c, m in zip(raw, moved, strict=True)}), "rows")
    beyond = rows.where("_real = 1").agg(*[F.avg((F.coalesce(F.col(c) != F.col(m), F.lit(False))).cast("double")).alias(c) for c, m in zip(raw, moved, strict=True)]).first()
    cells = []
    for values in (raw, moved):
        edges = binned.thresholds(rows.where("not _held"), values)
        by = {b: F.when(F.col(v).isNull(), 0).otherwise(binned.place(F.col(v), edges[v])) for b, v in zip(bins, values, strict=True)}
        cells.append(written(rows.groupBy(F.col("_held"), *[x.alias(b) for b, x in by.items()]).agg(F.sum("_real").alias("ones"), F.sum(1 - F.col("_real")).alias("zeros")), "cells"))

    def judged(counted: DataFrame, names: list[str], n: int):
        model = binned.classify(counted.where("not _held"), names, n, TOLD_DEPTH, SEED)
        test = counted.where("_held").groupBy(*names).agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        scored = binned.assembled(test, names).withColumn("p", F.lit(0.5)) if model is None else model.transform(binned.assembled(test, names)).withColumn("p", vector_to_array("probability")[1])
        return model, counted_auroc(scored, "p", "ones", "zeros").first()

    asked = [(cells[0], bins, trees), (cells[1], bins, trees), *[(cells[1], [b], alone) for b in bins]]
    with ThreadPool(min(len(asked), AT_A_TIME)) as pool:  # a tree is a few small jobs
        (model, whole), (_, within), *ones = pool.map(inheritable_thread_target(real.sparkSession)(lambda x: judged(*x)), asked)
    lost = _lost(model, cells[0].where("_held"), bins) if model is not None else [0.0] * len(bins)
    total = sum(map(abs, lost)) or 1.0
    verdict = None if within.auroc is None else next(v for most, v in VERDICTS if most is None or within.auroc < most)
    out = [(None, whole.positives, whole.negatives, whole.auroc, whole.low, whole.high, within.auroc, None, None, verdict)]
    for c, x, (_, one), fall in zip(columns, raw, ones, lost, strict=True):
        out.append((c, one.positives, one.negatives, None, None, None, one.auroc, abs(fall) / total, beyond[x], None))
    return real.sparkSession.createDataFrame(out, "column_name string, positives long, negatives long, auroc double, low double, high double, within double, blame double, beyond double, verdict string")


def _lost(model, test: DataFrame, bins: list[str]) -> list[float]:
    """What the model loses of its accuracy, both classes weighing the same, when a column's values change places: each row gets each value as often as there are rows of it, which is the mean over all orders."""
    counts = written(test.groupBy(*bins).agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")), "test")
    one = counts.agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).first()
    if not one.ones or not one.zeros:
        return [0.0] * len(bins)
    weighed = counts.select(*bins, (F.col("ones") / one.ones / 2).alias("_w1"), (F.col("zeros") / one.zeros / 2).alias("_w0"))

    def accuracy(cells: DataFrame) -> float:
        return model.transform(binned.assembled(cells, bins)).agg(F.sum(F.when(F.col("prediction") == 1, F.col("_w1")).otherwise(F.col("_w0"))).alias("a")).first().a

    whole, out = accuracy(weighed), []
    for b in bins:
        others = [x for x in bins if x != b]
        rest = weighed.groupBy(*others).agg(F.sum("_w1").alias("_v1"), F.sum("_w0").alias("_v0"))
        shares = weighed.groupBy(b).agg(F.sum(F.col("_w1") + F.col("_w0")).alias("_share"))
        mixed = rest.crossJoin(F.broadcast(shares))  # shares: a row a bin
        out.append(whole - accuracy(mixed.select(*bins, (F.col("_v1") * F.col("_share")).alias("_w1"), (F.col("_v0") * F.col("_share")).alias("_w0"))))
    return out


def dp_quantile(df: DataFrame, value: str, q: float, low: float, high: float, epsilon: float, u: float) -> DataFrame:
    """A quantile by the exponential mechanism over intervals between neighbouring values, picked by ``u``.

    Values are counted by interval of a fine fixed grid first, so the choice is over a
    bounded number of cells however many rows there are.
    """
    cells = 1_024
    width = (high - low) / cells
    inside = df.where(F.col(value).isNotNull()).select(F.least(F.greatest(F.floor((F.col(value) - low) / width), F.lit(0)), F.lit(cells - 1)).cast("int").alias("cell"))
    counts = df.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell")).join(inside.groupBy("cell").agg(F.count("*").alias("n")), "cell", "left").fillna(0, ["n"])
    w = Window.orderBy("cell")  # over the grid's cells
    upto = counts.withColumn("below", F.sum("n").over(w) - F.col("n") / 2).withColumn("total", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    score = upto.withColumn("s", -F.abs(F.col("below") - q * F.col("total")) * epsilon / 2)
    weight = score.withColumn("p", F.exp(F.col("s") - F.max("s").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    reached = weight.withColumn("c", safe(F.sum("p").over(w), F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return reached.where(F.col("c") >= u).agg(F.min("cell").alias("cell"), F.max("total").alias("n")).select("n", F.round(low + (F.col("cell") + 0.5) * width, 6).alias("quantile"))
