"""Statements about a table that can't all be true: orderings in a circle, bounds that leave no room, means beside quantiles that imply others.

Statements are tables themselves, (a, b, strict) for a <= b or a < b, (name, low, high) for
bounds, (total, part) for sums, so any number of them is joined, not looped over.  What
follows from orderings is their closure, found by joining it with itself until it stays,
in about the logarithm of the longest chain's steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.shared import written

#: A mean may be off what its quantiles imply by so much of a deviation, or of itself where none is known.
SLACK_OF_SD, SLACK_OF_MEAN = 0.10, 0.05
#: Rounds of sums after which intervals that still narrow are taken as they are.
MOST_ROUNDS = 20


def closure(orders: DataFrame) -> DataFrame:
    """(a, b, strict): all orderings that follow, one row a pair; strict if any way there is."""
    now = written(orders.where("a is not null and b is not null").groupBy("a", "b").agg(F.max(F.col("strict").cast("int")).alias("strict")), "orders")
    size = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum("strict").alias("s")).first()
        if (mark.n, mark.s) == size or not mark.n:
            return now.select("a", "b", (F.col("strict") > 0).alias("strict"))
        size = mark.n, mark.s
        further = now.alias("x").join(now.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b", F.greatest("x.strict", "y.strict").alias("strict"))
        now = written(now.union(further).groupBy("a", "b").agg(F.max("strict").alias("strict")), "orders")


def circles(closed: DataFrame) -> DataFrame:
    """(name, strict): what is before itself; not strict: all of its circle are equal, which can be true."""
    return closed.where("a = b").select(F.col("a").alias("name"), "strict")


def narrowed(bounds: DataFrame, closed: DataFrame) -> DataFrame:
    """(name, low, high): bounds after all orderings: no lower than anything below, no higher than anything above."""
    below = closed.join(bounds.select(F.col("name").alias("a"), F.col("low").alias("v")), "a").groupBy(F.col("b").alias("name")).agg(F.max("v").alias("below"))
    above = closed.join(bounds.select(F.col("name").alias("b"), F.col("high").alias("v")), "b").groupBy(F.col("a").alias("name")).agg(F.min("v").alias("above"))
    names = bounds.select("name").union(closed.select("a")).union(closed.select("b")).distinct()
    every = names.join(bounds, "name", "left").join(below, "name", "left").join(above, "name", "left")
    return every.select("name", F.greatest("low", "below").alias("low"), F.least("high", "above").alias("high"))


def summed(bounds: DataFrame, sums: DataFrame) -> DataFrame:
    """Bounds after totals that are the sum of their parts: a total lies between the parts' sums, a part between the total less the others.

    It ends when nothing moves, or with the first round that leaves somebody no room, for
    from there on everything that is tied to it would follow.
    """
    for _ in range(MOST_ROUNDS):
        parts = sums.join(bounds.withColumnRenamed("name", "part"), "part").groupBy("total").agg(F.count("*").alias("n"), F.count("low").alias("nl"), F.count("high").alias("nh"), F.sum("low").alias("sl"), F.sum("high").alias("sh"))
        wanted = sums.groupBy("total").agg(F.count("*").alias("all"))
        whole = parts.join(wanted, "total").select("total", F.when(F.col("nl") == F.col("all"), F.col("sl")).alias("sl"), F.when(F.col("nh") == F.col("all"), F.col("sh")).alias("sh"))
        totals = whole.select(F.col("total").alias("name"), F.col("sl").alias("low"), F.col("sh").alias("high"))
        tb = bounds.select(F.col("name").alias("total"), F.col("low").alias("tl"), F.col("high").alias("th"))
        pb = bounds.select(F.col("name").alias("part"), F.col("low").alias("pl"), F.col("high").alias("ph"))
        shares = sums.join(whole, "total").join(tb, "total", "left").join(pb, "part", "left").select(F.col("part").alias("name"), (F.col("tl") - (F.col("sh") - F.col("ph"))).alias("low"), (F.col("th") - (F.col("sl") - F.col("pl"))).alias("high"))
        more = totals.union(shares).groupBy("name").agg(F.max("low").alias("l"), F.min("high").alias("h"))
        new = written(bounds.join(more, "name", "full").select("name", F.greatest("low", "l").alias("low"), F.least("high", "h").alias("high")), "narrowed")
        moved = new.alias("x").join(bounds.alias("y"), "name", "left").where(~(F.col("x.low").eqNullSafe(F.col("y.low")) & F.col("x.high").eqNullSafe(F.col("y.high")))).count()
        bounds = new
        if not moved or not bounds.where("low > high").isEmpty():
            break
    return bounds


def find(bounds: DataFrame, orders: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """(rule, name, low, high) of what can't be: names in a strict circle, and names whose bounds leave no room."""
    closed = closure(orders)
    left = narrowed(bounds, closed)
    if sums is not None:
        left = narrowed(summed(left, sums), closed)
    ring = circles(closed).where("strict").select(F.lit("circle").alias("rule"), "name", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    return ring.union(left.where("low > high").select(F.lit("bounds"), "name", F.col("low").cast("double"), F.col("high").cast("double")))


def implied_means(knots: DataFrame, means: DataFrame) -> DataFrame:
    """(name, mean, implied, gap): published means that their own quantiles don't have.

    ``knots``: (name, q, v), between which what is drawn is even; ``means``: (name, mean,
    sd), the sd null where there is none.  Means that agree, and names without two knots,
    are left out.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("name").orderBy("q")  # a few knots a name
    steps = knots.withColumns({"q1": F.lead("q").over(w), "v1": F.lead("v").over(w)}).where("q1 > q")
    implied = steps.groupBy("name").agg((F.sum((F.col("q1") - F.col("q")) * (F.col("v") + F.col("v1")) / 2) / F.sum(F.col("q1") - F.col("q"))).alias("implied"))
    both = means.join(implied, "name")
    gap = F.when(F.col("sd") > 0, F.abs(F.col("implied") - F.col("mean")) / F.col("sd") / SLACK_OF_SD).when(F.col("mean") != 0, F.abs(F.col("implied") - F.col("mean")) / F.abs("mean") / SLACK_OF_MEAN)
    return both.withColumn("gap", gap).where("gap > 1").select("name", F.round("mean", 6).alias("mean"), F.round("implied", 6).alias("implied"), F.round("gap", 6).alias("gap"))
