"""What somebody who has only a release can do with it: score rows by the published marginals, guess an attribute, link by quasi-identifiers; each beside a control."""

from __future__ import annotations

from math import log

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import Z95
from plumbline.operators.privacy import linkage
from plumbline.plans.blueprint import Marginal

# The logarithm of what lies outside of everything published, the least chance of a level or of absence, rows below which nothing is measured, and the excess that a verbatim republish has to show.
OUTSIDE, LEAST_CHANCE, LEAST_ROWS, LEAST_CONTROL = -12.0, 1e-6, 40, 0.02
TREES = 40


def density(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Logarithm of the density between published knots: even within a segment, the first of those that a value is in; a segment without width or mass, and what is beyond the ends, count as outside."""
    out = F.lit(OUTSIDE)
    for (q0, v0), (q1, v1) in reversed(list(zip(knots, knots[1:], strict=False))):
        inside = log(max((q1 - q0) / (v1 - v0), 1e-12)) if v1 > v0 and q1 > q0 else OUTSIDE
        out = F.when(x.between(v0, v1), inside).otherwise(out)
    return out


def blueprint_likelihood(df: DataFrame, marginals: dict[str, Marginal], into: str = "log_likelihood") -> DataFrame:
    """Adds the sum of the logarithms of what the marginals say of each row's cells, and of those that are missing."""
    total = F.lit(0.0)
    for c, m in marginals.items():
        if m.knots:
            value = density(F.col(c).cast("double"), m.knots)
        else:
            shares = {x: max(w / sum(m.weights), LEAST_CHANCE) for x, w in zip(m.levels, m.weights, strict=True)}
            known = F.create_map(*[F.lit(v) for x, p in shares.items() for v in (x, log(p))])
            value = F.coalesce(F.try_element_at(known, F.col(c).cast("string")), F.lit(log(LEAST_CHANCE)))
        has, none = log(max(m.coverage, LEAST_CHANCE)), log(max(1 - m.coverage, LEAST_CHANCE))
        total = total + F.when(F.col(c).isNull(), none).otherwise(has + value)
    return df.withColumn(into, total)


def attribute_disclosure(members: DataFrame, others: DataFrame, released: DataFrame, quasi: list[str], sensitive: str, seed: int = 0) -> DataFrame:
    """(n, marginal, control, release, excess, low, high): how often a level is guessed right of the release's own people.

    The control learns from real people who aren't in the release, so only what a guesser
    who learned from the release has over it is the release's doing: the excess, with an
    interval from the people of whom just one of the two is right.  Nulls where a side has
    fewer than ``LEAST_ROWS`` rows or learns one level only.  Numbers go in as they are.
    """
    known = [d.select(*[F.col(c).cast("double").alias(c) for c in quasi], F.col(sensitive).cast("string").alias("_s")).dropna() for d in (members, others, released)]
    index = StringIndexer(inputCol="_s", outputCol="_y", handleInvalid="keep").fit(known[1].union(known[2]))
    shape = VectorAssembler(inputCols=quasi, outputCol="_x")
    target, control, release = (shape.transform(index.transform(d)) for d in known)
    sizes = [d.count() for d in known]
    kinds = [d.select("_s").distinct().count() for d in known[1:]]
    if min(sizes) < LEAST_ROWS or min(kinds) < 2:
        return members.sparkSession.createDataFrame([(sizes[0], None, None, None, None, None, None)], "n long, marginal double, control double, release double, excess double, low double, high double")
    common = known[1].groupBy("_s").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "_s").first()["_s"]
    scored = target
    for name, d in (("_control", control), ("_release", release)):
        forest = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=TREES, maxDepth=8, minInstancesPerNode=5, seed=seed, predictionCol=name, rawPredictionCol=f"{name}_r", probabilityCol=f"{name}_p")
        scored = forest.fit(d).transform(scored).drop(f"{name}_r", f"{name}_p")
    hit = lambda c: (F.col(c) == F.col("_y")).cast("double")
    gain = hit("_release") - hit("_control")
    one = scored.agg(F.count("*").alias("n"), F.avg((F.col("_s") == common).cast("double")).alias("marginal"), F.avg(hit("_control")).alias("control"), F.avg(hit("_release")).alias("release"), F.avg(gain).alias("excess"), F.stddev_pop(gain).alias("sd"))
    half = Z95 * F.col("sd") / F.sqrt("n")
    return one.select("n", *[F.round(c, 6).alias(c) for c in ("marginal", "control", "release", "excess")], F.round(F.col("excess") - half, 6).alias("low"), F.round(F.col("excess") + half, 6).alias("high"))


def with_control(members: DataFrame, others: DataFrame, released: DataFrame, quasi: list[str], sensitive: str, least: int = 5) -> DataFrame:
    """(honest, control, share, verdict): by how much members are guessed better than others from the release, and from their own rows handed out as one.

    The control leaks by construction.  Where even it shows less than ``LEAST_CONTROL``, or
    nobody can be scored, nothing can be read off; else the honest excess is judged as a
    share of it: CLEAN up to none, LEAK from a half, PARTIAL between.
    """
    def excess(release: DataFrame, name: str) -> DataFrame:
        per = linkage(members, others, release, quasi, sensitive, least)
        return per.agg((F.max(F.when(F.col("arm") == "other", F.col("error"))) - F.max(F.when(F.col("arm") == "member", F.col("error")))).alias(name))

    both = excess(released, "honest").crossJoin(excess(members, "control"))  # a row each
    powered = F.col("control") >= LEAST_CONTROL
    share = F.when(powered & (F.col("honest") > 0), F.col("honest") / F.col("control")).when(powered & F.col("honest").isNotNull(), 0.0)
    verdict = F.when(share.isNull(), "UNREADABLE").when(share <= 0, "CLEAN").when(share >= 0.5, "LEAK").otherwise("PARTIAL")
    return both.select(F.round("honest", 6).alias("honest"), F.round("control", 6).alias("control"), F.round(share, 6).alias("share"), verdict.alias("verdict"))


