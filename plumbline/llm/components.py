"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

Every round is a few grouped minima and joins on edges; the graph never meets on the
driver, and each round is written to the shared folder, so lineage stays short and a
lost executor repeats one round at most.  The number of rounds is about the logarithm of
the number of nodes; the loop ends when a round changes no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_merge, forget
from plumbline.sources.shared import written


def _large(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return by_merge(both.where("v > u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node sends itself and its smaller neighbours to the smallest of them (edges run from larger to smaller)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = by_merge(edges).join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v) reaches; nodes that are their own root are left out."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    sign = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == sign or not mark.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign, last = mark, now
        now = written(_small(_large(now)), "edges")
        forget(last)
