"""One report of a table against its source: marginals, a curve, and dynamics, each by the source's ruler."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import dynamics, fidelity


def report(source: DataFrame, other: DataFrame, entity: str, order: list[str], value: str, level: str) -> DataFrame:
    """(measure, source, other): distances have only one side."""
    none = F.lit(None).cast("double")
    one = lambda name, df, column: df.select(F.lit(name).alias("measure"), none.alias("source"), F.col(column).cast("double").alias("other"))
    both = lambda name, f, column: f(source).select(F.lit(name).alias("measure"), F.col(column).alias("source")).join(f(other).select(F.lit(name).alias("measure"), F.col(column).alias("other")), "measure")
    return (
        one(f"tvd.{value}", fidelity.tvd_numeric(source, other, value), "tvd")
        .union(one(f"tvd.{level}", fidelity.tvd_levels(source, other, level), "tvd"))
        .union(one(f"ks.{value}", fidelity.ks(source, other, value), "ks"))
        .union(both(f"eta.{value}~{level}", lambda d: fidelity.eta(d, level, value), "eta"))
        .union(both(f"icc1.{value}", lambda d: dynamics.icc1(d, entity, value), "icc"))
        .union(both(f"lag1.{value}", lambda d: dynamics.lag1(d, entity, order, value), "lag1"))
        .union(both(f"stickiness.{level}", lambda d: dynamics.stickiness(d, entity, order, level), "stickiness"))
    )
