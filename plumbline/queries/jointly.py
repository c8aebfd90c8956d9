"""Lines of even suppliers as the source, those of odd ones as if they had been made."""

from pyspark.sql import functions as F

from plumbline.operators import jointly
from plumbline.registry import query, table

COLUMNS = ["l_quantity", "l_discount", "l_linenumber", "cost"]


def _sides(spark, sf):
    cost = F.col("l_quantity") * (1 - 4 * F.col("l_discount")) * F.col("l_linenumber") + F.col("l_extendedprice") / 10_000
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_linenumber", cost.alias("cost"))
    return lines.where("l_suppkey % 2 = 0"), lines.where("l_suppkey % 2 = 1")


@query("joint_utility")
def joint_utility(spark, sf):
    """What prices cost to learn from the other half."""
    real, made = _sides(spark, sf)
    return jointly.utility(real, made, "l_orderkey", "l_extendedprice", COLUMNS[:3])


@query("joint_predictability")
def joint_predictability(spark, sf):
    real, made = _sides(spark, sf)
    return jointly.predictability(real, made, "l_orderkey", ["l_extendedprice", "l_quantity", "cost"])


@query("joint_three_way")
def joint_three_way(spark, sf):
    """A cost of three factors, found on one side and held against the other."""
    real, made = _sides(spark, sf)
    return jointly.three_way(real, made, "l_orderkey", COLUMNS)
