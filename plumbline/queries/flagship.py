from pyspark.sql import functions as F

from plumbline.plans.flagship import report
from plumbline.registry import query, table


@query("fidelity_report")
def fidelity_report(spark, sf):
    events = table(spark, sf, "events")
    out = report(events.where("user_id % 2 = 0"), events.where("user_id % 2 = 1"), "user_id", ["ts", "event_id"], "value", "event_type")
    return out.select("measure", F.round("source", 6).alias("source"), F.round("other", 6).alias("other"))
