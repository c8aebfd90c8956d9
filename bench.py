"""Seconds of the headline queries: one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from plumbline.queries import QUERIES

HEADLINE = ["fidelity_report", "tvd_bivariate", "cond_curve", "cross_coupling_spearman", "auroc", "interval_join_active", "wrangle_tidy", "inherit_three_hops", "set_cooccurrence_lift", "typing_census", "icc1", "lag_last_observed", "k_safe_bounds", "gen_clean_table", "cleaning_eval", "extraction_recall", "phi_shapes", "copula_generate", "condnet_search", "discover_parents", "coupled_keys", "related_draws", "persistent_draws", "relational_plan"]


def main() -> None:
    cpus, folder = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    names = dict.fromkeys(HEADLINE)
    every = dict(QUERIES)
    try:
        from plumbline.llm.queries import QUERIES as more

        every |= more
        names |= dict.fromkeys(more)
    except ImportError:
        pass
    QUERIES["k_levels"](spark, folder).write.format("noop").mode("overwrite").save()  # the session's own start isn't timed
    took = {}
    for name in names:
        began = time.time()
        every[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1].strip("/")}))
    spark.stop()


if __name__ == "__main__":
    main()
