"""Whether a spec means what it says: its own table is drawn and looked at, where a check of the spec alone can't tell.

All figures come from one aggregate over the whole table that the spec makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.generate import Spec, clean_table, with_outcomes

# Shares of an outcome that leave one class only, the size that no derived column should reach, and the words by which a description asks for a corruption.
RARE, COMMON, HUGE = 0.01, 0.9, 1e12
ASKED = {"duplicate": None, "missing": "missing", "outlier": "outlier", "typo": "typo", "wrong": "wrong", "casing": "case", "whitespace": "space"}


def lint_table(spark: SparkSession, spec: Spec, description: str = "") -> DataFrame:
    """(level, code, subject, figure): what is probably not meant (WARN) and what is worth knowing (INFO)."""
    table = with_outcomes(clean_table(spark, spec), spec)
    measures = {"n": F.count("*")}
    for i, o in enumerate(spec.outcomes):
        measures[f"o{i}"] = F.avg(F.col(o.name).cast("double"))
    for i, r in enumerate(spec.rules):
        if r.kind == "derived":
            x = F.abs(F.col(r.target).cast("double"))
            measures |= {f"top{i}": F.max(F.when(x < float("inf"), x)), f"bad{i}": F.count_if(F.isnan(x) | (x == float("inf")))}
        elif r.days_from:
            measures[f"gap{i}"] = F.count_if(F.datediff(F.to_date(r.target), F.to_date(r.source)) != F.greatest(F.bround(F.col(r.days_from)), F.lit(0)))
    one = table.agg(*[c.alias(n) for n, c in measures.items()]).first()
    found: list[tuple[str, str, str, float | None]] = []
    for i, o in enumerate(spec.outcomes):
        share = one[f"o{i}"]
        if share is None:
            continue
        if o.between:
            found.append(("INFO" if o.between[0] <= share <= o.between[1] else "WARN", "prevalence", o.name, share))
        else:
            found.append(("WARN" if share < RARE or share > COMMON else "INFO", "one class" if share < RARE or share > COMMON else "prevalence", o.name, share))
    for i, r in enumerate(spec.rules):
        if r.kind == "derived":
            top, bad = one[f"top{i}"], one[f"bad{i}"]
            if bad or (top or 0) > HUGE:
                found.append(("WARN", "derived size", r.target, top))
            elif top == 0:
                found.append(("WARN", "derived zeros", r.target, 0.0))
        elif r.days_from and one[f"gap{i}"]:
            found.append(("WARN", "uncoupled days", r.target, one[f"gap{i}"] / one.n))
    made = {r.target for r in spec.rules}
    found += [("INFO", "overwritten distribution", c.name, None) for c in spec.columns if c.name in made]
    for word, op in ASKED.items():
        has = spec.duplicate_rate > 0 if op is None else any(getattr(c.mess, op) > 0 for c in spec.columns)
        if word in description.lower() and not has:
            found.append(("WARN", "asked and not declared", word, None))
    return spark.createDataFrame([(a, b, c, None if d is None else round(float(d), 6)) for a, b, c, d in found], "level string, code string, subject string, figure double")
