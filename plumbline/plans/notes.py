"""Notes written from facts, with a ledger of what each says, and the grading of their readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import seeds
from plumbline.functions.stats import safe

# Ways to spoil a statement; at most one is applied, the first that fires.
TRAPS = ["negation", "hedge", "history"]


def write(df: DataFrame, row: str, facts: dict[str, Column], rate: float, seed: int) -> DataFrame:
    """Adds ``note`` and ``ledger``: for each fact whether the note asserts it, as current and certain, and the trap.

    A fact's draw and trap are columns of their own, so each is made once a row.
    """
    cells, drawn, traps = [], {}, {}
    for i, (name, present) in enumerate(facts.items()):
        drawn[f"_u{i}"] = seeds.uniform(seed, F.col(row), name, "trap")
        u, trap = F.col(f"_u{i}"), F.col(f"_trap{i}")
        traps[f"_trap{i}"] = F.when(u < rate, F.element_at(F.array(*[F.lit(t) for t in TRAPS]), (F.floor(u / rate * len(TRAPS)) + 1).cast("int"))).otherwise("clean")
        words = F.lit(name.replace("_", " "))
        said = F.when(trap == "negation", F.concat(F.lit("No sign of "), words)).when(trap == "hedge", F.concat(F.lit("There may be "), words)).when(trap == "history", F.concat(F.lit("In the past there was "), words)).otherwise(F.concat(F.lit("There is "), words))
        cells.append(F.struct(F.lit(name).alias("fact"), present.alias("holds"), (trap != "negation").alias("asserted"), (trap != "history").alias("current"), (trap != "hedge").alias("certain"), trap.alias("trap"), F.concat(said, F.lit(".")).alias("sentence")))
    ledger = F.filter(F.array(*cells), lambda x: x["holds"])
    made = df.withColumns(drawn).withColumns(traps).withColumn("ledger", ledger).drop(*drawn, *traps)
    return made.withColumn("note", F.array_join(F.transform("ledger", lambda x: x["sentence"]), " "))


def naive_reader(note: Column, facts: list[str]) -> Column:
    """Claims every fact whose words are in the note."""
    return _claims(note, {f: f.replace("_", " ") for f in facts})


def careful_reader(note: Column, facts: list[str]) -> Column:
    """Claims facts that the note says there are."""
    return _claims(note, {f: f"There is {f.replace('_', ' ')}." for f in facts})


def _claims(note: Column, words: dict[str, str]) -> Column:
    """The facts whose words are in the note; without a lambda, into which a note that is written in the same plan would be moved, and written for each fact."""
    return F.array_compact(F.array(*[F.when(F.contains(note, F.lit(w)), F.lit(f)) for f, w in words.items()]))


def grade(df: DataFrame, claims: str) -> DataFrame:
    """For each trap: facts that the notes assert as current and certain, those found, and claims of facts that they don't."""
    # outer: for a plain one the optimizer asks first whether the ledger is empty, by making it once more from the draws
    each = df.select(F.explode_outer("ledger").alias("x"), F.col(claims).alias("c")).where("x is not null").select("x.*", F.array_contains("c", F.col("x.fact")).alias("claimed"))
    true = F.col("asserted") & F.col("current") & F.col("certain")
    per = each.groupBy("trap").agg(F.count(F.when(true, 1)).alias("stated"), F.count(F.when(true & F.col("claimed"), 1)).alias("found"), F.count(F.when(~true, 1)).alias("trapped"), F.count(F.when(~true & F.col("claimed"), 1)).alias("fell"))
    return per.select("trap", "stated", "found", "trapped", "fell", F.round(safe(F.col("found"), F.col("stated")), 6).alias("recall"), F.round(safe(F.col("fell"), F.col("trapped")), 6).alias("false_positive_rate"))


def grounding(claims: DataFrame, text: DataFrame, record: DataFrame, on: list[str]) -> DataFrame:
    """What stands behind claims: text and record, one of them, or neither (all with the columns ``on``)."""
    t, r = (d.select(*on).distinct().withColumn(n, F.lit(True)) for d, n in ((text, "_t"), (record, "_r")))
    found = claims.select(*on).join(t, on, "left").join(r, on, "left")
    kind = F.when(F.col("_t") & F.col("_r"), "both").when(F.col("_t"), "text_only").when(F.col("_r"), "record_only").otherwise("ungrounded")
    return found.groupBy(kind.alias("support")).agg(F.count("*").alias("claims"))


def consistency(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Whether two runs claim the same of the same records."""
    x, y = (d.select(*on).distinct().withColumn(n, F.lit(1)) for d, n in ((a, "_a"), (b, "_b")))
    one = x.join(y, on, "full").agg(F.count("*").alias("n_claims"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("agreed"))
    return one.withColumn("agreement", F.round(safe(F.col("agreed"), F.col("n_claims")), 6))


def autoclean(df: DataFrame, columns: list[str]) -> DataFrame:
    """A plain cleaner: white space trimmed, each value in its commonest casing, and repeats of a whole row marked.

    It guesses no value: what is missing stays so.
    """
    tidy = df.select("row_id", *[F.trim(F.regexp_replace(c, "\\s+", " ")).alias(c) for c in columns])
    for c in columns:
        forms = tidy.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_form")).agg(F.count("*").alias("_n"))
        best = forms.groupBy(F.lower("_form").alias("_key")).agg(F.max_by("_form", F.struct("_n", F.col("_form"))).alias("_best"))
        tidy = tidy.join(best, F.lower(c) == F.col("_key"), "left").withColumn(c, F.coalesce("_best", c)).drop("_key", "_best")
    first = tidy.groupBy(*columns).agg(F.min("row_id").alias("_first"))
    held = tidy.alias("t").join(first.alias("f"), [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in columns])
    return held.select("t.row_id", *[f"t.{c}" for c in columns], (F.col("t.row_id") > F.col("_first")).alias("duplicate"))
