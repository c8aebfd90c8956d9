"""Tables from a declared spec: clean values, planted corruption, and a ledger of every corrupted cell.

Every cell is a function of (seed, row, column, op), so columns don't affect each other
and a larger table starts with the smaller one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import seeds

#: Distributions that a column type can have; each sampler below enters the types that it serves.
TYPES: dict[str, set[str]] = {}
SAMPLERS: dict[str, Callable[[Col, Column, int], Column]] = {}
# Texts that stand for a missing cell.
MISSING_TOKENS = ["", "NULL", "N/A", "?"]
OPS = ["missing", "wrong", "outlier", "format", "case", "space", "typo"]


@dataclass
class Mess:
    """Rates of corruption, each from 0 to 1."""

    missing: float = 0.0
    wrong: float = 0.0
    outlier: float = 0.0
    format: float = 0.0
    case: float = 0.0
    space: float = 0.0
    typo: float = 0.0


@dataclass
class Col:
    name: str
    ctype: str
    dist: str
    params: dict = field(default_factory=dict)
    mess: Mess = field(default_factory=Mess)


@dataclass
class Rule:
    """A column that follows others: ``date_after`` puts ``target`` ``least`` to ``most`` days after ``source`` (or as many as ``days_from`` says), ``derived`` makes it ``factor`` times ``source``, with noise."""

    kind: str
    source: str
    target: str
    least: int = 0
    most: int = 0
    days_from: str | None = None
    factor: float = 1.0
    sigma: float = 0.0


@dataclass
class Outcome:
    """A flag whose chance is logistic in standardised columns; ``between``: the share of true rows that is wanted."""

    name: str
    effects: dict[str, float]
    intercept: float = 0.0
    between: tuple[float, float] | None = None


@dataclass
class Spec:
    title: str
    columns: list[Col]
    rows: int
    seed: int = 7
    duplicate_rate: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    outcomes: list[Outcome] = field(default_factory=list)

    def problems(self) -> list[str]:
        """Everything that is wrong with the spec, as sentences."""
        found = []
        names = [c.name for c in self.columns]
        found += [f"column {n} is declared twice" for n in sorted({n for n in names if names.count(n) > 1})]
        if self.rows < 0:
            found.append("rows is negative")
        if not 0 <= self.duplicate_rate <= 0.5:
            found.append("duplicate_rate is outside 0 to 0.5")
        for c in self.columns:
            if c.ctype not in TYPES:
                found.append(f"{c.name}: no such type as {c.ctype}")
            elif c.dist not in TYPES[c.ctype]:
                found.append(f"{c.name}: {c.ctype} can't be {c.dist}")
                continue  # its parameters mean nothing then
            found += [f"{c.name}: {op} rate {r} is outside 0 to 1" for op in OPS if not 0 <= (r := getattr(c.mess, op)) <= 1]
            p = c.params
            if c.dist == "uniform" and not p.get("low", 0) <= p.get("high", 1):
                found.append(f"{c.name}: low is above high")
            if c.dist == "beta" and not all(isinstance(p.get(k), int) and p[k] > 0 for k in "ab"):
                found.append(f"{c.name}: a and b have to be whole and positive")
            if c.dist == "categorical" and (len(p.get("levels", [])) != len(p.get("weights", [])) or not p.get("levels") or min(p["weights"]) < 0 or sum(p["weights"]) <= 0):
                found.append(f"{c.name}: levels and weights don't fit")
        kinds = {c.name: c.ctype for c in self.columns}
        for r in self.rules:
            found += [f"rule for {r.target}: no column {n}" for n in (r.source, r.target, r.days_from) if n and n not in kinds]
            wanted = {"date_after": {"date"}, "derived": {"int", "float"}}.get(r.kind)
            if wanted is None:
                found.append(f"rule for {r.target}: no such kind as {r.kind}")
                continue
            found += [f"rule for {r.target}: {n} has to be {' or '.join(sorted(wanted))}" for n in (r.source, r.target) if n in kinds and kinds[n] not in wanted]
            if r.kind == "date_after" and not 0 <= r.least <= r.most:
                found.append(f"rule for {r.target}: least and most don't fit")
        for o in self.outcomes:
            found += [f"outcome {o.name}: {n} is no number" for n in o.effects if kinds.get(n) not in ("int", "float")]
            if o.name in kinds:
                found.append(f"outcome {o.name} is a column already")
        return found


def sampler(dist: str, *types: str) -> Callable:
    """Enters a function of (column, row, seed) as the sampler of a distribution for some types."""

    def keep(f: Callable[[Col, Column, int], Column]) -> Callable:
        SAMPLERS[dist] = f
        for t in types:
            TYPES.setdefault(t, set()).add(dist)
        return f

    return keep


def _u(c: Col, row: Column, seed: int, what: str = "value") -> Column:
    return seeds.uniform(seed, row, c.name, what)


@sampler("sequence", "str_id")
def _sequence(c: Col, row: Column, seed: int) -> Column:
    return F.concat(F.lit(c.params.get("prefix", "")), (row + c.params.get("start", 1)).cast("string"))


@sampler("categorical", "category")
def _categorical(c: Col, row: Column, seed: int) -> Column:
    return seeds.pick(c.params["levels"], c.params["weights"], _u(c, row, seed))


@sampler("bernoulli", "bool")
def _bernoulli(c: Col, row: Column, seed: int) -> Column:
    return _u(c, row, seed) < c.params["p"]


@sampler("date_range", "date")
def _date_range(c: Col, row: Column, seed: int) -> Column:
    return F.date_add(F.lit(c.params["start"]).cast("date"), F.floor(_u(c, row, seed) * (c.params["days"] + 1)).cast("int"))


@sampler("full_name", "person_name")
def _full_name(c: Col, row: Column, seed: int) -> Column:
    """A given and a family name, each as likely."""
    picked = [F.element_at(F.array(*[F.lit(n) for n in c.params[part]]), F.floor(_u(c, row, seed, part) * len(c.params[part])).cast("int") + 1) for part in ("given", "family")]
    return F.concat_ws(" ", *picked)


@sampler("uniform", "int", "float")
def _uniform(c: Col, row: Column, seed: int) -> Column:
    return c.params["low"] + (c.params["high"] - c.params["low"]) * _u(c, row, seed)


@sampler("quantiles", "int", "float")
def _quantiles(c: Col, row: Column, seed: int) -> Column:
    return seeds.quantile_draw(_u(c, row, seed), c.params["knots"])


def _bounded(c: Col, x: Column) -> Column:
    x = F.greatest(x, F.lit(float(c.params["min"]))) if "min" in c.params else x
    return F.least(x, F.lit(float(c.params["max"]))) if "max" in c.params else x


def _gauss(c: Col, row: Column, seed: int) -> Column:
    return c.params["mean"] + c.params["sd"] * seeds.normal(seed, row, c.name, "value")


@sampler("normal", "int", "float")
def _normal(c: Col, row: Column, seed: int) -> Column:
    return _bounded(c, _gauss(c, row, seed))


@sampler("lognormal", "int", "float")
def _lognormal(c: Col, row: Column, seed: int) -> Column:
    return _bounded(c, F.exp(_gauss(c, row, seed)))


@sampler("mixture", "int", "float")
def _mixture(c: Col, row: Column, seed: int) -> Column:
    """Of parts (weight, mean, sd)."""
    parts, z = c.params["parts"], seeds.normal(seed, row, c.name, "value")
    choice = seeds.pick([str(i) for i in range(len(parts))], [w for w, _, _ in parts], _u(c, row, seed, "part"))
    return _bounded(c, F.coalesce(*[F.when(choice == str(i), m + s * z) for i, (_, m, s) in enumerate(parts)]))


@sampler("beta", "int", "float")
def _beta(c: Col, row: Column, seed: int) -> Column:
    """For whole a and b, times ``scale``: of a + b - 1 uniform draws the one of rank a is distributed so."""
    a, b = c.params["a"], c.params["b"]
    draws = F.array_sort(F.array(*[_u(c, row, seed, f"draw{i}") for i in range(a + b - 1)]))
    return F.element_at(draws, a) * c.params.get("scale", 1.0)


def value(c: Col, row: Column, seed: int) -> Column:
    """One clean, typed cell."""
    x = SAMPLERS[c.dist](c, row, seed)
    return F.bround(x).cast("long") if c.ctype == "int" else F.round(x, 4) if c.ctype == "float" else x


def text(c: Col, clean: Column) -> Column:
    """The canonical text of a clean value."""
    if c.ctype == "bool":
        return F.when(clean, "True").otherwise("False")
    if c.ctype == "float":
        return F.format_string("%.4f", clean)
    return clean.cast("string")


def clean_table(spark: SparkSession, spec: Spec) -> DataFrame:
    """row_id and the typed columns."""
    if found := spec.problems():
        raise ValueError("; ".join(found))
    rows = spark.range(spec.rows).withColumnRenamed("id", "row_id")
    made = rows.select("row_id", *[value(c, F.col("row_id"), spec.seed).alias(c.name) for c in spec.columns])
    for r in spec.rules:
        if r.kind == "date_after":
            made = date_after(made, "row_id", r.source, r.target, spec.seed, r.least, r.most, r.days_from)
        else:
            made = derived(made, "row_id", r.source, r.target, r.factor, spec.seed, r.sigma, whole=next(c.ctype for c in spec.columns if c.name == r.target) == "int")
    return made


def with_outcomes(clean: DataFrame, spec: Spec) -> DataFrame:
    """The clean table with the spec's outcomes, as flags."""
    for o in spec.outcomes:
        stats = clean.agg(*[f(c).alias(f"_{n}_{c}") for c in o.effects for n, f in (("m", F.avg), ("s", F.stddev_pop))]) if o.effects else None
        z = F.lit(float(o.intercept))
        for c, beta in o.effects.items():
            z = z + beta * F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0))
        both = clean.crossJoin(stats) if stats is not None else clean  # stats: one row
        flag = seeds.uniform(spec.seed, F.col("row_id"), o.name, "outcome") < 1 / (1 + F.exp(-z))
        clean = both.withColumn(o.name, flag).drop(*(stats.columns if stats is not None else []))
    return clean


def _fires(c: Col, row: Column, seed: int, op: str) -> Column:
    rate = getattr(c.mess, op)
    return seeds.uniform(seed, row, c.name, op) < rate if rate else F.lit(False)


def dirty_cell(c: Col, shown: Column, row: Column, seed: int) -> tuple[Column, Column]:
    """(op, dirty text): the first operation that fires and changes the text; a missing cell is always one."""
    draw = lambda op: seeds.uniform(seed, row, c.name, op + ".how")
    made = {
        "missing": seeds.pick(MISSING_TOKENS, [1.0] * len(MISSING_TOKENS), draw("missing")),
        "wrong": F.reverse(shown),
        "outlier": F.when(F.lit(c.ctype in ("int", "float")), (shown.try_cast("double") * 10).cast("string")).otherwise(shown),
        "format": F.regexp_replace(shown, "^(\\d{4})-(\\d{2})-(\\d{2})$", "$2/$3/$1") if c.ctype == "date" else shown,
        "case": F.when(draw("case") < 0.5, F.upper(shown)).otherwise(F.lower(shown)),
        "space": F.concat(F.lit(" "), shown, F.lit("  ")),
        "typo": F.concat(F.substring(shown, 2, 1 << 20), F.substring(shown, 1, 1)),
    }
    op, dirty = F.lit(None).cast("string"), shown
    for name in reversed(OPS):
        hit = _fires(c, row, seed, name) & (F.lit(True) if name == "missing" else made[name] != shown)
        op, dirty = F.when(hit, F.lit(name)).otherwise(op), F.when(hit, made[name]).otherwise(dirty)
    return op, dirty


def plan_table(spark: SparkSession, spec: Spec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean, dirty, ledger): two tables of texts, the second with repeated rows at the end, and a row for each corrupted cell."""
    clean = clean_table(spark, spec)
    shown = clean.select("row_id", *[text(c, F.col(c.name)).alias(c.name) for c in spec.columns])
    both = shown.select("row_id", *[F.struct(*[x.alias(n) for x, n in zip(dirty_cell(c, F.col(c.name), F.col("row_id"), spec.seed), ("op", "dirty"), strict=True)], F.col(c.name).alias("clean")).alias(c.name) for c in spec.columns])
    ledger = both.select("row_id", F.explode(F.array(*[F.struct(F.lit(c.name).alias("column_name"), F.col(c.name)["op"].alias("op"), F.col(c.name)["clean"].alias("clean"), F.col(c.name)["dirty"].alias("dirty")) for c in spec.columns])).alias("x")).select("row_id", "x.*").where("op is not null")
    dirty = both.select("row_id", *[F.col(c.name)["dirty"].alias(c.name) for c in spec.columns], F.lit(None).cast("long").alias("duplicate_of"))
    again = dirty.where(seeds.uniform(spec.seed, F.col("row_id"), "row", "duplicate") < spec.duplicate_rate)
    return shown, dirty.union(again.withColumn("duplicate_of", F.col("row_id")).withColumn("row_id", F.col("row_id") + spec.rows)), ledger


def date_after(df: DataFrame, row: str, earlier: str, later: str, seed: int, least: int = 0, most: int = 0, days_from: str | None = None) -> DataFrame:
    """``later`` put ``least`` to ``most`` days after ``earlier``, or as many as another column says (none if that is negative)."""
    gap = F.greatest(F.bround(F.col(days_from)), F.lit(0)) if days_from else least + F.floor(seeds.uniform(seed, F.col(row), later, "rule") * (most - least + 1))
    return df.withColumn(later, F.date_add(F.to_date(earlier), gap.cast("int")))


def derived(df: DataFrame, row: str, source: str, target: str, factor: float, seed: int, sigma: float = 0.0, whole: bool = False) -> DataFrame:
    """``target`` as a multiple of ``source``, with lognormal noise."""
    x = F.col(source).cast("double") * factor
    x = x * F.exp(sigma * seeds.normal(seed, F.col(row), target, "rule")) if sigma else x
    return df.withColumn(target, F.bround(x).cast("long") if whole else F.round(x, 4))


def feature(df: DataFrame, key: str) -> Column:
    """What a coefficient's key stands for: ``column=level`` is 1 where it holds, a flag 1 where it is true, a number itself."""
    name, _, level = key.partition("=")
    if level:
        return (F.col(name).cast("string") == level).cast("double")
    return F.col(name).cast("double")
