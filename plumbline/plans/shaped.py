"""Tables drawn from published relations: columns after their parents, moved by curves and surfaces; tails bent to their mean and spread; whole numbers cut where their mean says.

What is published is a few numbers for each relation: a curve's grid and the child's mean
response at it, a surface's two grids and responses, the share of the child's variance
that they explain.  A drawn child is

    mean + what its parents' values add + sqrt(1 - explained) (own draw - mean)

so that its spread stays what it was.  All of it is columns: a table of any size is drawn in
place, and a cell depends on its row's key and its parents' cells only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import seeds
from plumbline.operators.fidelity import bin_of, inner_edges
from plumbline.operators.ranks import exact_quantiles
from plumbline.plans.blueprint import Marginal
from plumbline.plans.blueprint import draw as draw_marginals

LEAST_ROWS = 5
# What a model may explain at most, how near to certain a level may get, and how sharply a tail may bend.
MOST_EXPLAINED, SURE, BENDS = 0.99, 0.999, (0.02, 60.0)


@dataclass
class Curve:
    """Mean of the child where the parent is at each place of the grid (numbers in order, or levels), and over all rows; ``missing``: the curve is about whether the parent has a value, and this is the child's mean where it has none."""

    grid: list
    response: list[float]
    centre: float
    missing: float | None = None


@dataclass
class Surface:
    """Mean of the child at each pair of places of two parents' grids."""

    grid_a: list[float]
    grid_b: list[float]
    response: list[list[float]]
    centre: float


@dataclass
class Relation:
    """What moves a child: curves by parent, surfaces by pairs of parents (which count instead of both parents' curves), the explained share of its variance; ``level``: of a column of levels, the one whose chance is moved."""

    child: str
    curves: dict[str, Curve] = field(default_factory=dict)
    surfaces: dict[tuple[str, str], Surface] = field(default_factory=dict)
    explained: float = 0.0
    strength: float = 1.0
    level: str | None = None

    @property
    def parents(self) -> list[str]:
        return list(dict.fromkeys([*self.curves, *[p for pair in self.surfaces for p in pair]]))


def in_order(relations: list[Relation]) -> tuple[list[Relation], list[tuple[str, str]]]:
    """Relations so that parents come before their children, and the (parent, child) edges that had to go: in a circle, the relation that explains least loses those to columns that aren't drawn yet."""
    left, out, dropped = list(relations), [], []
    while left:
        undrawn = {r.child for r in left}
        free = next((r for r in left if not undrawn & set(r.parents) - {r.child}), None)
        if free is None:
            free = min(left, key=lambda r: (r.explained, r.child))
            dropped += [(p, free.child) for p in free.parents if p in undrawn and p != free.child]
        left.remove(free)
        gone = undrawn if any(c == free.child for _, c in dropped) else {free.child}
        out.append(Relation(free.child, {p: c for p, c in free.curves.items() if p not in gone}, {k: s for k, s in free.surfaces.items() if not gone & set(k)}, free.explained, free.strength, free.level))
    return out, dropped


def curve_delta(parent: Column, curve: Curve) -> Column:
    """How far a parent's value moves the child from its mean: linear between places of the grid, flat beyond its ends, nothing where the parent is missing or at no known level."""
    if curve.missing is not None:
        share = curve.centre  # of a presence curve the centre is the mean over all rows, its one response that of present ones
        return F.when(parent.isNotNull(), curve.response[0]).otherwise(curve.missing) - share
    if not curve.grid:
        return F.lit(0.0)
    if isinstance(curve.grid[0], str):
        known = F.create_map(*[F.lit(x) for g, r in zip(curve.grid, curve.response, strict=True) for x in (g, float(r) - curve.centre)])
        return F.coalesce(F.try_element_at(known, parent.cast("string")), F.lit(0.0))
    out = F.lit(float(curve.response[-1]))
    x = parent.cast("double")
    for (g0, r0), (g1, r1) in reversed(list(zip(zip(curve.grid, curve.response, strict=True), list(zip(curve.grid, curve.response, strict=True))[1:], strict=False))):
        out = F.when(x < g1, r0 + (r1 - r0) * (x - g0) / (g1 - g0)).otherwise(out)
    out = F.when(x <= curve.grid[0], float(curve.response[0])).otherwise(out)
    return F.when(x.isNotNull(), out - curve.centre).otherwise(0.0)


def _nearest(x: Column, grid: list[float]) -> Column:
    """Place of the nearest number of a grid, the lower of two that are as near."""
    return reduce(Column.__add__, [(x.cast("double") > (a + b) / 2).cast("int") for a, b in zip(grid, grid[1:], strict=False)], F.lit(0))


def surface_delta(a: Column, b: Column, surface: Surface) -> Column:
    """As ``curve_delta``, by the nearest cell of two parents' grid; nothing where either is missing."""
    flat = F.array(*[F.lit(float(r) - surface.centre) for row in surface.response for r in row])
    at = _nearest(a, surface.grid_a) * len(surface.grid_b) + _nearest(b, surface.grid_b)
    return F.when(a.isNotNull() & b.isNotNull(), F.get(flat, at)).otherwise(0.0)


def systematic(relation: Relation) -> Column:
    """What a row's parents add to the child's mean."""
    held = {p for pair in relation.surfaces for p in pair}
    parts = [surface_delta(F.col(a), F.col(b), s) for (a, b), s in relation.surfaces.items()]
    parts += [curve_delta(F.col(p), c) for p, c in relation.curves.items() if p not in held]
    return relation.strength * sum(parts[1:], parts[0]) if parts else F.lit(0.0)


def related_number(own: Column, mean: float, relation: Relation) -> Column:
    rest = (1 - min(max(relation.explained, 0.0), MOST_EXPLAINED) * min(relation.strength, 1.0)) ** 0.5
    return mean + systematic(relation) + rest * (own - mean)


def related_level(own: Column, levels: list[str], weights: list[float], relation: Relation, u: Column, other: Column) -> Column:
    """A level whose one class is as likely as the parents make it, the others in proportion; rows that nothing moves keep their own draw."""
    total, delta = sum(weights), systematic(relation)
    rest = [(x, w) for x, w in zip(levels, weights, strict=True) if x != relation.level]
    chance = F.greatest(F.least(weights[levels.index(relation.level)] / total + delta, F.lit(SURE)), F.lit(1 - SURE))
    drawn = F.when(u < chance, relation.level).otherwise(seeds.pick([x for x, _ in rest], [w for _, w in rest], other))
    return F.when((F.abs(delta) > 1e-9) & own.isNotNull(), drawn).otherwise(own)


def draw(rows: DataFrame, row: str, marginals: dict[str, Marginal], relations: list[Relation], means: dict[str, float], seed: int) -> DataFrame:
    """Draws all columns by their marginals, then moves those with relations, parents first; missing cells stay missing."""
    made = draw_marginals(rows, row, marginals, seed)
    for r in in_order(relations)[0]:
        m, own = marginals[r.child], F.col(r.child)
        if m.knots:
            x = related_number(own, means[r.child], r)
            low, high = m.knots[0][1], m.knots[-1][1]
            x = F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))
            made = made.withColumn(r.child, F.bround(x).cast("double") if m.whole else x)
        else:
            u, other = (seeds.uniform(seed, F.col(row), r.child, what) for what in ("moved", "other"))
            made = made.withColumn(r.child, related_level(own, m.levels, m.weights, r, u, other))
    return made


# -- what is published of a source


def fit_curve(df: DataFrame, entity: str, parent: str, child: Column, bins: int = 12, k: int = 10) -> Curve:
    """Means of parent and child over quantile bins of the parent with k entities or more."""
    both = df.select(F.col(entity).alias("_e"), F.col(parent).cast("double").alias("_x"), child.cast("double").alias("_y")).where("_x is not null and _y is not null")
    edges = inner_edges(both, "_x", [i / bins for i in range(bins + 1)])
    per = both.groupBy(bin_of(F.col("_x"), edges).alias("b")).agg(F.avg("_x").alias("x"), F.avg("_y").alias("y"), F.count("*").alias("n"), F.count_distinct("_e").alias("m"))
    kept = per.where((F.col("n") >= LEAST_ROWS) & (F.col("m") >= k)).orderBy("x").collect()  # a row a bin
    whole = sum(r.n for r in kept)
    return Curve([r.x for r in kept], [r.y for r in kept], sum(r.n * r.y for r in kept) / whole if whole else 0.0)


def fit_surface(df: DataFrame, entity: str, a: str, b: str, child: Column, bins: int = 4, k: int = 10) -> Surface | None:
    """Means over a grid of two parents' quantile bins; None unless every cell has k entities."""
    both = df.select(F.col(entity).alias("_e"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"), child.cast("double").alias("_y")).dropna()
    at = [i / bins for i in range(bins + 1)]
    binned = both.withColumns({"ba": bin_of(F.col("_a"), inner_edges(both, "_a", at)), "bb": bin_of(F.col("_b"), inner_edges(both, "_b", at))})
    cells = binned.groupBy("ba", "bb").agg(F.avg("_a").alias("a"), F.avg("_b").alias("b"), F.avg("_y").alias("y"), F.count("*").alias("n"), F.count_distinct("_e").alias("m")).collect()  # bins x bins rows
    names = sorted({r.ba for r in cells}), sorted({r.bb for r in cells})
    found = {(r.ba, r.bb): r for r in cells if r.m >= k}
    if not cells or len(found) < len(names[0]) * len(names[1]):
        return None
    mean = lambda rs, c: sum(r.n * r[c] for r in rs) / sum(r.n for r in rs)
    grid_a = [mean([r for r in cells if r.ba == x], "a") for x in names[0]]
    grid_b = [mean([r for r in cells if r.bb == x], "b") for x in names[1]]
    return Surface(grid_a, grid_b, [[found[x, y].y for y in names[1]] for x in names[0]], mean(cells, "y"))


def explained(df: DataFrame, child: Column, relation: Relation) -> float:
    """Share of the child's variance in the source that its parents' values account for, each row's own included."""
    rows = df.select(child.cast("double").alias("_y"), systematic(relation).alias("_s")).where("_y is not null")
    one = rows.agg(F.var_pop("_y").alias("whole"), F.var_pop(F.col("_y") - F.col("_s")).alias("rest")).first()
    return min(max(1 - one.rest / one.whole, 0.0), MOST_EXPLAINED) if one.whole else 0.0


# -- tails


def tail_moments(a: float, b: float, power: float, capped: float) -> tuple[float, float]:
    """Mean and deviation of a + (b - a) t**power over even t, a share ``capped`` of which sits at b."""
    free, wide = 1 - capped, b - a
    mean = a + wide * (free / (power + 1) + capped)
    square = wide * wide * (free / (2 * power + 1) + capped) - (mean - a) ** 2
    return mean, max(square, 0.0) ** 0.5


def solve_tail(a: float, b: float, mean: float, sd: float | None = None) -> tuple[float, float] | None:
    """(power, capped share) with that mean and, if it can be had, that deviation; None for a mean outside of (a, b).

    For a capped share the mean gives the power, and the deviation grows with the share,
    so it is found by halving; a deviation below that of no cap can't be had and is left.
    """
    if not a < mean < b:
        return None

    def power(capped: float) -> float:
        return (1 - capped) * (b - a) / max(mean - a - capped * (b - a), 1e-300) - 1

    held = lambda p: min(max(p, BENDS[0]), BENDS[1])
    most = (mean - a) / (b - a)  # all else at a
    if sd is None or sd <= tail_moments(a, b, power(0.0), 0.0)[1]:
        return held(power(0.0)), 0.0
    low, high = 0.0, most
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail_moments(a, b, power(mid), mid)[1] < sd else (low, mid)
    return held(power(low)), low


def bent_draw(u: Column, knots: list[tuple[float, float]], upper: tuple[float, float | None] | None = None, lower: float | None = None) -> Column:
    """``quantile_draw`` whose last segment has the mean and deviation ``upper``, and whose first has the mean ``lower``."""
    out = seeds.quantile_draw(u, knots)
    (q0, a), (q1, b) = knots[-2:]
    if upper and (got := solve_tail(a, b, *upper)):
        power, capped = got
        t = (u - q0) / (q1 - q0)
        out = F.when(u >= q0, F.when(t < 1 - capped, a + (b - a) * F.pow(t / (1 - capped), F.lit(power))).otherwise(float(b))).otherwise(out)
    (q0, a), (q1, b) = knots[:2]
    if lower is not None and (got := solve_tail(-b, -a, -lower)):
        out = F.when(u < q1, b - (b - a) * F.pow((q1 - u) / (q1 - q0), F.lit(got[0]))).otherwise(out)
    return out


def whole_numbers(df: DataFrame, value: str, mean: float) -> DataFrame:
    """Numbers cut to whole ones so that their mean is as asked: all move up by one share before they are cut, which is a quantile of what is behind their points."""
    x = F.col(value).cast("double")
    part = x - F.floor(x)
    base = df.agg(F.avg(F.floor(x)).alias("m")).first().m
    if base is None:
        return df
    need = min(max(mean - base, 0.0), 1.0)  # share of rows that have to move to the next number
    cut = exact_quantiles(df.select(part.alias("_part")), "_part", [1 - need])[0]
    return df.withColumn(value, F.when(F.lit(need > 0) & (part >= cut), F.floor(x) + 1).otherwise(F.floor(x)).cast("double"))
