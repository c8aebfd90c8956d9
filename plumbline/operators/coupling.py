"""Which parent a child row is given, so that columns on both sides of a link go together as much as was asked.

Neither side's values move, nor does the number of children of a parent: parents' slots
are drawn first, one for each child, and only who takes which slot is chosen.  Children
are put in the order of a score of their columns' ranks, mixed with noise, slots in the
order of a score of their parents', and a child takes the slot of its own place.  One
choice a row gives correlations of rank one, so the scores' weights are the leading
singular vectors of the asked correlations, each side's carried through the inverse of
that side's own correlations (without it, columns that go together would all get the
same).  How much noise, is bisected on what is measured; both places are exact ranks over
whole tables, joined by equality.

Defined results: a child without a value counts as the mean in the score, and not in the
measured correlation; with fewer than ``LEAST_ROWS`` rows, or nothing asked, slots stay as
they were drawn.  Where a rank of one carries less than ``least_carried`` of what was
asked, the strongest pair alone is met and the others are named.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.seeds import normal, uniform
from plumbline.operators.ranks import row_places, standard_ranks
from plumbline.operators.related import draw_parents
from plumbline.sources.shared import written

# Rows below which nothing is coupled, and what a rank of one has to carry.
LEAST_ROWS = 30
LEAST_CARRIED = 0.9
#: Part of each side's order, far below a rank of any table, that keeps equal scores apart.
APART = 1e-9


@dataclass
class Coupled:
    """Children with their parents' keys, and what was asked and reached."""

    rows: DataFrame
    carried: float = 1.0
    joint: bool = True
    mix: float = 0.0
    pairs: list[tuple[str, str, float, float]] = field(default_factory=list)
    left_out: list[tuple[str, str]] = field(default_factory=list)


def leading(asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Directions of both sides whose product is nearest to what is asked, and the part of it that they carry."""
    u, s, vt = np.linalg.svd(asked, full_matrices=False)
    flip = 1.0 if u[np.argmax(np.abs(u[:, 0])), 0] > 0 else -1.0
    whole = float(np.sqrt((s**2).sum()))
    return flip * u[:, 0], flip * vt[0], float(s[0]) / whole if whole else 0.0


def whitened(corr: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Weights whose score correlates with the columns in proportion to ``direction``; columns that are one and the same keep it."""
    if not np.isfinite(corr).all() or np.linalg.matrix_rank(corr, tol=1e-9) < len(corr):
        return direction
    out = np.linalg.solve(corr, direction)
    return out / np.linalg.norm(out)


def _own(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Correlations of standard ranks on one side."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    corr = np.eye(len(columns))
    if pairs:
        one = df.agg(*[F.corr(f"_z_{columns[i]}", f"_z_{columns[j]}").alias(f"r{i}_{j}") for i, j in pairs]).first()
        for i, j in pairs:
            corr[i, j] = corr[j, i] = np.nan if one[f"r{i}_{j}"] is None else one[f"r{i}_{j}"]
    return corr


def _score(columns: list[str], weights: np.ndarray) -> Column:
    return sum((float(w) * F.col(f"_z_{c}") for c, w in zip(columns[1:], weights[1:], strict=True)), float(weights[0]) * F.col(f"_z_{columns[0]}"))


def couple(children: DataFrame, row: str, child_columns: list[str], parents: DataFrame, key: str, parent_columns: list[str], asked: list[list[float]], seed: int, into: str, steps: int = 8, tolerance: float = 0.01, least_carried: float = LEAST_CARRIED) -> Coupled:
    """Gives each child a parent's key in ``into``; ``asked[i][j]`` is the rank correlation of child column i and parent column j.

    Keys of parents, and ``row`` of children, have to be unique.
    """
    target = np.array(asked, float)
    slots = draw_parents(children.select(row), row, parents.select(key), key, seed, into)
    n = children.count()
    if n < LEAST_ROWS or not target.any():
        return Coupled(children.join(slots, row))
    u, v, carried = leading(target)
    left_out: list[tuple[str, str]] = []
    joint = carried >= least_carried
    if not joint:
        i, j = np.unravel_index(np.argmax(np.abs(target)), target.shape)
        left_out = [(c, p) for a, c in enumerate(child_columns) for b, p in enumerate(parent_columns) if (a, b) != (i, j) and target[a, b]]
        child_columns, parent_columns, target = [child_columns[i]], [parent_columns[j]], target[i : i + 1, j : j + 1]
        u, v, _ = leading(target)
    kids = children.select(row, *[F.col(c).cast("double").alias(c) for c in child_columns])
    for c in child_columns:
        kids = standard_ranks(kids, c, f"_z_{c}")
    noise, apart = normal(seed, F.col(row), into, "mix"), APART * uniform(seed, F.col(row), into, "apart")
    kids = written(kids.withColumn("_noise", noise).withColumn("_apart", apart), "kids")
    seats = slots.join(parents.select(F.col(key).alias("_k"), *[F.col(p).cast("double").alias(p) for p in parent_columns]), F.col(into) == F.col("_k")).drop("_k")
    for p in parent_columns:
        seats = standard_ranks(seats, p, f"_z_{p}")
    seats = written(seats, "seats")
    score = _score(parent_columns, whitened(_own(seats, parent_columns), v)) + APART * uniform(seed, F.col(row), into, "seat")
    seats = written(row_places(seats.withColumn("_s", score), "_s", row, "_place").select("_place", into, *parent_columns, *[f"_z_{p}" for p in parent_columns]), "seats")
    mine = _score(child_columns, whitened(_own(kids, child_columns), u))
    spread = kids.agg(F.stddev_pop(mine).alias("s")).first().s or 1.0
    low, high, taken, got = 0.0, 1.0, None, None
    for _ in range(steps):
        mix = (low + high) / 2
        mixed = mix * (mine / spread) + float(np.sqrt(1 - mix * mix)) * F.col("_noise") + F.col("_apart")
        placed = row_places(kids.withColumn("_s", mixed), "_s", row, "_place").drop("_s")
        taken = placed.join(seats, "_place")
        both = [(F.when(F.col(c).isNotNull() & F.col(p).isNotNull(), F.col(f"_z_{c}")), F.col(f"_z_{p}")) for c in child_columns for p in parent_columns]
        one = taken.agg(*[F.corr(F.when(b.isNotNull() & a.isNotNull(), a), F.when(a.isNotNull(), b)).alias(f"r{k}") for k, (a, b) in enumerate(both)]).first()
        got = np.array([r if r is not None else 0.0 for r in one]).reshape(target.shape)
        reached = float((got * target).sum() / (target**2).sum())
        if abs(reached - 1) * float(np.abs(target).max()) <= tolerance:
            break
        low, high = (mix, high) if reached < 1 else (low, mix)
    pairs = [(c, p, float(target[i, j]), round(float(got[i, j]), 6)) for i, c in enumerate(child_columns) for j, p in enumerate(parent_columns)]
    return Coupled(children.join(taken.select(F.col(row).alias("_row"), into), F.col(row) == F.col("_row")).drop("_row"), carried, joint, mix, pairs, left_out)
