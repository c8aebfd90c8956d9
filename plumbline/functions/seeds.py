"""Per-cell deterministic draws: a hash of (seed, row, column, op), so that adding a column changes no other and more rows reshuffle nothing."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str | int) -> Column:
    """In (0, 1), from 52 bits of the hash of the parts."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def normal(*parts: Column | str | int) -> Column:
    """Standard normal, by Box and Muller from two draws."""
    return F.sqrt(-2.0 * F.log(uniform(*parts, "a"))) * F.cos(2.0 * pi * uniform(*parts, "b"))


def pick(levels: list[str], weights: list[float], u: Column) -> Column:
    """The level whose cumulative weight first reaches ``u``."""
    total, out, reached = sum(weights), None, 0.0
    for level, w in zip(levels[:-1], weights[:-1], strict=True):
        reached += w / total
        out = (F.when if out is None else out.when)(u < reached, F.lit(level))
    return F.lit(levels[-1]) if out is None else out.otherwise(F.lit(levels[-1]))


def quantile_draw(u: Column, knots: list[tuple[float, float]]) -> Column:
    """Inverse of a distribution given by (q, value) knots, linear between them."""
    out = F.lit(knots[-1][1])
    for (q0, v0), (q1, v1) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(u <= q1, v0 + (v1 - v0) * (u - q0) / (q1 - q0)).otherwise(out)
    return out
