"""Related tables: keys drawn from parents, references broken or spelled otherwise, keys invented anew, and the order in which tables can be made."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.seeds import uniform
from plumbline.operators.ranks import average_ranks

KEY_NAMES = ("{}_id", "{}id", "id")


def numbered(df: DataFrame, key: str, into: str) -> DataFrame:
    """(key, place): the distinct keys in their order, from 0; no task sees them all."""
    return average_ranks(df.select(key).distinct(), key).select(key, (F.col("rank") - 1).cast("long").alias(into))


def draw_parents(children: DataFrame, row: str, parents: DataFrame, key: str, seed: int, into: str) -> DataFrame:
    """Adds to each child the key of a parent, each as likely; the draw depends on the row and the number of parents only."""
    places = numbered(parents, key, "_place").withColumnRenamed(key, "_key")
    total = places.agg(F.count("*").alias("_n"))
    drawn = children.crossJoin(total).withColumn("_at", F.floor(uniform(seed, F.col(row), into) * F.col("_n")).cast("long"))  # total: one row
    return drawn.join(places, F.col("_at") == F.col("_place"), "left").withColumn(into, F.col("_key")).drop("_n", "_at", "_place", "_key")


def key_text(key: Column, prefix: str, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), width, "0"))


def break_references(df: DataFrame, row: str, key: str, parents: DataFrame, parent_key: str, prefix: str, width: int, orphans: float, drift: float, style: str, seed: int) -> DataFrame:
    """Adds ``dirty``, the reference as it is spelled, and ``mess``: 'orphan', 'drift' or null; a row has one of them at most.

    An orphan names no parent: ``random`` keys are of one digit more than the parents',
    ``near`` ones have two neighbouring digits exchanged, the first such exchange (from a
    drawn place on) that is no parent's; without one the row stays whole.  Drifted keys
    still mean their parent: lower case, a space before or two after.
    """
    u = lambda what: uniform(seed, F.col(row), key, what)
    orphan = u("orphan") < orphans
    if style == "random":
        fake = F.concat(F.lit(prefix), (F.lit(10**width) + F.floor(u("fake") * (9 * 10**width))).cast("long").cast("string"))
        marked = df.withColumn("_fake", F.when(orphan, fake))
    else:
        start, body = F.floor(u("fake") * (width - 1)).cast("int"), F.substring(F.col(key), len(prefix) + 1, width)
        # all exchanges of a broken row, in the order in which they are tried
        tries = F.transform(F.sequence(F.lit(0), F.lit(width - 2)), lambda k: F.struct(k.alias("turn"), ((start + k) % (width - 1)).alias("at")))
        swapped = F.concat(F.lit(prefix), F.expr("substring(body, 1, t.at)"), F.expr("substring(body, t.at + 2, 1)"), F.expr("substring(body, t.at + 1, 1)"), F.expr(f"substring(body, t.at + 3, {width})"))
        found = df.where(orphan).select(F.col(row).alias("_row"), F.col(key).alias("_true"), body.alias("body"), F.explode(tries).alias("t")).withColumn("swap", swapped).where("swap <> _true")
        absent = found.join(parents.select(F.col(parent_key).alias("swap")), "swap", "left_anti")
        first = absent.groupBy("_row").agg(F.min_by("swap", "t.turn").alias("_fake"))
        marked = df.join(first, F.col(row) == F.col("_row"), "left").drop("_row")
    drifts = F.col("_fake").isNull() & ~orphan & (u("drift") < drift)
    how = F.floor(u("how") * 3)
    spelled = F.when(how == 0, F.lower(key)).when(how == 1, F.concat(F.lit(" "), F.col(key))).otherwise(F.concat(F.col(key), F.lit("  ")))
    mess = F.when(F.col("_fake").isNotNull(), "orphan").when(drifts & (spelled != F.col(key)), "drift")
    return marked.withColumn("dirty", F.coalesce("_fake", F.when(drifts, spelled), F.col(key))).withColumn("mess", mess).drop("_fake")


def assign_keys(children: DataFrame, row: str, fk: str, parents: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``new_key``: of parents numbered anew, or none of theirs, as often as the child's references miss now."""
    known = children.join(parents.select(F.col(key).alias("_k")).distinct(), F.col(fk) == F.col("_k"), "left")
    share = known.agg(F.avg(F.col("_k").isNull().cast("double")).alias("_share"))
    drawn = draw_parents(children, row, numbered(parents, key, "_new").select("_new"), "_new", seed, "_drawn")
    lost = uniform(seed, F.col(row), "orphan") < F.col("_share")
    return drawn.crossJoin(share).withColumn("new_key", F.when(lost, F.concat(F.lit("X"), F.col("_drawn"))).otherwise(F.concat(F.lit("K"), F.col("_drawn")))).drop("_share", "_drawn")  # share: one row


def pick_key(table: str, candidates: list[str]) -> str | None:
    """Of several columns whose values could be the key, the one whose name says so; the first if none does."""
    base = table.lower().rstrip("s")

    def worth(name: str) -> int:
        plain = name.lower()
        return 4 * (plain in [n.format(base) for n in KEY_NAMES]) + 2 * plain.endswith("id") + (base in plain if base else 0)

    return max(candidates, key=worth) if candidates else None  # of equals the first


def unique_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns without nulls whose values never repeat."""
    one = df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"d_{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if one.n and one[f"d_{i}"] == one.n]


def link_order(links: list[tuple[str, str]]) -> list[str]:
    """Tables of (child, parent) links, parents first and by name where either may come; those in a circle last."""
    tables, out = sorted({t for link in links for t in link}), []
    while True:
        free = [t for t in tables if t not in out and all(p in out or p == t for c, p in links if c == t)]
        if not free:
            return out + [t for t in tables if t not in out]
        out.append(free[0])


def is_scaffolding(name: str) -> bool:
    """Names that this library gives to columns of its own making, not to a source's."""
    return bool(re.search(r"__(?:has|n|prev|delta)(?:$|_)", name))


def collisions(columns: list[str]) -> list[str]:
    return [c for c in columns if is_scaffolding(c)]
