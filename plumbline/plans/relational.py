"""Several related tables from one declared spec: each by its own spec, references drawn from parents' keys, and a ledger of every reference that was broken or spelled otherwise.

A table's draws depend on the spec's seed and the table's name only, a reference's on its
link and row, so a table or link more changes none of the others.  A repeated row refers to
what its original does; whether its reference is broken is drawn for itself.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.related import break_references, draw_parents
from plumbline.plans.generate import Spec, plan_table

# How an orphan is made, and the greatest share of broken or drifted references.
STYLES, MOST = ("random", "near"), 0.5


@dataclass
class Link:
    """``fk`` of the child names ``parent_key`` of the parent; shares of references to nobody, and of true ones that are spelled otherwise."""

    child: str
    parent: str
    parent_key: str
    fk: str
    orphans: float = 0.0
    style: str = "random"
    drift: float = 0.0


@dataclass
class Relational:
    title: str
    tables: dict[str, Spec]
    links: list[Link] = field(default_factory=list)
    seed: int = 7

    def problems(self) -> list[str]:
        """Everything that is wrong with the tables and links, as sentences."""
        found = [] if self.tables else ["there are no tables"]
        for name, t in self.tables.items():
            found += [f"{name}: {p}" for p in t.problems()]
        taken: set[tuple[str, str]] = set()
        for x in self.links:
            tag = f"{x.child}.{x.fk}"
            found += [f"{tag}: no table {t}" for t in (x.child, x.parent) if t not in self.tables]
            key = next((c for c in self.tables[x.parent].columns if c.name == x.parent_key), None) if x.parent in self.tables else None
            if x.parent in self.tables and key is None:
                found.append(f"{tag}: {x.parent} has no column {x.parent_key}")
            elif key is not None and (key.ctype, key.dist) != ("str_id", "sequence"):
                found.append(f"{tag}: {x.parent_key} is no sequence of keys")
            if x.child in self.tables and x.fk in ("row_id", "duplicate_of", *[c.name for c in self.tables[x.child].columns]):
                found.append(f"{tag}: the link makes this column, and the table has it already")
            if (x.child, x.fk) in taken:
                found.append(f"{tag}: two links make it")
            taken.add((x.child, x.fk))
            found += [f"{tag}: {n} is outside 0 to {MOST}" for n, r in (("orphans", x.orphans), ("drift", x.drift)) if not 0 <= r <= MOST]
            if x.style not in STYLES:
                found.append(f"{tag}: no such style as {x.style}")
        return found


@dataclass
class Planned:
    """Clean and dirty tables with their references, each table's ledger of cells, and the ledger of references (child, fk, row_id, true_key, dirty, mess)."""

    clean: dict[str, DataFrame]
    dirty: dict[str, DataFrame]
    cells: dict[str, DataFrame]
    references: DataFrame


def seed_of(seed: int, name: str) -> int:
    return int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:12], 16)


def plan(spark: SparkSession, spec: Relational) -> Planned:
    if found := spec.problems():
        raise ValueError("; ".join(found))
    made = {name: plan_table(spark, replace(t, seed=seed_of(spec.seed, name))) for name, t in spec.tables.items()}
    clean, dirty, cells = ({name: t[i] for name, t in made.items()} for i in range(3))
    references = spark.createDataFrame([], "child string, fk string, row_id long, true_key string, dirty string, mess string")
    for x in spec.links:
        parent, key = spec.tables[x.parent], next(c for c in spec.tables[x.parent].columns if c.name == x.parent_key)
        prefix, last = key.params.get("prefix", ""), parent.rows - 1 + key.params.get("start", 1)
        seed, width = seed_of(spec.seed, f"link:{x.child}:{x.fk}"), max(len(str(last)), 2)
        keys = clean[x.parent].select(F.col("row_id").alias("_p"), F.col(x.parent_key).alias("_key"))
        drawn = draw_parents(clean[x.child].select("row_id"), "row_id", keys.select("_p"), "_p", seed, "_parent")
        named = drawn.join(keys, F.col("_parent") == F.col("_p")).select(F.col("row_id").alias("_r"), "_key")
        clean[x.child] = clean[x.child].join(named, F.col("row_id") == F.col("_r"), "left").withColumnRenamed("_key", x.fk).drop("_r")
        rows = dirty[x.child].join(named, F.coalesce("duplicate_of", "row_id") == F.col("_r"), "left").drop("_r")
        broken = break_references(rows.select("row_id", "_key").where("_key is not null"), "row_id", "_key", keys.select(F.col("_key").alias("_parent")), "_parent", prefix, width, x.orphans, x.drift, x.style, seed)
        told = broken.select(F.col("row_id").alias("_r"), F.col("dirty").alias("_dirty"), F.col("mess").alias("_mess"))
        both = rows.join(told, F.col("row_id") == F.col("_r"), "left")
        references = references.union(both.where("_mess is not null").select(F.lit(x.child), F.lit(x.fk), "row_id", F.col("_key"), F.col("_dirty"), F.col("_mess")))
        dirty[x.child] = both.withColumn(x.fk, F.col("_dirty")).drop("_r", "_key", "_dirty", "_mess")
    return Planned(clean, dirty, cells, references)
