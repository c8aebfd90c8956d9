"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and line contracts: bytes 0x20 and 0x09-0x0D.
ASCII_SPACE = " \t\n\r\x0b\x0c"


#: Bytes of an Arrow batch, unless the session sets it: long texts then need no more memory than short ones.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def by_merge(df: DataFrame) -> DataFrame:
    """One side of a join neither side of which is sent whole to all: Spark takes what an explode or a Python function makes for no larger than what goes in, and a file for as large as it is compressed."""
    return df.hint("merge")


def tidy() -> None:
    """Gives memory that a Python worker has freed back to the system; the worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def arrow(run: Callable[[Iterator], Iterator[pa.Array]], kind: str, several: bool = False) -> Callable:
    """A column function from one that maps Arrow arrays (tuples of them, if ``several`` columns go in); evaluated once for each use."""

    def each(batches):
        yield from run(batches)
        tidy()

    each.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]] if several else Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(each, kind).asNondeterministic()


def forget(df: DataFrame) -> None:
    """Deletes a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, most: dict[int, int]) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """(text, y) of a bounded number of labelled documents, the number of labels of each kind, and the share of them that was taken.

    Labels above 0 are 1.  Of each kind at most ``most`` are taken in expectation, by a
    hash of the key.  The labels are chosen first, so what is broadcast to the documents
    is that many keys at most, and texts don't move.
    """
    known = labels.select(F.col(f"`{key}`").alias("key"), (F.col(f"`{label}`") > 0).cast("int").alias("y")).where("y is not null and key is not null")
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, most[y] / n) for y, n in sizes.items()}
    part = F.when(F.col("y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    picked = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < part * (1 << 20))
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text is not null")
    return texts.join(F.broadcast(picked), "key").select("text", "y"), sizes, share


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use, whatever the case."""
    used = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in used:
        name += "_"
    return name


def add(df: DataFrame, columns: dict) -> DataFrame:
    """Adds result columns; one of the same name (in any case) gives way, and the other columns keep their places."""
    names = {c.lower() for c in columns}
    keep = [c for c in df.columns if c.lower() not in names]
    return df.select(*[df[f"`{c}`"] for c in keep], *[c.alias(n) for n, c in columns.items()])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weighted logistic regression: Newton steps on the penalised likelihood, halved until they raise it."""
    weight, w = weight / weight.mean(), np.zeros(x.shape[1])
    cost = lambda w: float((weight * (np.logaddexp(0, z := x @ w) - y * z)).sum() + ridge * (w @ w) / 2)
    now = cost(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step, size = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * w), 1.0
        while size > 1e-4 and cost(w + size * step) > now:
            size /= 2
        if size <= 1e-4 or np.abs(size * step).max() < 1e-8:
            break
        w = w + size * step
        now = cost(w)
    return w
