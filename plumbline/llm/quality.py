"""Quality by hierarchical empirical Bayes: what a document shows, and what its site is like.

A classifier of surface features (logistic over quantile bins, fitted on at most
``DOCS_PER_LABEL`` labelled rows of each label in expectation, chosen by a hash of the
id) gives every document a probability of being good.  Grouped sums of these over all
documents give each path of each host, and each host, its share.  Beta priors shrink
them: a path towards its host, a host towards all documents, with strengths estimated
from how much sites of a level differ beyond chance (method of moments), so a sparse
site says little and a large one much.  A document's own part is left out of its site's
share; the site's log odds against the whole then shift the document's.

Sums run over scaled whole numbers, so they are the same in any order; a host with a
third of all rows is summed per task first, and joined back by sites, which carry no
text.

Defined results: a null or empty text is scored like any text by its features (all
zero); a null host or path is a site of its own.  Labelled rows with a null text, label
or id teach nothing; without both labels every document has the share of good labels
(one half without any).  Repeated rows count each and score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow, labelled_sample, logistic
from plumbline.sources.shared import written

DOCS_PER_LABEL = 6_000
BINS = 12
#: A document stays at this probability of being good; losing a good one is the worse mistake.
KEEP = 0.2
SCALE = 1 << 20
#: Bounds of a prior's strength in documents.
STRENGTH = (1.0, 1e6)

_UPPER, _DIGIT, _MARK, _BAR = (np.array([bool(f(chr(c))) if c < 128 else False for c in range(256)]) for f in (str.isupper, str.isdigit, lambda c: not c.isalnum() and not c.isspace() and c not in ".,;:'\"-()?!", lambda c: c in "|!"))


def features(text: str | None) -> list[float]:
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * 10
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = float(counts.sum())
    after = words[1:]
    return [
        float(np.log1p(n)),
        len(set(words)) / n**0.8,
        len(set(zip(words, after, strict=False))) / n,
        sum(map(eq, words, after)) / n,
        size / n,
        counts[_UPPER].sum() / size,
        counts[_DIGIT].sum() / size,
        counts[_MARK].sum() / size,
        counts[_BAR].sum() / size,
        float(counts[46]) / n,
    ]


class Classifier:
    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, base: float):
        self.base, self.edges = base, [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else []
        self.w = np.zeros(0)
        if len(x) and 0 < y.mean() < 1:
            self.w = logistic(self._spread(x), y, weight, 1.0)

    def _spread(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), *[np.eye(len(e) + 1)[np.searchsorted(e, c, side="right")] for e, c in zip(self.edges, x.T, strict=True)]])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.w):
            return np.full(len(texts), self.base)
        return 1 / (1 + np.exp(-np.clip(self._spread(np.array([features(t) for t in texts]).reshape(len(texts), -1)) @ self.w, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id") -> Classifier:
    """A classifier from documents and the labels of some of them."""
    picked, sizes, share = labelled_sample(docs, labels, text, label, key, {0: DOCS_PER_LABEL, 1: DOCS_PER_LABEL})
    total = sum(sizes.values())
    base = sizes.get(1, 0) / total if total else 0.5

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([features(t.as_py()) for t in batch], pa.list_(pa.float64()))

    seen = sorted((r.x, r.y) for r in picked.select("y", arrow(run, "array<double>")("text").alias("x")).collect())
    y = np.array([v for _, v in seen], float)
    return Classifier(np.array([x for x, _ in seen]), y, np.array([1 / share[int(v)] for v in y]), base)


def evidence(classifier: Classifier, text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(classifier(batch.to_pylist()), pa.float64())

    return arrow(run, "double")(text)


def _strength(sites: DataFrame, mean: Column) -> float:
    """How many documents a prior with these means is worth, from the spread of the sites' shares beyond what chance gives."""
    p, n = F.col("s") / SCALE / F.col("n"), F.col("n").cast("double")
    r = sites.agg(F.sum(n).alias("n"), F.sum(n * (p - mean) ** 2).alias("spread"), F.sum(mean * (1 - mean)).alias("chance"), F.sum(n * mean * (1 - mean)).alias("room")).first()
    if not r.n:
        return STRENGTH[0]
    between = max((r.spread - r.chance) / r.n, 1e-12)
    return float(min(max((r.room / r.n - between) / between, STRENGTH[0]), STRENGTH[1]))


def grade(df: DataFrame, classifier: Classifier, text: str = "text", key: str = "doc_id", host: str = "host", path: str = "path") -> DataFrame:
    """A row for each row of ``df``: ``key``, ``evidence``, ``host_share``, ``path_share``, ``score`` and ``keep``."""
    p = evidence(classifier, df[f"`{text}`"])
    docs = written(df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{host}`").alias("host"), F.col(f"`{path}`").alias("path"), p.alias("p")).withColumn("q", F.round(F.col("p") * SCALE).cast("long")), "evidence")
    paths = written(docs.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("q").alias("s")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mean = min(max(whole.s / SCALE / whole.n, 1e-6), 1 - 1e-6) if whole.n else 0.5
    above = _strength(hosts.select(F.col("hn").alias("n"), F.col("hs").alias("s")), F.lit(mean))
    shrunk = hosts.withColumn("host_share", (F.col("hs") / SCALE + above * mean) / (F.col("hn") + above))
    sites = paths.join(shrunk, paths["host"].eqNullSafe(shrunk["host"])).drop(shrunk["host"])
    below = _strength(sites, F.col("host_share"))
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("r"), "n", "s", "hn", "hs")
    # the document's own part is left out of both levels
    joined = docs.join(sites, docs["host"].eqNullSafe(sites["h"]) & docs["path"].eqNullSafe(sites["r"]))
    own = F.col("q")
    host_share = ((F.col("hs") - own) / SCALE + above * mean) / (F.col("hn") - 1 + above)
    path_share = ((F.col("s") - own) / SCALE + below * F.col("host_share")) / (F.col("n") - 1 + below)
    odds = lambda x: F.log(F.greatest(x, F.lit(1e-9)) / F.greatest(1 - x, F.lit(1e-9)))
    score = 1 / (1 + F.exp(-(odds(F.col("p")) + odds(F.col("path_share")) - float(np.log(mean / (1 - mean))))))
    out = joined.withColumn("host_share", host_share).withColumn("path_share", path_share).withColumn("score", score)
    return out.select(F.col("id").alias(key), F.col("p").alias("evidence"), "host_share", "path_share", "score", (F.col("score") >= KEEP).alias("keep"))
