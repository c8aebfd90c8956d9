"""Toxicity by a linear-chain conditional random field over words.

Only documents are labelled, so words are labelled first: over a sample of labelled
documents, features of words (the word itself and its leading 4, 5 and 6 letters) that
stand in significantly more toxic than clean documents mark their words in toxic
documents as toxic; every word of a clean document is clean.  A two-state chain (clean,
toxic) is fitted to windows of words by the likelihood's gradient.  Each line of a text
is a chain; forward-backward gives every word its marginal, and a logistic curve, fitted
on the sample, turns the largest marginal and the number of likely toxic words into the
document's score.

The sample has at most ``TOXIC_DOCS`` and ``CLEAN_DOCS`` labelled documents in
expectation, chosen by a hash of the id; near copies (equal smallest hash of 5-word
shingles) teach once.  Scoring reads every text whole, and nothing but the text.

Defined results: a null, empty or wordless text has the score of no toxic word and no
spans.  Labelled rows with a null text, label or id teach nothing; without both labels
the score is the share of toxic labels (0 for none at all).  Repeated rows score alike.
Other columns pass through; one with a result's name gives way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import add, arrow, free_name, labelled_sample, logistic

TOXIC_DOCS = 3_000
CLEAN_DOCS = 6_000
#: A feature counts as toxic if its log odds ratio less three standard errors is above this.
MIN_LOG_ODDS = 0.3
ERRORS = 3.0
MIN_DOCS = 5
#: Words on either side of a marked word that the chain is fitted to, and windows from clean documents for each document.
REACH = 8
CLEAN_WINDOWS = 3
BUCKETS = 1 << 18
STEPS = 80
MEMO_ENTRIES = 1 << 17

_RUNS = re.compile(r"[^\W\d_]+").findall


def _features(word: str) -> list[str]:
    return ["=" + word, *[word[:k] for k in (4, 5, 6) if len(word) >= k]]


def _bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def _runs(token: str) -> list[str]:
    return _RUNS(token.lower())


def _chain(scores: np.ndarray, sizes: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains that lie end to end: at each word the odds of toxic given the words up to it, given those after it, and both.

    Chains are handled side by side, longest first, one word of each at a time.
    ``pairs[a, b]`` weighs b after a; 0 is clean, 1 toxic.
    """
    odds = np.exp(np.clip(scores, -30.0, 30.0))
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    ranked = sizes[order]
    ahead, behind = np.empty(len(scores)), np.ones(len(scores))
    longest = int(ranked[0]) if len(ranked) else 0
    alive = np.searchsorted(-ranked, -np.arange(longest), side="left")  # chains longer than t
    r = np.ones(len(order))
    for t in range(longest):
        at = starts[: alive[t]] + t
        r = r[: alive[t]]
        if t:
            r = (r * pairs[1, 1] + pairs[0, 1]) / (r * pairs[1, 0] + pairs[0, 0])
        r = r * odds[at]
        ahead[at] = r
    b = np.ones(0)
    for t in range(longest - 2, -1, -1):
        n = alive[t + 1]
        at = starts[:n] + t + 1
        if len(b) < n:
            b = np.concatenate((b, np.ones(n - len(b))))
        y = b * odds[at]
        b = (y * pairs[1, 1] + pairs[1, 0]) / (y * pairs[0, 1] + pairs[0, 0])
        behind[at - 1] = b
    both = ahead * behind
    return ahead, behind, both


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    bias: float = 0.0
    pairs: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    base: float = 0.0  # the score where nothing could be learned
    fitted: bool = False

    def word(self, token: str) -> float:
        """Log odds of toxic for a token by itself; the highest of its runs of letters."""
        found = [sum(float(self.weights[_bucket(f)]) for f in _features(w)) for w in _runs(token)]
        return self.bias + max(found, default=0.0)

    def score(self, highest: np.ndarray, likely: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * highest + c * np.log1p(likely), -30, 30))) if self.fitted else np.full(len(highest), self.base)


class _Scores(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[token] = found = self.model.word(token)
        return found


def _read(texts: list[str | None], scores: _Scores) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, float]]]]:
    """Highest log odds and number of likely toxic words of each text, and (place among the text's words, marginal) of the latter."""
    words, sizes, ends = [], [], []
    for text in texts:
        for line in (text or "").split("\n"):
            tokens = line.split()
            if tokens:
                words += map(scores.__getitem__, tokens)
                sizes.append(len(tokens))
        ends.append(len(words))
    _, _, odds = _chain(np.array(words), np.array(sizes, np.int64), scores.model.pairs)
    highest, likely, places = np.full(len(texts), -30.0), np.zeros(len(texts)), []
    starts = [0, *ends[:-1]]
    hot = np.flatnonzero(odds > 1)
    cut = np.searchsorted(hot, starts), np.searchsorted(hot, ends)
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        if b > a:
            highest[i] = np.log(max(odds[a:b].max(), 1e-13))
        own = hot[cut[0][i] : cut[1][i]]
        likely[i] = len(own)
        places.append([(int(x) - a, float(odds[x] / (1 + odds[x]))) for x in own])
    return highest, likely, places


def sample(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, toxic: int = TOXIC_DOCS, clean: int = CLEAN_DOCS) -> tuple[DataFrame, dict[int, float]]:
    """(text, y) of a bounded number of labelled rows, near copies once, and the share of each label that was taken."""
    picked, _, share = labelled_sample(docs, labels, text, label, key, {0: clean, 1: toxic})

    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for t in batch:
                w = t.as_py().encode("utf-8", "surrogatepass").split()
                out.append(min((xxhash.xxh64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0) >> 1)
            yield pa.array(out, pa.int64())

    once = picked.withColumn("sketch", arrow(sketch, "long")("text")).groupBy("sketch", "y").agg(F.min("text").alias("text"))
    return once.select("text", "y"), share


def _lexicon(rows: DataFrame) -> set[str]:
    """Features that stand in significantly more toxic than clean documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for batch in batches:
            for t, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                sides[y].update({f for w in set(_runs(t.as_py())) for f in _features(w)})
                n[y] += 1
        found = list({*sides[1]} | {*sides[0]}) + [""]
        sides[0][""], sides[1][""] = n
        yield pa.RecordBatch.from_pydict({"f": found, "toxic": [sides[1][f] for f in found], "clean": [sides[0][f] for f in found]}, schema=pa.schema([("f", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]))

    counts = rows.mapInArrow(count, "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where(F.col("a") >= MIN_DOCS).collect()
    n1, n0 = next(((r.a, r.b) for r in counts if r.f == ""), (0, 0))
    odds = lambda a, b: np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)) - ERRORS * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return {r.f for r in counts if r.f and odds(r.a, r.b) > MIN_LOG_ODDS}


def _windows(rows: DataFrame, lexicon: set[str]) -> DataFrame:
    """(words, marks): windows about marked words of toxic documents and about look-alikes of clean ones, and others of the latter."""
    names = frozenset(lexicon)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, marks = [], []
            for t, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                tokens = t.as_py().split()
                like = [any(f in names for w in _runs(x) for f in _features(w)) for x in tokens]
                centres = [i for i, x in enumerate(like) if x]
                if not y and tokens:
                    step = xxhash.xxh32_intdigest(t.as_py().encode("utf-8", "surrogatepass"))
                    centres += [(step * (k + 1) + k) % len(tokens) for k in range(CLEAN_WINDOWS)]
                last = -1
                for i in sorted(centres):
                    if i > last:
                        a, last = max(0, i - REACH), i + REACH
                        words.append(tokens[a : last + 1])
                        marks.append([int(bool(y and x)) for x in like[a : last + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int8()))], ["words", "marks"])

    return rows.mapInArrow(cut, "words array<string>, marks array<byte>")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> Model:
    """A model from documents and the labels of some of them; see the module's docstring for what it reads."""
    rows, share = sample(docs, labels, text, label, key)
    if len(share) < 2:
        return Model(base=float(bool(share.get(1))))
    rows = rows.persist()
    try:
        lexicon = _lexicon(rows)
        chains = _windows(rows, lexicon).toPandas().sort_values("words", key=lambda s: s.map(lambda w: " ".join(w)))  # any order of rows, the same model
        model = _fit_chain(list(chains["words"]), list(chains["marks"]))
        found = rows.select("y", _marked(model, F.col("text")).alias("m")).select("y", "m.highest", F.size("m.spans").alias("likely")).toPandas()
    finally:
        rows.unpersist()
    weight = found["y"].map({y: 1 / s for y, s in share.items()}).to_numpy(float)
    x = np.column_stack((np.ones(len(found)), found["highest"], np.log1p(found["likely"])))
    model.curve = tuple(map(float, logistic(x, found["y"].to_numpy(float), weight, 0.1)))
    model.fitted = True
    return model


def _fit_chain(words: list, marks: list) -> Model:
    """Full-batch gradient steps (Adam) on the mean log likelihood of the windows, with a small weight penalty."""
    sizes = np.array([len(w) for w in words], np.int64)
    gold = np.concatenate([np.asarray(m, float) for m in marks]) if len(marks) else np.zeros(0)
    rows, cols = [], []
    for i, token in enumerate(x for w in words for x in w):
        own = max((_features(w) for w in _runs(token)), key=len, default=[])
        rows += [i] * len(own)
        cols += map(_bucket, own)
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    same = np.ones(len(gold), bool)
    same[np.cumsum(sizes)[:-1][np.cumsum(sizes)[:-1] < len(gold)]] = False  # a chain's first word has nothing before it
    if len(same):
        same[0] = False
    here = np.flatnonzero(same)
    kinds = (gold[here - 1] * 2 + gold[here]).astype(int)
    theta = np.zeros(BUCKETS + 5)
    theta[BUCKETS] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        scores = theta[BUCKETS] + np.bincount(rows, theta[cols], minlength=len(gold))
        pairs = np.exp(theta[-4:].reshape(2, 2))
        ahead, behind, both = _chain(scores, sizes, pairs)
        wrong = gold - both / (1 + both)
        x, y = ahead[here - 1], np.exp(np.clip(scores[here], -30, 30)) * behind[here]
        joint = np.stack((np.full(len(here), pairs[0, 0]), pairs[0, 1] * y, pairs[1, 0] * x, pairs[1, 1] * x * y))
        expected = (joint / joint.sum(axis=0)).sum(axis=1)
        grad = np.zeros_like(theta)
        grad[:BUCKETS] = np.bincount(cols, wrong[rows], minlength=BUCKETS)
        grad[BUCKETS] = wrong.sum()
        grad[-4:] = np.bincount(kinds, minlength=4) - expected
        grad = grad / max(1, len(sizes)) - 1e-5 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (grad != 0)
    return Model(theta[:BUCKETS].astype(np.float32), float(theta[BUCKETS]), np.exp(theta[-4:].reshape(2, 2)))


def _marked(model: Model, text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = _Scores(model)
        word = re.compile(r"\S+")
        for batch in batches:
            texts = batch.to_pylist()
            highest, likely, places = _read(texts, scores)
            spans = []
            for t, own in zip(texts, places, strict=True):
                found = []
                if own:
                    want = dict(own)
                    for i, x in enumerate(word.finditer(t)):
                        if i in want:
                            found.append({"start": x.start(), "end": x.end(), "p": want[i]})
                spans.append(found)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.StructArray.from_arrays([pa.array(model.score(highest, likely), pa.float64()), pa.array(highest, pa.float64()), pa.array(spans, kind)], ["score", "highest", "spans"])

    return arrow(run, "score double, highest double, spans array<struct<start:int,end:int,p:double>>")(text)


def tag(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1), ``predicted`` (1 at 0.5 or more) and ``spans``: the toxic words' offsets in code points and marginals."""
    name = free_name(df, "marked")
    made = df.withColumn(name, _marked(model, df[f"`{text}`"]))
    score = F.col(name)["score"]
    return add(made, {"score": score, "predicted": (score >= 0.5).cast("int"), "spans": F.col(name)["spans"]}).drop(name)
