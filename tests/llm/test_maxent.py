import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from plumbline.llm import maxent, queries
from pyspark.sql import functions as F


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def base(rows):
    """rows: (text, learned); (n_tokens, n_known, train_tokens, base_score) of each."""
    seen = Counter(w for t, learned in rows if learned for w in tokens(t))
    total, types = sum(seen.values()), len(seen)
    out = []
    for t, _ in rows:
        own = tokens(t)
        out.append((len(own), sum(seen[w] > 0 for w in own), total, round(sum(log10((seen[w] + 1) / (total + types + 1)) for w in own), 6)))
    return out


def corpus(n, seed=0):
    """Two languages whose words follow each other by rule, with words of their own here and there."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        stem, at, words = "ab"[i % 2], int(rng.integers(30)), []
        for _ in range(int(rng.integers(5, 80))):
            at = (at * 7 + int(rng.integers(3))) % 30
            words.append(f"own{rng.integers(1 << 40)}" if rng.random() < 0.03 else f"{stem}{at}")
        out.append(" ".join(words))
    return out


def test_base_and_edge_cases(spark):
    texts = [*corpus(60), None, "", " \n\t", "Same SAME same", "x" * 50_000, "é " * 40_000, "a\x0bb\x0cc\x1cd e"]
    rows = [(i, t, i % 3 != 0) for i, t in enumerate(texts)] + [(None, "null id", True), (4, texts[4], None), (4, texts[4], True)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, teach boolean, score double").repartition(3)
    made = maxent.score(df, F.col("teach"), bundle_bytes=20_000, range_bytes=20_000)
    assert made.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = made.collect()
    want = base([(t, teach) for _, t, teach in rows])
    shown = lambda i, w: (str(i), *w)
    assert sorted(shown(r.doc_id, (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got) == sorted(shown(r[0], w) for r, w in zip(rows, want, strict=True))
    assert all(r.score <= 1e-3 and np.isfinite(r.score) for r in got)
    same = [r.score for r in got if r.doc_id == 4]
    assert len(same) == 3 and max(same) - min(same) < 1e-6
    again = {str(r.doc_id): r.score for r in maxent.score(df, F.col("teach"), bundle_bytes=1 << 20).collect()}
    assert all(abs(again[str(r.doc_id)] - r.score) < 0.5 * r.n_tokens for r in got)
    assert maxent.score(df.limit(0), F.col("teach")).count() == 0


def test_nothing_learned(spark):
    df = spark.createDataFrame([("k1", "a b c"), ("k2", None)], "id string, body string")
    got = {r.id: r for r in maxent.score(df, F.lit(False), "body", "id").collect()}
    assert (got["k1"].n_tokens, got["k1"].n_known, got["k1"].train_tokens, got["k1"].base_score) == (4, 0, 0, 0.0)
    assert abs(got["k1"].score) < 1e-3 and got["k2"].n_tokens == 1 and abs(got["k2"].score) < 1e-3


def test_chances_of_all_tokens_add_up_to_one():
    rng = np.random.default_rng(3)
    counts = {b"w%d" % i: int(n) for i, n in enumerate(np.maximum(rng.zipf(1.4, 3_000) % 1_000, 1))} | {maxent.END: 40}
    often = sorted((w for w, n in counts.items() if n > 1 and w != maxent.END), key=lambda w: (-counts[w], w))
    head = {w: 2 + i for i, w in enumerate(often[: maxent.HEAD])}
    mass = np.zeros(maxent.LEAVES)
    once, twice = (sum(n == k for w, n in counts.items() if w != maxent.END) for k in (1, 2))
    vocab = maxent.Vocabulary(head, mass, sum(counts.values()), len(counts), once, twice)
    for w, n in counts.items():
        mass[vocab.leaf(w, n)] += n if n > 1 else 0
    mass[maxent.RARE] = once + 1
    assert 0 < vocab.unknown < 1
    leaf = np.array([vocab.leaf(w, n) for w, n in counts.items()] + [maxent.RARE])
    inside = 10 ** vocab.within(leaf, np.array([*counts.values(), 0]))
    per = np.bincount(leaf, inside, maxent.LEAVES)
    assert np.allclose(per[mass > 0], 1)
    weights = rng.normal(0, 1, (maxent.ROWS, maxent.WIDTH)).astype(np.float32)
    features = np.repeat(maxent.histories(np.array([7, 900, 0], np.uint16), np.arange(3), 2, 3), maxent.LEAVES, 1)
    every = np.arange(maxent.LEAVES)
    top, low, _, _ = maxent.chances(weights, vocab.offsets(), features, every)
    p = top[every, every // maxent.WIDTH].astype(float) * low[every, every % maxent.WIDTH]
    assert abs((p * per).sum() - 1) < 1e-4


def test_histories_are_those_of_the_own_document():
    leaves, sizes = np.array([5, 6, 7, 8, 9, 5, 6], np.uint16), np.array([4, 1, 2], np.int32)
    whole = maxent.histories(leaves, maxent.places(sizes), 0, 7)
    assert np.array_equal(whole[:, 3:6], maxent.histories(leaves, maxent.places(sizes), 3, 6))
    alone = maxent.histories(leaves[5:], maxent.places(sizes[2:]), 0, 2)
    assert np.array_equal(whole[:, 5:], alone) and np.array_equal(whole[:, :2], alone)
    assert len(set(whole[3].tolist())) == 4  # starts of all three, of two after a 5, and two further in


def test_a_step_follows_the_gradient():
    """One batch from zero weights: each touched row moves by its slope, as counted outcome by outcome."""
    rng = np.random.default_rng(5)
    sizes = np.array([40, 60], np.int32)
    leaves = rng.integers(0, 64, 100).astype(np.uint16)
    offsets = (np.zeros(32, np.float32), np.zeros((32, 32), np.float32))
    weights, squares = np.zeros((maxent.ROWS, 32), np.float32), np.zeros(maxent.ROWS, np.float32)
    touched = maxent.fit_shard(weights, squares, offsets, leaves, sizes)
    features = maxent.histories(leaves, maxent.places(sizes), 0, 100)
    slope = np.zeros((maxent.ROWS, 32))
    for i, leaf in enumerate(leaves.tolist()):
        for which, node, hit in ((maxent.TOP, 0, leaf // 32), (maxent.LOW, leaf // 32 + 1, leaf % 32)):
            for row in maxent.rows_of(features[which, i : i + 1], np.array([node]))[:, 0]:
                slope[row] += 1 / 32
                slope[row, hit] -= 1
    at = np.flatnonzero(np.abs(slope).sum(1))
    assert np.array_equal(np.flatnonzero(touched), at)
    want = -maxent.RATE * slope / np.sqrt(1 + (slope**2).sum(1))[:, None]
    assert np.allclose(weights, want, atol=1e-4) and np.allclose(squares, (slope**2).sum(1), rtol=1e-3)


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(i, t) for i, t in enumerate(corpus(3_000, 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r.doc_id: r for r in maxent.score(df, F.col("doc_id") % 5 != 0, bundle_bytes=30_000).collect()}


def test_held_out_texts_gain_from_their_order(learned, spark):
    held = [r for i, r in learned.items() if i % 5 == 0]
    per = lambda c: sum(r[c] for r in held) / sum(r.n_tokens for r in held)
    assert per("score") > per("base_score") + 0.5
    assert sum(r.score > r.base_score for r in held) > 0.99 * len(held)


def test_shuffled_words_are_less_likely(spark):
    rng = np.random.default_rng(9)
    texts = corpus(2_000, 2)
    mixed = [" ".join(rng.permutation(t.split())) for t in texts[:200]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + mixed)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.score for r in maxent.score(df, (F.col("doc_id") >= 200) & (F.col("doc_id") < 2_000)).collect()}
    assert np.mean([got[2_000 + i] < got[i] for i in range(200)]) > 0.95


def test_query(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.QUERIES["op11_lm_score"](spark, sf).collect()}
    want = base([(t, zlib.crc32(str(i).encode()) % 7 != 2) for i, t in rows])
    assert len(got) == len(rows)
    for (i, _), w in zip(rows, want, strict=True):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) == w and r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.5 * sum(r.n_tokens for r in held)
