import itertools
import zlib

import numpy as np

from plumbline.llm import queries, toxicity
from pyspark.sql import functions as F


def test_chain_gives_the_marginals_of_all_labellings():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 5, 3, 7], np.int64)
    scores, pairs = rng.normal(size=sizes.sum()), np.exp(rng.normal(size=(2, 2)))
    _, _, odds = toxicity._chain(scores, sizes, pairs)
    at = 0
    for n in sizes:
        weight = np.zeros((n, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(s for s, y in zip(scores[at : at + n], labels, strict=True) if y)) * np.prod([pairs[a, b] for a, b in zip(labels, labels[1:], strict=False)])
            for i, y in enumerate(labels):
                weight[i, y] += w
        assert np.allclose(odds[at : at + n] / (1 + odds[at : at + n]), weight[:, 1] / weight.sum(axis=1))
        at += n


def test_edge_cases(spark):
    rows = [(i, f"nice words number {i} here " + ("you awful wretch" if i % 3 == 0 else "and more"), int(i % 3 == 0)) for i in range(90)]
    rows += [(200, None, 1), (201, "text", None), (None, "awful", 1)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs = labelled.select("doc_id", "text")
    model = toxicity.fit(docs, labelled.select("doc_id", "toxic"))
    df = spark.createDataFrame([(1, "an awful day\nYou AWFUL wretch!", "a"), (2, "kind words", "b"), (3, None, "c"), (4, "", "d"), (4, "", "d"), (5, "kind " * 40_000 + "wretch", "e")], "doc_id long, text string, predicted string")
    out = toxicity.tag(df, model)
    assert out.columns == ["doc_id", "text", "score", "predicted", "spans"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 6 and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].predicted for i in (1, 2, 3, 4, 5)] == [1, 0, 0, 0, 1]
    assert "AWFUL" in [got[1].text[s.start : s.end] for s in got[1].spans] and got[3].spans == []
    empty = labelled.limit(0)
    assert toxicity.fit(empty, empty).score(np.zeros(1), np.zeros(1))[0] == 0
    assert toxicity.tag(df.limit(0), model).count() == 0


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op2_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    known = [(r.predicted, truth[r.doc_id]) for r in rows if r.doc_id in truth]
    assert sum(a == b for a, b in known) >= 0.9 * len(known)
    unseen = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(unseen) > 30 and sum(a == b for a, b in unseen) >= 0.9 * len(unseen)
