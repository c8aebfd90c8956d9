import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import langid, queries


def test_profile_is_the_bundle_of_bound_permuted_letters():
    assert langid.profile(None) is None and langid.profile("") is None and langid.profile("12 !? 3") is None
    pair, last = langid._bound()
    code = lambda c: 0 if c == " " else ord(c) - 96
    want = np.zeros(langid.DIMENSIONS)
    text = " abc de "
    for i in range(len(text) - 2):
        a, b, c = map(code, text[i : i + 3])
        want += np.roll(last[a], 2) * np.roll(last[b], 1) * last[c]
    got = langid.profile("ABC, 12 de!")
    assert np.allclose(got, want) and np.allclose(langid.profile("abc de"), want)
    assert langid.profile("x" * 200_000).shape == (langid.DIMENSIONS,)


def test_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "123", "xx"), (6, "the house", None), (6, "the house", None), (None, "und die", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("SCORE", F.lit("x"))
    protos = langid.learn(df)
    assert set(protos) == {"en", "de"}
    out = langid.predict(df, protos)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = out.collect()
    assert sorted(r.lang_pred for r in got) == ["de", "de", "en", "en", "en", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in langid.predict(df.limit(1), {}).collect()] == ["und"]
    assert langid.learn(df.limit(0)) == {} and langid.predict(df.limit(0), protos).count() == 0


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.QUERIES["op4_language_id"](spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.99 * len(held)
