import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from plumbline.llm import queries, resample
from pyspark.sql import functions as F


def features(text, n=2):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, percent=25, min_words=20, n=2, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) of rows (doc_id, text), n-grams as strings."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, text in rows:
        for f in features(text, n)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in features(text, n)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (float(s.sum()) + buckets) / ((float(s[b]) + 1) * (float(t.sum()) + buckets)))) for b in range(buckets)]
    out, pool = [], []
    for at, (i, text) in enumerate(rows):
        words, found = features(text, n)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
            if len(words) >= min_words:
                pool.append((-score, i, at))
        out.append([i, len(found), weight, score, None])
    for rank, (_, _, at) in enumerate(sorted(pool)[: percent * len(pool) // 100], 1):
        out[at][4] = rank
    return sorted(map(repr, map(tuple, out)))


def shown(df):
    return sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in df.collect())


def test_crcs_are_those_of_the_joined_words():
    rng = np.random.default_rng(1)
    texts = [b" ".join(bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(1, 40, 30)) for _ in range(5)] + [b"", b"...", ("wörter é ok " * 3).encode(), b"x" * 70_000 + b" y"]
    for n in (1, 2, 4):
        crc, of, counts = resample._features(texts, n)
        want = sorted((d, zlib.crc32(f.encode())) for d, t in enumerate(texts) for f in features(t.decode(), n)[1])
        assert sorted(zip(of.tolist(), crc.tolist(), strict=True)) == want
        assert counts.tolist() == [len(features(t.decode())[0]) for t in texts]


def test_edge_cases(spark):
    rng = np.random.default_rng(2)
    word = lambda: "abcdefghij"[rng.integers(10)] * int(rng.integers(1, 4))
    rows = [(i, " ".join(word() for _ in range(rng.integers(1, 60)))) for i in range(200)]
    rows += [(200, None), (201, ""), (202, " .,-! "), (None, "a b c " * 20), (None, None), (5, rows[5][1]), (203, "LONG Text, " * 30_000), (204, "Ä" * 50_000), (-3, rows[7][1])]
    target = ["aa bb cc", None, "", "Aa, bb; ÄÄ"]
    df = spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id long, text string, rank string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (25, 100, 0):
        assert shown(resample.resample(df, wanted, percent=percent)) == brute(rows, target, percent)
    assert shown(resample.resample(df, wanted, ngram=3, buckets=97)) == brute(rows, target, n=3, buckets=97)
    assert shown(resample.resample(df, wanted.limit(0))) == brute(rows, [])
    assert resample.resample(df.limit(0), wanted).count() == 0
    with pytest.raises(ValueError):
        resample.resample(df, wanted, ngram=0)


def test_ties_go_to_the_smaller_id(spark):
    scored = spark.createDataFrame([(i, i % 3, 30) for i in range(30)], "doc_id long, score long, n_words long")
    got = {r.doc_id: r["rank"] for r in resample.ranked(scored, "doc_id", F.col("n_words") >= 20, 50).collect()}
    best = sorted(range(30), key=lambda i: (-(i % 3), i))[:15]
    assert got == {i: best.index(i) + 1 if i in best else None for i in range(30)}


def test_query(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = shown(queries.QUERIES["op13_resample"](spark, sf))
    assert got == brute(rows, target)
    want = con.sql(queries.ORACLES["op13_resample"])
    at = [want.columns.index(c) for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
