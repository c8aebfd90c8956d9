import math
from collections import defaultdict

from plumbline.llm import quality, queries
from pyspark.sql import functions as F


def junk(i):
    return f"buy{i} " * 60


def good(i):
    return " ".join(f"word{(i * 7 + k * k) % 900}" for k in range(60)) + "."


def test_sites_shift_and_sparse_ones_shrink(spark):
    rows = []
    for i in range(400):
        host = "bad" if i % 2 else "fine"
        rows.append((i, junk(i) if host == "bad" and i % 10 else good(i), host, f"p{i % 3}", 0 if host == "bad" and i % 10 else 1))
    rows += [(900, good(3), "new", None, None), (901, good(5), None, None, None), (902, None, "fine", "p1", 1), (903, "", "bad", "p1", None), (903, "", "bad", "p1", None), (None, good(8), "fine", "p0", 1), (904, "x" * 200_000, "bad", "p2", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, quality int").withColumn("score", F.lit("x"))
    model = quality.fit(df, df.select("doc_id", "quality"))
    out = quality.grade(df, model)
    assert out.columns == ["doc_id", "evidence", "host_share", "path_share", "score", "keep"] and out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].keep and not got[1].keep
    assert got[10].host_share > 0.9 and got[11].host_share < 0.3
    mean = sum(r.evidence for r in got.values()) / len(got)
    assert abs(got[900].host_share - mean) < 0.1  # a site of one document says nothing about it
    assert got[900].score > got[10].score - 0.5 and 0 <= min(r.score for r in got.values())
    empty = df.limit(0)
    assert quality.grade(empty, quality.fit(empty, empty)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op10_quality"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    kept = [(r.keep, truth[r.doc_id]) for r in rows if r.doc_id in truth]
    assert sum(k for k, y in kept if y) >= 0.98 * sum(y for _, y in kept)
    assert sum(not k for k, y in kept if not y) >= 0.7 * sum(1 - y for _, y in kept)


def strength(sites):
    """sites: (n, sum of evidence, prior mean)."""
    total = sum(n for n, _, _ in sites)
    spread = sum(n * (s / n - m) ** 2 for n, s, m in sites)
    between = max((spread - sum(m * (1 - m) for _, _, m in sites)) / total, 1e-12)
    room = sum(n * m * (1 - m) for n, _, m in sites) / total
    return min(max((room - between) / between, quality.STRENGTH[0]), quality.STRENGTH[1])


def test_posteriors_against_brute_force(spark, sf):
    """The grouped part of the query, worked out again document by document from its evidence."""
    place = {r.doc_id: (r.source, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.QUERIES["op10_quality"](spark, sf).collect()}
    hosts, paths = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for i, r in rows.items():
        for held, at in ((hosts, place[i][0]), (paths, place[i])):
            held[at][0] += 1
            held[at][1] += round(r.evidence * quality.SCALE) / quality.SCALE
    mean = sum(s for _, s in hosts.values()) / len(rows)
    above = strength([(n, s, mean) for n, s in hosts.values()])
    share = {h: (s + above * mean) / (n + above) for h, (n, s) in hosts.items()}
    below = strength([(n, s, share[h]) for (h, _), (n, s) in paths.items()])
    odds = lambda x: math.log(max(x, 1e-9) / max(1 - x, 1e-9))
    for i, r in rows.items():
        (hn, hs), (n, s) = hosts[place[i][0]], paths[place[i]]
        q = round(r.evidence * quality.SCALE) / quality.SCALE
        host = (hs - q + above * mean) / (hn - 1 + above)
        path = (s - q + below * host) / (n - 1 + below)
        score = 1 / (1 + math.exp(-(odds(r.evidence) + odds(path) - math.log(mean / (1 - mean)))))
        assert math.isclose(r.host_share, host, rel_tol=1e-6) and math.isclose(r.path_share, path, rel_tol=1e-6) and math.isclose(r.score, score, rel_tol=1e-5, abs_tol=1e-9)
        assert r.keep == (r.score >= quality.KEEP)


def test_labels_that_were_not_learned(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 4 <> 0"))
    truth = {r.doc_id: r.quality for r in labels.where("doc_id % 4 = 0").collect()}
    kept = [(r.keep, truth[r.doc_id]) for r in quality.grade(docs, model).collect() if r.doc_id in truth]
    assert sum(k for k, y in kept if y) >= 0.95 * sum(y for _, y in kept)
    assert sum(not k for k, y in kept if not y) >= 0.6 * sum(1 - y for _, y in kept)
