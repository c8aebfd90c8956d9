import re
from itertools import permutations

import duckdb
import pytest
from plumbline.llm import interactions, queries


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    return out + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))


def brute(rows, labels):
    """rows: (doc_id, text, source); labels: {doc_id: (quality, toxic)}; the report as tuples, one order after another."""
    docs = []
    for i, t, source in rows:
        smaller = any(j is not None and (i is None or j < i) and (u or "") == (t or "") for j, u, _ in rows)
        docs.append((source or "", fails(t or "") + "E" * smaller, *labels.get(i, (0, 0))))
    out, every = [], {}
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                now, rest = [d for d in left if x in d[0]], [d for d in left if x not in d[0]]
                failing = sum(x in d[0] for d in own)
                every[part, x] = every.get((part, x), 0) + len(now)
                out.append((part, "".join(order), step, len(rest), len(now), failing - len(now), sum(d[0] == x for d in own), sum(d[1] == 1 for d in now), sum(d[2] == 1 for d in now)))
                left = rest
    return sorted((*r, every[r[0], r[1][r[2] - 1]]) for r in out)


def shown(df):
    return sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect())


def cases():
    long = " ".join(f"w{i}" for i in range(250))
    same = "one TEXT that many share #1"
    rows = [(i, same, f"s{i % 3}") for i in range(40, 0, -1)]
    rows += [(100, None, "s1"), (101, "", "s1"), (102, long, None), (103, long + " $", ""), (104, "AB " * 300, "s2"), (105, "é" * 9_000, "s2"), (7, same, "s0"), (7, same, "s1"), (7, long, "s0"), (None, same, "s0"), (None, "own", None), (None, "own", "s2"), (-1, "", "s2"), (106, "é" * 9_000, "s1")]
    return rows, {7: (1, 1), 30: (1, 0), 102: (0, 1), 101: (1, 1), 999: (1, 1)}


def test_against_brute_force(spark):
    rows, labels = cases()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, part string").repartition(7)
    marks = spark.createDataFrame([(k, *v) for k, v in labels.items()] + [(7, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert shown(interactions.run(df, marks)) == brute(rows, labels)
    assert shown(interactions.audit(interactions.failures(df.coalesce(1), held_bytes=100), marks)) == brute(rows, labels)  # chains are sent off again and again
    assert interactions.run(df.limit(0), marks).count() == 0
    assert shown(interactions.run(df, marks.limit(0))) == brute(rows, {})


def test_later_copies(spark):
    rows, _ = cases()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    want = {}
    for i, t in rows_of(rows):
        if any(j is not None and (i is None or j < i) and u == t for j, u in rows_of(rows)):
            want[i] = want.get(i, 0) + 1
    assert {r.doc_id: r.n for r in interactions.later_copies(df).collect()} == want


def rows_of(rows):
    return [(i, t or "") for i, t, _ in rows]


def test_equal_fingerprints_alone_fail_nobody(spark, monkeypatch):
    chain = interactions._Chain()
    assert chain.add(b"a", 3, {("", 0): 1}) is None and chain.add(b"b", 1, {("", 0): 1}) is None
    assert chain.add(b"a", 5, {("", 1): 1}) == (5, {("", 1): 1}) and chain.add(b"a", 2, {("", 2): 1}) == (3, {("", 0): 1})
    assert chain.add(b"b", None, {("", 0): 2}) == (None, {("", 0): 2}) and chain.add(b"b", 1, {("", 0): 1, ("x", 0): 1}) is None
    assert chain.links == [[b"a", 2, {("", 2): 1}], [b"b", 1, {("", 0): 2, ("x", 0): 1}]]


def test_other_filters(spark):
    df = spark.createDataFrame([(i, "x" * i, "s") for i in range(10)], "doc_id long, text string, source string")
    own = {"short": lambda text, words: len(text) < 4, "odd": lambda text, words: len(text) % 2 == 1}
    got = {r.mask: r.n for r in interactions.failures(df, own).groupBy("mask").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert got == {0: 3, 1: 2, 2: 3, 3: 2}
    with pytest.raises(ValueError):
        interactions.failures(df, {"a": None, "b": None})
    with pytest.raises(ValueError):
        interactions.audit(interactions.failures(df), df, "ABCDEFG")


def test_query(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = con.sql(queries.ORACLES["op12_filter_audit"])
    at = [want.columns.index(c) for c in names]
    got = shown(queries.QUERIES["op12_filter_audit"](spark, sf))
    assert got == sorted(tuple(r[i] for i in at) for r in want.fetchall())
    assert len(got) == 600 * con.sql("SELECT count(DISTINCT coalesce(source, '')) FROM documents").fetchall()[0][0]
