import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import queries, substrings


def brute(rows, n=20):
    """rows: (doc_id, text) with distinct ids; id -> (words, removed, kept)."""
    words = {i: (t or "").encode().split() for i, t in rows}
    order = sorted(words, key=lambda i: (i is None, i))
    first = {}
    for i in order:
        for p in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][p : p + n]), (i, p))
    out = {}
    for i in order:
        gone = set()
        for p in range(len(words[i]) - n + 1):
            if first[tuple(words[i][p : p + n])] != (i, p):
                gone |= set(range(p, p + n))
        out[i] = (len(words[i]), len(gone), b" ".join(w for k, w in enumerate(words[i]) if k not in gone).decode())
    return out


@pytest.mark.parametrize("window,group_bytes,how", [(20, 1 << 23, {}), (20, 2_000, {}), (6, 500, {}), (20, 2_000, {"range_bytes": 300, "most_partitions": 5})])
def test_against_brute_force(spark, window, group_bytes, how):
    rng = random.Random(window)
    word = lambda: f"w{rng.randrange(400)}"
    passages = [" ".join(word() for _ in range(rng.randrange(window - 2, window * 3))) for _ in range(6)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(5)):
            text.append(" ".join(word() for _ in range(rng.randrange(40))))
            text.append(rng.choice(passages))
        rows.append((i * 3 - 20, rng.choice([" ", "\n", "  \t"]).join(text)))
    rows += [(1_000, "na " * 300), (1_001, "na " * 25), (1_002, None), (1_003, ""), (1_004, "x" * 700_000 + " end"), (None, passages[0] + " tail")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, g int")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup(df, window=window, group_bytes=group_bytes, **how).collect()}
    assert got == brute(rows, window)


def test_repeated_rows_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, None), (None, text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substrings.dedup(df).collect())
    assert got == [("1", 50, 0), ("1", 50, 0), ("2", 50, 50), ("None", 0, 0), ("None", 50, 50)]
    assert substrings.dedup(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in brute(rows).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op7_substrings"](spark, sf).collect()} == want


def test_only_ranges_with_hashes_are_visited():
    assert substrings._cut(np.array([], np.uint64)) == []
    assert substrings._cut(np.array([3, 3, 10**9, 10**12], np.uint64)) == [(3, 0, 2), (10**9, 2, 3), (10**12, 3, 4)]


def test_words_that_collide_in_rolling_hashes_stay(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64, whatever the odd base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2_048))
    other = word.translate(str.maketrans("ab", "ba"))
    same = [f"w{i}" for i in range(19)]
    texts = [" ".join([*same, word]), " ".join([*same, other]), " ".join([*same, word])]
    one = substrings.Group(substrings.pa.table({"key": [1, 2], "text": [t.encode() for t in texts[:2]]}), 20)
    _, h = one.hashes(20)
    assert h[0] == h[1] and (one.digests(np.array([0, 20]))[0] != one.digests(np.array([0, 20]))[1]).any()
    for group_bytes in (1 << 23, 100):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r.doc_id: r.n_removed for r in substrings.dedup(df, group_bytes=group_bytes).collect()} == {0: 0, 1: 0, 2: 20}
