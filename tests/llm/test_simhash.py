import random

import numpy as np
import pytest
import xxhash

from plumbline.llm import components, queries, simhash
from pyspark.sql import functions as F


def brute_print(text, words=3):
    parts = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints, distance):
    """prints: id -> fingerprint; id -> smallest id reachable."""
    ids, root = sorted(prints), {}
    for i in ids:
        root.setdefault(i, i)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(prints[a] ^ prints[b]).count("1") <= distance and root[b] > root[a]:
                    root[b] = root[a]
                    changed = True
    return root


def brute_set(text):
    parts = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    return frozenset(b" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))) if parts else frozenset()


def brute_kept(texts):
    """texts: id -> text; ids that are smallest of their group by five-word fingerprints or sets."""
    ids, root = sorted(texts), {i: i for i in texts}
    prints, sets = {i: brute_print(t, 5) for i, t in texts.items()}, {i: brute_set(t) for i, t in texts.items()}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            few, many = sorted((len(sets[a]), len(sets[b])))
            near = few >= 0.8 * many and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            if near or bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i for i in ids if root[i] == i}


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "one", "One TWO", "a b c d e f g", "É é x", "w " * 30_000]
    for t in texts:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == brute_print(t)


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("busy", [2, 64])
def test_links_have_the_components_of_all_pairs(spark, distance, busy):
    rng, found = random.Random(distance), set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(14):
            found.add(p)
            for _ in range(rng.choice([1, 1, 2, 3])):
                p ^= 1 << rng.randrange(64)
    signed = {i: p - (1 << 64) if p >> 63 else p for i, p in enumerate(sorted(found))}
    points = spark.createDataFrame([(p,) for p in signed.values()], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(points, distance, busy)).collect()}
    got = {i: roots.get(p, p) for i, p in signed.items()}
    want = brute_groups({i: p & (1 << 64) - 1 for i, p in signed.items()}, distance)
    assert len({(got[i], want[i]) for i in signed}) == len(set(want.values())) == len(set(got.values()))


def test_components_of_paths_and_none(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_members_and_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, 1), (3, base.upper(), 2), (9, base + "  ", 3), (7, "quite another text", 4), (7, "quite another text", 4), (8, None, 5), (2, "", 6), (None, base, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = sorted(((r.doc_id is None, r.doc_id, r.component_id) for r in simhash.members(df).collect()), key=str)
    assert sorted(out, key=str) == sorted([(False, 5, 3), (False, 3, 3), (False, 9, 3), (False, 7, 7), (False, 7, 7), (False, 8, 2), (False, 2, 2), (True, None, 3)], key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 7]
    assert simhash.members(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {k: brute_print(t) for k, t in texts.items()}
    want = brute_groups(prints, 2)
    got = queries.QUERIES["op3_simhash"](spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(k, f"{p:016x}", want[k]) for k, p in prints.items()} and len(got) == len(texts)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_similar_texts_against_brute_force(spark, monkeypatch):
    rng, texts = random.Random(8), {}
    for i in range(12):
        words = [f"w{rng.randrange(3_000)}" for _ in range(rng.choice([6, 40, 200, 400]))]
        texts[i * 50] = " ".join(words)
        for k in range(1, rng.choice([2, 5, 30])):
            texts[i * 50 + k] = edited(rng, words, rng.randrange(1 + len(words) // 40))
    texts |= {900: "", 901: " ", 902: None, 903: "a b", 904: "A  b", 905: "na " * 40, 906: "na " * 80}
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, node int, kept int")
    want = brute_kept(texts)
    for few, heads, many in ((16, 64, 1_000), (2, 3, 4)):  # nearly all pairs, and rounds of few heads, dealt to parts
        monkeypatch.setattr(simhash, "FEW", few)
        monkeypatch.setattr(simhash, "HEADS", heads)
        monkeypatch.setattr(simhash, "MOST_HEADS", 8 * heads)
        monkeypatch.setattr(simhash, "MANY", many)
        kept = simhash.keep_similar(df)
        assert kept.columns == df.columns
        assert {r.doc_id for r in kept.collect()} == want
    assert simhash.keep_similar(df.limit(0)).count() == 0


def test_similar_texts_of_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(None, base), (None, base.upper()), (None, base.replace("w150 ", "other ")), (4, "quite another text"), (4, "quite another text"), (None, "quite another  text")]
    got = simhash.keep_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) <= 3 and [r.text for r in got if r.doc_id] == ["quite another text"] and sum(r.doc_id is None for r in got) >= 1


def test_groups_of_a_large_band_value_are_compared(spark, monkeypatch):
    """Links between groups, in blocks of a few sets, against all pairs of them."""
    monkeypatch.setattr(simhash, "FEW", 2)
    monkeypatch.setattr(simhash, "BLOCK", 3)
    rng, sets = random.Random(3), {}
    for family in range(8):
        base = rng.sample(range(100_000), rng.choice([5, 30, 90]))
        for k in range(6):
            own = set(base)
            for x in rng.sample(base, rng.randrange(1 + len(base) // 8)):
                own.discard(x)
                own.add(rng.randrange(100_000))
            sets[f"n{family}-{k}"] = np.sort(np.array(list(own), np.uint32))
    roots = {n: rng.choice(["r1", "r1", "r2", "r3"]) for n in sets}
    spots = [(0, 7, n, len(sets)) for n in sets] + [(1, 7, n, 2) for n in list(sets)[:2]] + [(2, 9, n, 24) for n in list(sets)[:24]]
    shared = spark.createDataFrame(spots, "band int, value long, node string, n long")
    blobs = spark.createDataFrame([(n, bytearray(x.tobytes())) for n, x in sets.items()], "node string, shingles binary")
    rooted = spark.createDataFrame([(n, 1, r) for n, r in roots.items()], "node string, id long, root string")
    found = {frozenset((r.u, r.v)) for r in simhash._between(shared, blobs, rooted, 0.8).collect()}
    similar = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and roots[a] != roots[b] and similar(sets[a], sets[b])}
    assert found == want and want
    assert simhash._between(shared, blobs, rooted.withColumn("root", F.lit("r1")), 0.8) is None


def test_two_that_resemble_heads_of_their_own_meet(spark, monkeypatch):
    """A chain of texts, each similar to the next only, with one head a round: groups are those of all pairs."""
    monkeypatch.setattr(simhash, "FEW", 1)
    monkeypatch.setattr(simhash, "HEADS", 1)
    monkeypatch.setattr(simhash, "MOST_HEADS", 1)
    words, texts = [f"w{i}" for i in range(200)], {}
    for i in range(24):
        for k in range(4):
            words[(i * 37 + k * 50) % 200] = f"new{i}-{k}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_similar(df).collect()} == brute_kept(texts)
