import random

import numpy as np

from plumbline.llm import decontam, queries


def brute(passage, item):
    """Best local alignment score, cell by cell."""
    best, above = 0, [0] * (len(passage) + 1)
    for w in item:
        row = [0]
        for j, v in enumerate(passage, 1):
            row.append(max(0, above[j - 1] + (2 if v == w else -1), above[j] - 1, row[j - 1] - 1))
            best = max(best, row[j])
        above = row
    return best / (2 * max(1, len(item)))


def test_alignment_against_brute_force():
    rng = random.Random(5)
    passages = [np.array([rng.randrange(6) for _ in range(rng.randrange(1, 40))]) for _ in range(300)]
    items = [np.array([rng.randrange(1, 6) for _ in range(rng.randrange(1, 15))]) for _ in range(300)]
    got = decontam.align(passages, items)
    assert np.allclose(got, [brute(p.tolist(), i.tolist()) for p, i in zip(passages, items, strict=True)])


def words(rng, n):
    return [f"w{rng.randrange(5_000)}" for _ in range(n)]


def test_edge_cases(spark, monkeypatch):
    rng = random.Random(2)
    items = [words(rng, 30) for _ in range(40)]
    edited = [w if k % 6 else "other" for k, w in enumerate(items[1])]
    docs = [(0, " ".join(words(rng, 80) + items[0] + words(rng, 80))), (1, " ".join(words(rng, 9) + edited)), (2, " ".join(items[2]).upper() + "!"), (3, None), (4, ""), (5, " ".join(words(rng, 30_000))), (6, "short one"), (7, " ".join(items[0][:6])), (7, " ".join(items[0][:6]))]
    docs += [(100 + i, " ".join(words(rng, 20) + items[3])) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(items)] + [(98, None, 1), (99, "Short, one", 1)], "item_id long, text string, code int")
    for most in (1_000_000, 100):  # one block, and many
        monkeypatch.setattr(decontam, "BLOCK_WORDS", most)
        monkeypatch.setattr(decontam.blocks, "__defaults__", (most,))
        out = decontam.match(df, bench)
        assert out.columns == ["doc_id", "text", "leaks"] and out.count() == len(docs)
        got = {(r.doc_id, x.item_id): x.score for r in out.collect() for x in r.leaks}
        assert set(got) == {(0, 0), (1, 1), (2, 2), (6, 99)} | {(100 + i, 3) for i in range(60)}
        assert got[0, 0] == 1 and 0.4 < got[1, 1] < 1
    assert decontam.match(df.limit(0), bench).count() == 0
    assert all(r.leaks == [] for r in decontam.match(df, bench.limit(0)).collect())


def test_query_finds_every_whole_item(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op8_decontamination"](spark, sf).collect()}
    assert want and want <= got
    # false hits: every other pair really is an edited copy, by an alignment of the whole text cell by cell
    plain = {d: decontam.words_of(t) for d, t in docs.items()}
    for d, i in got - want:
        assert brute(plain[d], decontam.words_of(items[i])) >= decontam.MIN_SCORE
    # and no pair that shares a seed and scores so is missing: all pairs, held against the whole texts of a part
    some = [d for d in docs if d % 9 == 0 and len(plain[d]) < 400]
    for d in some:
        runs = {tuple(plain[d][k : k + 4]) for k in range(len(plain[d]))}
        for i, t in items.items():
            own = decontam.words_of(t)
            if (d, i) not in got and any(tuple(own[k : k + 4]) in runs for k in range(len(own) - 3)):
                assert brute(plain[d], own) < decontam.MIN_SCORE


def test_edited_passage_in_many_copies(spark):
    rng = random.Random(3)
    items = [words(rng, 40) for _ in range(3)]
    edited = [[w if k % 9 else f"other{k}" for k, w in enumerate(x)] for x in items]
    docs = [(i, " ".join(words(rng, 30) + edited[0] + words(rng, 30))) for i in range(60)]
    docs += [(100 + i, " ".join(edited[1])) for i in range(60)] + [(200, " ".join(items[1]))]
    docs += [(300 + i, " ".join(words(rng, 30) + items[2][:6] + words(rng, 30))) for i in range(60)]  # a stock phrase is no leak
    # where a rare seed stands alone, and the copy elsewhere
    docs += [(400, " ".join(items[0][-4:] + words(rng, 200) + edited[0]))]
    got = {(r.doc_id, x.item_id): x for r in decontam.match(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect() for x in r.leaks}
    assert set(got) == {(i, 0) for i in range(60)} | {(100 + i, 1) for i in range(60)} | {(200, 1), (400, 0)}
    assert all(0.7 < got[k].score < 0.9 for k in got if k[0] != 200) and got[200, 1].score == 1
    assert got[400, 0].first_word >= 200


def test_bound_is_never_below_the_score():
    rng = random.Random(6)
    for _ in range(300):
        passage, item = (np.array([rng.randrange(12) for _ in range(rng.randrange(1, most))]) for most in (40, 15))
        assert decontam.reachable(passage, item) >= brute(passage.tolist(), item.tolist())


def test_alignment_does_not_depend_on_how_many_go_together(monkeypatch):
    rng = random.Random(7)
    passages = [np.array([rng.randrange(6) for _ in range(rng.randrange(1, 90))]) for _ in range(60)]
    items = [np.array([rng.randrange(1, 6) for _ in range(rng.randrange(1, 15))]) for _ in range(60)]
    want = decontam.align(passages, items)
    monkeypatch.setattr(decontam, "ROW_CELLS", 100)
    assert np.array_equal(decontam.align(passages, items), want)
