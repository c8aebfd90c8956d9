import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from plumbline.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def truth():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_finds_every_key(vocab):
    assert sorted(vocab.find.slots) == list(range(len(vocab.tokens)))
    assert all(vocab.rank(t) == i for i, t in enumerate(vocab.tokens))
    assert vocab.rank(b"no such token at all") == -1


def test_same_ids_as_the_public_library(vocab, truth):
    rng = random.Random(3)
    letters = "abcde  \n\t'stx09éßñ中文😀​\x1c -_.!\"" + "aaaa"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2_000)]
    texts += ["", " ", "a" * 5_000, "<|endoftext|>", "x\x00y", "é" * 3_000]
    for t in texts:
        assert list(memoryview(vocab.encode(t)).cast("i")) == truth.encode_ordinary(t), t[:80]


def test_columns_round_trip_with_nulls_repeats_and_clashing_names(spark, vocab, truth):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, None, "y"), (2, "", None), (3, "ab" * 60_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = bpe.decode(bpe.encode(df, vocab), vocab)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    assert len(got) == 5
    for r in got:
        assert r.ids == truth.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(nulls, vocab).collect()] == [b"", b""]
    assert bpe.decode(bpe.encode(df.limit(0), vocab), vocab).count() == 0


def test_query_covers_every_document(spark, sf, truth):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_byte_bpe"](spark, sf).collect()
    want = {}
    for k, t in texts.items():
        ids = truth.encode_ordinary(t or "")
        want[k] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want
