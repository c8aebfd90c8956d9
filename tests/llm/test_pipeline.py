import base64

import public_tokenizers
import tiktoken
from test_lines import brute as brute_lines
from test_simhash import brute_kept

import __spark_entry__
import corpus_pipeline
from plumbline.llm import langid


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_dedup", "decontaminate", "encode"]
    now = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = now, stage(spark, docs, sf)
        rows = docs.collect()
        assert len(rows) == len({r.doc_id for r in rows})
        if name != "encode":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            now = {r.doc_id: r.text for r in rows}
            assert all(r.n_chars == len(r.text) for r in rows)
            docs = spark.createDataFrame(rows, docs.schema)
        if name == "language_id":
            assert set(now) == {i for i, t in before.items() if langid.profile(t) is not None}
        elif name == "line_dedup":
            order = sorted(before)
            assert now == dict(zip(order, brute_lines([(i, before[i]) for i in order]), strict=True))
        elif name == "simhash_dedup":
            assert now == {i: before[i] for i in brute_kept(before)} and len(now) < len(before)
        elif name == "decontaminate":
            items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            leaked = {i for i, t in before.items() if any(x in " ".join(t.split()) for x in items)}
            assert leaked <= set(before) - set(now) and len(before) - len(now) <= len(leaked) + 2
        else:
            with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert {r.doc_id: r.ids for r in rows} == {i: truth.encode_ordinary(t) for i, t in now.items()}
            assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_run_and_registration(spark, sf):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}_" for n in range(1, 11)} <= {q[: q.index("_") + 1] for q in __spark_entry__.queries() if q.startswith("op")}
    assert corpus_pipeline.run(spark, sf).count() > 100


def test_stages_take_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_columns_beside_those_of_documents_pass_through(spark, sf):
    names = ["kept", "n_lines", "guess", "leaks", "fp", "g"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    docs = docs.select("*", *[(docs["doc_id"] * 2).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert all(r[n] == 2 * r.doc_id for r in out.collect() for n in names), name


def test_stages_take_nulls_repeats_and_long_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    long = "\n".join(f"line {i} of a long text about word{i % 977} and word{i * 31 % 991}" for i in range(20_000))
    rows = [(None, None, None, None, None), (None, "a null id but a text of its own", "en", None, None), (900, None, "en", "web", None), (901, "", None, "web", 0), (902, long, "en", "web", len(long)), (903, "twice the same row", "en", "web", 18), (903, "twice the same row", "en", "web", 18)]
    docs = docs.union(spark.createDataFrame(rows, docs.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        seen[name] = sorted((r.doc_id for r in docs.collect() if r.doc_id is None or r.doc_id >= 900), key=str)
    assert seen == {"language_id": [902, 903, 903, None], "line_dedup": [902, 903, 903, None], "simhash_dedup": [902, 903, None], "decontaminate": [902, 903, None], "encode": [902, 903, None]}
    assert all(r.round_trip for r in docs.collect())
