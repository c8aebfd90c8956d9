import hashlib

from plumbline.llm import linededup, queries
from pyspark.sql import functions as F

SPACE = " \t\n\r\x0b\x0c"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_chars=40, min_docs=5):
    """rows: (doc_id, text); the kept text of each row."""
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key_of(line), set()).add(i)
    common = {k: max(x for x in v if x is not None) for k, v in holders.items() if len(k) >= min_chars and len(v - {None}) >= min_docs}
    return ["\n".join(x for x in (t or "").split("\n") if common.get(key_of(x), i) == i) for i, t in rows]


def test_edge_cases(spark):
    long = "This Line is shared by MANY documents, é and all of them"
    rows = [(i, f"own {i}\n  {long.upper() if i % 2 else long}\t\nend") for i in range(6)]
    rows += [(6, None), (7, ""), (8, "\n\n"), (9, long + "\n" + long), (None, long), (9, long), (10, "x" * 200_000), (3, f"again\n{long}")]
    rows += [(20 + i, "y" * 39) for i in range(6)] + [(30 + i, "ÄÖÜ" * 14) for i in range(4)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, gone string")
    out = linededup.dedup(df)
    assert out.columns == ["doc_id", "text", "gone", "n_lines", "n_dropped", "kept"]
    got = sorted((str(r.doc_id), r.text or "", r.kept, r.n_lines, r.n_dropped) for r in out.collect())
    kept = brute(rows)
    want = sorted((str(i), t or "", k, len((t or "").split("\n")), len((t or "").split("\n")) - (len(k.split("\n")) if k or (t or "") in ("", "\n") else 0)) for (i, t), k in zip(rows, kept, strict=True))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == w[3] for g, w in zip(got, want, strict=True))
    assert linededup.dedup(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: hashlib.sha256(k.encode()).hexdigest() for (i, _), k in zip(rows, brute(rows), strict=True)}
    got = queries.QUERIES["op5_line_dedup"](spark, sf).collect()
    assert {r.doc_id: r.kept_sha256 for r in got} == want and len(got) == len(rows)
