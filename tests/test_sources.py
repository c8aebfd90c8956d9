import pytest
from pyspark.sql import functions as F

from plumbline.operators import typing
from plumbline.sources import readers, sinks


def test_formats_read_as_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "a,b", None), (2, 3.0, "", "x")], "i long, w double, s string, n string")
    df.coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    df.coalesce(1).write.json(str(tmp_path / "t.jsonl"))
    df.coalesce(1).write.csv(str(tmp_path / "t.csv"), header=True)
    want = [("1", "2", "a,b", ""), ("2", "3", "", "x")]
    for kind in ("parquet", "csv"):
        got, note = readers.read_table(spark, str(tmp_path / f"t.{kind}"))
        assert all(k == "string" for _, k in got.dtypes) and note
        rows = sorted(tuple(r[c] for c in ("i", "w", "s", "n")) for r in got.collect())
        assert rows == want if kind == "parquet" else [r[0] for r in rows] == ["1", "2"]
    assert readers.read_table(spark, str(tmp_path / "t.jsonl"))[0].count() == 2
    (tmp_path / "list.json").write_text('[\n {"i": 1, "s": "x"},\n {"i": 2}\n]')
    (tmp_path / "lines.json").write_text('{"i": 1, "s": "x"}\n{"i": 2}\n')
    for name in ("list", "lines"):
        assert sorted((r.i, r.s) for r in readers.read_table(spark, str(tmp_path / f"{name}.json"))[0].collect()) == [("1", "x"), ("2", "")]
    with pytest.raises(readers.IntakeError):
        readers.read_table(spark, "x.docx")


def test_a_run_is_whole_or_refused(spark, tmp_path):
    folder = str(tmp_path / "run")
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    sinks.write_run({"a": df, "b": df.limit(3)}, folder)
    assert {k: v.count() for k, v in sinks.load_run(spark, folder).items()} == {"a": 50, "b": 3}
    df.limit(1).write.mode("append").parquet(f"{folder}/a")
    with pytest.raises(ValueError, match="not what was written"):
        sinks.load_run(spark, folder)
    with pytest.raises(ValueError, match="secret"):
        sinks.publish({"secret": df}, {"a"}, str(tmp_path / "out"))
    for trial in (1, 2):
        sinks.append_trial(df, str(tmp_path / "trials"), trial)
    assert spark.read.parquet(str(tmp_path / "trials")).count() == 100


def test_typed(spark):
    rows = [(str(i), f"{i}.5" if i % 3 else "", f"2024-01-{i % 28 + 1:02d}", "ab"[i % 2]) for i in range(60)]
    table, roles = typing.typed(spark.createDataFrame(rows, "k string, x string, d string, c string"), "k")
    assert (roles["x"], roles["d"], roles["c"]) == ("numeric", "date", "category") and dict(table.dtypes)["d"] == "double"
    assert table.where("x is null").count() == 20
