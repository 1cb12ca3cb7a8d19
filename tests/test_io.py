import gzip
import json

import pytest
from pyspark.sql import functions as F

from gleanery.operators import rank
from gleanery.sources import io
from gleanery.streaming import chunks


@pytest.mark.parametrize(("columns", "kind", "expected"), [
    (["id", "source"], "url", "source"), (["id", "href"], "url", "href"), (["a", "b"], "url", "a"), ([], "url", None), (["My Link", "URL "], "url", "URL "), (["x", "article name"], "title", "article name"),
    (["x", "the hed"], "title", "the hed"), (["shed"], "title", None), (["x", "the_dek"], "summary", "the_dek"), (["lead snippet"], "summary", "lead snippet"), (["x"], "summary", None), (["headline", "title"], "title", "title"),
])
def test_detection(columns, kind, expected):
    assert io.detect(columns, kind) == expected


def test_payload():
    body = json.dumps({"rows": [{"a": 1}]}).encode()
    assert io.payload(body) == io.payload(gzip.compress(body), encoding="gzip") == {"rows": [{"a": 1}]}
    for bad in ((b"", "application/json"), (b"{", "application/json"), (b"[]", "application/json"), (b"{}", "application/json"), (body, "text/plain")):
        with pytest.raises(ValueError):
            io.payload(*bad)
    with pytest.raises(ValueError):
        io.payload(body, encoding="br")
    for rows in (["a"], "text", [{"a": {"b": 1}}]):
        with pytest.raises(ValueError):
            io.payload(json.dumps({"rows": rows}).encode())


def test_preconditions(spark):
    rows = spark.createDataFrame([("u",)], "url string")
    assert io.require(rows, "url") is rows
    for bad, name in ((rows, "link"), (rows.limit(0), "url")):
        with pytest.raises(ValueError):
            io.require(bad, name)


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", ["x"]), (2, None, None)], "row_id long, text string, tags array<string>")
    io.write_jsonl(rows, str(tmp_path / "j.jsonl"))
    back = spark.read.json(str(tmp_path / "j.jsonl"))
    assert back.count() == 2 and back.columns == ["row_id", "tags", "text"]
    (tmp_path / "rows.json").write_text('[{"a": 1}, {"b": "x"}]')
    assert sorted(io.read_rows_json(spark, str(tmp_path / "rows.json")).columns) == ["a", "b"]
    with gzip.open(tmp_path / "rows.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": 2, "c": 3}\n')
    assert io.read_rows_json(spark, str(tmp_path / "rows.jsonl.gz")).where("c = 3").count() == 1
    for _ in range(2):
        io.append(spark, str(tmp_path / "side"), rows.select("row_id"))
    assert spark.read.parquet(str(tmp_path / "side")).count() == 4
    io.audit_package(str(tmp_path / "audit.json"), {"rows": 1}, [{"name": "v"}], [], [1])
    assert json.loads((tmp_path / "audit.json").read_text()) == {"result": {"rows": 1}, "savedViews": [{"name": "v"}], "reviewLabels": [], "runHistory": [1]}


def test_union_of_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(2, 3)], "k int, b int")
    out = io.union_rows([a, b])
    assert out.columns == ["k", "a", "b"] and sorted(map(tuple, out.collect())) == [(1, "x", None), (2, None, 3)]


def test_compaction(spark):
    rows = spark.createDataFrame([(i, "word " * 2000) for i in range(4)], "row_id long, fetched_text string")
    assert io.compacted(rows) is rows
    small = io.compacted(rows, 20_000)
    assert small.where("_compacted").count() == 0 and io.compacted(rows.withColumn("fetched_text", F.repeat("fetched_text", 20)), 100_000).where("_compacted and length(fetched_text) <= 24000").count() == 4


def test_history_and_views(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "name string, at int, filters string")
    assert [(r.name, r.filters) for r in io.newest(t, "name", "at", 24).collect()] == [("a", "y"), ("b", "z")] and io.newest(t, "name", "at", 1).count() == 1


def test_snapshots(spark):
    c = spark.createDataFrame([("j", p, s, float(v), "t") for p, s, v in ((1, 0, 50), (1, 1, 60), (2, 0, 90), (3, 0, 99))] + [("j", 1, 2 + i, 1.0, "t") for i in range(6)], "job_key string, place int, seq int, score double, text string")
    out = rank.snapshot_stop(c)
    assert sorted((r.place, r.seq) for r in out.collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
    assert rank.snapshot_stop(c, enough=float("inf")).where("place = 3").count() == 1


def test_early_stop(spark):
    c = spark.createDataFrame([("a", 0, 0, 10.0, "t", "partial_text"), ("a", 1, 0, 20.0, "t", "partial_text"), ("a", 1, 1, 70.0, "tt", "full_text"), ("a", 2, 0, 99.0, "t", "full_text"), ("b", 2, 0, 5.0, "t", "failed")], "job_key string, route_no int, seq int, score double, text string, text_label string")
    assert sorted((r.job_key, r.route_no, r.seq) for r in rank.until_full(c).collect()) == [("a", 0, 0), ("a", 1, 0), ("a", 1, 1), ("b", 2, 0)]
    assert rank.until_full(c, everything=True).count() == 5


def test_follow(spark, tmp_path):
    rows = spark.range(5).withColumnRenamed("id", "row_id")
    rows.write.parquet(str(tmp_path / "in"))
    chunks.follow(spark, str(tmp_path / "in"), "row_id long", lambda d: d.where("row_id > 2"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
