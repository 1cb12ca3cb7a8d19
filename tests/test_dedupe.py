from pyspark.sql import functions as F

from gleanery.operators import dedupe, health, views
from gleanery.sources import io

ROWS = [
    (0, "http://a.example/1", "Storm hits coast", "own"), (1, "https://a.example/1", "Storm hits coast | Outlet", None), (2, "https://b.example/1", "BREAKING: storm hits coast", "x"),
    (3, None, None, None), (4, "", "short", None), (5, "https://b.example/1", "Storm hits coast", ""),
]
MANIFEST = "row_id long, url string, title string, note string"


def test_groups(spark):
    rows = spark.createDataFrame(ROWS, MANIFEST)
    g = {r.dedupe_key: r for r in dedupe.groups(rows).collect()}
    assert g["storm hits coast"].group_size == 4 and g["storm hits coast"].representative_row == 1 and g["storm hits coast"].first_row == 0
    assert len(g) == 3
    assert tuple(dedupe.statistics(rows).first()) == (6, 3, 3, 4)
    assert tuple(dedupe.statistics(rows.limit(0)).first()) == (0, 0, 0, 0)
    assert tuple(dedupe.statistics(rows, None).first()) == (6, 6, 0, 1)


def test_repartitioning_changes_nothing(spark):
    rows = spark.createDataFrame(ROWS, MANIFEST)
    assert set(dedupe.groups(rows).collect()) == set(dedupe.groups(rows.repartition(7)).collect())


def test_expansion_keeps_all_rows(spark):
    rows = spark.createDataFrame(ROWS, MANIFEST).withColumn("fetched_text", F.lit("stale"))
    results = spark.createDataFrame([(1, "text", "full_text"), (3, "none", "failed")], "row_id long, fetched_text string, quality_label string")
    out = {r.row_id: r for r in dedupe.expand(rows, results).collect()}
    assert len(out) == 6
    assert [out[i].fetched_text for i in range(6)] == ["text", "text", "text", "none", None, "text"]
    assert out[0].note == "own" and out[0].scraped_once_for_group and not out[3].scraped_once_for_group


def test_health(spark):
    rows = spark.createDataFrame([("https://www.A.example/x", "full_text", "1.25", "5"), ("https://a.example/y", "url_only", None, "bad"), (None, None, "", None)], "u string, quality_label string, extraction_score string, quality_score string")
    h = {r.domain: r for r in health.domain_health(rows, health.domain_of("u")).collect()}
    assert h["a.example"].n_rows == 2 and h["a.example"].n_failed == 1 and h["a.example"].avg_extraction_score == 0.6 and h["a.example"].avg_quality_score == 2.5
    c = {r.domain: r for r in health.domain_health(rows, health.domain_of("u"), server=False).collect()}
    assert c["a.example"].avg_quality_score == 5.0 and h["unknown"].n_rows == 1


def test_filter_round_trip_and_search(spark):
    f = views.Filter(search="Coast", min_quality=3)
    assert views.Filter.from_json(f.to_json()) == f
    rows = spark.createDataFrame([("a COAST", "4"), ("coast", None), ("sea", "9")], "title string, quality_score string")
    assert [r.title for r in f.apply(rows).collect()] == ["a COAST"]


def test_robots():
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\n\nUser-agent: gleanery\nDisallow: /x*y$\n"
    assert not io.robots_allows(text, "/a/c", "other") and io.robots_allows(text, "/a/b/c", "other")
    assert io.robots_allows(text, "/a/c", "gleanery/1") and not io.robots_allows(text, "/x1y", "gleanery/1") and io.robots_allows(text, "/x1yz", "gleanery/1")
    assert io.robots_allows(None, "/", "any")


def test_detect():
    assert io.detect(["Id", "Link ", "HED"], "url") == "Link " and io.detect(["Id", "HED"], "title") == "HED" and io.detect(["a"], "url") == "a" and io.detect(["a"], "summary") is None


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a,b", 'say "x"', "two\nlines"), ("c", "", "é")], "x string, y string, z string")
    io.write_csv(rows, str(tmp_path / "c"), one_file=True)
    assert sorted(map(tuple, io.read_manifest_csv(spark, str(tmp_path / "c")).fillna("").collect())) == sorted(map(tuple, rows.collect()))


def test_docx_and_newest(spark, tmp_path):
    import zipfile

    rows = spark.createDataFrame([(1, "A & B", "text"), (2, None, None)], "row_id long, extracted_headline string, fetched_text string")
    io.write_docx(rows, str(tmp_path / "b.docx"))
    assert "A &amp; B" in zipfile.ZipFile(tmp_path / "b.docx").read("word/document.xml").decode()
    runs = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "run string, at int")
    assert [tuple(r) for r in io.newest(runs, "run", "at", 1).collect()] == [("a", 3)]
