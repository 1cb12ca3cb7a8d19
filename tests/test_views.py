import pytest
from pyspark.sql import functions as F

from gleanery.operators import health, views as V


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, "https://a.example/x", "", "Alpha", None, "VERIFIED", "full_text", 90, 80, True, "usa", "s", None, None, 3),
        (2, "", "https://b.example/y", "", "zeta", "NEEDS_MANUAL_REVIEW", "partial_text", 40, 20, False, "Norland", None, "r", "[1, {\"a\": 2}]", None),
        (3, None, None, None, "", None, None, None, None, None, None, None, None, "no json", 1),
        (4, "https://a.example/z", "", "éclair", "FAILED_SUMMARY_ALIGNMENT", "FAILED_SUMMARY_ALIGNMENT", "bot_blocked", 60, 10, "yes", "U.S.", "t", None, "[]", 2),
    ]
    data = [(*r[:9], None if r[9] is None else str(r[9]).lower(), *r[10:]) for r in data]
    return spark.createDataFrame(data, "row_id int, source_url_used string, canonical_url string, extracted_headline string, headline string, ai_verification_status string, quality_label string, quality_score int, summary_alignment_score int, is_national_outlet string, outlet_country string, executive_summary string, reasoning string, extraction_trace_json string, dedupe_group_size int")


def ids(df):
    return [r.row_id for r in df.collect()]


def test_search_looks_in_addresses_and_statuses(rows):
    assert ids(V.search(rows, "A.EXAMPLE/z")) == [4] and ids(V.search(rows, " ")) == [1, 2, 3, 4] and ids(V.search(rows, "manual_review")) == [2]
    assert ids(V.search(rows.withColumn("status", F.lit("Queued")), "queued")) == [1, 2, 3, 4] and ids(V.search(rows, "b.example/y  norland")) == [2] and ids(V.search(rows, "b.example/y norland")) == []


def test_presets(rows):
    find = lambda n: ids(V.PRESETS[n].apply(rows))
    assert find("high-quality") == [1] and find("us-national") == [1, 4] and find("manual-review") == [2] and find("bot-blocked") == [4] and find("low-alignment") == [4] and find("all") == [1, 2, 3, 4]
    assert V.PRESETS["low-alignment"].sort == "alignment"


def test_filters(rows):
    assert ids(V.Filter(status="not analyzed").apply(rows)) == [3] and ids(V.Filter(duplicates_only=True).apply(rows)) == [1, 4]
    assert ids(V.Filter(country="norland").apply(rows)) == [2] and ids(V.Filter(national="no").apply(rows)) == [2, 3]
    assert ids(V.Filter(status="x").apply(rows.withColumn("status", F.when(F.col("row_id") == 1, "x")))) == [1]


def test_sorts(rows):
    order = lambda m: ids(V.ordered(rows.withColumn("extraction_score", F.lit(1.0)).withColumn("word_count", F.col("row_id")), m))
    assert order("quality") == [1, 4, 2, 3] and order("words") == [4, 3, 2, 1] and order("extraction") == [1, 2, 3, 4] and order("country") == [2, 1, 4, 3]
    assert order("headline") == [1, 4, 3, 2]  # Alpha, FAILED..., Untitled article, zeta


def test_options(rows):
    assert [r.option for r in V.options(rows, V.status_of(rows)).collect()] == ["Any", "FAILED_SUMMARY_ALIGNMENT", "NEEDS_MANUAL_REVIEW", "not analyzed", "VERIFIED"]
    assert [r.option for r in V.options(rows, F.coalesce("quality_label", F.lit("unknown"))).collect()] == ["Any", "bot_blocked", "full_text", "partial_text", "unknown"]


def test_reviews_by_row_key(spark, rows):
    keys = {r.row_id: r.k for r in rows.select("row_id", V.row_key(rows).alias("k")).collect()}
    assert keys[1] == "https://a.example/x::Alpha::::0" and keys[2] == "https://b.example/y::zeta::::0" and keys[3] == "::::::0"
    labels = spark.createDataFrame([(1, keys[1], "Approved", "2024-01-02"), (2, keys[1], "rejected", "2024-01-01"), (3, keys[2], " ", "2024-01-01"), (4, keys[4], "needs-better-scrape", None)], "review_id int, row_key string, review_status string, reviewed_at string")
    found = V.with_review(rows, labels.withColumn("reviewed_at", F.to_timestamp("reviewed_at")))
    assert {r.row_id: r.review_status for r in found.collect()} == {1: "approved", 2: "unreviewed", 3: "unreviewed", 4: "needs-better-scrape"}
    s = health.filtered_statistics(found, V.truth(F.col("is_national_outlet"))).first()
    assert (s.n, s.approved, s.needs_review, s.national, s.us_national) == (4, 1, 3, 2, 2)


def test_detail(rows):
    one = V.detail(rows, 1, "row_id").first()
    assert one.row_id == 2 and one.detail_headline == "zeta" and one.detail_reasoning == "r" and one.detail_attempts == ["1", '{"a":2}'] and one.detail_evidence == []
    assert V.detail(rows, 99, "row_id").first().row_id == 4 and V.detail(rows, -5, "row_id").first().detail_headline == "Alpha"
    assert V.detail(rows, 2, "row_id").first().detail_attempts == [] and V.detail(rows.limit(0), 0, "row_id").count() == 0


def test_visible_and_panels(spark, rows):
    assert V.visible(rows).columns[0] == "quality_label" and "executive_summary" in V.visible(rows).columns and "reasoning" not in V.visible(rows).columns
    assert V.history_panel(spark.createDataFrame([("r", 1250)], "run_id string, elapsed_ms long")).first().elapsed_s == 1.3
