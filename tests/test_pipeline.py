import json

import pytest
from pyspark.sql import functions as F

from gleanery.plans import pipeline as P
from gleanery.plans.options import Options

WORDS = "The council of the old town met on {0} and spoke for a long time about the bridge near the {1} mill and its {2} gate. "


def html(n, no):
    body = "".join(f"<p>{WORDS.format(f'day {i}', f'{no}th', i * 7)}{WORDS.format(f'night {i}', 'upper', no + i)}</p>" for i in range(n))
    return f"<html><head><title>Story {no} of the town</title></head><body><article class='story'>{body}</article></body></html>"


def tables(spark):
    rows = spark.createDataFrame([(i, f"https://a.example/story-{i}", f"A long title of story number {w}", "") for i, w in enumerate(["one", "two", "three"])], "row_id long, url string, title string, summary string")
    shots = [("https://a.example/story-0", "20200101000000", html(1, 0)), ("https://a.example/story-0", "20210101000000", html(12, 0)), ("https://a.example/story-1", "20200101000000", html(12, 1))]
    index = spark.createDataFrame([(u, t, u, "200", "text/html", f"{u}{t}") for u, t, _ in shots], "url string, timestamp string, original string, statuscode string, mimetype string, digest string")
    pages = spark.createDataFrame([(t, u, h, 200) for u, t, h in shots], "timestamp string, original string, html string, http_status int")
    none = {"live": spark.createDataFrame([], "url string, html string, http_status int, error string"), "reader": spark.createDataFrame([], "url string, body string, http_status int")}
    return rows, index, pages, none


def test_a_source_that_is_not_given_is_an_error(spark):
    rows, index, pages, none = tables(spark)
    for o in (Options(), Options(route="archive-only"), Options(use_archive=False, use_reader=False)):
        with pytest.raises(ValueError):
            P.run(rows, o)
    assert P.run(rows, Options(route="archive-only", use_archive=False)).rows.where("quality_label = 'failed'").count() == 3


def test_pages_only_the_archive_holds(spark):
    rows, index, pages, none = tables(spark)
    for o in (Options(), Options(route="archive-only"), Options(profile="maximum")):
        out = {r.row_id: r for r in P.run(rows, o, index=index, pages=pages, **none).rows.collect()}
        assert out[0].fetched_text and out[0].recovery_route.startswith("archive") and out[1].fetched_text and out[2].quality_label == "failed"
        assert out[0].source_url_used == "https://web.archive.org/web/20210101000000id_/https://a.example/story-0"
    best = json.loads(P.run(rows, Options(), index=index, pages=pages, **none).rows.where("row_id = 0").first().extraction_trace_json)
    assert any(x["selected"] for x in best)


def test_cache_and_model(spark):
    rows, index, pages, none = tables(spark)
    o = Options(enable_ai=True)
    cache = spark.createDataFrame([("https://a.example/story-2", json.dumps({"fetched_text": "kept text " * 20, "quality_label": "full_text"}))], "url string, result string")
    cache = cache.select(P.cache_key(F.col("url"), o).alias("cache_key"), "result", F.lit("2030-01-01").cast("timestamp").alias("expires_at"))
    run = P.run(rows, o, index=index, pages=pages, **none, cache=cache, now=F.lit("2029-01-01").cast("timestamp"), model=lambda pack: json.dumps({"status": "verified", "quality_score": 7}))
    out = {r.row_id: r for r in run.rows.collect()}
    assert out[2].fetched_text.startswith("kept text") and out[2].quality_label == "full_text" and out[0].quality_score == 7 and out[2].ai_verification_status == "VERIFIED"
    counters = run.summary.first()
    assert counters.ai_calls == 3 and counters.ai_calls_saved == 0 and counters.input_rows == 3 and counters.elapsed_ms >= 0 and len(counters) == 11


def test_equal_stories_share_a_call(spark):
    rows, index, pages, none = tables(spark)
    twice = rows.unionByName(rows.withColumn("row_id", F.col("row_id") + 10))
    run = P.run(twice, Options(enable_ai=True), index=index, pages=pages, **none, model=lambda pack: json.dumps({"status": "verified"}))
    c = run.summary.first()
    assert (c.ai_calls, c.ai_calls_saved, c.jobs, c.requests_saved) == (3, 3, 3, 3) and run.rows.where("ai_reused").count() == 3
