import pytest

from gleanery.functions import html
from gleanery.operators import enrich, extract
from gleanery.plans import pipeline
from gleanery.plans.options import Options

LONG = " ".join(f"Sentence number {i} tells how the river rose over the old bridge." for i in range(20))


def page(body, head=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


def routes(source, url="https://x.example/"):
    return [c["route"].split(":")[1] for c in extract.candidates(source, url)]


def test_linked_data():
    c = extract.candidates(page("<p>short</p>", f'<script type="application/ld+json">{{"@graph": [{{"@type": "NewsArticle", "headline": "H", "author": [{{"name": "A"}}, "B"], "articleBody": "{LONG}"}}]}}</script>'), "https://x.example/")
    best = c[0]
    assert best["route"] == "live:json_ld" and best["title"] == "H" and best["author"] == "A, B" and best["text"] == LONG


def test_broken_scripts_and_state():
    assert "json_ld" not in routes(page("<p>x</p>", '<script type="application/ld+json">{broken</script>'))
    assert "state_payload" in routes(page("", f'<script>window.__INITIAL_STATE__ = {{"a": [{{"body": "{LONG}"}}]}};</script>'))


def test_adapter_by_host_suffix():
    source = page(f"<h1>T</h1><article><p>{LONG}</p></article>")
    assert any(r == "domain_adapter" for r in routes(source, "https://www.apnews.com/x")) and "domain_adapter" not in routes(source, "https://x.example/apnews.com")


def test_furniture_is_pruned():
    c = extract.candidates(page(f"<nav>{'menu ' * 50}</nav><article class='story'><h2>One two three four five six seven</h2><p>{LONG}</p><ul><li>one two three four five six</ul></article><footer>f</footer>"), "https://x.example/")
    dom = next(x for x in c if x["route"] == "live:dom")
    assert "menu" not in dom["text"] and dom["text"].startswith("## One") and "- one two" in dom["text"] and dom["boilerplate_ratio"] > 0.1


@pytest.mark.parametrize("source", ["", "<", "<p>unclosed <b>bold", "plain words", "<![broken", "<table><tr><td>a<td>b"])
def test_any_page_gives_a_candidate(source):
    assert extract.candidates(source, "") and html.render(source) is not None


def test_rendering():
    out = html.render("<h1>T</h1><p>a<p>b<ul><li>x<li>y</ul><div hidden>no</div><span style='display: none'>no</span><table><tr><td>k<td>value<tr><td>long key<td>v</table>")
    assert out == "T\n\na\n\nb\n\n- x\n- y\n\nk         value\nlong key  v"


def test_answers():
    r = enrich.normalised(enrich.answer_object('words ```json {"status": "verified", "quality_score": "", "completeness_score": 99.5, "key_entities": "a, b|c", "evidence": [{"point": "p"}, {}, null]} ```'))
    assert r["ai_verification_status"] == "VERIFIED" and r["quality_score"] == 0 and r["extraction_completeness_score"] == 100 and r["key_entities"] == ["a", "b", "c"] and r["evidence_count"] == 1
    assert enrich.normalised({})["quality_score"] == 50 and enrich.normalised({"is_national_outlet": "false"})["national_outlet_confidence"] == 75
    assert [enrich.clamp(v, 7) for v in ("x", None, True, "0x10", 1e9, 49.5)] == [7, 0, 1, 16, 100, 50]


def test_model_errors_are_rows(spark):
    jobs = spark.createDataFrame([("a", "t" * 60), ("b", None), ("c", "u" * 60)], "ai_key string, pack string")

    def model(pack):
        if pack.startswith("u"):
            raise RuntimeError("down")
        return '{"status": "ok"}'

    out = {r.ai_key: r.ai_verification_status for r in enrich.analysed(jobs, model).collect()}
    assert out == {"a": "OK", "b": "REJECTED_EMPTY_TEXT", "c": "API_ERROR"}
    assert {r.ai_verification_status for r in enrich.analysed(jobs, None).collect()} == {"AI_DISABLED"}


def test_run(spark):
    rows = spark.createDataFrame([(0, "https://a.example/1", "Storm hits coast", "s"), (1, "https://a.example/1?x=1", "Storm hits coast", "s"), (2, "not a url", "Another story here", "s"), (3, "https://r.example/no", "A third story here", "s")], "row_id long, url string, title string, summary string")
    live = spark.createDataFrame([("https://a.example/1", page(f"<article><p>{LONG}</p></article>"), 200, "")], "url string, html string, http_status int, error string")
    robots = spark.createDataFrame([("r.example", "User-agent: *\nDisallow: /", 200)], "host string, robots_txt string, http_status int")
    run = pipeline.run(rows, Options(route="live-only"), live=live, robots=robots)
    out = {r.row_id: r for r in run.rows.collect()}
    assert len(out) == 4 and out[0].fetched_text == out[1].fetched_text != "" and out[1].scraped_once_for_group
    assert out[2].quality_label == "url_only" and out[3].quality_label == "robots_disallowed"
    assert run.summary.first().input_rows == 4 and sum(r.n_rows for r in run.health.collect()) == 4


def test_options():
    with pytest.raises(ValueError):
        Options(min_chars=1)
    assert Options(profile="fast").tuned().routes() == ["live", "reader"] and Options(route="archive-only", use_archive=False).routes() == []
