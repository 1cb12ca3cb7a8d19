import json
import random
from datetime import datetime, timezone

import pytest

from gleanery.plans import service as S

NOW = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)


@pytest.mark.parametrize(("value", "expected"), [("https://A.example/v1/?k=1#x", "https://a.example/v1"), ("http://a.example/", "http://a.example"), ("ftp://a.example", None), ("no address", None), (None, None), ("https://a.ex\x00ample/v1", "https://a.example/v1"), ("http://[bad", None)])
def test_base_urls(value, expected):
    assert S.safe_base_url(value) == expected


@pytest.mark.parametrize(("value", "expected"), [("3", 3000.0), ("1.5", 1500.0), ("-4", 0.0), ("Mon, 06 May 2024 07:08:19 GMT", 10000.0), ("Mon, 06 May 2019 07:08:19 GMT", 0.0), ("soon", None), ("", None), (None, None)])
def test_retry_after(value, expected):
    assert S.retry_after(value, NOW) == expected


def test_run_ids():
    one = S.run_id(NOW, random.Random(1))
    assert one.startswith("run_20240506070809_") and len(one) == 24 and one == S.run_id(NOW, random.Random(1)) != S.run_id(NOW, random.Random(2))


def fetch_all(answers, retries=3):
    waits, left = [], list(answers)

    def one():
        a = left.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    class Still(random.Random):
        def random(self):
            return 0.5

    return S.fetched(one, retries, waits.append, lambda: NOW, Still()), waits, len(left)


def test_retries():
    A = S.Answer
    assert fetch_all([A(200, "x")]) == (S.Outcome(True, 200, "x", ""), [], 0)
    assert fetch_all([A(403, "wall"), A(200)])[0] == S.Outcome(False, 403, "wall", "the server refuses access")
    assert fetch_all([A(429, "", "7"), A(429), A(200, "x")]) == (S.Outcome(True, 200, "x", ""), [7.0, 2.75], 0)
    assert fetch_all([A(503), A(503), A(503, "last")]) == (S.Outcome(False, 503, "last", "HTTP 503"), [1.6, 2.6], 0)
    assert fetch_all([OSError("broken")] * 3) == (S.Outcome(False, 0, "", "broken"), [1.5, 2.5], 0)
    assert fetch_all([A(404, "gone")])[0].error == "HTTP 404" and fetch_all([A(429)] * 3)[0].status == 429
    assert S.wait_for("rate", 20, 0) == 45 and S.wait_for("server", 20, 0) == 30 and S.wait_for("network", 20, 0) == 25


def test_requests_prompts_and_checks():
    assert "temperature" not in S.request("o3-mini", "a", "b") and len(S.request("o1", "a", "b")["messages"]) == 1 and S.request("x", "a", "b")["temperature"] == 0
    assert S.connection(lambda p: " ready ") == {"ok": True, "message": "the model answers: ready"} and not S.connection(None)["ok"]
    made = {(k, s): S.prompt("find floods", k, strictness=s, include="dates", avoid="guesses")["prompt"] for k in S.PROMPTS for s in S.STRICTNESS}
    assert len(set(made.values())) == 15 and all("find floods" in p and "dates" in p and "guesses" in p for p in made.values())
    assert "column summary" in S.prompt("find floods", summary_column="summary")["prompt"]

    def broken(p):
        raise RuntimeError("down")

    assert S.prompt("find floods", model=broken)["note"] == "the model failed: down" and S.prompt("find floods", model=lambda p: "better")["source"] == "model"
    with pytest.raises(ValueError):
        S.prompt(" x ")
    assert [c["ok"] for c in S.readiness(3, "url", None, 0, True, False)] == [True, True, False, False]
    assert S.response(" ") == {} and S.response('{"a": 1}') == {"a": 1} and len(S.response("x" * 3000)["error"]) == 2000
    assert S.message({"error": "", "message": "m"}, "f") == "m" and S.message({}, "f") == "f"


def test_chunks(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 5) * 30) for i in range(120)], "row_id long, text string")
    for most, size in ((25, 10**6), (1000, 700)):
        out = S.chunked(rows, "row_id", most, size).collect()
        groups: dict = {}
        for r in sorted(out):
            groups.setdefault(r.chunk_id, []).append({"row_id": r.row_id, "text": r.text})
        assert len(out) == 120 and all(len(g) <= most and sum(len(json.dumps(x)) + 1 for x in g) <= size for g in groups.values())
        ids = [[x["row_id"] for x in g] for g in groups.values()]
        assert all(g == list(range(g[0], g[0] + len(g))) for g in ids)
    with pytest.raises(Exception, match="a chunk holds"):
        S.chunked(rows, "row_id", 25, 50).collect()
    assert S.chunked(rows.limit(0), "row_id").count() == 0
