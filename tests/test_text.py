import pytest
from pyspark.sql import functions as F

from gleanery.functions import pytext
from gleanery.functions import text as X
from gleanery.functions.urls import canonical, host, url_points


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def paragraph(i):
    return f"Paragraph {i} " + " ".join(f"alpha{i}x{k}" for k in range(48)) + ". Second sentence here."


MANY = "\n\n".join(map(paragraph, range(24)))


@pytest.mark.parametrize(
    ("title", "key"),
    [
        ("Storm hits coast | Daily News", "storm hits coast"), ("Storm Hits Coast - Live Updates: day 2", "storm hits coast"), ("BREAKING: Storm hits coast", "storm hits coast"), ("Updated - Storm hits coast", "storm hits coast"),
        ("Heartbreaking news today", "heartbreaking news today"), ("Storm — opinionated take", "storm opinionated take"), ("a | b", "a"), ("x | y | Outlet Name", "x y"), ("ﬁre season ｜ Outlet", "fire season"),
        ("Élection à Paris", "lection paris"), ("日本の選挙", ""), ("NaN", ""), (None, ""), ("", ""),
    ],
)
def test_duplicate_key(spark, title, key):
    assert one(spark, X.duplicate_key, title) == key


@pytest.mark.parametrize(
    ("url", "points"),
    [
        ("https://example.com/a", 56.833333333333), ("http://example.com/a", 44.888888888889), ("https://example.com/a?utm_source=x", 32.111111111111), ("https://example.com/amp/a", 52.611111111111),
        ("https://netflix.com/a", 16.833333333333), ("https://bootcamp.com/", 52.833333333333), ("", 28.0), (None, 28.0), ("https://example.com/" + "a" * 320, 40.0),
    ],
)
def test_url_points(spark, url, points):
    assert one(spark, url_points, url) == pytest.approx(points, abs=1e-9)


@pytest.mark.parametrize(
    ("text", "status", "expected"),
    [
        ("\n\n".join(map(paragraph, range(10))), "200", (5058, 530, 10, 20, 82.3, "full_text")), (MANY, "200", (12828, 1272, 24, 48, 100.0, "full_text")), (MANY + " privacy policy", "200", (12843, 1274, 24, 48, 92.0, "full_text")),
        ("\n\n".join([paragraph(1)] * 4), "200", (2022, 212, 4, 8, 19.9, "low_confidence")), ("Hello world.", "200", (12, 2, 0, 1, 0.0, "partial_text")), ("Already a subscriber? Log in.", "200", (29, 5, 0, 2, 0.0, "auth_required")),
        ("Access denied", "200", (13, 2, 0, 0, 0.0, "bot_blocked")), ("  \n", "200", (0, 0, 0, 0, 0.0, "failed")), (None, None, (0, 0, 0, 0, 0.0, "failed")), ("x", "429", (1, 1, 0, 0, 0.0, "rate_limited")), ("x", "401", (1, 1, 0, 0, 0.0, "auth_required")),
    ],
)
def test_quality(spark, text, status, expected):
    row = X.judged(spark.createDataFrame([(text, status)], "t string, s string"), "t", F.col("s")).first()
    assert (row.chars, row.words, row.paragraphs, row.sentences, row.text_score, row.text_label) == expected
    assert pytext.score(text or "") == pytest.approx(row.text_score)


def test_clean(spark):
    assert one(spark, X.clean, "a😀b  c\xa0d\n\n\n\ne") == "ab c d\n\ne"
    assert pytext.clean("a😀b  c\xa0d\n\n\n\ne") == "ab c d\n\ne"
    assert one(spark, X.clean, None) == ""


def test_ascii_words(spark):
    row = X.judged(spark.createDataFrame([("café xé l'été its",)], "t string"), "t").first()
    assert row.words == 5


def test_evidence_pack(spark):
    packed = one(spark, X.evidence_pack, "abcdefghi " * 3000)
    assert packed.startswith("[BEGINNING]\n") and packed.count("--- SAMPLE ---") == 2
    assert one(spark, X.evidence_pack, " short ") == "short"


def test_clip_is_within_its_limit(spark):
    out = one(spark, lambda c: X.clip(c, 900), "word " * 1000)
    assert len(out) <= 900 and "5,000" in out


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTP://Example.COM:80/a/../b#x", "http://example.com/b"), ("//example.com/a", "https://example.com/a"), ("example.com/a?q=1", "https://example.com/a?q=1"), ("'https://example.com'", "https://example.com/"),
        ("ftp://example.com/", "https://ftp//example.com/"), ("ftp:example", ""), ("no address", ""), ("", ""), (None, ""), ("https://bücher.example/ä", "https://xn--bcher-kva.example/%C3%A4"),
    ],
)
def test_canonical(url, expected):
    assert canonical(url) == expected


def test_host(spark):
    assert one(spark, host, "https://WWW.Example.com:443/x") == "example.com"
    assert one(spark, host, "broken") == ""
