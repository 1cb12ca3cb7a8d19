from pyspark.sql import functions as F

from gleanery.llm import ranking as K

A = "row_id long, rubric_version string, ai_verification_status string, quality_score int, summary_alignment_score int, source_reliability_score int"
S = "row_id long, extraction_score double, fetched_text string, rank int"


def ranks(spark, scrapes, results):
    return {r.row_id: r["rank"] for r in K.ranking(spark.createDataFrame(scrapes, S), spark.createDataFrame(results, A)).collect()}


def test_no_score_counts_more_for_its_range(spark):
    """Rows 1 and 2 are best in one score each, by as much in terms of its spread; the scales differ a hundredfold."""
    results = [(i, "r", "VERIFIED", 40 + 10 * (i % 3), 50, 4 + i % 3) for i in range(10, 40)]
    results += [(1, "r", "VERIFIED", 70, 50, 5), (2, "r", "VERIFIED", 50, 50, 7)]
    out = ranks(spark, [(i, 20.0, "t", 0) for i in [1, 2, *range(10, 40)]], results)
    assert {out[1], out[2]} <= {1, 2} | set(range(1, 14)) and abs(out[1] - out[2]) == 1


def test_failed_null_and_repeated(spark):
    results = [(1, "r", "api_error", 0, 0, 0), (2, "r", "OK", None, None, None), (3, "r", "OK", 90, 90, 9), (3, "r", "OK", 90, 90, 9), (4, "r", "OK", 10, 10, 1), (None, "r", "OK", 1, 1, 1)]
    out = ranks(spark, [(5, 3.0, "t", 0), (6, 3.0, None, 0), (5, 3.0, "t", 0), (7, None, "t", 0)], results)
    assert set(out) == {3, 4, 5} and out[3] < out[5] < out[4]
    assert sorted(out.values()) == [1, 2, 3]


def test_ties_and_empty(spark):
    assert ranks(spark, [(i, 1.0, "t", 0) for i in (5, 3, 9)], []) == {3: 1, 5: 2, 9: 3}
    assert ranks(spark, [], []) == {}


def test_partitions_do_not_matter(spark):
    scrapes = [(i, float(i * 37 % 101), "t", 0) for i in range(500)]
    want = [r[0] for r in sorted(scrapes, key=lambda r: (-r[1], r[0]))]
    out = ranks(spark, scrapes, [])
    assert sorted(out, key=out.get) == want


def test_exact_medians_in_rounds(spark):
    import random
    from statistics import median

    r = random.Random(3)
    groups = {"a": [r.gauss(0, 1e6) for _ in range(501)], "b": [r.random() for _ in range(400)], "c": [5.0] * 7, "d": [1.0, 2.0], "e": [r.choice([1e-300, 1.0, 1e300]) for _ in range(99)]}
    df = spark.createDataFrame([(k, "", x) for k, v in groups.items() for x in v], "score string, population string, value double")
    counted = df.groupBy("score", "population", "value").agg(F.count("*").alias("n"))
    for few in (10, 10**6):
        assert {x.score: x.middle for x in K.middles(counted, few).collect()} == {k: median(v) for k, v in groups.items()}
