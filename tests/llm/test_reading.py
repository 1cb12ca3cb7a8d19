import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import reading as R

PLAIN, HARD, GLUE = "cat dog ran red sun box hat cup big old".split(), "jurisdiction methodological statutory procurement depreciation classification infrastructure fiscal".split(), "the of and to in".split()


def text(r, level):
    return ". ".join(" ".join(r.choice(GLUE) if k % 3 == 0 else r.choice(HARD if r.random() < (0.05, 0.45, 0.9)[level - 1] else PLAIN) for k in range(9)) for _ in range(12))


def sample(n, seed):
    r = random.Random(seed)
    levels = [r.choice([1, 2, 3]) for _ in range(n)]
    return [text(r, k) for k in levels], np.array(levels, float)


def test_held_out_accuracy_with_wrong_labels():
    texts, levels = sample(500, 1)
    noisy = levels.copy()
    noisy[::12] = 4 - noisy[::12]
    reader = R.fit(texts, noisy, ["en"] * 500)
    unseen, truth = sample(300, 2)
    x, said, ours = R.measure(unseen, reader.model)
    assert ours.all() and (reader.level(x, said) == truth).mean() > 0.93


def test_isotonic():
    knots, values = R.isotonic(np.array([3.0, 1, 2, 4]), np.array([2.0, 1, 3, 5]))
    assert values.tolist() == [1, 2.5, 5] and knots.tolist() == [1, 3, 4]
    assert (np.diff(R.isotonic(np.arange(50.0), np.random.default_rng(0).random(50))[1]) > 0).all()


def test_frame(spark):
    texts, levels = sample(120, 3)
    d = spark.createDataFrame([(i, t, "en", i) for i, t in enumerate(texts)] + [(900, None, "en", 0), (901, " \n", "en", 0), (902, "これは日本語の文です。" * 9, "en", 0), (903, texts[0], "ja", 0)], "doc_id long, text string, lang string, reading_level int")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(levels)] + [(0, int(levels[0])), (1, None), (2, 9)], "doc_id long, reading_level int")
    out = {r.doc_id: r.reading_level for r in R.levels(d, labels).collect()}
    assert not out.keys() & {900, 901, 902} and out[903] == out[0] and len(out) == 121
    assert np.mean([out[i] == k for i, k in enumerate(levels)]) > 0.9
    assert R.levels(d.limit(0), labels).count() == 0


def test_all_rated_documents_are_learned_from(spark):
    r = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = ["zz" + letters[i // 26] + letters[i % 26] for i in range(60)]
    rows = [(i, " ".join([r.choice(PLAIN + HARD + GLUE) for _ in range(5)] + rare[i // 3 : i // 3 + 1]), r.choice(["en", "DE", None, "ja"]), r.choice([1, 2, 3])) for i in range(12600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, level int")
    got = R.train(d, d.select("doc_id", F.col("level").alias("reading_level")))
    whole = R.fit_models([t for _, t, _, _ in rows], np.array([k for *_, k in rows], float), [x for _, _, x, _ in rows])
    assert set(rare) <= set(got.model.vocabulary) and got.model.vocabulary == whole.vocabulary
    for name in ("pairs", "pair_gain", "word_gain", "spoken"):
        assert np.array_equal(getattr(got.model, name), getattr(whole, name))


def test_models_of_a_fold_are_those_of_the_others(spark):
    texts, levels = sample(90, 9)
    d = spark.createDataFrame([(i, f"{t} only{'abcdefghijklmnop'[i % 16]}", "en" if i % 3 else "fr", float(k)) for i, (t, k) in enumerate(zip(texts, levels))], "doc_id long, text string, lang string, level double")
    d = d.withColumn("part", F.pmod(F.col("doc_id"), F.lit(R.FOLDS)).cast("int"))
    rows, counts = d.collect(), R.counted(d)
    for away in range(-1, R.FOLDS):
        rest = [x for x in rows if x.part != away]
        whole, got = R.fit_models([x.text for x in rest], np.array([x.level for x in rest]), [x.lang for x in rest]), counts.model(away)
        assert got.vocabulary == whole.vocabulary
        for name in ("pairs", "pair_gain", "word_gain", "spoken"):
            assert np.array_equal(getattr(got, name), getattr(whole, name))


def test_maps_of_pieces_are_those_of_all_measures(spark):
    r = np.random.default_rng(3)
    language = r.choice(5, 4000, p=[0.6, 0.25, 0.14, 0.01, 0])
    rating = r.choice([1.0, 1.5, 2.0, 2.5, 3.0], 4000)
    x = np.round(r.normal(size=(4000, 4)) + rating[:, None] * r.random((4000, 4)), 2)
    x[:1000, 2:] = 0
    order = np.argsort(-rating, kind="stable")
    whole = R.reader_of(None, x[order], language[order], rating[order])
    df = spark.createDataFrame([(float(k), int(j), *map(float, row)) for k, j, row in zip(rating, language, x)], "level double, language int, x0 double, x1 double, x2 double, x3 double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        maps, mixes = R.maps_of(df.repartition(7))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert mixes == whole.mixes
    for got, of in zip(maps, whole.maps):
        for (a, b), (c, d) in zip(got, of):
            assert np.array_equal(a, c) and np.allclose(b, d, atol=1e-12)


@pytest.mark.parametrize("texts", [[], [None], ["", " "]])
def test_nothing_to_learn_from(texts):
    reader = R.fit([], np.zeros(0), [])
    x, said, ours = R.measure(texts, reader.model)
    assert len(reader.level(x, said)) == len(texts) and not ours.any()


def test_a_handful_of_ratings(spark):
    texts, levels = sample(6, 5)
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for n in (0, 1, 2, 6):
        labels = spark.createDataFrame([(i, int(levels[i])) for i in range(n)], "doc_id long, reading_level int")
        out = R.levels(d, labels).collect()
        assert len(out) <= 6 and all(r.reading_level in R.LEVELS for r in out)
