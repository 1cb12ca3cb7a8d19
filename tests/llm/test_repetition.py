import random
import re

import numpy as np

from gleanery.llm import gbt
from gleanery.llm import repetition as R


def brute(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    seen, again = set(), set()
    for i in range(len(words) - 4):
        run = tuple(words[i : i + 5])
        if run in seen:
            again.update(range(i, i + 5))
        seen.add(run)
    return len(words), len(again)


def texts(n, seed=1):
    r = random.Random(seed)
    for _ in range(n):
        body = [r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 90))]
        if r.random() < 0.5 and body:
            i = r.randrange(len(body))
            body += body[i : i + r.randint(3, 60)]
        yield " ".join(body)


def test_against_brute_force():
    given = [*texts(400), None, "", "one", "... 12 _ !", "É é É é É é É é É é É é"]
    x = R.statistics(given)
    assert [(int(a), round(b * a)) for a, b in x[:, :2]] == [brute(t) for t in given]


def test_whole_batch_has_no_neighbours():
    assert R.statistics(["a b c d e", "a b c d e"])[:, 1].tolist() == [0, 0]


def test_found_equals_the_rule(spark):
    given = list(texts(300, 3)) + [None, "", "a b c d e " * 500]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(given)], "result_id long, fetched_text string, words int")
    expected = {i for i, t in enumerate(given) for w, a in [brute(t)] if w >= 30 and a * 10 >= w * 3}
    assert {r.result_id for r in R.found(df).collect()} == expected and expected
    assert R.measured(df).count() == len(given)
    assert R.found(df.limit(0)).count() == 0


def test_trees_are_monotone_and_learn():
    g = np.random.default_rng(0)
    x = g.random((2000, 3))
    y = ((x[:, 0] + 0.3 * x[:, 1] + 0.2 * g.standard_normal(2000)) > 0.7).astype(float)
    m = gbt.fit(x, y, (1, 0, -1))
    test = g.random((500, 3))
    for j, sign in ((0, 1), (2, -1)):
        more = test.copy()
        more[:, j] = np.minimum(1, more[:, j] + 0.2)
        assert (sign * (m.score(more) - m.score(test)) >= -1e-12).all()
    assert ((m.score(x) > 0.5) == y).mean() > 0.8
    assert gbt.fit(np.zeros((0, 3)), np.zeros(0), (0, 0, 0)).score(test).shape == (500,)
