import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gleanery.llm import lines as L


def brute(rows):
    texts = defaultdict(set)
    for _, d, t in rows:
        if d and t:
            texts[d].add(t)
    standing = {}
    for d, own in texts.items():
        c = Counter(k for t in own for k in {L.line_key(x) for x in t.split("\n")} - {0})
        standing[d] = {k for k, n in c.items() if n >= 5 and n * 10 >= len(own)}
    return sorted((i, n) for i, d, t in rows if d and t for n, x in enumerate(t.split("\n")) if L.line_key(x) in standing[d])


def rows(seed=1):
    r = random.Random(seed)
    out = []
    for i in range(240):
        d = r.choice(["big.example"] * 6 + ["small.example", "tiny.example", "", None])
        t = "\n".join(r.choice(["All rights: 20%d" % r.randint(10, 99), "ALL RIGHTS", "Menu", "", "12", "line %s" % chr(97 + r.randint(0, 25)) * r.randint(1, 3)]) for _ in range(r.randint(0, 8)))
        out.append((i, d, t if r.random() < 0.9 else None))
    return out + out[:10]


def frame(spark, data):
    return spark.createDataFrame(data, "result_id long, d string, fetched_text string").withColumn("line_no", F.lit("clash"))


def test_against_brute_force(spark):
    data = rows()
    for counters in (2048, 4):  # few counters: large errors, more candidates, same result
        found = L.occurrences(frame(spark, data), domain=F.col("d"), counters=counters)
        assert sorted((r.result_id, r.line_no) for r in found.collect()) == brute(data)


def test_cleaned(spark):
    data = [(i, "a.example", f"Share this\nstory {'xyz'[i % 3] * (i + 1)}\n\nshare  THIS 3") for i in range(9)] + [(9, "a.example", None), (10, "a.example", "")]
    out = {r.result_id: r for r in L.cleaned(frame(spark, data), domain=F.col("d")).collect()}
    assert out[0].cleaned_text == "story x\n" and out[0].removed == 2 and out[9].cleaned_text is None and out[10].cleaned_text == ""
    assert L.occurrences(frame(spark, data).limit(0), domain=F.col("d")).count() == 0


def test_summary_bound():
    s, true = L.Summary(8), Counter()
    r = random.Random(2)
    for _ in range(5000):
        k = int(r.paretovariate(0.6)) % 500 + 1
        s.add(k)
        true[k] += 1
    s.shrink()
    assert len(s.counts) <= 8
    assert all(s.counts.get(k, 0) <= n <= s.counts.get(k, 0) + s.error for k, n in true.items())


def test_lines_dropped_from_all_summaries(spark):
    data = [(i, "long.example", "\n".join([f"only {chr(97 + i // 26)}{chr(97 + i % 26)} {chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)] + ["Standing line"] * (i < 6))) for i in range(60)]
    data = data[6:] + data[:6] + [(100 + i, "short.example", f"Menu\nstory {chr(97 + i)}") for i in range(6)]
    df = frame(spark, data).coalesce(1)
    found = L.occurrences(df, domain=F.col("d"), counters=8)
    assert sorted((r.result_id, r.line_no) for r in found.collect()) == brute(data)
    limits = L.summaries(L._texts(df, "result_id", "fetched_text", F.col("d")), 8).where("line = 0 and domain = 'long.example'").first()
    assert limits.error >= 6


def test_the_shuffle_join_gives_the_same_rows(spark, monkeypatch):
    data = rows(3)
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    found = L.occurrences(frame(spark, data), domain=F.col("d"))
    assert sorted((r.result_id, r.line_no) for r in found.collect()) == brute(data)
