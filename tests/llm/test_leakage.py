import random

from gleanery.llm import leakage as K


def world(seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(400)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, say(r.randint(45, 90))) for i in range(40)]
    docs, truth = [], set()
    for d in range(300):
        words = say(r.randint(0, 200))
        kind = r.random()
        k, p = r.choice(items)
        if kind < 0.3:
            n = r.choice([25, 30, len(p)])
            s = r.randint(0, len(p) - n)
            piece = list(p[s : s + n])
            for j in r.sample(range(n), n // 10):
                piece[j] = "zzz"
            at = r.randint(0, len(words))
            words[at:at] = piece
            truth.add((d, k))
        elif kind < 0.5:
            s = r.randint(0, len(p) - 12)
            words[5:5] = p[s : s + 12]
        docs.append((d, " ".join(w.title() if r.random() < 0.2 else w + r.choice(["", ",", ".", "\n"]) for w in words)))
    return items, docs, truth


def test_held_out_truth():
    items, docs, truth = world()
    index = K.Index([(i, " ".join(w)) for i, w in items])
    found = {(d, index.items[k]) for d, t in docs for k, sure in index.leaked(t) if sure}
    assert found == truth


def test_spelling_markup_and_accents():
    passage = "Élodie bought the red — very red — boat; " * 5 + "then Ülo sold all of it to a man from the far north of Narva."
    index = K.Index([(7, passage), (8, None), (9, ""), (10, "short one")])
    assert index.leaked("x <b>" + passage.upper().replace("É", "E").replace("—", "&mdash;") + "</b> y") == [(index.items.index(7), True)]
    assert index.leaked(None) == [] and index.leaked("") == [] and index.leaked("nothing of it") == []


def test_frame(spark):
    items, docs, truth = world(2)
    i = spark.createDataFrame([(k, " ".join(w), "who asks", " ".join(w[:2])) for k, w in items] + [(99, None, None, None)], "item_id long, passage string, question string, answer string")
    d = spark.createDataFrame([(k, t, None) for k, t in docs] + [(900, None, None), (901, "", None)], "doc_id long, text string, item_id string")
    assert {(r.doc_id, r.item_id) for r in K.leaks(d, i).collect()} == truth
    assert K.leaks(d.limit(0), i).count() == 0 and K.leaks(d, i.limit(0)).count() == 0


def test_question_and_answer_decide_close_cases(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    piece = list(words[10:35])
    for j in range(9, 16):
        piece[j] = "zzz"
    items = spark.createDataFrame([(1, " ".join(words), "what did the mayor sell", "an old mill")], "item_id long, passage string, question string, answer string")
    text = " ".join(piece)
    others = [(10 + i, " ".join(r.choices(["one", "two", "three", "four"], k=30))) for i in range(400)]
    docs = spark.createDataFrame(others + [(1, text), (2, text + " so what did the mayor sell? An old mill."), (3, text + " an old mill")], "doc_id long, text string")
    assert [x.doc_id for x in K.leaks(docs, items).collect()] == [2]


def test_retrieval_is_exact():
    """Every query and item at or above its threshold comes out, by sums over all postings."""
    items, docs, _ = world(5)
    index = K.Index([(i, " ".join(w)) for i, w in items])
    rows = {t: range(index.block_post[index.term_block[t]], index.block_post[index.term_block[t + 1]]) for t in range(len(index.terms))}
    for _, text in docs[:80]:
        ids = index.ids(text)
        at, term = index.found(ids)
        brute = set()
        for w in range(len(at)):
            score: dict = {}
            for x in range(w, len(at)):
                if at[x] < at[w] + K.RUN + K.SLACK:
                    for p in rows[int(term[x])]:
                        score[index.item[p]] = score.get(index.item[p], 0.0) + float(index.impact[p])
            own = {index.item[p] for p in rows[int(term[w])]}
            brute |= {(int(at[w]), int(i)) for i, s in score.items() if i in own and s >= index.least[i] - 0.01}
        assert set(index.retrieve(ids)) == brute


def test_the_index_grows_with_its_postings():
    r = random.Random(6)
    words = [f"word{i}x" for i in range(3000)]
    sizes = []
    for n in (200, 800):
        index = K.Index([(i, " ".join(r.choices(words, k=50))) for i in range(n)])
        sizes.append(sum(a.nbytes for a in (index.item, index.impact, index.block, index.block_post, index.block_max, index.term_block, index.term_max)))
    assert sizes[1] < 5 * sizes[0]
