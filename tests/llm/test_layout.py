from pyspark.sql import functions as F

from gleanery.llm import layout as L

STORY = "The {0} council of {1} met for a long time and spoke about the old bridge near the {2} mill."
WORDS = ["river", "harbour", "forest", "castle", "garden", "market", "school", "station", "tower", "valley", "meadow", "quarry"]


def tag(i):
    return "".join("abcdefghij"[int(x)] for x in str(i)) + "x"


def corpus():
    rows = []
    for i in range(48):
        a, b, c = WORDS[i % 12], WORDS[(i * 5 + 1) % 12], WORDS[(i * 7 + 2) % 12]
        site = "northgazette" if i % 2 else "southgazette"
        story = [STORY.format(a, b, c), f"Nobody in {b} had seen the {c} in such a state since the {a} was built, said mayor number {i}."]
        body = f"Home | World | Sport | Weather\nNumber {tag(i)} of the {a} {b}\n\n{story[0]}\n\nA look back\n\n{story[1]}\nTop stories\nThe {b} won the {a} prize\nThe {c} lost the {b} game\nAll rights rest with {site[:5].title()} Gazette."
        rows.append((i, f"{site}.example", body))
    rows += [(100 + i, f"{s}gazette.example", f"Page number {i} not found\nAll rights rest with {s.title()} Gazette.") for i, s in enumerate(["north", "south"] * 5)]
    rows += [(200 + i, "northgazette.example", f"Heading {WORDS[i]} of {WORDS[i + 1]}\n\n{STORY.format(WORDS[i], 'place', i)}\n\n" + "Your filler sentence stands here.\n\n" + "Replace this by a text of your own.\n\n" * (i % 2) + STORY.format("second", WORDS[i], "blue") + f" Again {i}.") for i in range(8)]
    rows += [(220 + i, "southgazette.example", f"Heading {WORDS[i]} on {WORDS[i + 1]}\n\n{STORY.format(WORDS[i], 'spot', i)}\n\n" + "Your filler sentence stands here.\n\n" + "Replace this by a text of your own.\n\n" * (i % 2) + STORY.format("third", WORDS[i], "red") + f" More {i}.") for i in range(8)]
    return rows


def judged(spark, rows):
    df = spark.createDataFrame(rows, "result_id long, d string, fetched_text string").withColumn("body", F.lit(1))
    return {r.result_id: r for r in L.judged(df, domain=F.col("d")).collect()}


def test_body_and_leftovers(spark):
    rows = corpus() + [(300, "northgazette.example", "Title of it\n\nA sentence with {{ story.byline }} in the middle of all its words."), (301, "x.example", None), (302, "x.example", ""), (303, None, "Just one line of text that ends well.")]
    out = judged(spark, rows)
    assert out[0].furniture == [0, 8, 9, 10, 11] and not out[0].leftover and "A look back" in out[0].body and "Top stories" not in out[0].body
    assert all(out[100 + i].whole and out[100 + i].furniture == [] for i in range(10))
    assert out[200].leftover and not out[200].whole
    assert out[300].leftover and 301 not in out and 302 not in out and not out[303].leftover


def test_markup_is_rendered(spark):
    out = judged(spark, [(1, "a.example", "<html><body><p>A first sentence of the story.<p>And <b>one</b> more of it.<div hidden>no</div></body></html>")])
    assert out[1].body == "A first sentence of the story.\n\nAnd one more of it."


def test_empty_table(spark):
    assert judged(spark, corpus()[:1]) and L.judged(spark.createDataFrame([], "result_id long, d string, fetched_text string"), domain=F.col("d")).count() == 0


def test_shapes():
    assert len(L.cells("Home | World | Sport")) == 3 and L.shaped("Lindow 3° / 9°") == "N 0° / 0°" and L.shaped("Ann Lee, 5 hours ago") == "N, 0 hours ago"


def test_the_join_gives_the_same_rows_as_the_broadcast(spark):
    df = spark.createDataFrame(corpus(), "result_id long, d string, fetched_text string")
    one, other = (sorted(map(str, L.judged(df, domain=F.col("d"), limit=n).collect())) for n in (L.BROADCAST_KEYS, 0))
    assert one == other


def test_foreign_sites_change_nothing(spark):
    foreign = [(1000 + i, f"site{i % 90}post.example", f"Number {tag(i)}\n\n{STORY.format(tag(i), 'another', 'stone')} Chapter {i} of it tells it in full, they said.\nMenu of site {tag(i % 90)} alone") for i in range(360)]
    small, large = judged(spark, corpus()), judged(spark, corpus() + foreign)
    assert all(large[i].furniture == r.furniture and large[i].leftover == r.leftover for i, r in small.items())


def test_lines_of_marked_up_texts_are_source_lines(spark):
    page = "<html><body>\n<nav><a>Home</a>\n<a>World</a></nav>\n<p>The council met for\na long time about the bridge.</p>\n<footer>Imprint</footer>\n</body></html>"
    out = judged(spark, [(1, "a.example", page)])
    assert out[1].furniture == [0, 1, 2, 5, 6] and set(out[1].reasons) == {"beside"} and out[1].body == "The council met for a long time about the bridge."


def test_long_lines_can_be_furniture(spark):
    notice = "This site and its partners keep small files on your device " + "and so on " * 30 + "."
    rows = [(i, "northgazette.example", f"{notice}\nHeading {WORDS[i % 12]}\n\n{STORY.format(WORDS[i % 12], i, 'x')} Part {i} of it.") for i in range(12)]
    assert all(r.furniture == [0] for r in judged(spark, rows).values())


def test_syntaxes_off_the_list_are_learned(spark):
    rows = corpus() + [(400 + i, "northgazette.example", f"A line with QQ{n}QQ stands here and %({n.lower()})s too {{{n.lower()}}} of the {w} story.") for i, (n, w) in enumerate(zip(["TITLE", "CAPTION", "BYLINE", "DATE"], WORDS))]
    rows += [(410, "x.example", "Now a fifth one QQRUBRICQQ in a sentence of its own."), (411, "x.example", "Words in *some* marks and a #title and one more *name* here.")]
    out = judged(spark, rows)
    assert all(out[400 + i].leftover for i in range(4)) and out[410].leftover and not out[411].leftover


def test_slots_of_aligned_lines(spark):
    names = ["Ann Lee", "Bo Marsh", "Cy Dorn", "Di Falk", "Ed Gray", "Flo Hart"]
    line = "Written today by {0} for our readers"
    rows = [(i, "northgazette.example", f"{STORY.format(WORDS[i % 12], WORDS[i % 7], i)} And number {i} of them went home again.\n\n{line.format(names[i % 6])}") for i in range(30)]
    rows += [(100 + i, "northgazette.example", f"{STORY.format('last', WORDS[i], 'old')} And so on.\n\n{line.format(x)}") for i, x in enumerate(["", "Name", "undefined", "Gus Ives"])]
    out = judged(spark, rows)
    assert [out[100 + i].leftover for i in range(4)] == ["slot", "slot", "slot", ""] and not any(out[i].leftover for i in range(30))
