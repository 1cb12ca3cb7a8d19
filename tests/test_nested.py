import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.operators import nested

values = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab\"{}[],:", max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from("abc"), c, max_size=3), max_leaves=12)


def brute(v, path="$", parent=""):
    if isinstance(v, dict):
        yield path, parent
        for k, x in v.items():
            yield from brute(x, f"{path}.{k}", path)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from brute(x, f"{path}[{i}]", parent)


@settings(max_examples=200, deadline=None)
@given(values)
def test_paths_and_restoring(v):
    rows = nested.walk(nested.parse(json.dumps([v])))
    assert sorted((r[0], r[1]) for r in rows) == sorted(brute([v]))
    bodies = {r[6]: r[8] for r in rows}
    for r in rows:
        if r[0] == "$[0]":
            assert nested.restore(r[8], bodies) == v


@settings(max_examples=200, deadline=None)
@given(values, st.text("ab\"{}[],: 1", max_size=8))
def test_deep_parser_agrees(v, noise):
    for text in (json.dumps(v), noise, json.dumps(v)[:-1], json.dumps(v) + noise):
        try:
            expected = json.loads(text)
        except ValueError:
            with pytest.raises(nested.NotJson):
                nested._deep(text)
        else:
            assert nested._deep(text) == expected


def test_equal_objects_have_one_identity():
    rows = nested.walk(json.loads('[{"a": 1.0, "b": {"c": null}}, {"b": {"c": null}, "a": 1}]'))
    assert len(rows) == 4 and len({r[6] for r in rows}) == 2


@pytest.mark.parametrize("text", [None, "", "  ", "{", '[{"a": 1}', "{'a': 1}", "NaN", '{"a": NaN}', "{} x", "```json\n{\n```"])
def test_no_json(text):
    with pytest.raises(nested.NotJson):
        nested.walk(nested.parse(text))


def test_wrapped():
    for text in ('{"a": {}}', '```json\n{"a": {}}\n```', '```\n{"a": {}}```', json.dumps('{"a": {}}'), json.dumps(json.dumps('{"a": {}}'))):
        assert [(r[0], r[1]) for r in nested.walk(nested.parse(text))] == [("$", ""), ("$.a", "$")]


def test_very_deep():
    depth = 60_000
    rows = nested.walk(nested.parse('{"a":' * 3 + "[" * depth + "{}" + "]" * depth + "}" * 3))
    assert len(rows) == 4 and rows[-1][1] == "$.a.a"


def test_tables(spark):
    v = '[{"k": {"x": 1}}, null, {"k": {"x": 1}}]'
    df = spark.createDataFrame([(1, v, "s"), (1, v, "s"), (2, None, None), (3, "", None)], "id long, j string, path string")
    b = nested.occurrences(df, "t", "id", "j")
    o = nested.objects(nested.bodies(df, "id", "j"))
    assert b.count() == 8 and {(r.places, r.least_depth) for r in o.collect()} == {(4, 0), (4, 1)} and [tuple(r)[1:3] + (r.places,) for r in nested.edges(b).collect()] == [("k", None, 4)]
    assert sorted((r.path, r.field, r.item) for r in b.where("record_id = 2 or record_id = 1").distinct().collect()) == [("$[0]", "", 0), ("$[0].k", "k", None), ("$[2]", "", 2), ("$[2].k", "k", None)]
    assert [tuple(r) for r in nested.fields(o).where("field = 'x'").select("field", "value").collect()] == [("x", "1")]
    assert nested.occurrences(df.limit(0), "t", "id", "j").count() == 0


@pytest.mark.parametrize("value", [{"$object": 1}, {"$object": "0" * 32}, {"$$object": {"$object": {}}}, {"a": [{"$object": [{"b": {}}]}, {"$objects": 2}]}])
def test_keys_that_look_like_references(spark, value):
    rows = nested.walk(value)
    assert nested.restore(rows[0][8], {r[6]: r[8] for r in rows}) == value
    plain = nested.walk({"a": {"x": 1}})
    assert nested.walk({"a": {"$object": plain[1][6]}})[0][6] != plain[0][6]
    df = spark.createDataFrame([(1, json.dumps(value))], "id long, j string")
    assert set(value) <= {r.field for r in nested.fields(nested.objects(nested.bodies(df, "id", "j"))).collect()}


def test_deep_values_are_restored():
    value = nested.parse('{"a":[' * 3000 + "1" + "]}" * 3000)
    rows = nested.walk(value)
    back = nested.restore(rows[0][8], {r[6]: r[8] for r in rows})
    for _ in range(3000):
        assert list(back) == ["a"] and len(back["a"]) == 1
        back = back["a"][0]
    assert back == 1
