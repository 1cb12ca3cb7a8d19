"""Problem 1: nested JSON into flat tables by Merkle subtree identities.

Every object of a value is canonicalised and hashed bottom-up, so equal objects get the same identity
wherever they stand. ``occurrences`` is the bridge: one row per place of an object with its parent, the parent's field it
stands in, its place in that field's array (null outside arrays, of nested arrays the innermost) and its ordinal in the record.
``objects`` holds each distinct object once, nested objects replaced by references, and
``edges`` the distinct parent-child links; ``restore`` puts a value together again from both. A source key that begins
like the reference mark gets one more ``$``, so data never look like references.

Values that are null, empty, cut off or otherwise not valid JSON give no rows; so do values without
objects. A JSON string that holds JSON and a code fence are opened first. Nesting may be deeper than
Python's recursion limit. Of a key that an object repeats, the last holds. Repeated records come out as often
as they came in. Only the key and the JSON column are read, so further columns may have any names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OCCURRENCES = "source_table string, record_id long, path string, parent_path string, field string, item int, ordinal int, depth int, object_hash string, parent_hash string"
BODIES = "object_hash string, body string, depth int, places long"
REF = "$object"

_fence = re.compile(r"\A\s*(`{3,}|~{3,})[^\n`]*\n(.*?)\n?\s*\1\s*\Z", re.S)
_token = re.compile(r'[ \t\r\n]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null))')


class NotJson(ValueError):
    pass


def _constant(name: str) -> None:
    raise NotJson(name)


def _deep(text: str) -> Any:
    """Parse without recursion; only for values nested deeper than the standard parser can go."""
    root: list = []
    stack: list[Any] = [root]
    keys: list[str | None] = [None]
    state, pos, end = "value", 0, len(text.rstrip(" \t\r\n"))
    while pos < end:
        m = _token.match(text, pos)
        if not m or state == "done":
            raise NotJson(pos)
        pos = m.end()
        mark, string, number, word = m.groups()
        at = stack[-1]
        if string is not None and state in ("key", "key or }"):
            keys[-1], state = json.loads(string), ":"
            continue
        if mark == ":" and state == ":":
            state = "value"
            continue
        if mark == "," and state == "next":
            state = "key" if isinstance(at, dict) else "value"
            continue
        if mark in ("]", "}"):
            if len(stack) < 2 or isinstance(at, dict) != (mark == "}") or state not in ("next", "key or }" if mark == "}" else "value or ]"):
                raise NotJson(pos)
            stack.pop(), keys.pop()
        elif state in ("value", "value or ]") and mark in ("[", "{", None):
            new = [] if mark == "[" else {} if mark == "{" else json.loads(string or number or word)
            if isinstance(at, dict):
                at[keys[-1]] = new
            else:
                at.append(new)
            if mark:
                stack.append(new), keys.append(None)
                state = "value or ]" if mark == "[" else "key or }"
                continue
        else:
            raise NotJson(pos)
        state = "next" if len(stack) > 1 else "done"
    if state != "done":
        raise NotJson(end)
    return root[0]


def parse(text: str | None) -> Any:
    """The JSON within a value; NotJson if it isn't complete and valid."""
    for _ in range(8):
        if text is None or not text.strip():
            raise NotJson("empty")
        m = _fence.match(text)
        if m:
            text = m[2]
            continue
        try:
            value = json.loads(text, parse_constant=_constant)
        except RecursionError:
            value = _deep(text)
        except NotJson:
            raise
        except ValueError as e:
            raise NotJson(str(e)) from None
        if not isinstance(value, str):
            return value
        text = value
    raise NotJson("strings in strings")


def _scalar(x: Any) -> str:
    if isinstance(x, float) and x == x and abs(x) < 1e15 and x == int(x):
        x = int(x)
    return json.dumps(x, ensure_ascii=True)


def marked(key: str) -> str:
    """A source key as it stands in a body."""
    return f"${key}" if key.lstrip("$") == REF[1:] and key.startswith("$") else key


def walk(value: Any) -> list[tuple[str, str, str, int | None, int, int, str, str, str]]:
    """(path, parent path, field, item, ordinal, depth, hash, parent hash, body) of each object, keys in sorted order; no recursion.

    The body of an object is its canonical JSON: keys sorted, whole floats as integers, nested objects as references.
    """
    objects: list[list] = []  # path, parent's index, depth, field, item, hash, body
    results: list[str] = []
    stack: list[tuple] = [(0, value, "$", -1, 0, "", None)]
    while stack:
        kind, node, path, owner, depth, field, item = stack.pop()
        if kind == 0:
            if isinstance(node, dict):
                objects.append([path, owner, depth, field, item, "", ""])
                me = len(objects) - 1
                stack.append((1, node, path, me, depth, field, item))
                stack += [(0, node[k], f"{path}.{k}", me, depth + 1, k, None) for k in reversed(sorted(node))]
            elif isinstance(node, list):
                stack.append((2, node, path, owner, depth, field, item))
                stack += [(0, node[i], f"{path}[{i}]", owner, depth, field, i) for i in range(len(node) - 1, -1, -1)]
            else:
                results.append(_scalar(node))
            continue
        n = len(node)
        parts = results[len(results) - n :] if n else []
        del results[len(results) - n :]
        if kind == 2:
            results.append("[" + ",".join(parts) + "]")
            continue
        body = "{" + ",".join(f"{json.dumps(marked(k))}:{p}" for k, p in zip(sorted(node), parts)) + "}"
        digest = hashlib.blake2b(body.encode(), digest_size=16).hexdigest()
        objects[owner][5:] = [digest, body]
        results.append(f'{{"{REF}":"{digest}"}}')
    return [(o[0], objects[o[1]][0] if o[1] >= 0 else "", o[3], o[4], i, o[2], o[5], objects[o[1]][5] if o[1] >= 0 else "", o[6]) for i, o in enumerate(objects)]


def _clean(text: str) -> str:
    """Without lone surrogates, which JSON can escape and Arrow can't hold."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _walked(b: pa.RecordBatch) -> Iterator[tuple[int, list[tuple]]]:
    for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        try:
            yield i, walk(parse(text))
        except NotJson:
            continue


def _values(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.where(F.length(F.col(f"`{column}`")) > 1).select(F.col(f"`{key}`").cast("long"), F.col(f"`{column}`"))


def occurrences(df: DataFrame, source_table: str, key: str, column: str) -> DataFrame:
    """The bridge table of one JSON column; it carries identities, not the objects themselves."""
    kept = [f.split()[0] for f in OCCURRENCES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, own in _walked(b):
                ids += [i] * len(own)
                rows += own
            cols = list(zip(*rows)) if rows else [()] * 9
            strings = lambda k: pa.array([_clean(x) for x in cols[k]], pa.string())
            numbers = lambda k: pa.array(cols[k], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([source_table] * len(ids), pa.string()), pa.array(ids, pa.int64()), strings(0), strings(1), strings(2), numbers(3), numbers(4), numbers(5), strings(6), strings(7)],
                names=kept,
            )

    return _values(df, key, column).mapInArrow(run, OCCURRENCES)


def bodies(df: DataFrame, key: str, column: str) -> DataFrame:
    """(object_hash, body, depth, places): the objects of one JSON column, each once in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list] = {}
            for _, own in _walked(b):
                for o in own:
                    x = seen.setdefault(o[6], [_clean(o[8]), o[5], 0])
                    x[1], x[2] = min(x[1], o[5]), x[2] + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.string()), pa.array([x[1] for x in seen.values()], pa.int32()), pa.array([x[2] for x in seen.values()], pa.int64())],
                names=["object_hash", "body", "depth", "places"],
            )

    return _values(df, key, column).mapInArrow(run, BODIES)


def objects(found: DataFrame) -> DataFrame:
    """Each distinct object of ``bodies`` once, with the number of its places; equal hashes have equal bodies, so max() merges on the map side."""
    return found.groupBy("object_hash").agg(F.max("body").alias("body"), F.sum("places").alias("places"), F.min("depth").alias("least_depth"))


def edges(bridge: DataFrame) -> DataFrame:
    """Distinct links between objects: the parent's field, the place in its array, and the number of their places."""
    return bridge.where("parent_hash != ''").groupBy("parent_hash", "field", "item", "object_hash").agg(F.count("*").alias("places"))


def fields(objects_table: DataFrame) -> DataFrame:
    """(object_hash, field, value): the flat attribute table of the distinct objects, values as JSON text, fields as in the source."""
    pairs = F.from_json("body", "map<string,string>")
    each = objects_table.select("object_hash", F.explode(pairs).alias("field", "value"))
    return each.withColumn("field", F.when(F.col("field").rlike(r"^\$\$+object$"), F.expr("substring(field, 2)")).otherwise(F.col("field")))


def _loaded(body: str) -> Any:
    try:
        return json.loads(body)
    except RecursionError:
        return _deep(body)


def restore(body: str, bodies: dict[str, str]) -> Any:
    """The value of a body, its references filled in from (hash -> body); a stack instead of recursion, so any depth will do."""
    top: list[Any] = [None]
    stack: list[tuple[Any, Any, Any]] = [(top, 0, _loaded(body))]
    while stack:
        owner, place, v = stack.pop()
        if isinstance(v, dict) and list(v) == [REF]:
            v = _loaded(bodies[v[REF]])
        if isinstance(v, dict):
            owner[place] = new = {(k[1:] if marked(k[1:]) == k else k): None for k in v}
            stack += [(new, k[1:] if marked(k[1:]) == k else k, x) for k, x in v.items()]
        elif isinstance(v, list):
            owner[place] = new = [None] * len(v)
            stack += [(new, i, x) for i, x in enumerate(v)]
        else:
            owner[place] = v
    return top[0]
