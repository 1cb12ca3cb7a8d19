"""The few CSS selectors the extractor needs, matched on ``functions.html`` trees."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from gleanery.functions.html import Node

_part = re.compile(r"(?P<tag>^[a-z0-9]+)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<op>[*^$~]?=)['\"]?(?P<value>[^'\"\]]*)['\"]?)?\]")


@lru_cache(maxsize=256)
def matcher(selector: str) -> Callable[[Node], bool]:
    """A test for one simple selector: tag, .class, #id and [attribute] with =, *=, ^= or $=."""
    tests = []
    for m in _part.finditer(selector):
        if m["tag"]:
            tests.append(lambda n, v=m["tag"]: n.tag == v)
        elif m["cls"]:
            tests.append(lambda n, v=m["cls"]: v in n.attrs.get("class", "").split())
        elif m["id"]:
            tests.append(lambda n, v=m["id"]: n.attrs.get("id") == v)
        else:
            name, op, value = m["name"], m["op"], m["value"]
            tests.append({
                None: lambda n, k=name: k in n.attrs,
                "=": lambda n, k=name, v=value: n.attrs.get(k) == v,
                "*=": lambda n, k=name, v=value: v in n.attrs.get(k, ""),
                "^=": lambda n, k=name, v=value: n.attrs.get(k, "").startswith(v),
                "$=": lambda n, k=name, v=value: n.attrs.get(k, "").endswith(v),
                "~=": lambda n, k=name, v=value: v in n.attrs.get(k, "").split(),
            }[op])
    return lambda n: all(t(n) for t in tests)


def every(root: Node, selector: str) -> list[Node]:
    test = matcher(selector)
    return [n for n in root.walk() if n.tag != "#root" and test(n)]


def first(root: Node, selector: str) -> Node | None:
    test = matcher(selector)
    return next((n for n in root.walk() if n.tag != "#root" and test(n)), None)
