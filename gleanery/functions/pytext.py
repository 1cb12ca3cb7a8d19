"""Python twins of the text measures, for the extractor, which ranks inside one page."""

from __future__ import annotations

import re

from gleanery.functions.constants import AUTH, BOT, JUNK

_drop = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\U00010000-\U0010ffff\ud800-\udfff﷐-﷯￾￿]")
_gap = re.compile(r"\n\s*\n")


def clean(text: object) -> str:
    t = _drop.sub("", "" if text is None else str(text)).replace("\xa0", " ")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()


def duplicate_ratio(text: str) -> float:
    marks = [re.sub(r"\W+", "", p.lower(), flags=re.A)[:260] for p in _gap.split(text)]
    marks = [m for m in marks if len(m) > 60]
    return int((len(marks) - len(set(marks))) / len(marks) * 1000 + 0.5) / 1000 if marks else 0.0


def score(text: str, min_chars: int = 300) -> float:
    """The text score of ``functions.text.score``."""
    t = clean(text)
    if not t:
        return 0.0
    low = t.lower()
    paras = sum(len(re.split(r"\s+", p)) >= 8 for p in _gap.split(t))
    points = min(45, len(t) / 120) + min(25, len(re.findall(r"\b\w+[\w'-]*\b", t, re.A)) / 35) + min(20, paras * 2.5) + min(10, len(re.findall(r"[.!?](?:\s|$)", t)) / 4)
    points -= 35 * (len(t) < min_chars) + 15 * (paras < 2) + 45 * any(p in low for p in AUTH) + 60 * any(p in low for p in BOT)
    points -= min(30, 8 * sum(p in low for p in JUNK)) + 20 * duplicate_ratio(t)
    return max(0.0, min(100.0, int(points * 10 + 0.5) / 10 if points > 0 else 0.0))


def distinct_blocks(blocks: list[str]) -> list[str]:
    """The first of each block with the same first 220 letters and digits; those with fewer than 20 are dropped."""
    seen: dict[str, str] = {}
    for b in map(clean, blocks):
        mark = re.sub(r"\W+", "", b.lower(), flags=re.A)[:220]
        if len(mark) >= 20:
            seen.setdefault(mark, b)
    return list(seen.values())
