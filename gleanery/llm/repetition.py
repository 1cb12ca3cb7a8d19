"""Problem 3: the share of repeated wording inside each document.

Statistics of a document come from its words (runs of letters, lower case) in numpy over a whole
Arrow batch: every run of five words gets a 64-bit hash, and all words of a run seen earlier in the
same document count as repeated. Boosted trees over the statistics, trained on a bounded sample and
held monotone in the repeated shares, give the score; ``found`` checks the trees' candidates exactly.

Null, empty and wordless texts have zero statistics and are never found. Ids are passed on as they
are, so repeated rows come out as often as they came in; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import gbt
from gleanery.llm.arrow import bounded_sample, map_rows

RUN, LEAST_WORDS, LEAST_SHARE = 5, 30, 0.3
#: Rows the trees are trained on, at most.
SAMPLE = 3000
#: Trees' score from which a text is checked exactly; low, for the check decides.
GATE = 0.02
STATS = ("words", "repeated_share", "line_share", "distinct_share", "top_share", "mean_word")
MONOTONE = (0, 1, 1, 0, 0, 0)

_words = re.compile(r"[^\W\d_]+").findall


class Ids(dict):
    """Numbers words as they are first looked up."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _ids_and_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word ids of all texts in a row, words per text, and the words by id."""
    known = Ids()
    flat: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            words = _words(t.lower())
            counts[i] = len(words)
            flat += map(known.__getitem__, words)
    return np.array(flat, np.int64), counts, list(known)


def repeated_words(flat: np.ndarray, counts: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each text the number of words inside a run of ``run`` words that stood earlier in it."""
    n = len(flat)
    out = np.zeros(len(counts), np.int64)
    if n < run:
        return out
    doc = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        mixed = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        h = np.zeros(n - run + 1, np.uint64)
        for k in range(run):
            h = h * np.uint64(0x100000001B3) + mixed[k : n - run + 1 + k]
        inside = doc[: n - run + 1] == doc[run - 1 :]
        at = np.flatnonzero(inside)
        key = h[at] ^ ((doc[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    again = at[order[1:][key[order[1:]] == key[order[:-1]]]]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + run, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(counts)) if covered.any() else out


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of STATS for each text."""
    flat, counts, words = _ids_and_words(texts)
    letters = np.fromiter(map(len, words), np.int64, len(words))
    n, some = len(texts), np.maximum(counts, 1)
    doc = np.repeat(np.arange(n), counts)
    repeated = repeated_words(flat, counts)
    lines = np.zeros(n)
    for i, t in enumerate(texts):
        if t and "\n" in t:
            own = [x for x in map(str.strip, t.split("\n")) if x]
            if own:
                lines[i] = 1 - len(set(own)) / len(own)
    if len(flat):
        pairs, times = np.unique(doc * (len(letters) + 1) + flat, return_counts=True)
        of = pairs // (len(letters) + 1)
        distinct = np.bincount(of, minlength=n)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, of, times)
        size = np.bincount(doc, letters[flat], minlength=n)
    else:
        distinct = top = size = np.zeros(n)
    return np.stack([counts, repeated / some, lines, distinct / some, top / some, size / some], 1).astype(float)


def is_case(stats: np.ndarray) -> np.ndarray:
    """The exact rule; in whole numbers, for three tenths has no exact float."""
    repeated = np.rint(stats[:, 1] * stats[:, 0])
    return (stats[:, 0] >= LEAST_WORDS) & (repeated * 10 >= stats[:, 0] * 3)


def _anchors(x: np.ndarray) -> np.ndarray:
    """Made-up statistics around the rule's limits, so that the trees know these even from a sample without a case."""
    usual = np.median(x, 0) if len(x) else np.array([200.0, 0, 0, 0.6, 0.05, 5])
    words, shares = np.meshgrid([5, 20, 29, 30, 31, 60, 200, 1000, 20000], np.r_[0, 0.1, 0.2, 0.25, np.arange(0.28, 0.325, 0.005), 0.4, 0.6, 0.9])
    out = np.tile(usual, (words.size, 1))
    out[:, 0], out[:, 1] = words.ravel(), shares.ravel()
    return out


def train(df: DataFrame, key: str, text: str, sample: int = SAMPLE) -> gbt.FlatTrees:
    """Trees on a sample of at most ``sample`` texts, chosen by the hash of their key."""
    rows = bounded_sample(df.where(F.length(text) > 0).select(key, text), key, sample).select(text).collect()
    x = statistics([r[0] for r in rows])
    x = np.concatenate([x, _anchors(x)])
    return gbt.fit(x, is_case(x).astype(float), MONOTONE, {0: [float(LEAST_WORDS)], 1: [LEAST_SHARE]})


def measured(df: DataFrame, key: str = "result_id", text: str = "fetched_text", sample: int = SAMPLE) -> DataFrame:
    """(key, words, repeated, repeated_share, score): each row's repetition and the trees' score."""
    model = train(df, key, text, sample)
    kind = df.schema[key].dataType.simpleString()

    def make():
        def batch(ids, texts):
            x = statistics(texts)
            repeated = np.rint(x[:, 1] * x[:, 0]).astype(int)
            return ids, x[:, 0].astype(int), repeated, x[:, 1], model.score(x)

        return batch

    return map_rows(df, [key, text], make, f"{key} {kind}, words int, repeated int, repeated_share double, score double")


def found(df: DataFrame, key: str = "result_id", text: str = "fetched_text", gate: float = GATE) -> DataFrame:
    """Keys of the texts whose wording is repeated too much: the trees' candidates, exactly checked."""
    m = measured(df, key, text)
    return m.where((F.col("score") >= gate) & (F.col("words") >= LEAST_WORDS) & (F.col("repeated") * 10 >= F.col("words") * 3)).select(key)
