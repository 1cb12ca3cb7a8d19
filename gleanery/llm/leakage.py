"""Problem 9: evaluation items leaking into training documents.

The passages of the items form a BM25 index whose terms are pairs of neighbouring words, for single words are shared with
most of the corpus. Their inverse frequencies are the corpus's, from a count over all documents. Only distinctive pairs (those
in few documents; the others add little to a score) are kept: a posting list with impacts for each, its largest impact, and the
largest of each block of items it has postings in (block-max). All are sparse rows, so the index grows with the postings. In a
document every stretch of RUN words, with some slack, that begins with a distinctive pair is a query, so every passage of the
document is asked for. A query is evaluated as block-max WAND does, for all queries of a document at once: sums of the lists' maxima give the
pivots, queries that can reach no threshold go no further; of the rest the sums of block maxima bound the score in each
block; only the postings of blocks whose bound reaches their lowest threshold are read and scored exactly. An item's threshold is PART of the least score of any RUN words of its
passage; a replaced word takes two of their RUN - 1 pairs with it, so with one word in ten replaced about four fifths are left. Retrieved pairs
are verified word by word: some RUN consecutive words of the passage must meet the document in the same order, up to
DRIFT words out of step, with at least KEPT of them equal; NEAR are enough where the question and the answer overlap with the
document too, the answer as a whole and the question with at least ASKED of its words.

Words are compared without case, accents, punctuation, tags and entities. The index grows with the items only, a bounded
table, and is broadcast; documents are scanned once and nothing is shuffled. Null and empty texts and passages are
never cases. A passage shorter than RUN must occur whole. A repeated row of a document gives its pairs once per row.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.arrow import map_rows

RUN, KEPT, NEAR, DRIFT, PART, ASKED = 25, 19, 18, 1, 0.5, 0.6
SLACK = 5
K1, B, BLOCK = 0.9, 0.4, 8
#: A pair is distinctive for an item if at most this share of the documents has it; of each item the first share that leaves it a threshold of LEAST is taken.
SHARES, LEAST = (0.001, 0.003, 0.01, 0.03, 0.1, 1.0), 30.0

_marks = re.compile("[̀-ͯ­​-‏⁠﻿]+")
_tags = re.compile(r"</?[A-Za-z!][^<>]{0,300}>")
_inline = re.compile(r"</?(?:a|b|em|font|i|mark|small|span|strong|sub|sup|u)\b[^<>]{0,300}>", re.I)
_words = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if "<" in text:
        text = _tags.sub(" ", _inline.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _marks.sub("", unicodedata.normalize("NFKD", text))
    return _words(text.casefold())


class Index:
    """Postings of all items; word 0 is any word outside the passages. corpus: documents by pair, and all; without it the items stand for it."""

    def __init__(self, items: list[tuple[int, str | None]], corpus: tuple[dict[int, int], int] | None = None):
        passages = sorted(((i, words_of(p)) for i, p in items), key=lambda x: (len(x[1]), x[0]))
        passages = [(i, w) for i, w in passages if w]
        self.items = [i for i, _ in passages]
        self.vocabulary: dict[str, int] = {}
        for _, words in passages:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.passages = [np.array([self.vocabulary[w] for w in words]) for _, words in passages]
        self.places: dict[int, dict[int, list[int]]] = {}  # of items that were retrieved, where their words stand
        n = len(passages)
        self.size = len(self.vocabulary) + 1
        pairs = [p[:-1] * self.size + p[1:] if len(p) > 1 else p[:0] for p in self.passages]
        length = np.array([len(p) for p in self.passages], float)
        norm = K1 * (1 - B + B * length / max(length.mean() if n else 1.0, 1e-9))
        flat, item = np.concatenate([*pairs, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(n), [len(x) for x in pairs])
        posting, tf = np.unique(flat * max(n, 1) + item, return_counts=True)
        term, item = posting // max(n, 1), posting % max(n, 1)
        self.terms, df = np.unique(term, return_counts=True)
        seen, total = corpus or (dict(zip(self.terms.tolist(), df.tolist())), n)
        often = np.array([seen.get(t, 0) for t in self.terms.tolist()], float)
        idf = np.log(1 + (max(total, 1) - np.minimum(often, total) + 0.5) / (often + 0.5))
        impact = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[item]) if n else np.zeros(0)
        spread = np.repeat(often, df)
        self.least, keep = np.zeros(n, np.float32), np.zeros(len(item), bool)
        by_item = np.argsort(item, kind="stable")
        limits = np.searchsorted(item[by_item], np.arange(n + 1))
        for k in range(n):
            mine = by_item[limits[k] : limits[k + 1]]
            for share in SHARES:
                use = mine[spread[mine] <= max(2, share * total)]
                self.least[k] = self._least(pairs[k], dict(zip(term[use].tolist(), impact[use].tolist())))
                if self.least[k] >= LEAST:
                    break
            keep[use] = True
        # postings by term and item; of each term its blocks, with where their postings begin and their largest impact
        self.terms = np.unique(term[keep])
        row, self.item, self.impact = np.searchsorted(self.terms, term[keep]), item[keep], impact[keep].astype(np.float32)
        order = np.lexsort((self.item, row))
        row, self.item, self.impact = row[order], self.item[order], self.impact[order]
        block = self.item // BLOCK
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])]) if len(row) else np.zeros(0, np.int64)
        self.block, self.block_post = block[first], np.r_[first, len(row)]
        self.block_max = np.maximum.reduceat(self.impact, first) if len(first) else self.impact
        self.term_block = np.searchsorted(row[first], np.arange(len(self.terms) + 1))
        self.term_max = np.maximum.reduceat(self.block_max, self.term_block[:-1]) if len(self.terms) else self.impact
        self.block_least = np.array([self.least[s : s + BLOCK].min() for s in range(0, n, BLOCK)], np.float32)
        self.lowest = float(self.least.min()) if n else np.inf

    @staticmethod
    def _least(pairs: np.ndarray, impact: dict[int, float]) -> float:
        own = np.array([impact.get(p, 0.0) for p in pairs.tolist()])
        scores = []
        for s in range(max(1, len(pairs) - RUN + 2)):
            run, where = np.unique(pairs[s : s + RUN - 1], return_index=True)
            scores.append(float(own[s : s + RUN - 1][where].sum()))
        return PART * min(scores)

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the index's pairs in a text and their places among the terms."""
        if len(ids) < 2 or not len(self.terms):
            return ids[:0], ids[:0]
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        key = ids[at] * self.size + ids[at + 1]
        term = np.minimum(np.searchsorted(self.terms, key), len(self.terms) - 1)
        hit = self.terms[term] == key
        return at[hit], term[hit]

    def ids(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)

    def retrieve(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(place in the text, item's place) of all queries and items at or above the item's threshold. A pair counts as often as
        a query has it, which can only raise a score."""
        at, term = self.found(ids)
        if not len(at):
            return []
        n = len(at)
        ends = np.searchsorted(at, at + RUN + SLACK)
        sums = np.r_[0.0, np.cumsum(self.term_max[term])]
        pivots = np.flatnonzero(sums[ends] - sums[:n] >= self.lowest - 0.01)
        if not len(pivots):
            return []
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, pivots, 1)
        np.add.at(cover, ends[pivots], -1)
        hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        hit, entry = _expanded(hit, self.term_block[term[hit]], self.term_block[term[hit] + 1])
        block = self.block[entry]
        reached = _reached(block, hit, self.block_max[entry], ends, n, self.block_least)
        use = np.isin(block, np.unique(block[reached]))
        hit, post = _expanded(hit[use], self.block_post[entry[use]], self.block_post[entry[use] + 1])
        item = self.item[post]
        good = _reached(item, hit, self.impact[post], ends, n, self.least)
        return sorted(zip(at[hit[good]].tolist(), item[good].tolist()))

    def verify(self, ids: np.ndarray, start: int, k: int) -> int:
        """How sure it is that RUN consecutive words of the passage lie about a place of the text, equal and in step: 2 for KEPT of them, 1 for NEAR."""
        passage, places = self.passages[k], self.places.get(k)
        if places is None:
            places = self.places[k] = {}
            for j, t in enumerate(passage.tolist()):
                places.setdefault(t, []).append(j)
        run = min(RUN, len(passage))
        kept, near_ = (-(-run * x // RUN) for x in (KEPT, NEAR))
        best = 0
        lo = max(0, start - RUN)
        diagonals: dict[int, list[int]] = {}
        for i, t in enumerate(ids[lo : start + 2 * RUN + SLACK].tolist()):
            if t:
                for j in places.get(t, ()):
                    diagonals.setdefault(i - j, []).append(j)
        for d, own in diagonals.items():
            if len(own) * (2 * DRIFT + 1) < near_:
                continue
            mask = np.zeros(len(passage) + 1, np.int64)
            for near in range(d - DRIFT, d + DRIFT + 1):
                mask[[j + 1 for j in diagonals.get(near, ())]] = 1
            if mask.sum() >= near_:
                sums = np.cumsum(mask)
                most = (sums[run:] - sums[: len(sums) - run]).max()
                if most >= kept:
                    return 2
                best = max(best, int(most >= near_))
        return best

    def leaked(self, text: str | None) -> list[tuple[int, bool]]:
        """Places of the items whose passage, or a run of it, may be in the text, and whether that is sure."""
        ids = self.ids(text)
        done: dict[int, int] = {}
        tried: dict[int, int] = {}
        for start, k in self.retrieve(ids):
            if done.get(k, 0) < 2 and start >= tried.get(k, -RUN) + RUN // 2:  # a place near one just tried shows nothing new
                tried[k], done[k] = start, max(done.get(k, 0), self.verify(ids, start, k))
        return [(k, how == 2) for k, how in done.items() if how]


def _expanded(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner as often as its range is long, with the places of the range."""
    size = stop - start
    return np.repeat(owner, size), np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _reached(group: np.ndarray, hit: np.ndarray, score: np.ndarray, ends: np.ndarray, n: int, least: np.ndarray) -> np.ndarray:
    """Which (group, hit) begin a query whose scores in the group reach the group's threshold."""
    key = group.astype(np.int64) * (n + 1) + hit
    order = np.argsort(key, kind="stable")
    sums = np.r_[0.0, np.cumsum(score[order], dtype=np.float64)]
    upto = np.searchsorted(key[order], group[order].astype(np.int64) * (n + 1) + ends[hit[order]])
    out = np.zeros(len(key), bool)
    out[order] = sums[upto] - sums[:-1] >= least[group[order]] - 0.01
    return out


def index_of(documents: DataFrame, items: DataFrame, text: str = "text") -> Index:
    """The items are a small fixed table (their size is the evaluation's, not the corpus's), and so are their pairs."""
    own = [(r.item_id, r.passage) for r in items.select("item_id", "passage").orderBy("item_id").collect()]
    shared = documents.sparkSession.sparkContext.broadcast(Index(own))

    def run(batches):
        import pyarrow as pa

        index = shared.value
        counts, total = np.zeros(len(index.terms), np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                counts[np.unique(index.found(index.ids(t))[1])] += 1
                total += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[index.terms[some], -1], pa.int64()), pa.array(np.r_[counts[some], total], pa.int64())], names=["pair", "n"])

    rows = documents.where(F.length(text) > 0).select(text).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    seen = {r.pair: r.n for r in rows}
    return Index(own, (seen, seen.pop(-1, 0)))


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, question_share, answer): the leaked items of each document, with the share of the question's words
    and whether the whole answer stand in the document too."""
    sc = documents.sparkSession.sparkContext
    asked = {r.item_id: (set(words_of(r.question)), words_of(r.answer)) for r in items.select("item_id", "question", "answer").collect()}
    shared = sc.broadcast((index_of(documents, items, text), asked))

    def make():
        index, questions = shared.value

        def batch(keys, texts):
            out_key, out_item, share, answer = [], [], [], []
            for key_, t in zip(keys, texts):
                found = index.leaked(t)
                if found:
                    words = words_of(t)
                    present, running = set(words), " " + " ".join(words) + " "
                    for k, sure in found:
                        q, a = questions[index.items[k]]
                        asked_, whole = len(q & present) / len(q) if q else 0.0, bool(a) and f" {' '.join(a)} " in running
                        if sure or whole and asked_ >= ASKED:
                            out_key.append(key_)
                            out_item.append(index.items[k])
                            share.append(asked_)
                            answer.append(whole)
            return out_key, out_item, share, answer

        return batch

    kind = documents.schema[key].dataType.simpleString()
    return map_rows(documents.where(F.length(text) > 0), [key, text], make, f"{key} {kind}, item_id long, question_share double, answer boolean")
