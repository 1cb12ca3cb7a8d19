"""Problem 10: the reading level of a document.

For each step of the scale (to 2, to 3) two interpolated n-gram models (word bigrams, unigrams, uniform) are trained, on
the texts rated below the step and on those at or above it, and one unigram comparison per language tells languages apart. The
surprisal of every word of a document under both models gives the distribution of its difficulty at that step (surprisal
among the lower texts less surprisal among the higher ones, in nats). What of this distribution is mapped, its mean or that drawn towards
a decile, is chosen by the least error on texts the models have not seen. It is mapped to the share of raters who put such a
text at or above the step by isotonic regression, in each language and fitted on scores of texts that the models of their fold
have not seen. A text is beyond a step when this share is over a half. Wrong ratings are outvoted, since the mapping is
monotone and averages.

Training counts words and pairs of words of all rated documents, by fold, so that the models of a fold are made of the counts of the
other ones; the measures are pooled in sorted pieces, whose blocks are pooled again. The driver gets counts and blocks. Scoring reads every document whole. Null and blank texts and texts
in other languages get no row. A text without any known word gets the level of the middle of the ratings. Repeated rows
come out as often as they came in; a document rated twice counts with its mean rating; null ratings are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.arrow import map_rows
from gleanery.session import broadcastable, checkpointed

LEVELS = (1, 2, 3)
STEPS = LEVELS[1:]
LANGUAGES = ("de", "en", "es", "fr", "pt")
FOLDS = 6
#: A word of fewer rated documents is unknown.
RARE = 3
#: Ratings up to which they are broadcast to the documents, and rated documents that are measured at once.
BROADCAST_ROWS, AT_ONCE = 2_000_000, 5000
#: A language with fewer rated texts is mapped with all languages together.
OWN_LANGUAGE = 60
#: Shares of the lower and the upper decile that may be added to the mean.
MIXES = ((0.0, 0.0), (0.25, 0.0), (0.0, 0.25), (0.25, 0.25))
#: Weights of bigram and unigram; the rest goes to the uniform model.
BIGRAM, UNIGRAM = 0.5, 0.45
#: A text is in one of LANGUAGES if at least so many of its letters are Latin and so many of its words are known in one of them.
LATIN, KNOWN = 0.5, 0.15

_words = re.compile(r"[^\W\d_]+").findall
_latin = re.compile(r"[A-Za-zÀ-ɏ]")
_other = re.compile(r"[^\W\d_A-Za-zÀ-ɏ]")


@dataclass(frozen=True)
class Model:
    """N-gram models of both sides of each step over one vocabulary, as arrays; ids are 1.. and 0 is any unknown word."""

    vocabulary: dict[str, int]
    pairs: np.ndarray
    pair_gain: np.ndarray
    word_gain: np.ndarray
    spoken: np.ndarray

    def gains(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each step and word how much more surprising the word is among the lower texts."""
        out = self.word_gain[:, ids]
        if len(ids) > 1 and len(self.pairs):
            key = ids[:-1] * self.word_gain.shape[1] + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = (self.pairs[at] == key) & ~first[1:]
            out[:, 1:][:, hit] = self.pair_gain[:, at[hit]]
        return out


def ids_of(texts: list[str | None], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts in a row and words per text."""
    flat: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    get = vocabulary.get
    for i, t in enumerate(texts):
        if t:
            own = [get(w, 0) for w in _words(t.lower())]
            counts[i] = len(own)
            flat += own
    return np.array(flat, np.int64), counts


def side_of(levels: np.ndarray) -> np.ndarray:
    """How many steps each rating is at or above."""
    return sum((levels >= step - 0.5).astype(int) for step in STEPS)


def model_of(vocabulary: dict[str, int], by_language: np.ndarray, one: np.ndarray, pairs: np.ndarray, two: np.ndarray) -> Model:
    """Models from counts: of words by language (other languages last) and by steps passed, and of pairs by steps passed."""
    size = len(vocabulary) + 1
    spoken = np.zeros((len(LANGUAGES), size), bool)
    words = by_language.sum(1)
    for j in range(len(LANGUAGES)):
        rest = (by_language.sum(0) - by_language[j]) / max(1, words.sum() - words[j])
        spoken[j] = by_language[j] / max(1, words[j]) > rest
    spoken[:, 0] = False
    pair_gain, word_gain = np.zeros((len(STEPS), len(pairs))), np.zeros((len(STEPS), size))
    for i in range(len(STEPS)):
        for sign, own in ((-1, slice(i + 1)), (1, slice(i + 1, None))):
            single, double = one[own].sum(0), two[own].sum(0)
            before = np.bincount(pairs // size, double, size)
            word = (single + 0.1) / (single.sum() + 0.1 * size)
            uniform = (1 - UNIGRAM - BIGRAM) / size
            word_gain[i] += sign * np.log((UNIGRAM + BIGRAM) * word + uniform)
            pair_gain[i] += sign * np.log(BIGRAM * double / np.maximum(before[pairs // size], 1) + UNIGRAM * word[pairs % size] + uniform)
    word_gain[:, 0] = 0.0
    return Model(vocabulary, pairs, pair_gain, word_gain, spoken)


def fit_models(texts: list[str], levels: np.ndarray, langs: list[str | None]) -> Model:
    """Models of the texts below and above each step."""
    seen = Counter(w for t in texts for w in set(_words(t.lower())))
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= RARE), 1)}
    size = len(vocabulary) + 1
    ids, counts = ids_of(texts, vocabulary)
    doc = np.repeat(np.arange(len(texts)), counts)
    spoken = np.array([LANGUAGES.index(x) if (x := (lang or "")[:2].lower()) in LANGUAGES else len(LANGUAGES) for lang in langs], int)[doc]
    side = side_of(levels)[doc]
    key = ids[:-1] * size + ids[1:]
    inside = doc[:-1] == doc[1:]
    pairs, at = np.unique(key[inside], return_inverse=True)
    by_language = np.stack([np.bincount(ids[spoken == j], minlength=size) for j in range(len(LANGUAGES) + 1)])
    one = np.stack([np.bincount(ids[side == c], minlength=size) for c in range(len(LEVELS))])
    two = np.stack([np.bincount(at[side[:-1][inside] == c], minlength=len(pairs)) for c in range(len(LEVELS))])
    return model_of(vocabulary, by_language, one, pairs, two)


@dataclass(frozen=True)
class Counts:
    """Counts of rated texts by fold over all words that some model knows; place 0 is any other word. docs: texts with each word,
    at 0 all texts; by_language and one: words as in ``model_of``; entries: pair times cells plus cell, sorted, with their times,
    where a cell is a fold and the steps passed."""

    words: list[str]
    docs: np.ndarray
    by_language: np.ndarray
    one: np.ndarray
    entries: np.ndarray
    times: np.ndarray

    def texts_beside(self, away: int) -> int:
        return int(np.delete(self.docs[:, 0], away).sum())

    def model(self, away: int = -1) -> Model:
        """The models of all texts but those of a fold, as ``fit_models`` makes them."""
        rest = np.arange(FOLDS) != away
        keep = self.docs[rest].sum(0) >= RARE
        keep[0] = False
        place = np.where(keep, np.cumsum(keep), 0)
        size, old = int(keep.sum()) + 1, len(place)
        placed = lambda of: np.stack([np.bincount(place, row, size) for row in of[rest].sum(0)])
        key, cell = np.divmod(self.entries, FOLDS * len(LEVELS))
        use = rest[cell // len(LEVELS)]
        key, side, times = key[use], cell[use] % len(LEVELS), self.times[use]
        pairs, at = np.unique(place[key // old] * size + place[key % old], return_inverse=True)
        two = np.stack([np.bincount(at[side == c], times[side == c], len(pairs)) for c in range(len(LEVELS))])
        return model_of({w: int(i) for w, i in zip(self.words, place[1:]) if i}, placed(self.by_language), placed(self.one), pairs, two)


def measure(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: mean difficulty at each step, then the words' lower and upper decile at the last step and the number
    of words; its language's place in LANGUAGES; whether it is in one of them."""
    ids, counts = ids_of(texts, model.vocabulary)
    n = len(texts)
    doc = np.repeat(np.arange(n), counts)
    first = np.ones(len(ids), bool)
    first[1:] = doc[1:] != doc[:-1]
    gain = model.gains(ids, first)
    known = ids > 0
    weight = np.maximum(np.bincount(doc[known], minlength=n), 1)
    means = [np.bincount(doc[known], g[known], minlength=n) / weight for g in gain]
    sorted_gain = gain[-1][np.lexsort((gain[-1], doc))]
    starts = np.cumsum(counts) - counts
    deciles = []
    for q in (0.1, 0.9):
        at = starts + (q * np.maximum(counts - 1, 0)).astype(int)
        deciles.append(np.where(counts > 0, sorted_gain[np.minimum(at, max(0, len(ids) - 1))], 0.0) if len(ids) else np.zeros(n))
    speaks = np.stack([np.bincount(doc, row[ids], minlength=n) for row in model.spoken])
    latin = np.array([bool(t) and (t.isascii() or not (other := len(_other.findall(t))) or len(_latin.findall(t)) * (1 - LATIN) >= LATIN * other) for t in texts], bool)
    return np.stack([*means, *deciles, counts], 1), speaks.argmax(0), latin & (counts > 0) & (speaks.max(0, initial=0) >= KNOWN * counts)


def pooled(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool adjacent violators of points in order, y being means of n: the last x, the mean and the size of each block."""
    means: list[float] = []
    sizes: list[int] = []
    ends: list[float] = []
    for end, mean, size in zip(x.tolist(), y.tolist(), n.tolist()):
        means.append(mean), sizes.append(size), ends.append(end)
        while len(means) > 1 and means[-2] >= means[-1]:
            both = sizes[-2] + sizes[-1]
            means[-2:] = [(means[-2] * sizes[-2] + means[-1] * sizes[-1]) / both]
            sizes[-2:], ends[-2:] = [both], [ends[-1]]
    return np.array(ends), np.array(means), np.array(sizes, int)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest y over x."""
    order = np.argsort(x, kind="stable")
    return pooled(x[order].astype(float), y[order].astype(float), np.ones(len(x), int))[:2]


@dataclass(frozen=True)
class Reader:
    """maps: for each step and language the knots and values of the isotonic regression; mixes: for each step what is added to the
    mean, as shares of the lower and the upper decile."""

    model: Model
    maps: list[list[tuple[np.ndarray, np.ndarray]]]
    mixes: list[tuple[float, float]]

    def level(self, x: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Levels of texts, given what ``measure`` says of them."""
        out = np.full(len(x), LEVELS[0])
        for i, of in enumerate(self.maps):
            difficulty = mixed(x, i, self.mixes[i])
            for j, (knots, values) in enumerate(of):
                own = np.flatnonzero(language == j)
                if len(knots) and len(own):
                    share = values[np.minimum(np.searchsorted(knots, difficulty[own]), len(knots) - 1)]
                    out[own] += share > 0.5
                elif i == 0:
                    out[own] += 1  # nothing is known: the middle
        return out


def mixed(x: np.ndarray, step: int, mix: tuple[float, float]) -> np.ndarray:
    """What is mapped at a step: the mean of the distribution, drawn towards its deciles."""
    return x[:, step] + mix[0] * x[:, len(STEPS)] + mix[1] * x[:, len(STEPS) + 1]


def unseen(texts: list[str], levels: np.ndarray, langs: list[str | None], away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(measures, languages) of the texts that are away, by models of the others."""
    own = fit_models([t for t, a in zip(texts, away) if not a], levels[~away], [x for x, a in zip(langs, away) if not a])
    x, said, _ = measure([t for t, a in zip(texts, away) if a], own)
    return x, said


def reader_of(model: Model, x: np.ndarray, language: np.ndarray, levels: np.ndarray) -> Reader:
    """The maps from measures of texts that the models have not seen; of the mixes the one with the least error, the mean on a tie."""
    maps, mixes = [], []
    parts = []
    for j in range(len(LANGUAGES)):
        own = language == j
        parts.append(own if own.sum() >= OWN_LANGUAGE else np.ones(len(levels), bool))
    for i, step in enumerate(STEPS):
        beyond = np.clip(levels - step + 1, 0, 1)
        tried = []
        for mix in MIXES:
            score = mixed(x, i, mix)
            of = [isotonic(score[own], beyond[own]) for own in parts]
            error = 0.0
            for j, (knots, values) in enumerate(of):
                own = np.flatnonzero(language == j)
                if len(own):
                    error += np.square(values[np.minimum(np.searchsorted(knots, score[own]), len(knots) - 1)] - beyond[own]).sum()
            tried.append((round(error, 9), of, mix))
        _, of, mix = min(tried, key=lambda t: t[0])
        maps.append(of)
        mixes.append(mix)
    return Reader(model, maps, mixes)


def maps_of(measures: DataFrame) -> tuple[list[list[tuple[np.ndarray, np.ndarray]]], list[tuple[float, float]]]:
    """(maps, mixes) as ``reader_of`` makes them, from measures (level, language, x0, x1 ...) that stay distributed: sorted by score they
    are pooled in pieces, and the pieces' blocks on the driver, which gives the same blocks. Of equal scores the higher rating is
    first, so that they are one block."""
    number = dict(measures.groupBy("language").agg(F.count("*")).collect())
    alone = [j for j in range(len(LANGUAGES)) if number.get(j, 0) >= OWN_LANGUAGE]
    few = measures.where(~F.col("language").isin(alone)).toArrow() if sum(number.values()) else None  # under OWN_LANGUAGE of each
    together = len(LANGUAGES)
    trials = [(i, mix) for i in range(len(STEPS)) for mix in MIXES]
    lower, upper = F.col(f"x{len(STEPS)}"), F.col(f"x{len(STEPS) + 1}")
    scores = F.array(*(F.struct(F.lit(t).alias("trial"), (F.col(f"x{i}") + mix[0] * lower + mix[1] * upper).alias("score"), F.least(F.greatest(F.col("level") - STEPS[i] + 1, F.lit(0.0)), F.lit(1.0)).alias("y")) for t, (i, mix) in enumerate(trials)))
    groups = F.filter(F.array(F.when(F.col("language").isin(alone), F.col("language")), F.lit(None if len(alone) == len(LANGUAGES) else together).cast("int")), lambda g: g.isNotNull())
    points = measures.select("language", scores.alias("s"), groups.alias("g")).select(F.explode("g").alias("of"), "s").select("of", F.explode("s").alias("s")).select("of", "s.*")
    ordered = points.repartitionByRange("trial", "of", "score").sortWithinPartitions("trial", "of", "score", F.desc("y"))

    def make():
        def batch(*columns):
            of, trial, score, y = map(np.array, columns)
            out = [[], [], [], [], [], []]
            edges = np.flatnonzero((np.diff(of) != 0) | (np.diff(trial) != 0)) + 1
            for a, z in zip([0, *edges], [*edges, len(of)]):
                ends, means, sizes = pooled(score[a:z], y[a:z], np.ones(z - a, int))
                squares = [float(np.square(y[a:z]).sum()), *[0.0] * (len(ends) - 1)]
                for column, x in zip(out, ([trial[a]] * len(ends), [of[a]] * len(ends), ends, means, sizes, squares)):
                    column.extend(x)
            return out

        return batch

    got = map_rows(ordered, ["of", "trial", "score", "y"], make, "trial int, of int, last double, mean double, n long, squares double").toArrow()
    trial, of, last, mean, n, squares = (c.to_numpy() for c in got.columns)
    order = np.lexsort((-mean, last, of, trial))
    trial, of, last, mean, n, squares = (c[order] for c in (trial, of, last, mean, n, squares))
    maps, mixes = [], []
    for i, step in enumerate(STEPS):
        tried = []
        for t, (of_step, mix) in enumerate(trials):
            if of_step != i:
                continue
            found, error = {}, 0.0
            for j in (*alone, together):
                own = (trial == t) & (of == j)
                knots, values, sizes = pooled(last[own], mean[own], n[own])
                found[j] = knots, values
                if j != together:
                    error += squares[own].sum() - (sizes * np.square(values)).sum()
            if few is not None and len(few):
                level, _, *x = (c.to_numpy() for c in few.columns)
                knots, values = found[together]
                score = mixed(np.stack(x, 1), i, mix)
                error += np.square(values[np.minimum(np.searchsorted(knots, score), len(knots) - 1)] - np.clip(level - step + 1, 0, 1)).sum()
            tried.append((round(float(error), 9), [found.get(j, found[together]) for j in range(len(LANGUAGES))], mix))
        _, maps_, mix = min(tried, key=lambda x: x[0])
        maps.append(maps_)
        mixes.append(mix)
    return maps, mixes


def fit(texts: list[str], levels: np.ndarray, langs: list[str | None], folds: int = FOLDS) -> Reader:
    """A reader from rated texts in one process."""
    model = fit_models(texts, levels, langs)
    x, language = np.zeros((len(texts), len(STEPS) + 3)), np.zeros(len(texts), int)
    part = np.arange(len(texts)) % folds
    for k in range(folds):
        away = part == k
        if away.any() and (~away).any():
            x[away], language[away] = unseen(texts, levels, langs, away)
    return reader_of(model, x, language, levels)


def counted(rows: DataFrame) -> Counts:
    """Counts of all rated texts (text, lang, level, part)."""
    spark, languages, sides = rows.sparkSession, len(LANGUAGES) + 1, len(LEVELS)
    side = sum(((F.col("level") >= step - 0.5).cast("int") for step in STEPS), F.lit(0))
    place = F.array_position(F.array(*map(F.lit, LANGUAGES)), F.lower(F.substring(F.coalesce("lang", F.lit("")), 1, 2))).cast("int")
    cells = rows.select("text", (F.col("part") * sides + side).alias("cell"), F.when(place > 0, place - 1).otherwise(languages - 1).alias("lang"))

    def words():
        def batch(texts, cells, langs):
            found: dict[tuple[str, int], list[int]] = {}
            for t, cell, lang in zip(texts, cells, langs):
                own = _words(t.lower())
                for w, n in (*Counter(own).items(), ("", len(own))):
                    x = found.setdefault((w, cell * languages + lang), [0, 0])
                    x[0] += 1
                    x[1] += n
            return [w for w, _ in found], [c for _, c in found], [x[0] for x in found.values()], [x[1] for x in found.values()]

        return batch

    each = map_rows(cells, ["text", "cell", "lang"], words, "word string, cell int, docs long, n long").groupBy("word", "cell").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    known = each.groupBy("word").agg(F.collect_list(F.struct("cell", "docs", "n")).alias("of"), F.sum("docs").alias("docs")).where((F.col("docs") >= RARE) | (F.col("word") == ""))
    got = known.select("word", "of").toArrow().combine_chunks().sort_by("word")
    names = got["word"].to_pylist()
    if names[:1] != [""]:
        names = ["", *names]
    size = len(names)
    lists = got["of"].combine_chunks()
    flat, at = lists.flatten(), np.repeat(np.arange(size - len(got), size), lists.value_lengths().to_numpy(zero_copy_only=False))
    cell, docs, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    part, side_, lang = cell // (sides * languages), cell // languages % sides, cell % languages
    by_docs, by_language, one = np.zeros((FOLDS, size), np.int64), np.zeros((FOLDS, languages, size), np.int64), np.zeros((FOLDS, sides, size), np.int64)
    np.add.at(by_docs, (part, at), docs)
    np.add.at(by_language, (part, lang, at), n)
    np.add.at(one, (part, side_, at), n)
    for of in (by_language, one):
        of[..., 0] -= of[..., 1:].sum(-1)  # of all words those not known
    vocabulary = spark.sparkContext.broadcast({w: i for i, w in enumerate(names) if i})

    def pairs():
        known = vocabulary.value

        def batch(texts, cells):
            ids, counts = ids_of(texts, known)
            doc = np.repeat(np.arange(len(texts)), counts)
            inside = doc[:-1] == doc[1:]
            return np.unique((ids[:-1] * size + ids[1:])[inside] * (FOLDS * sides) + np.array(cells, np.int64)[doc[:-1][inside]], return_counts=True)

        return batch

    both = map_rows(cells, ["text", "cell"], pairs, "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n")).toArrow()
    vocabulary.unpersist()
    entries, times = (both[c].to_numpy() for c in ("entry", "n"))
    order = np.argsort(entries)
    return Counts(names[1:], by_docs, by_language, one, entries[order], times[order])


def train(documents: DataFrame, labels: DataFrame) -> Reader:
    """A reader from all rated documents. Each fold is a group of tasks; the driver gets counts and blocks of measures, no texts."""
    rated = checkpointed(labels.where(F.col("reading_level").between(LEVELS[0], LEVELS[-1])).groupBy("doc_id").agg(F.avg("reading_level").alias("level")))
    few = broadcastable(rated, BROADCAST_ROWS)
    rows = documents.where(F.length(F.trim("text")) > 0).select("doc_id", "text", "lang").join(F.broadcast(rated) if few else rated, "doc_id")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    if not few:
        rows = checkpointed(rows)
    counts = counted(rows)
    shared: Broadcast[Counts] = documents.sparkSession.sparkContext.broadcast(counts)
    models: dict[int, Model] = {}

    def task(key, rows):
        away = int(key[0])
        if not shared.value.texts_beside(away):
            return pd.DataFrame({c: [] for c in columns}, dtype=object)
        if away not in models:
            models.clear()  # groups of a fold mostly follow each other
            models[away] = shared.value.model(away)
        x, said, _ = measure(rows.text.tolist(), models[away])
        return pd.DataFrame(dict(zip(columns, [rows.level, said, *x.T[:-1]])))

    columns = ["level", "language", *(f"x{i}" for i in range(len(STEPS) + 2))]
    group = F.pmod(F.xxhash64(F.lit("group"), "doc_id"), F.lit(1 + int(counts.docs[:, 0].sum()) // (FOLDS * AT_ONCE))).alias("group")
    found = rows.select("text", "level", "part", group).groupBy("part", "group").applyInPandas(task, "level double, language int, " + ", ".join(f"{c} double" for c in columns[2:]))
    maps, mixes = maps_of(checkpointed(found))
    shared.unpersist()
    return Reader(counts.model(), maps, mixes)


def levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_level, to_2, to_3, tenth, ninetieth, words): a row for each document in one of LANGUAGES."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def make():
        reader = shared.value

        def batch(ids, texts):
            x, said, ours = measure(texts, reader.model)
            x, said, keep = x[ours], said[ours], np.flatnonzero(ours)
            return [ids[i] for i in keep], reader.level(x, said), *x.T[:-1], x[:, -1].astype(int)

        return batch

    return map_rows(documents, ["doc_id", "text"], make, "doc_id long, reading_level int, to_2 double, to_3 double, tenth double, ninetieth double, words int")
