"""Problem 4: standing lines of a site.

A line is known by the XXH64 of its letters in lower case. Each task keeps one mergeable Misra-Gries
summary per domain: at most ``counters`` counters; on overflow all counters fall by the one that would be
next, and this loss is added to the summary's error. Summaries merge by addition, so a line's true count is at
most its counter plus the domain's errors, and every line that can reach the limit becomes a candidate.
Where the errors of a domain reach the limit itself, a line may have dropped out of all its summaries; the
lines of such a domain are counted without a summary. A second pass counts the candidates exactly, in
distinct texts of the domain.

Null and empty texts, rows without a domain and lines without letters take no part. Repeated rows are listed
as often as they occur, while equal texts count once. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import defaultdict

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.urls import page_domain
from gleanery.llm.arrow import map_rows
from gleanery.session import broadcastable, checkpointed

LEAST_TEXTS, SHARE = 5, 10
COUNTERS = 2048
#: A candidate or confirmed set of up to so many (domain, line) rows is broadcast, 24 bytes each; a larger one is joined by shuffle.
BROADCAST_ROWS = 400_000
SALTS = 32

_other = re.compile(r"[\W\d_]+")


def line_key(line: str) -> int:
    """Signed XXH64 of the line's letters, 0 without any."""
    letters = _other.sub("", line.lower())
    return xxhash.xxh64_intdigest(letters, 42) - (1 << 63) if letters else 0


class Summary:
    """Misra-Gries counters of one stream."""

    __slots__ = ("counts", "error", "size")

    def __init__(self, size: int):
        self.counts: dict[int, int] = {}
        self.error, self.size = 0, size

    def add(self, key: int, times: int = 1) -> None:
        self.counts[key] = self.counts.get(key, 0) + times
        if len(self.counts) > 2 * self.size:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > self.size:
            loss = sorted(self.counts.values())[-self.size - 1]
            self.error += loss
            self.counts = {k: c - loss for k, c in self.counts.items() if c > loss}


def _texts(df: DataFrame, key: str, text: str, domain: Column) -> DataFrame:
    return df.where(F.length(text) > 0).select(F.col(key), domain.alias("_domain"), F.col(text).alias("_text")).where("_domain != ''")


def summaries(texts: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(domain, line, estimate, error): counters of all tasks' summaries; error is given once per summary, on line 0."""

    def run(batches):
        import pyarrow as pa

        found: dict[str, Summary] = defaultdict(lambda: Summary(counters))
        seen: set[int] = set()
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                copy = xxhash.xxh3_64_intdigest(d + "\n" + t)
                if copy in seen:
                    continue
                seen.add(copy)
                s = found[d]
                for k in {line_key(x) for x in t.split("\n")} - {0}:
                    s.add(k)
        rows = []
        for d, s in found.items():
            s.shrink()
            rows += [(d, k, c, 0) for k, c in s.counts.items()]
            rows.append((d, 0, 0, s.error))
        cols = list(zip(*rows)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["domain", "line", "estimate", "error"])

    return texts.select("_domain", "_text").mapInArrow(run, "domain string, line long, estimate long, error long")


def candidates(texts: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(domain, line, least): lines whose count may reach ``least``, the larger of LEAST_TEXTS and a tenth of the domain's distinct texts."""
    total = texts.select("_domain", F.xxhash64("_text", F.length("_text")).alias("h")).distinct().groupBy(F.col("_domain").alias("domain")).agg(F.ceil(F.count("*") / F.lit(SHARE)).alias("n"))
    merged = summaries(texts, counters).groupBy("domain", "line").agg(F.sum("estimate").alias("estimate"), F.sum("error").alias("error"))
    errors = merged.where("line = 0").select("domain", F.col("error").alias("loss"))
    limits = total.join(errors, "domain").select("domain", "loss", F.greatest(F.lit(LEAST_TEXTS), "n").alias("least"))
    limits = checkpointed(limits)
    sure = merged.where("line != 0").join(limits.where("loss < least"), "domain").where("estimate + loss >= least").select("domain", "line", "least")
    open_domains = limits.where("loss >= least").select("domain", "least")
    return sure if open_domains.isEmpty() else sure.unionByName(counted(texts, open_domains))


def counted(texts: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain, line, least): lines in at least ``least`` distinct texts of the given domains (domain, least), counted exactly."""
    own = texts.select(F.col("_domain").alias("domain"), "_text").join(_small(domains.select("domain")), "domain", "left_semi").distinct()

    def batch(names, values):
        doms, lines = [], []
        for d, t in zip(names, values):
            keys = {line_key(x) for x in t.split("\n")} - {0}
            doms += [d] * len(keys)
            lines += keys
        return doms, lines

    counts = map_rows(own, ["domain", "_text"], lambda: batch, "domain string, line long").groupBy("domain", "line").agg(F.count("*").alias("n"))
    return counts.join(_small(domains), "domain").where("n >= least").select("domain", "line", "least")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if broadcastable(df, BROADCAST_ROWS) else df


def _matched(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """rows joined to known lines (domain, line): broadcast behind a count, else by shuffle in SALTS parts a line, for a standing line of
    the largest site may hold a large share of all rows."""
    if broadcastable(known, BROADCAST_ROWS):
        return rows.join(F.broadcast(known), ["domain", "line"], how)
    parts = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("copy", F.lit(SALTS)).cast("int")).join(parts, ["domain", "line", "salt"], how).drop("salt")


def occurrences(df: DataFrame, key: str = "result_id", text: str = "fetched_text", domain: Column | None = None, counters: int = COUNTERS) -> DataFrame:
    """(key, line_no) of each standing line of each text."""
    texts = _texts(df, key, text, page_domain() if domain is None else domain)
    likely = checkpointed(candidates(texts, counters))
    kind = df.schema[key].dataType.simpleString()

    def make():
        def batch(keys, domains, values):
            ids, doms, copies, numbers, lines = [], [], [], [], []
            for k, d, t in zip(keys, domains, values):
                copy = xxhash.xxh3_64_intdigest(t) - (1 << 63)
                own = [(n, line_key(x)) for n, x in enumerate(t.split("\n"))]
                own = [x for x in own if x[1]]
                ids += [k] * len(own)
                doms += [d] * len(own)
                copies += [copy] * len(own)
                numbers += [x[0] for x in own]
                lines += [x[1] for x in own]
            return ids, doms, copies, numbers, lines

        return batch

    lines = map_rows(texts, [key, "_domain", "_text"], make, f"{key} {kind}, domain string, copy long, line_no int, line long")
    hits = checkpointed(_matched(lines, likely, "inner"))
    confirmed = hits.select("domain", "line", "copy", "least").distinct().groupBy("domain", "line").agg(F.count("*").alias("n"), F.first("least").alias("least")).where("n >= least").select("domain", "line")
    return _matched(hits, checkpointed(confirmed), "left_semi").select(key, "line_no")


def cleaned(df: DataFrame, key: str = "result_id", text: str = "fetched_text", domain: Column | None = None) -> DataFrame:
    """(key, removed, cleaned_text): each row's text without its site's standing lines; null stays null.

    The line numbers of a key are gathered as a set, whose size is bounded by the lines of its text.
    """
    gone = occurrences(df, key, text, domain).groupBy(key).agg(F.collect_set("line_no").alias("_gone"))
    split = F.split(F.col(text), "\n")
    kept = F.filter(F.transform(split, lambda x, i: F.when(~F.array_contains("_gone", i), x)), lambda x: x.isNotNull())
    return df.select(key, text).join(gone, key, "left").select(key, F.coalesce(F.size("_gone"), F.lit(0)).alias("removed"), F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.concat_ws("\n", kept)).alias("cleaned_text"))
