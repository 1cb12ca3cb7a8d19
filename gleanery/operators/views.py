"""Filters, sorts and projections over results."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.constants import TRUE_NAMES
from gleanery.functions.text import compact, country
from gleanery.operators.health import number

#: The columns a search looks in, in the order in which they are put in a row, and those a table shows.
SEARCHED = [
    "extracted_headline", "headline", "title", "source_url_used", "canonical_url", "extracted_site_name", "outlet_country", "status",
    "ai_verification_status", "quality_label", "executive_summary", "reasoning", "fetched_text",
]
VISIBLE = [
    "quality_label", "status", "quality_score", "summary_alignment_score", "is_national_outlet", "outlet_country", "extracted_headline", "headline", "source_url_used",
    "recovery_route", "extraction_score", "extraction_confidence_label", "candidate_count", "winning_candidate_route", "word_count", "dedupe_group_size", "executive_summary", "error_message",
]
#: Reviews that still ask for work.
NEEDS_REVIEW = ["needs-better-scrape", "unreviewed"]
DETAIL_ERROR, ANY = 220, "Any"


def given(rows: DataFrame, *names: str) -> list[Column]:
    """Those of the named columns that the rows have."""
    return [F.col(n) for n in names if n in rows.columns]


def truth(c: Column) -> Column:
    """Whether a value says yes."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(TRUE_NAMES), F.lit(False))


def search(rows: DataFrame, needle: str, columns: list[str] | None = None) -> DataFrame:
    """Rows that hold the needle in their searched columns put in a row; absent columns are empty, a blank needle holds all."""
    one = lambda c: F.array_join(c, ",") if rows.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
    parts = [F.coalesce(one(c), F.lit("")) if c in rows.columns else F.lit("") for c in columns or SEARCHED]
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(needle.strip().lower())))


@dataclass(frozen=True)
class Filter:
    """A saved view: all that narrows a table, as data."""

    search: str = ""
    min_quality: float = 0
    min_alignment: float = 0
    min_words: float = 0
    national: str = "any"
    country: str = "Any"
    label: str = "Any"
    status: str = "Any"
    duplicates_only: bool = False
    review: str = "Any"
    sort: str = "quality"

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Filter:
        return cls(**{k: v for k, v in json.loads(text).items() if k in cls.__dataclass_fields__})

    def apply(self, rows: DataFrame) -> DataFrame:
        out = search(rows, self.search) if self.search.strip() else rows
        for name, least in (("quality_score", self.min_quality), ("summary_alignment_score", self.min_alignment), ("word_count", self.min_words)):
            if least:
                out = out.where(F.coalesce(number(F.col(name)), F.lit(0.0)) >= least)
        if self.national != "any":
            yes = truth(F.col("is_national_outlet"))
            out = out.where(yes if self.national == "yes" else ~yes)
        if self.country != "Any":
            out = out.where(F.lower(country(F.col("outlet_country"))) == F.lower(country(F.lit(self.country))))
        if self.label != "Any":
            out = out.where(F.coalesce("quality_label", F.lit("")) == self.label)
        if self.status != "Any":
            out = out.where(status_of(out) == self.status)
        if self.duplicates_only:
            out = out.where(F.coalesce("dedupe_group_size", F.lit(1)) >= 2)
        if self.review != "Any":
            out = out.where(F.coalesce("review_status", F.lit("unreviewed")) == self.review)
        return out


PRESETS = {
    "high-quality": Filter(min_quality=80, min_alignment=70, label="full_text"),
    "us-national": Filter(national="yes", country="United States", min_quality=50),
    "manual-review": Filter(status="NEEDS_MANUAL_REVIEW", sort="alignment"),
    "bot-blocked": Filter(label="bot_blocked"),
    "low-alignment": Filter(search="FAILED_SUMMARY_ALIGNMENT", sort="alignment"),
    "all": Filter(),
}


def status_of(rows: DataFrame) -> Column:
    """A row's own status, else that of its model call."""
    return F.coalesce(*given(rows, "status", "ai_verification_status"), F.lit("not analyzed"))


def ordered(rows: DataFrame, mode: str, row_id: str = "row_id") -> DataFrame:
    """quality, alignment, extraction and words fall; headline and country rise by Unicode collation. Ties keep the rows' order."""
    columns = {"quality": "quality_score", "alignment": "summary_alignment_score", "extraction": "extraction_score", "words": "word_count"}
    if mode in columns:
        return rows.orderBy(F.desc(F.coalesce(number(F.col(columns[mode])), F.lit(0.0))), row_id)
    text = headline(rows) if mode == "headline" else country(F.col("outlet_country"))
    return rows.orderBy(F.collate(text, "UNICODE"), row_id)


def _first(rows: DataFrame, *names: str) -> Column:
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in given(rows, *names)), F.lit(""))


def headline(rows: DataFrame) -> Column:
    """The first of a row's headlines that isn't empty, on one line."""
    return compact(F.coalesce(F.nullif(_first(rows, "headline", "extracted_headline", "title", "name"), F.lit("")), F.lit("Untitled article")), 140)


def row_key(rows: DataFrame) -> Column:
    """The key by which reviews are kept: address, headline, group key and 0."""
    url, title = _first(rows, "source_url_used", "canonical_url", "url", "link"), _first(rows, "extracted_headline", "headline", "title")
    return F.concat_ws("::", url, title, _first(rows, "dedupe_key"), F.lit("0"))


def review_queue(rows: DataFrame, limit: int = 500, row_id: str = "row_id") -> DataFrame:
    """Unreviewed first, then the worst aligned. The limit is the queue's length, a top-k."""
    needs = F.when(F.coalesce("review_status", F.lit("unreviewed")) == "unreviewed", 0).otherwise(1)
    return rows.withColumns({"needs": needs, "alignment": F.coalesce(number(F.col("summary_alignment_score")), F.lit(0.0))}).orderBy("needs", "alignment", row_id).limit(limit)


def with_review(rows: DataFrame, labels: DataFrame, key: str = "row_key") -> DataFrame:
    """rows with their key's latest review that says anything, 'unreviewed' without one; ties of time go to the later label.

    Reviews are kept by ``row_key``; rows without that column get it. Reviews are made by hand, one a row at most, and are joined by key.
    """
    rows = rows if key in rows.columns else rows.withColumn(key, row_key(rows))
    latest = labels.where("trim(review_status) != ''").groupBy(key).agg(F.max(F.struct("reviewed_at", "review_id", F.lower("review_status").alias("s"))).alias("r")).select(key, F.col("r.s").alias("review_status"))
    return rows.join(latest, key, "left").withColumn("review_status", F.coalesce(F.nullif("review_status", F.lit("")), F.lit("unreviewed")))


def options(rows: DataFrame, column: Column) -> DataFrame:
    """The values offered for a filter: 'Any', then the distinct ones by Unicode collation, empty ones left out."""
    found = rows.select(column.alias("option")).where("option != ''").distinct().withColumn("_n", F.lit(1))
    any_ = rows.sparkSession.createDataFrame([(ANY, 0)], "option string, _n int")
    return any_.unionByName(found).orderBy("_n", F.collate("option", "UNICODE")).select("option")


TRACE = "array<struct<route:string,label:string,score:double,words:long,statusCode:string,error:string,boilerplateRatio:double,selected:boolean>>"


def trace(rows: DataFrame, key: str, column: str = "extraction_trace_json") -> DataFrame:
    """(key, place, selected, route, label, score, words, status, boilerplate_percent, error) of each attempt in the traces that are JSON arrays."""
    value = F.when(F.col(column).startswith("["), F.try_variant_get(F.expr(f"try_parse_json(`{column}`)"), "$", TRACE))
    each = rows.select(key, F.posexplode(value).alias("place", "a"))
    return each.select(
        key, F.col("place").cast("long").alias("place"), F.coalesce("a.selected", F.lit(False)).alias("selected"), "a.route", "a.label", "a.score", "a.words", F.col("a.statusCode").alias("status"),
        F.floor(F.coalesce("a.boilerplateRatio", F.lit(0.0)) * 100 + 0.5).cast("long").alias("boilerplate_percent"), F.substring(F.coalesce("a.error", F.lit("")), 1, DETAIL_ERROR).alias("error"),
    )


def detail(rows: DataFrame, index: int, *order: Column | str) -> DataFrame:
    """The selected row of a filtered view, its index held within the view: headline, summary, reasoning, attempts and evidence.

    A view without rows has no detail; lists that are no JSON arrays are empty.
    """
    at = rows.orderBy(*order).limit(max(0, index) + 1).withColumn("_n", F.monotonically_increasing_id())
    last = at.orderBy(F.desc("_n")).limit(1)
    text = lambda *names: F.coalesce(*given(rows, *names), F.lit("")).cast("string")
    listed = lambda c: F.coalesce(F.expr(f"try_variant_get(try_parse_json(`{c}`), '$', 'array<variant>')"), F.expr("cast(array() as array<variant>)")) if c in rows.columns else F.expr("cast(array() as array<variant>)")
    return last.select(
        *rows.columns, headline(rows).alias("detail_headline"), text("executive_summary", "summary").alias("detail_summary"), text("summary_alignment_notes", "reasoning").alias("detail_reasoning"),
        F.transform(listed("extraction_trace_json"), lambda v: v.cast("string")).alias("detail_attempts"), F.transform(listed("evidence_json"), lambda v: v.cast("string")).alias("detail_evidence"),
    )


def history_panel(runs: DataFrame) -> DataFrame:
    """Runs as the history shows them, elapsed time in seconds to a tenth."""
    return runs.withColumn("elapsed_s", F.floor(F.col("elapsed_ms") / 100 + 0.5) / 10).drop("elapsed_ms")


def visible(rows: DataFrame) -> DataFrame:
    return rows.select(*(c for c in VISIBLE if c in rows.columns))


def preview(rows: DataFrame) -> DataFrame:
    """The first five rows and six columns, each value on one line."""
    return rows.select(*(compact(F.col(c).cast("string"), 110).alias(c) for c in rows.columns[:6])).limit(5)
