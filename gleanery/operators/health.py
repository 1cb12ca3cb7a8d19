"""Counts and means of runs and domains, each one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import country, tenth
from gleanery.functions.urls import host

GROUPS = {
    "n_full_text": ["full_text"], "n_partial": ["partial_text", "low_confidence"], "n_failed": ["failed", "url_only"], "n_bot_blocked": ["bot_blocked"],
    "n_auth_required": ["auth_required"], "n_rate_limited": ["rate_limited"], "n_robots_disallowed": ["robots_disallowed"],
}


def number(c: Column) -> Column:
    """A number from a value of any kind: blanks are 0, other text without a number is null."""
    s = F.trim(c.cast("string"))
    return F.when(s == "", 0.0).otherwise(F.when(s.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), s.try_cast("double")))


def mean(c: Column) -> Column:
    """A mean from an exact sum, so that it doesn't depend on the order of rows."""
    return F.try_divide(F.sum(c.try_cast("decimal(24,6)")).cast("double"), F.count(c))


def count_of(labels: list[str], c: str = "quality_label") -> Column:
    return F.count_if(F.coalesce(F.col(c), F.lit("")).isin(labels))


def domain_of(*urls: str) -> Column:
    """The host of the first address that isn't empty, 'unknown' if it has none."""
    first = F.coalesce(*(F.nullif(F.col(u), F.lit("")) for u in urls))
    return F.coalesce(F.nullif(host(first), F.lit("")), F.lit("unknown"))


def domain_health(rows: DataFrame, domain: Column, server: bool = True) -> DataFrame:
    """Per domain: rows, label counts, means to a tenth. server: what is no number counts as 0, else it is left out."""
    means = {"avg_extraction_score": "extraction_score", "avg_quality_score": "quality_score", "avg_alignment_score": "summary_alignment_score"}
    one = lambda c: F.coalesce(number(F.col(c)), F.lit(0.0)) if server else number(F.col(c))
    aggs = [count_of(v).alias(k) for k, v in GROUPS.items()]
    aggs += [tenth(F.coalesce(mean(one(c)), F.lit(0.0))).alias(k) if c in rows.columns else F.lit(0.0).alias(k) for k, c in means.items()]
    return rows.withColumn("domain", domain).groupBy("domain").agg(F.count("*").alias("n_rows"), *aggs)


def in_order(health: DataFrame) -> DataFrame:
    return health.orderBy(F.desc("n_rows"), F.desc("n_full_text"), "domain")


def panel(health: DataFrame, *also: str) -> DataFrame:
    """The columns of domain health that its panel shows."""
    shown = [c for c in GROUPS if c != "n_robots_disallowed"]
    return health.select(*also, "domain", "n_rows", *shown, "avg_extraction_score", "avg_quality_score", "avg_alignment_score")


def run_summary(rows: DataFrame, by: list[str] | None = None, ai_calls: int | None = None, ai_calls_saved: int | None = None, elapsed_ms: int | None = None) -> DataFrame:
    """Counters of a run. Here robots and rate limits are failures too. What the rows don't show (model calls, time) is given by the caller."""
    aggs = [
        F.count("*").alias("input_rows"), F.count_distinct("dedupe_key").alias("jobs"), (F.count("*") - F.count_distinct("dedupe_key")).alias("requests_saved"), count_of(["full_text"]).alias("full_text_rows"),
        count_of(["partial_text", "low_confidence"]).alias("partial_rows"), count_of(["failed", "url_only", "robots_disallowed", "rate_limited"]).alias("failed_rows"),
        count_of(["bot_blocked"]).alias("bot_blocked_rows"), count_of(["auth_required"]).alias("auth_required_rows"),
    ]
    aggs += [F.lit(v).cast("long").alias(k) for k, v in (("ai_calls", ai_calls), ("ai_calls_saved", ai_calls_saved), ("elapsed_ms", elapsed_ms)) if v is not None]
    return rows.groupBy(*(by or [])).agg(*aggs) if by else rows.agg(*aggs)


def merged(parts: DataFrame, by: str) -> DataFrame:
    """Finished summaries of chunks added up."""
    return parts.groupBy(by).agg(*(F.sum(c).alias(c) for c, t in parts.dtypes if c != by and t in ("bigint", "int")))


def filtered_statistics(rows: DataFrame, national: Column) -> DataFrame:
    """Counts and means over a filtered view; means are null without numbers."""
    us = F.lower(country(F.col("outlet_country"))) == "united states"
    review = F.col("review_status")
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.col("quality_label") == "full_text").alias("full_text"), F.count_if(national).alias("national"), F.count_if(national & us).alias("us_national"),
        F.count_if(review == "approved").alias("approved"), F.count_if(F.coalesce(review, F.lit("unreviewed")).isin("needs-better-scrape", "unreviewed")).alias("needs_review"),
        F.avg(number(F.col("quality_score"))).alias("mean_quality"), F.avg(number(F.col("summary_alignment_score"))).alias("mean_alignment"),
    )
