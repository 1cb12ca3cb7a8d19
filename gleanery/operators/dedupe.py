"""Grouping of a manifest's rows by story, choice of one representative, and expansion of its result to all members.

Keys shorter than LEAST make a row its own group. The best address wins, ties go to the earliest row; both come from one
partial aggregate, and members are joined to results on the key, so a hot story never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.constants import RESULT_DEFAULTS
from gleanery.functions.text import duplicate_key
from gleanery.functions.urls import url_points

LEAST = 8


def keyed(rows: DataFrame, by: str | None = "title", row_id: str = "row_id") -> DataFrame:
    """rows with dedupe_key; without a column to group by every row is its own."""
    key = duplicate_key(F.col(by)) if by else F.lit("")
    return rows.withColumn("dedupe_key", key).withColumn("dedupe_key", F.when(F.length("dedupe_key") < LEAST, F.concat(F.lit("__unique__"), F.col(row_id).cast("string"))).otherwise(F.col("dedupe_key")))


def groups(rows: DataFrame, by: str | None = "title", url: str = "url", row_id: str = "row_id") -> DataFrame:
    """(dedupe_key, group_size, first_row, representative_row, representative_url)."""
    best = F.max(F.struct(url_points(F.col(url)).alias("points"), (-F.col(row_id)).alias("back"), F.coalesce(url, F.lit("")).alias("url")))
    out = keyed(rows, by, row_id).groupBy("dedupe_key").agg(F.count("*").alias("group_size"), F.min(row_id).alias("first_row"), best.alias("best"))
    return out.select("dedupe_key", "group_size", "first_row", (-F.col("best.back")).alias("representative_row"), F.col("best.url").alias("representative_url"))


def statistics(rows: DataFrame, by: str | None = "title", row_id: str = "row_id") -> DataFrame:
    """(n_rows, n_groups, requests_saved, largest_group), one row; zeros for an empty table."""
    sizes = keyed(rows, by, row_id).groupBy("dedupe_key").agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return sizes.agg(total.alias("n_rows"), F.count("*").alias("n_groups"), (total - F.count("*")).alias("requests_saved"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_group"))


def expand(rows: DataFrame, results: DataFrame, by: str | None = "title", url: str = "url", row_id: str = "row_id", chosen: DataFrame | None = None) -> DataFrame:
    """Every row with the result of its group's representative (results has one row per row_id at most).

    ``chosen`` are the groups, if they are known already. A row keeps its own columns; the recovered ones come from the representative, and lineage is added.
    """
    members = keyed(rows, by, row_id)
    own = [c for c in members.columns if c not in RESULT_DEFAULTS and c != "dedupe_key"]
    found = [c for c in RESULT_DEFAULTS if c in results.columns]
    chosen = groups(rows, by, url, row_id) if chosen is None else chosen
    best = chosen.join(results.select(F.col(row_id).alias("representative_row"), *found), "representative_row", "left")
    lineage = [F.col("group_size"), F.col("representative_row"), F.col("representative_url"), (F.col("group_size") > 1).alias("scraped_once_for_group")]
    return members.select(*own, "dedupe_key").join(best, "dedupe_key", "left").select(*own, *found, "dedupe_key", *lineage)


def reuse_key(key: Column, headline: Column, summary: Column | None, row_id: Column) -> Column:
    """The key under which one model call serves several rows."""
    base = F.coalesce(F.nullif(F.trim(key), F.lit("")), duplicate_key(headline))
    base = F.when(F.length(base) < LEAST, F.concat(F.lit("__unique_ai__"), row_id.cast("string"))).otherwise(base)
    return F.concat(base, F.lit("::summary::"), F.lit("") if summary is None else duplicate_key(summary))


def reuse_groups(rows: DataFrame, key: Column, row_id: str = "row_id") -> DataFrame:
    """(ai_key, group_size, job_row): the first row of each key is its job."""
    return rows.withColumn("ai_key", key).groupBy("ai_key").agg(F.count("*").alias("group_size"), F.min(row_id).alias("job_row"))


def reuse(rows: DataFrame, results: DataFrame, key: Column, row_id: str = "row_id") -> DataFrame:
    """Every row with the model's result of its key's job: its columns override equal ones, arrays become text."""
    jobs = reuse_groups(rows, key, row_id)
    flat = results
    for name, sep in (("key_entities", ", "), ("key_quotes", " | ")):
        if name in results.columns:
            flat = flat.withColumn(name, F.array_join(name, sep))
    given = [c for c in flat.columns if c != row_id]
    done = jobs.join(flat.withColumnRenamed(row_id, "job_row"), "job_row", "left")
    own = [c for c in rows.columns if c not in given]
    return rows.select(*own).withColumn("ai_key", key).join(done, "ai_key", "left").withColumn("ai_reused", F.col("job_row") != F.col(row_id)).drop("job_row")
