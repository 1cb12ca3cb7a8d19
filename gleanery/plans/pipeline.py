"""The whole run as one plan: group, extract the representatives' pages, choose, expand, and sum up.

Pages come from provider tables: live (url, html, http_status, error), reader (url, body, http_status), robots (host, robots_txt,
http_status), archive index (url, timestamp, original, statuscode, mimetype, digest) and archive pages (timestamp, original, html,
http_status). Jobs are joined to them by address; nothing is fetched here. Results of earlier runs come in as a cache (cache_key,
result as JSON of a row's recovered columns, expires_at), and a model as a function.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as X
from gleanery.functions.constants import RESULT_DEFAULTS
from gleanery.functions.urls import canonical_url, host
from gleanery.operators import dedupe, enrich, extract, health, rank
from gleanery.plans.options import Options
from gleanery.session import checkpointed
from gleanery.sources import io


@dataclass(frozen=True)
class Run:
    rows: DataFrame
    summary: DataFrame
    health: DataFrame


def jobs_of(chosen: DataFrame) -> DataFrame:
    """(job_key, row_id, url, host) of the groups' representatives; url is '' where it is none."""
    return chosen.select(F.col("dedupe_key").alias("job_key"), F.col("representative_row").alias("row_id"), canonical_url("representative_url").alias("url")).withColumn("host", host(F.col("url")))


def archived(todo: DataFrame, o: Options, index: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates of the jobs' snapshots, latest first, up to the first that is good enough; of all snapshots with the profile maximum."""
    shots = rank.snapshots(index.join(todo.select("url").distinct(), "url", "left_semi"))
    own = shots.select("url", "timestamp", "original", "place").join(pages.dropDuplicates(["timestamp", "original"]), ["timestamp", "original"])
    jobs = todo.select("job_key", F.col("url").alias("page")).join(own.withColumnRenamed("url", "page"), "page")
    each = F.concat_ws("\n", "job_key", F.col("place").cast("string"))
    named = jobs.select(each.alias("job_key"), io.snapshots_url(F.col("timestamp"), F.col("original")).alias("url"), "html", "http_status", F.lit("").alias("error"))
    found = extract.extracted(named, o.min_chars, "archive")
    found = found.withColumn("place", F.substring_index("job_key", "\n", -1).cast("int")).withColumn("job_key", F.expr("substring_index(job_key, '\\n', 1)"))
    kept = rank.snapshot_stop(found, enough=float("inf") if o.profile == "maximum" else 82)
    return kept.withColumn("seq", F.col("place") * 1000 + F.col("seq")).drop("place")


def cache_key(url: Column, o: Options) -> Column:
    return io.cache_key(url, o.route, o.profile, o.min_chars, o.use_reader, o.use_archive, o.respect_robots)


def recovered(jobs: DataFrame, o: Options, live: DataFrame | None, reader: DataFrame | None, robots: DataFrame | None, agent: str = "gleanery", index: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """One result per job, by row_id."""
    gated = io.robots_gate(jobs, robots, agent) if robots is not None and o.respect_robots else jobs.withColumns({"robots_allowed": F.lit(True), "robots_note": F.lit("robots.txt not checked")})
    todo = gated.where("url != '' and robots_allowed")
    found = []
    for no, route in enumerate(o.routes()):
        if route == "archive" and index is not None and pages is not None:
            found.append(archived(todo, o, index, pages).withColumn("route_no", F.lit(no)))
        elif route == "live" and live is not None:
            fetched = todo.join(live, "url").select("job_key", "url", "html", "http_status", "error")
            found.append(extract.extracted(fetched, o.min_chars, "live").withColumn("route_no", F.lit(no)))
        elif route == "reader" and reader is not None:
            texts = io.reader_pages(todo.join(reader, "url")).withColumn("text", X.clean(F.col("text")))
            points = X.judged(texts, "text", F.col("http_status"), o.min_chars)
            empty = {c: F.lit("") for c in ("title", "author", "published", "site_name", "canonical_url", "error")}
            row = points.withColumns(empty | {"seq": F.lit(0), "route": F.lit("reader"), "source_url": F.col("url"), "http_status": F.col("http_status").cast("string"), "score": F.col("text_score"), "boilerplate_ratio": F.lit(0.0), "duplicate_paragraph_ratio": F.col("duplicate_ratio")})
            found.append(row.select(*(f.split()[0] for f in extract.SCHEMA.split(", ")), F.lit(no).alias("route_no")))
    out = gated
    if found:
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        kept = rank.until_full(rank.measured(every, o.min_chars), everything=o.profile == "maximum")
        b = rank.best(kept)
        columns = {
            "fetched_text": "text", "quality_label": "text_label", "extracted_headline": "title", "extracted_author": "author", "extracted_date": "published", "extracted_site_name": "site_name",
            "canonical_url": "canonical_url", "recovery_route": "route", "http_status": "http_status", "source_url_used": "source_url", "word_count": "words", "char_count": "chars", "paragraph_count": "paragraphs",
            "winning_candidate_route": "route", "boilerplate_ratio": "boilerplate_ratio", "duplicate_paragraph_ratio": "duplicate_paragraph_ratio", "candidate_count": "candidate_count", "candidate_routes": "candidate_routes", "extraction_trace_json": "extraction_trace_json",
        }
        picked = b.select("job_key", *(F.col(c).alias(k) for k, c in columns.items()), X.tenth(F.col("score")).alias("extraction_score"), X.confidence(F.col("score"), F.col("text_label")).alias("extraction_confidence_label"))
        out = gated.join(picked, "job_key", "left")
    blank = F.when(F.col("url") == "", "url_only").when(~F.col("robots_allowed"), "robots_disallowed")
    value = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v)
    filled = {c: value(c, v) for c, v in RESULT_DEFAULTS.items()} | {"quality_label": F.coalesce(blank, value("quality_label", "failed"))}
    return out.select("row_id", *(c.alias(k) for k, c in filled.items()))


def analysed(full: DataFrame, o: Options, model: Callable[[str], str] | None) -> DataFrame:
    """The rows with a model's answers: one call a key of equal stories with reuse_ai, else one a row."""
    summary = F.col(o.summary_column) if o.summary_column and o.summary_column in full.columns else None
    shared = dedupe.reuse_key(F.col("dedupe_key"), F.col("extracted_headline"), summary, F.col("row_id")) if o.reuse_ai else F.concat(F.lit("__unique_ai__"), F.col("row_id").cast("string"))
    keyed = full.withColumn("ai_key", shared)
    jobs = keyed.groupBy("ai_key").agg(F.min_by(F.coalesce("fetched_text", F.lit("")), "row_id").alias("text"), F.min("row_id").alias("row_id"))
    answers = enrich.analysed(jobs.select("ai_key", X.evidence_pack(F.col("text")).alias("pack")), model)
    return dedupe.reuse(full, answers.join(jobs.select("ai_key", "row_id"), "ai_key").drop("ai_key"), shared)


def run(
    rows: DataFrame,
    o: Options,
    live: DataFrame | None = None,
    reader: DataFrame | None = None,
    robots: DataFrame | None = None,
    index: DataFrame | None = None,
    pages: DataFrame | None = None,
    cache: DataFrame | None = None,
    now: Column | None = None,
    model: Callable[[str], str] | None = None,
) -> Run:
    """One run. Sources that the options ask for and that aren't given are an error, as are options that leave no source at all.

    The groups and the results are checkpointed, so that pages are extracted once for rows, summary and health.
    """
    began = time.monotonic()
    o = o.tuned()
    given_ = {"live": live is not None, "reader": reader is not None, "archive": index is not None and pages is not None}
    if missing := [r for r in o.routes() if not given_[r]]:
        raise ValueError(f"the options ask for sources that aren't given: {', '.join(missing)}")
    chosen = checkpointed(dedupe.groups(rows, o.group_column, o.url_column))
    todo = jobs_of(chosen)
    hits = None
    if cache is not None:
        hits, todo = io.cached(todo.withColumn("cache_key", cache_key(F.col("url"), o)), cache, F.current_timestamp() if now is None else now)
        todo = todo.drop("cache_key")
    results = recovered(todo, o, live, reader, robots, index=index, pages=pages)
    if hits is not None:
        kept = hits.select("row_id", F.from_json("result", results.drop("row_id").schema).alias("r")).select("row_id", "r.*")
        results = results.unionByName(kept)
    full = dedupe.expand(rows, checkpointed(results), o.group_column, o.url_column, chosen=chosen)
    calls = saved = 0
    if o.enable_ai:
        full = checkpointed(analysed(full, o, model))
        calls = full.select("ai_key").distinct().count()
        saved = full.count() - calls
    domain = health.domain_of("source_url_used", "canonical_url", o.url_column)
    elapsed = int(1000 * (time.monotonic() - began))
    return Run(full, health.run_summary(full, None, calls, saved, elapsed), health.in_order(health.domain_health(full, domain)))
