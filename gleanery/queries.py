"""The registry of the core's queries: name -> query, name -> SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as X
from gleanery.functions.constants import AUTH, BOT, DROP, JUNK, TRUE_NAMES, UK_NAMES, US_NAMES, WS
from gleanery.functions.urls import canonical_url, url_points
from gleanery.operators import dedupe, enrich, extract, health, nested, rank, views
from gleanery.plans import pipeline
from gleanery.plans.options import Options
from gleanery.sources import io
from gleanery.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _bridge(spark: SparkSession, d: str) -> DataFrame:
    traces = nested.occurrences(table(spark, d, "scrape_results"), "scrape_results", "result_id", "extraction_trace_json")
    return traces.unionByName(nested.occurrences(table(spark, d, "ai_results"), "ai_results", "ai_id", "evidence_json"))


_OBJECTS = r"""
WITH raw AS (
  SELECT 'scrape_results' AS source_table, result_id AS record_id, extraction_trace_json AS v FROM scrape_results
  UNION ALL SELECT 'ai_results', ai_id, evidence_json FROM ai_results),
open1 AS (SELECT source_table, record_id, CASE WHEN regexp_matches(v, '^\s*```') THEN regexp_extract(v, '(?s)^\s*```[^\n]*\n(.*?)\n?\s*```\s*$', 1) ELSE v END AS v FROM raw),
open2 AS (SELECT source_table, record_id, CASE WHEN v LIKE '"%' AND json_valid(v) THEN json_extract_string(v::JSON, '$') ELSE v END AS v FROM open1),
good AS (SELECT source_table, record_id, v::JSON AS v FROM open2 WHERE v IS NOT NULL AND json_valid(v) AND NOT regexp_matches(v, '^\s*-?(NaN|Infinity)')),
places AS (SELECT source_table, record_id, t.fullkey AS path, regexp_replace(t.fullkey, '(\[\d+\])+$', '') AS up FROM good, json_tree(good.v) t WHERE t.type = 'OBJECT')
"""


@query("p1_found", _OBJECTS + r"SELECT source_table, record_id, path, CASE WHEN up LIKE '%.%' THEN regexp_replace(up, '\.[^.\[]*$', '') ELSE '' END AS parent_path FROM places")
def p1_found(spark, d):
    return _bridge(spark, d).select("source_table", "record_id", "path", "parent_path")


def _bodies(spark, d):
    traces = nested.bodies(table(spark, d, "scrape_results"), "result_id", "extraction_trace_json")
    return nested.objects(traces.unionByName(nested.bodies(table(spark, d, "ai_results"), "ai_id", "evidence_json")))


@query("p1_objects")
def p1_objects(spark, d):
    return _bodies(spark, d)


@query("p1_edges")
def p1_edges(spark, d):
    return nested.edges(_bridge(spark, d))


@query("p1_fields")
def p1_fields(spark, d):
    return nested.fields(_bodies(spark, d))


@query("p1_depths", _OBJECTS + r"SELECT source_table, len(regexp_extract_all(path, '\.'))::INT AS depth, count(*) AS n_objects, count(DISTINCT record_id) AS n_records FROM places GROUP BY ALL")
def p1_depths(spark, d):
    """How many objects of how many records stand at each depth."""
    return _bridge(spark, d).groupBy("source_table", "depth").agg(F.count("*").alias("n_objects"), F.countDistinct("record_id").alias("n_records"))


@query("p1_links", _OBJECTS + r"""SELECT source_table, record_id, path, regexp_extract(up, '\.([^.\[]*)$', 1) AS field, CASE WHEN path LIKE '%]' THEN regexp_extract(path, '\[(\d+)\]$', 1)::INT END AS item FROM places""")
def p1_links(spark, d):
    """Of each object the parent's field it stands in and its place in that field's array."""
    return _bridge(spark, d).select("source_table", "record_id", "path", "field", "item")


# --- texts: cleaning, measures, scores, labels -------------------------------------------------------------------


def _quoted(names: list[str]) -> str:
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+\z', '', 'g')"


def _clean(x: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace(replace(regexp_replace(coalesce({x}, ''), '[{DROP}]', '', 'g'), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def _hits(x: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({x}), '{p}')::INT" for p in phrases) + ")"


def _measures(table_: str, key: str, text: str, status: str) -> str:
    """SQL of all measures of a text, as a list of named tables that ends in ``judged``."""
    return rf"""
WITH cleaned AS (SELECT {key}, {status} AS status, {_clean(text)} AS t FROM {table_}),
split AS (SELECT *, string_split_regex(t, '\n[{WS}]*\n') AS paras FROM cleaned),
marked AS (SELECT *, list_filter(list_transform(paras, lambda p: left(regexp_replace(lower(p), '[^A-Za-z0-9_]+', '', 'g'), 260)), lambda p: length(p) > 60) AS marks FROM split),
measured AS (
  SELECT {key}, status, length(t) AS chars, len(regexp_extract_all(t, '\b\w+[\w''-]*\b')) AS words, len(list_filter(paras, lambda p: len(regexp_extract_all(p, '[{WS}]+')) >= 7)) AS paragraphs,
    len(regexp_extract_all(t, '[.!?](?:[{WS}]|\z)')) AS sentences, {_hits('t', JUNK)} AS junk_hits, {_hits('t', AUTH)} AS auth_hits, {_hits('t', BOT)} AS bot_hits,
    CASE WHEN len(marks) > 0 THEN floor((len(marks) - len(list_distinct(marks)))::DOUBLE / len(marks) * 1000 + 0.5::DOUBLE) / 1000 ELSE 0.0::DOUBLE END AS duplicate_ratio FROM marked),
raw AS (SELECT *, least(45.0::DOUBLE, chars / 120) + least(25.0::DOUBLE, words / 35) + least(20.0::DOUBLE, paragraphs * 2.5::DOUBLE) + least(10.0::DOUBLE, sentences / 4)
    - CASE WHEN chars < 300 THEN 35 ELSE 0 END - CASE WHEN paragraphs < 2 THEN 15 ELSE 0 END - CASE WHEN auth_hits > 0 THEN 45 ELSE 0 END - CASE WHEN bot_hits > 0 THEN 60 ELSE 0 END
    - least(30.0::DOUBLE, junk_hits * 8.0::DOUBLE) - duplicate_ratio * 20 AS points FROM measured),
scored AS (SELECT *, CASE WHEN chars = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, floor(points * 10 + 0.5::DOUBLE) / 10)) END AS text_score FROM raw),
labelled AS (SELECT *, CASE WHEN trim(status) = '429' THEN 'rate_limited' WHEN trim(status) IN ('401', '403') THEN 'auth_required' WHEN bot_hits > 0 THEN 'bot_blocked' WHEN auth_hits > 0 THEN 'auth_required' WHEN chars = 0 THEN 'failed'
    WHEN chars < 300 OR words < 80 THEN 'partial_text' WHEN text_score >= 68 THEN 'full_text' WHEN text_score >= 42 THEN 'partial_text' ELSE 'low_confidence' END AS text_label FROM scored),
judged AS (SELECT *, CASE WHEN text_label = 'full_text' AND text_score >= 85 THEN 'high' WHEN text_label = 'full_text' OR text_score >= 68 THEN 'medium' WHEN text_label IN ('partial_text', 'low_confidence') THEN 'low' ELSE 'blocked_or_failed' END AS confidence FROM labelled)
"""


_METRICS = ["chars", "words", "paragraphs", "sentences", "junk_hits", "auth_hits", "bot_hits", "duplicate_ratio"]
_JUDGED_S = _measures("scrape_results", "result_id", "fetched_text", "coalesce(http_status, '')")
_JUDGED_D = _measures("documents", "doc_id", "text", "'200'")


@query("text_clean", f"SELECT doc_id, {_clean('text')} AS clean FROM documents")
def text_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean(F.col("text")).alias("clean"))


@query("content_metrics", _JUDGED_S + f"SELECT result_id, {', '.join(_METRICS)} FROM judged")
def content_metrics(spark, d):
    return X.judged(table(spark, d, "scrape_results"), "fetched_text", F.col("http_status")).select("result_id", *_METRICS)


@query("text_quality", _JUDGED_S + "SELECT result_id, text_score, text_label, confidence FROM judged")
def text_quality(spark, d):
    return X.judged(table(spark, d, "scrape_results"), "fetched_text", F.col("http_status")).select("result_id", "text_score", "text_label", "confidence")


@query("document_quality", _JUDGED_D + "SELECT doc_id, text_score, text_label FROM judged")
def document_quality(spark, d):
    return X.judged(table(spark, d, "documents"), "text").select("doc_id", "text_score", "text_label")


@query("source_health", _JUDGED_D + """SELECT lower(source) AS source, count(*) AS n_rows, count_if(text_label = 'full_text') AS n_full_text, count_if(text_label IN ('partial_text', 'low_confidence')) AS n_partial,
  floor(avg(text_score) * 10 + 0.5::DOUBLE) / 10 AS avg_score FROM judged JOIN documents USING (doc_id) GROUP BY 1""")
def source_health(spark, d):
    rows = X.judged(table(spark, d, "documents"), "text")
    return rows.groupBy(F.lower("source").alias("source")).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("text_label") == "full_text").alias("n_full_text"),
        F.count_if(F.col("text_label").isin("partial_text", "low_confidence")).alias("n_partial"), X.tenth(F.avg("text_score")).alias("avg_score"),
    )


@query("text_compact", rf"SELECT doc_id, CASE WHEN length(s) > 110 THEN left(s, 110) || '...' ELSE s END AS compact FROM (SELECT doc_id, {_strip(f"regexp_replace(coalesce(text, ''), '[{WS}]+', ' ', 'g')")} AS s FROM documents)")
def text_compact(spark, d):
    return table(spark, d, "documents").select("doc_id", X.compact(F.col("text"), 110).alias("compact"))


@query("text_clip", rf"""SELECT doc_id, CASE WHEN length(coalesce(text, '')) <= 900 THEN coalesce(text, '') ELSE regexp_replace(left(text, 900 - length(note)), '[{WS}]+\z', '') || note END AS clipped
  FROM (SELECT doc_id, text, chr(10) || chr(10) || '[shortened; original length ' || format('{{:,}}', length(text)) || ' chars]' AS note FROM documents)""")
def text_clip(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clip(F.col("text"), 900).alias("clipped"))


_PACK = "substr(s, 1260 + floor(greatest(0, m - 400) * {k} / 4)::BIGINT + 1, least(400, m))"


@query("evidence_pack", rf"""SELECT doc_id, CASE WHEN n <= 3000 THEN s ELSE '[BEGINNING]' || chr(10) || left(s, 1260) || chr(10) || chr(10) || '[SAMPLES OF THE MIDDLE]' || chr(10) ||
    array_to_string(list_filter([{", ".join(_strip(_PACK.format(k=k)) for k in (1, 2, 3))}], lambda x: x != ''), chr(10) || chr(10) || '--- SAMPLE ---' || chr(10) || chr(10)) ||
    chr(10) || chr(10) || '[END]' || chr(10) || right(s, 900) || chr(10) || chr(10) || '[NOTE: the article was longer than this pack.]' END AS pack
  FROM (SELECT doc_id, s, length(s) AS n, length(s) - 2160 AS m FROM (SELECT doc_id, {_strip("coalesce(text, '')")} AS s FROM documents))""")
def evidence_pack(spark, d):
    return table(spark, d, "documents").select("doc_id", X.evidence_pack(F.col("text"), 3000).alias("pack"))


@query("country_names", f"SELECT ai_id, CASE WHEN c = '' THEN 'Unknown' WHEN lower(c) IN {_quoted(US_NAMES)} THEN 'United States' WHEN lower(c) IN {_quoted(UK_NAMES)} THEN 'United Kingdom' ELSE c END AS country FROM (SELECT ai_id, trim(coalesce(outlet_country, '')) AS c FROM ai_results)")
def country_names(spark, d):
    return table(spark, d, "ai_results").select("ai_id", X.country(F.col("outlet_country")).alias("country"))


@query("status_pill", """SELECT ai_id, CASE WHEN regexp_matches(s, 'full|verified|passed|complete|success|connected|entered|manual') THEN 'good' WHEN regexp_matches(s, 'partial|manual|low|truncated|needs|testing|environment|local') THEN 'warn'
  WHEN regexp_matches(s, 'failed|error|auth|paywall|rate|robots|bot|missing|blocked') THEN 'bad' ELSE 'info' END AS pill FROM (SELECT ai_id, lower(coalesce(ai_verification_status, '')) AS s FROM ai_results)""")
def status_pill(spark, d):
    return table(spark, d, "ai_results").select("ai_id", X.pill(F.col("ai_verification_status")).alias("pill"))


@query("byte_sizes", "SELECT result_id, CASE WHEN n < 1024 THEN n || ' B' ELSE printf('%.1f KB', floor(n / 1024 * 10 + 0.5::DOUBLE) / 10) END AS size FROM (SELECT result_id, octet_length(encode(coalesce(fetched_text, ''))) AS n FROM scrape_results)")
def byte_sizes(spark, d):
    return table(spark, d, "scrape_results").select("result_id", X.byte_size(F.octet_length(F.coalesce("fetched_text", F.lit("")))).alias("size"))


# --- addresses ---------------------------------------------------------------------------------------------------

_POINTS = r"""(CASE WHEN starts_with(u, 'https://') THEN 30 WHEN starts_with(u, 'http://') THEN 18 ELSE 0 END + CASE WHEN contains(u, '?') THEN 0 ELSE 10 END
  - CASE WHEN regexp_matches(u, 'utm_|fbclid=|gclid=|mc_cid=|mc_eid=') THEN 14 ELSE 0 END - CASE WHEN regexp_matches(u, '/login|/signin|/subscribe|facebook\.com|twitter\.com|x\.com/|instagram\.com') THEN 40 ELSE 0 END
  - CASE WHEN regexp_matches(u, '/amp\b|amp\.') THEN 4 ELSE 0 END + greatest(0.0::DOUBLE, 18 - length(u) / 18))::DOUBLE"""
_HOST = r"regexp_replace(lower(regexp_extract({u}, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@\s]*@)?([^/?#:\s]*)', 1)), '^www\.', '')"


@query("url_points", f"SELECT row_id, {_POINTS} AS points FROM (SELECT row_id, lower(trim(coalesce(url, ''))) AS u FROM manifest)")
def url_points_(spark, d):
    return table(spark, d, "manifest").select("row_id", url_points(F.col("url")).alias("points"))


_PART = "regexp_extract(u, '^https?://{}', 1, 'i')"


@query("url_canonical", rf"""SELECT row_id, CASE WHEN host = '' THEN '' ELSE scheme || '://' || regexp_replace(host, CASE scheme WHEN 'https' THEN ':443$' ELSE ':80$' END, '') || CASE WHEN path = '' THEN '/' ELSE path END || query END AS url
  FROM (SELECT row_id, lower(regexp_extract(u, '^(https?)://', 1, 'i')) AS scheme, lower({_PART.format('([^/?#]*)')}) AS host, {_PART.format('[^/?#]*([^?#]*)')} AS path, {_PART.format('[^?#]*([?][^#]*)')} AS query FROM (SELECT row_id, trim(coalesce(url, '')) AS u FROM manifest))""")
def url_canonical(spark, d):
    return table(spark, d, "manifest").select("row_id", canonical_url("url").alias("url"))


@query("url_domain", f"SELECT result_id, coalesce(nullif({_HOST.format(u="coalesce(nullif(source_url_used, ''), nullif(canonical_url, ''), '')")}, ''), 'unknown') AS domain FROM scrape_results")
def url_domain(spark, d):
    return table(spark, d, "scrape_results").select("result_id", health.domain_of("source_url_used", "canonical_url").alias("domain"))


# --- grouping, choice and expansion ------------------------------------------------------------------------------

_KEY = (
    lambda x: rf"""CASE WHEN lower({_strip(f"coalesce({x}, '')")}) IN ('', 'nan', 'none', 'null', 'undefined') THEN '' ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  trim(regexp_replace(lower(translate({_strip(f"coalesce({x}, '')")}, '‘’“”', chr(39) || chr(39) || '""')), '[{WS}]+', ' ', 'g')), ' *[|] *[^|]{{2,80}}\z', ''), ' +[-–—] +(?:breaking|live updates?|updated|analysis|opinion)\b.*\z', ''), '\b(?:updated|breaking)[: -]+', '', 'g'), '[^a-z0-9]+', ' ', 'g')) END"""
)
_KEYED = rf"""
WITH named AS (SELECT *, {_KEY('title')} AS k FROM manifest),
keyed AS (SELECT * EXCLUDE (k), CASE WHEN length(k) < 8 THEN '__unique__' || row_id ELSE k END AS dedupe_key, lower(trim(coalesce(url, ''))) AS u FROM named),
pointed AS (SELECT *, {_POINTS} AS points FROM keyed),
placed AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY points DESC, row_id) AS n, count(*) OVER (PARTITION BY dedupe_key) AS group_size, min(row_id) OVER (PARTITION BY dedupe_key) AS first_row FROM pointed),
grouped AS (SELECT dedupe_key, group_size, first_row, row_id AS representative_row, coalesce(url, '') AS representative_url FROM placed WHERE n = 1)
"""


@query("dedupe_keys", _KEYED + "SELECT row_id, dedupe_key FROM keyed")
def dedupe_keys(spark, d):
    return dedupe.keyed(table(spark, d, "manifest")).select("row_id", "dedupe_key")


@query("dedupe_groups", _KEYED + "SELECT * FROM grouped")
def dedupe_groups(spark, d):
    return dedupe.groups(table(spark, d, "manifest"))


@query("dedupe_statistics", _KEYED + "SELECT sum(group_size)::BIGINT AS n_rows, count(*) AS n_groups, (sum(group_size) - count(*))::BIGINT AS requests_saved, max(group_size) AS largest_group FROM grouped")
def dedupe_statistics(spark, d):
    return dedupe.statistics(table(spark, d, "manifest"))


def _one_result(spark, d):
    """The latest delivery of each manifest row's result."""
    rows = table(spark, d, "scrape_results")
    w = Window.partitionBy("row_id").orderBy(F.desc("loaded_at"), F.desc("result_id"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


_LATEST = "latest AS (SELECT * FROM scrape_results QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC NULLS LAST, result_id DESC) = 1)"


@query("group_expansion", _KEYED + f", {_LATEST}" + """
SELECT k.row_id, k.dedupe_key, g.group_size, g.representative_row, g.representative_url, g.group_size > 1 AS scraped_once_for_group, r.fetched_text, r.quality_label, r.extraction_score, r.word_count
FROM keyed k JOIN grouped g USING (dedupe_key) LEFT JOIN latest r ON r.row_id = g.representative_row""")
def group_expansion(spark, d):
    full = dedupe.expand(table(spark, d, "manifest"), _one_result(spark, d))
    return full.select("row_id", "dedupe_key", "group_size", "representative_row", "representative_url", "scraped_once_for_group", "fetched_text", "quality_label", "extraction_score", "word_count")


_REUSE = rf"""
WITH based AS (SELECT row_id, coalesce(nullif(trim(dedupe_key), ''), {_KEY('extracted_headline')}) AS b FROM scrape_results),
keyed AS (SELECT row_id, CASE WHEN length(b) < 8 THEN '__unique_ai__' || row_id ELSE b END || '::summary::' AS ai_key FROM based)
"""


def _reuse_key():
    return dedupe.reuse_key(F.col("dedupe_key"), F.col("extracted_headline"), None, F.col("row_id"))


@query("ai_reuse_groups", _REUSE + "SELECT ai_key, count(*) AS group_size, min(row_id) AS job_row FROM keyed GROUP BY ai_key")
def ai_reuse_groups(spark, d):
    return dedupe.reuse_groups(table(spark, d, "scrape_results"), _reuse_key())


@query("ai_savings", _REUSE + "SELECT count(*) AS n_rows, count(DISTINCT ai_key) AS jobs, count(*) - count(DISTINCT ai_key) AS saved FROM keyed")
def ai_savings(spark, d):
    g = dedupe.reuse_groups(table(spark, d, "scrape_results"), _reuse_key())
    return g.agg(F.sum("group_size").alias("n_rows"), F.count("*").alias("jobs"), (F.sum("group_size") - F.count("*")).alias("saved"))


_AI_LATEST = "ai AS (SELECT * FROM ai_results QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY analyzed_at DESC NULLS LAST, ai_id DESC) = 1)"


def _one_ai(spark, d):
    w = Window.partitionBy("row_id").orderBy(F.desc_nulls_last("analyzed_at"), F.desc("ai_id"))
    return table(spark, d, "ai_results").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


@query("ai_reuse", _REUSE.replace("keyed AS (SELECT row_id,", "keyed AS (SELECT row_id, result_id,").replace("based AS (SELECT row_id,", "based AS (SELECT row_id, result_id,") + f", {_AI_LATEST}, " + """
jobs AS (SELECT ai_key, count(*) AS group_size, min(row_id) AS job_row FROM keyed GROUP BY ai_key)
SELECT k.result_id, k.ai_key, group_size, quality_score, headline, array_to_string(key_entities, ', ') AS key_entities, array_to_string(key_quotes, ' | ') AS key_quotes, job_row != k.row_id AS ai_reused
FROM keyed k JOIN jobs USING (ai_key) LEFT JOIN ai ON ai.row_id = job_row""")
def ai_reuse(spark, d):
    results = _one_ai(spark, d).select("row_id", "quality_score", "headline", "key_entities", "key_quotes")
    out = dedupe.reuse(table(spark, d, "scrape_results"), results, _reuse_key())
    return out.select("result_id", "ai_key", "group_size", "quality_score", "headline", "key_entities", "key_quotes", "ai_reused")


# --- counts and means --------------------------------------------------------------------------------------------

_DOMAIN = f"coalesce(nullif({_HOST.format(u="coalesce(nullif(source_url_used, ''), nullif(canonical_url, ''), '')")}, ''), 'unknown')"
_LABEL_COUNTS = ", ".join(f"count_if(quality_label IN {_quoted(v)}) AS {k}" for k, v in health.GROUPS.items())


def _health_sql(score: str) -> str:
    mean = lambda c: f"floor(coalesce(sum(({score.format(c=c)})::DECIMAL(24,6))::DOUBLE / nullif(count({score.format(c=c)}), 0), 0.0::DOUBLE) * 10 + 0.5::DOUBLE) / 10"
    return f"""WITH {_AI_LATEST}, joined AS (SELECT s.*, quality_score, summary_alignment_score FROM scrape_results s LEFT JOIN ai USING (row_id))
SELECT {_DOMAIN} AS domain, count(*) AS n_rows, {_LABEL_COUNTS}, {mean('extraction_score')} AS avg_extraction_score, {mean('quality_score')} AS avg_quality_score, {mean('summary_alignment_score')} AS avg_alignment_score FROM joined GROUP BY 1"""


def _joined(spark, d):
    return table(spark, d, "scrape_results").join(_one_ai(spark, d).select("row_id", "quality_score", "summary_alignment_score", "outlet_country", "is_national_outlet", "ai_verification_status", "headline", "executive_summary"), "row_id", "left")


@query("domain_health_server", _health_sql("coalesce({c}, 0)::DOUBLE"))
def domain_health_server(spark, d):
    return health.domain_health(_joined(spark, d), health.domain_of("source_url_used", "canonical_url"))


@query("domain_health_client", _health_sql("{c}::DOUBLE"))
def domain_health_client(spark, d):
    return health.domain_health(_joined(spark, d), health.domain_of("source_url_used", "canonical_url"), server=False)


@query("domain_order", f"SELECT {_DOMAIN} AS domain, count(*) AS n_rows, count_if(quality_label = 'full_text') AS n_full_text FROM scrape_results GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1")
def domain_order(spark, d):
    h = health.domain_health(table(spark, d, "scrape_results"), health.domain_of("source_url_used", "canonical_url"))
    return health.in_order(h).select("domain", "n_rows", "n_full_text")


_SUMMARY = """count(*) AS input_rows, count(DISTINCT dedupe_key) AS jobs, count(*) - count(DISTINCT dedupe_key) AS requests_saved, count_if(quality_label = 'full_text') AS full_text_rows,
  count_if(quality_label IN ('partial_text', 'low_confidence')) AS partial_rows, count_if(quality_label IN ('failed', 'url_only', 'robots_disallowed', 'rate_limited')) AS failed_rows,
  count_if(quality_label = 'bot_blocked') AS bot_blocked_rows, count_if(quality_label = 'auth_required') AS auth_required_rows"""


@query("run_summary", f"SELECT {_SUMMARY} FROM scrape_results")
def run_summary(spark, d):
    return health.run_summary(table(spark, d, "scrape_results"))


@query("run_summaries", f"SELECT run_id, {_SUMMARY} FROM scrape_results GROUP BY run_id")
def run_summaries(spark, d):
    return health.run_summary(table(spark, d, "scrape_results"), ["run_id"])


@query("chunk_merge", "SELECT domain, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("n_rows", *health.GROUPS)) + " FROM domain_health GROUP BY domain")
def chunk_merge(spark, d):
    return health.merged(table(spark, d, "domain_health").drop("run_id"), "domain")


_ROW_KEY = "concat_ws('::', coalesce(nullif(source_url_used, ''), nullif(canonical_url, ''), ''), coalesce(nullif(extracted_headline, ''), nullif(headline, ''), ''), coalesce(dedupe_key, ''), '0')"
_REVIEWED = f"""reviews AS (SELECT row_key, arg_max(lower(review_status), struct_pack(a := coalesce(reviewed_at, TIMESTAMPTZ '0001-01-01'), b := review_id)) AS review_status FROM review_labels WHERE trim(review_status) != '' GROUP BY row_key),
keyed AS (SELECT s.* EXCLUDE (extraction_trace_json), quality_score, summary_alignment_score, outlet_country, is_national_outlet, ai_verification_status, headline, executive_summary FROM scrape_results s LEFT JOIN ai USING (row_id)),
rows AS (SELECT k.*, coalesce(nullif(review_status, ''), 'unreviewed') AS review_status FROM (SELECT *, {_ROW_KEY} AS row_key FROM keyed) k LEFT JOIN reviews USING (row_key))"""


def _reviewed(spark, d):
    return views.with_review(_joined(spark, d), table(spark, d, "review_labels"))


_US = f"lower(trim(coalesce(outlet_country, ''))) IN {_quoted(US_NAMES)}"


@query("filtered_statistics", f"WITH {_AI_LATEST}, {_REVIEWED}" + f"""SELECT count(*) AS n, count_if(quality_label = 'full_text') AS full_text, count_if(is_national_outlet) AS "national", count_if(is_national_outlet AND {_US}) AS us_national,
  count_if(review_status = 'approved') AS approved, count_if(review_status IN ('needs-better-scrape', 'unreviewed')) AS needs_review, avg(quality_score::DOUBLE) AS mean_quality, avg(summary_alignment_score::DOUBLE) AS mean_alignment FROM rows""")
def filtered_statistics(spark, d):
    return health.filtered_statistics(_reviewed(spark, d), views.truth(F.col("is_national_outlet")))


@query("review_labels", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id, review_status FROM rows")
def review_labels(spark, d):
    return _reviewed(spark, d).select("result_id", "review_status")


# --- filters, sorts and projections ------------------------------------------------------------------------------


@query("filter_search", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id FROM rows WHERE contains(lower(concat(" + ", ' ', ".join(f"coalesce({c}::VARCHAR, '')" for c in ("extracted_headline", "headline", "''", "source_url_used", "canonical_url", "extracted_site_name", "outlet_country", "''", "ai_verification_status", "quality_label", "executive_summary", "''", "fetched_text")) + ")), 'council')")
def filter_search(spark, d):
    return views.search(_reviewed(spark, d), " Council ").select("result_id")


@query("filter_thresholds", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id FROM rows WHERE coalesce(quality_score, 0) >= 60 AND coalesce(summary_alignment_score, 0) >= 50 AND coalesce(word_count, 0) >= 150")
def filter_thresholds(spark, d):
    return views.Filter(min_quality=60, min_alignment=50, min_words=150).apply(_reviewed(spark, d)).select("result_id")


@query("filter_national", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id FROM rows WHERE coalesce(is_national_outlet, false)")
def filter_national(spark, d):
    return views.Filter(national="yes").apply(_reviewed(spark, d)).select("result_id")


@query("filter_search_address", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id FROM rows WHERE contains(lower(coalesce(source_url_used, '')), 'courant.example/story/')")
def filter_search_address(spark, d):
    return views.search(_reviewed(spark, d), "courant.example/story/", ["source_url_used"]).select("result_id")


@query("filter_country", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id FROM rows WHERE lower(trim(outlet_country)) = 'norland'")
def filter_country(spark, d):
    return views.Filter(country="Norland").apply(_reviewed(spark, d)).select("result_id")


@query("filter_status", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id FROM rows WHERE coalesce(ai_verification_status, 'not analyzed') = 'not analyzed' AND coalesce(dedupe_group_size, 1) >= 2 AND review_status = 'unreviewed'")
def filter_status(spark, d):
    return views.Filter(status="not analyzed", duplicates_only=True, review="unreviewed").apply(_reviewed(spark, d)).select("result_id")


@query("preset_high_quality", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id FROM rows WHERE quality_score >= 80 AND summary_alignment_score >= 70 AND quality_label = 'full_text'")
def preset_high_quality(spark, d):
    return views.PRESETS["high-quality"].apply(_reviewed(spark, d)).select("result_id")


@query("preset_national_country", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id FROM rows WHERE coalesce(is_national_outlet, false) AND lower(trim(outlet_country)) = 'vestria' AND quality_score >= 50")
def preset_national_country(spark, d):
    """The preset of national outlets, of a country these tables have."""
    return replace(views.PRESETS["us-national"], country="Vestria").apply(_reviewed(spark, d)).select("result_id")


@query("preset_bot_blocked", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id FROM rows WHERE quality_label = 'bot_blocked'")
def preset_bot_blocked(spark, d):
    return views.PRESETS["bot-blocked"].apply(_reviewed(spark, d)).select("result_id")


@query("review_queue", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id, CASE WHEN review_status = 'unreviewed' THEN 0 ELSE 1 END AS needs, coalesce(summary_alignment_score, 0)::DOUBLE AS alignment FROM rows ORDER BY 2, 3, result_id LIMIT 500")
def review_queue(spark, d):
    return views.review_queue(_reviewed(spark, d), row_id="result_id").select("result_id", "needs", "alignment")


@query("sort_top_quality", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id, coalesce(quality_score, 0)::DOUBLE AS quality FROM rows ORDER BY 2 DESC, 1 LIMIT 500")
def sort_top_quality(spark, d):
    """The table view shows its first 500 rows; that is the view's length."""
    return views.ordered(_reviewed(spark, d), "quality", "result_id").limit(500).select("result_id", F.coalesce(F.col("quality_score").cast("double"), F.lit(0.0)).alias("quality"))


def _sorted(name: str, mode: str, value: str, order: str):
    """The table view's first 500 rows by a mode; that is the view's length."""

    @query(name, f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id, {value} AS value FROM rows ORDER BY {order}, 1 LIMIT 500")
    def run(spark, d):
        return views.ordered(_reviewed(spark, d), mode, "result_id").limit(500).select("result_id", F.coalesce(F.col(value.split("coalesce(")[1].split(",")[0]).cast("double"), F.lit(0.0)).alias("value"))


for _mode, _column in (("alignment", "summary_alignment_score"), ("extraction", "extraction_score"), ("words", "word_count")):
    _sorted(f"sort_top_{_mode}", _mode, f"coalesce({_column}, 0)::DOUBLE", "2 DESC")

_HEADLINE = rf"(SELECT CASE WHEN length(h) > 140 THEN left(h, 140) || '...' ELSE h END FROM (SELECT {_strip(f"regexp_replace(coalesce(nullif(headline, ''), nullif(extracted_headline, ''), 'Untitled article'), '[{WS}]+', ' ', 'g')")} AS h))"


@query("headlines", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id, {_HEADLINE} AS headline FROM rows")
def headlines(spark, d):
    rows = _joined(spark, d)
    return rows.select("result_id", views.headline(rows).alias("headline"))


@query("sort_by_headline", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id, extracted_headline FROM rows")
def sort_by_headline(spark, d):
    """All rows by headline; the order itself is by Unicode collation and checked in the tests."""
    return views.ordered(_joined(spark, d), "headline", "result_id").select("result_id", "extracted_headline")


@query("options_country", f"SELECT 'Any' AS option UNION ALL SELECT DISTINCT CASE WHEN c = '' THEN 'Unknown' WHEN lower(c) IN {_quoted(US_NAMES)} THEN 'United States' WHEN lower(c) IN {_quoted(UK_NAMES)} THEN 'United Kingdom' ELSE c END AS option FROM (SELECT trim(coalesce(outlet_country, '')) AS c FROM ai_results)")
def options_country(spark, d):
    return views.options(table(spark, d, "ai_results"), X.country(F.col("outlet_country")))


@query("options_label", "SELECT 'Any' AS option UNION ALL SELECT DISTINCT coalesce(quality_label, 'unknown') FROM scrape_results WHERE coalesce(quality_label, 'unknown') != ''")
def options_label(spark, d):
    return views.options(table(spark, d, "scrape_results"), F.coalesce("quality_label", F.lit("unknown")))


@query("options_status", "SELECT 'Any' AS option UNION ALL SELECT DISTINCT coalesce(ai_verification_status, 'not analyzed') FROM ai_results WHERE coalesce(ai_verification_status, 'not analyzed') != ''")
def options_status(spark, d):
    rows = table(spark, d, "ai_results")
    return views.options(rows, views.status_of(rows))


@query("row_keys", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT result_id, row_key FROM rows")
def row_keys(spark, d):
    rows = _joined(spark, d)
    return rows.select("result_id", views.row_key(rows).alias("row_key"))


@query("truth_values", f"SELECT ai_id, coalesce(lower(is_national_outlet::VARCHAR) IN {_quoted(TRUE_NAMES)}, false) AS yes FROM ai_results")
def truth_values(spark, d):
    return table(spark, d, "ai_results").select("ai_id", views.truth(F.col("is_national_outlet")).alias("yes"))


@query("visible_columns", f"WITH {_AI_LATEST}, {_REVIEWED} SELECT quality_label, quality_score, summary_alignment_score, is_national_outlet, outlet_country, extracted_headline, headline, source_url_used, recovery_route, extraction_score, extraction_confidence_label, candidate_count, winning_candidate_route, word_count, dedupe_group_size, executive_summary, error_message FROM rows")
def visible_columns(spark, d):
    return views.visible(_joined(spark, d))


_TRACES = """(SELECT result_id, i - 1 AS place, j FROM (SELECT result_id, unnest(range(1, json_array_length(v)::BIGINT + 1)) AS i, v FROM (SELECT result_id, extraction_trace_json::JSON AS v FROM scrape_results WHERE json_valid(extraction_trace_json) AND extraction_trace_json LIKE '[%')),
  LATERAL (SELECT json_extract(v, '$[' || (i - 1) || ']') AS j))"""


@query("trace_view", f"""SELECT result_id, place, coalesce((j->>'$.selected')::BOOLEAN, false) AS selected, j->>'$.route' AS route, j->>'$.label' AS label, (j->>'$.score')::DOUBLE + 0.0::DOUBLE AS score, (j->>'$.words')::BIGINT AS words, j->>'$.statusCode' AS status,
  floor(coalesce((j->>'$.boilerplateRatio')::DOUBLE, 0) * 100 + 0.5::DOUBLE)::BIGINT AS boilerplate_percent, left(coalesce(j->>'$.error', ''), 220) AS error FROM {_TRACES}""")
def trace_view(spark, d):
    return views.trace(table(spark, d, "scrape_results"), "result_id")


@query("article_detail", f"WITH {_AI_LATEST}, {_REVIEWED}, one AS (SELECT * FROM rows ORDER BY coalesce(quality_score, 0) DESC, result_id LIMIT 1 OFFSET 7) SELECT result_id, {_HEADLINE} AS detail_headline, coalesce(executive_summary, '') AS detail_summary FROM one")
def article_detail(spark, d):
    rows = _reviewed(spark, d)
    return views.detail(rows, 7, F.desc(F.coalesce("quality_score", F.lit(0))), "result_id").select("result_id", "detail_headline", "detail_summary")


@query("domain_panel", "SELECT run_id, domain, n_rows, n_full_text, n_partial, n_failed, n_bot_blocked, n_auth_required, n_rate_limited, avg_extraction_score, avg_quality_score, avg_alignment_score FROM domain_health")
def domain_panel(spark, d):
    return health.panel(table(spark, d, "domain_health"), "run_id")


@query("input_preview", "SELECT " + ", ".join(f"(SELECT CASE WHEN length(s) > 110 THEN left(s, 110) || '...' ELSE s END FROM (SELECT {_strip(f"regexp_replace(coalesce({c}::VARCHAR, ''), '[{WS}]+', ' ', 'g')")} AS s)) AS {c}" for c in ("row_id", "run_id", "url", "title", "summary", "outlet")) + " FROM (SELECT * FROM manifest ORDER BY row_id LIMIT 5)")
def input_preview(spark, d):
    return views.preview(table(spark, d, "manifest").orderBy("row_id"))


# --- candidates, routes, archives --------------------------------------------------------------------------------


def _candidates(spark, d):
    """Candidates read back from the traces: one per attempt, with its own label and a text of its length."""
    rows = table(spark, d, "scrape_results")
    shape = "array<struct<chars:long>>"
    chars = rows.select("result_id", F.posexplode(F.when(F.col("extraction_trace_json").startswith("["), F.try_variant_get(F.expr("try_parse_json(extraction_trace_json)"), "$", shape))).alias("place", "c"))
    return trace_view(spark, d).join(chars, ["result_id", "place"]).select("result_id", "place", "route", "label", F.coalesce("score", F.lit(0.0)).alias("score"), F.repeat(F.lit("x"), F.coalesce("c.chars", F.lit(0)).cast("int")).alias("text"))


_ATTEMPTS = f"SELECT result_id, place, j->>'$.route' AS route, j->>'$.label' AS label, (j->>'$.score')::DOUBLE + 0.0::DOUBLE AS score, coalesce((j->>'$.chars')::BIGINT, 0) AS chars FROM {_TRACES}"


@query("candidate_top", f"SELECT result_id, place, score FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY score DESC, chars DESC, place) AS n FROM (SELECT result_id, place, coalesce(score, 0) AS score, chars FROM ({_ATTEMPTS}))) WHERE n <= 12")
def candidate_top(spark, d):
    c = _candidates(spark, d).select("result_id", "score", "text", F.lit(0).alias("route_no"), F.col("place").alias("seq"))
    return rank.top(c, 12, "result_id").select("result_id", F.col("seq").alias("place"), "score")


@query("route_early_stop", f"SELECT result_id, place FROM (SELECT *, max((label = 'full_text')::INT) OVER (PARTITION BY result_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM ({_ATTEMPTS})) WHERE coalesce(done, 0) = 0")
def route_early_stop(spark, d):
    c = _candidates(spark, d).select("result_id", F.col("place").alias("route_no"), F.lit(0).alias("seq"), "text", "score", F.coalesce("label", F.lit("")).alias("text_label"))
    return rank.until_full(c, "result_id").select("result_id", F.col("route_no").alias("place"))


@query("best_candidate", f"SELECT result_id, arg_max(place, struct_pack(s := score, p := -place)) AS place, count(*) AS candidate_count FROM (SELECT result_id, place, coalesce(score, 0) AS score FROM ({_ATTEMPTS})) GROUP BY result_id")
def best_candidate(spark, d):
    c = _candidates(spark, d)
    return c.groupBy("result_id").agg(F.max_by("place", F.struct("score", (-F.col("place")).alias("p"))).alias("place"), F.count("*").alias("candidate_count"))


@query("archive_snapshots", """WITH index AS (SELECT source_url_used AS url, strftime(scraped_at AT TIME ZONE 'UTC', '%Y%m%d%H%M%S') AS "timestamp", md5(coalesce(fetched_text, '')) AS digest FROM scrape_results WHERE source_url_used != '' AND scraped_at IS NOT NULL AND http_status = '200'),
changed AS (SELECT * FROM index QUALIFY digest IS DISTINCT FROM lag(digest) OVER (PARTITION BY url ORDER BY "timestamp", digest)),
first AS (SELECT * FROM changed QUALIFY row_number() OVER (PARTITION BY url ORDER BY "timestamp", digest) <= 8)
SELECT url, "timestamp", digest, row_number() OVER (PARTITION BY url ORDER BY "timestamp" DESC, digest) AS place FROM first""")
def archive_snapshots(spark, d):
    """An archive's index made of the deliveries of each address."""
    rows = table(spark, d, "scrape_results").where("source_url_used != '' and scraped_at is not null")
    index = rows.select(F.col("source_url_used").alias("url"), F.date_format("scraped_at", "yyyyMMddHHmmss").alias("timestamp"), F.coalesce("http_status", F.lit("")).alias("statuscode"), F.lit("text/html").alias("mimetype"), F.md5(F.coalesce("fetched_text", F.lit(""))).alias("digest"))
    return rank.snapshots(index).select("url", "timestamp", "digest", F.col("place").cast("long").alias("place"))


@query("cache_lookup", """WITH cache AS (SELECT coalesce(source_url_used, '') AS url, arg_max(result_id, struct_pack(a := scraped_at, b := result_id)) AS cached FROM scrape_results WHERE source_url_used != '' AND scraped_at > TIMESTAMPTZ '2024-01-20' GROUP BY 1)
  SELECT row_id, cached FROM manifest JOIN cache USING (url)""")
def cache_lookup(spark, d):
    cache = table(spark, d, "scrape_results").where("source_url_used != ''").select(F.col("source_url_used").alias("cache_key"), F.col("scraped_at").alias("expires_at"), F.col("result_id").alias("result"))
    hits, _ = io.cached(table(spark, d, "manifest").withColumn("cache_key", F.col("url")), cache, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return hits.select("row_id", F.col("result").alias("cached"))


# --- pages and models --------------------------------------------------------------------------------------------


def _pages(spark, d, rows=None):
    """Pages rendered back from (key, url, title, text, by) rows, by default the documents: a heading, paragraphs and furniture,
    with linked data, a state script, neither, or on a known site."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "url", "title", "text", F.col("source").alias("by")) if rows is None else rows
    text = F.coalesce("text", F.lit(""))
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    kind = F.pmod("key", F.lit(4))
    name = F.coalesce("title", F.lit(""))
    no_end = lambda c: F.replace(c, F.lit("</"), F.lit("<\\/"))
    linked = F.concat(F.lit("<script type='application/ld+json'>"), no_end(F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), name.alias("headline"), text.alias("articleBody"), F.array(F.struct(F.col("by").alias("name"))).alias("author")))), F.lit("</script>"))
    state = F.concat(F.lit("<script>window.__INITIAL_STATE__ = "), no_end(F.to_json(F.struct(F.struct(text.alias("storyBody"), name.alias("title")).alias("story")))), F.lit(";</script>"))
    script = F.when(kind == 1, linked).when(kind == 2, state).otherwise("")
    body = F.concat(
        F.lit("<html><head><title>"), esc(name), F.lit("</title>"), script, F.lit("</head><body><nav><a href='/'>Home</a></nav><article class='story'><h1>"), esc(name), F.lit("</h1><p>"), F.regexp_replace(esc(text), "\n+", "</p><p>"),
        F.lit("</p></article><aside class='related'><p>Read more of what others read today</p></aside><footer>Imprint</footer></body></html>"),
    )
    url = F.when(kind == 3, F.concat(F.lit("https://www.theguardian.com/"), F.col("key").cast("string"))).otherwise(F.col("url"))
    return rows.select(F.col("key").cast("string").alias("job_key"), "url", url.alias("page_url"), body.alias("html"), F.lit(200).alias("http_status"), F.lit("").alias("error"))


@query("html_candidates")
def html_candidates(spark, d):
    return extract.extracted(_pages(spark, d).withColumn("url", F.col("page_url"))).select("job_key", "seq", "route", F.length("text").alias("chars"), F.round("score", 6).alias("score"), "title", "boilerplate_ratio")


def _recovered_pages(spark, d):
    """A page for each address of the manifest, from the text that was recovered from it."""
    results = _one_result(spark, d).select("row_id", F.col("fetched_text").alias("text"), F.col("extracted_author").alias("by"))
    rows = table(spark, d, "manifest").join(results, "row_id").select(F.col("row_id").alias("key"), canonical_url("url").alias("url"), "title", "text", "by").where("url != '' and length(text) > 0")
    w = Window.partitionBy("url").orderBy("key")
    return _pages(spark, d, rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")).select("url", "html", "http_status", "error")


def _archive(pages):
    shots = pages.select("url", F.col("url").alias("original"), F.lit("20240101000000").alias("timestamp"), "html", "http_status")
    index = shots.select("url", "timestamp", "original", F.lit("200").alias("statuscode"), F.lit("text/html").alias("mimetype"), F.md5("html").alias("digest"))
    return {"index": index, "pages": shots.select("timestamp", "original", "html", "http_status")}


_RUN = ["row_id", "dedupe_key", "quality_label", "extraction_score", "word_count", "recovery_route", "group_size"]


@query("pipeline_rows")
def pipeline_rows(spark, d):
    """The whole run over the manifest by all routes: a third each of its pages is live, with the reader or in the archive."""
    every = _recovered_pages(spark, d)
    third = lambda n: every.where(F.pmod(F.crc32("url"), F.lit(3)) == n)
    reader = third(1).select("url", F.regexp_replace(F.regexp_replace("html", "</p>", "\n\n"), "<[^>]*>", " ").alias("body"), "http_status")
    return pipeline.run(table(spark, d, "manifest"), Options(), live=third(0), reader=reader, **_archive(third(2))).rows.select(*_RUN)


@query("pipeline_archive")
def pipeline_archive(spark, d):
    """The run from the archive alone."""
    return pipeline.run(table(spark, d, "manifest"), Options(route="archive-only"), **_archive(_recovered_pages(spark, d))).rows.select(*_RUN)


def _cached_run(spark, d, **more):
    """A run that finds earlier results in the cache and no page at all."""
    o = Options(route="live-only", **more)
    kept = F.to_json(F.struct("fetched_text", "quality_label", "word_count"))
    cache = _one_result(spark, d).where("source_url_used != '' and quality_label != ''").withColumn("url", canonical_url("source_url_used"))
    cache = cache.select(pipeline.cache_key(F.col("url"), o.tuned()).alias("cache_key"), kept.alias("result"), F.coalesce("loaded_at", F.lit("2024-01-01").cast("timestamp")).alias("expires_at"))
    none = spark.createDataFrame([], "url string, html string, http_status int, error string")
    return pipeline.run(table(spark, d, "manifest"), o, live=none, cache=cache, now=F.lit("2000-01-01").cast("timestamp"), model=_stub if o.enable_ai else None)


_CANONICAL = SQL["url_canonical"]
_CACHED = _KEYED + f""", {_LATEST},
canonical AS ({_CANONICAL}),
places AS (SELECT result_id AS row_id, source_url_used AS url FROM latest WHERE source_url_used != '' AND quality_label != ''),
cache AS (SELECT c.url, arg_max(struct_pack(fetched_text, quality_label, word_count), struct_pack(a := coalesce(loaded_at, TIMESTAMPTZ '2024-01-01'), b := to_json(struct_pack(fetched_text, quality_label, word_count))::VARCHAR)) AS r
  FROM ({_CANONICAL.replace('FROM manifest', 'FROM places')}) c JOIN latest l ON l.result_id = c.row_id GROUP BY 1),
run AS (SELECT k.row_id, k.dedupe_key, k.summary, c.url, r, g.group_size FROM keyed k JOIN grouped g USING (dedupe_key) JOIN canonical c ON c.row_id = g.representative_row LEFT JOIN cache h ON h.url = c.url)
"""


@query("pipeline_cached", _CACHED + "SELECT row_id, dedupe_key, group_size, CASE WHEN r IS NOT NULL THEN r.quality_label WHEN url = '' THEN 'url_only' ELSE 'failed' END AS quality_label FROM run")
def pipeline_cached(spark, d):
    """The run over a cache that holds the earlier results."""
    return _cached_run(spark, d).rows.select("row_id", "dedupe_key", "group_size", "quality_label")


@query("pipeline_ai", _CACHED + f""", asked AS (SELECT count(DISTINCT dedupe_key || '::summary::' || {_KEY('summary')}) AS calls, count(*) AS n FROM run)
SELECT n AS input_rows, (SELECT count(*) FROM grouped) AS jobs, calls AS ai_calls, n - calls AS ai_calls_saved FROM asked""")
def pipeline_ai(spark, d):
    """The counters of a run whose rows a model judges, one call for equal stories with equal summaries."""
    return _cached_run(spark, d, enable_ai=True).summary.select("input_rows", "jobs", "ai_calls", "ai_calls_saved")


@query("list_values", "SELECT row_id, list_filter(list_transform(string_split_regex(coalesce(summary, ''), '[,|]'), lambda x: trim(x)), lambda x: x != '')[1:12] AS items FROM manifest")
def list_values(spark, d):
    return table(spark, d, "manifest").select("row_id", enrich.list_column(F.col("summary")).alias("items"))


@query("evidence_values", """WITH good AS (SELECT ai_id, evidence_json::JSON AS v FROM ai_results WHERE json_valid(evidence_json) AND evidence_json LIKE '[%'),
items AS (SELECT ai_id, t.rowid AS i, t.value AS j FROM good, json_each(v) t WHERE t.type = 'OBJECT'),
named AS (SELECT ai_id, i, trim(coalesce(j->>'$.claim', j->>'$.point', j->>'$.label', '')) AS claim, trim(coalesce(j->>'$.quote', j->>'$.evidence', j->>'$.text', '')) AS quote, trim(coalesce(j->>'$.relevance', j->>'$.reason', j->>'$.note', '')) AS relevance FROM items)
SELECT ai_id, n AS place, claim, quote, relevance FROM (SELECT *, row_number() OVER (PARTITION BY ai_id ORDER BY i) AS n FROM named WHERE claim != '' OR quote != '') WHERE n <= 8""")
def evidence_values(spark, d):
    rows = table(spark, d, "ai_results").where(F.col("evidence_json").startswith("[") & F.expr("try_parse_json(evidence_json)").isNotNull())
    rows = rows.select("ai_id", F.posexplode(enrich.evidence_column(F.col("evidence_json"))).alias("p", "e"))
    return rows.select("ai_id", (F.col("p") + 1).cast("long").alias("place"), "e.claim", "e.quote", "e.relevance")


@query("model_calls", _REUSE.replace("keyed AS (SELECT row_id,", "keyed AS (SELECT row_id, result_id, fetched_text,").replace("based AS (SELECT row_id,", "based AS (SELECT row_id, result_id, fetched_text,") + rf""",
jobs AS (SELECT ai_key, length({_strip("arg_min(coalesce(fetched_text, ''), struct_pack(a := row_id, b := result_id))")}) AS n FROM keyed GROUP BY ai_key)
SELECT ai_key, CASE WHEN n < 50 THEN 'REJECTED_EMPTY_TEXT' ELSE 'VERIFIED' END AS ai_verification_status, CASE WHEN n < 50 THEN 0 ELSE n % 101 END::INT AS quality_score, CASE WHEN n < 50 THEN 0 ELSE 1 END::INT AS evidence_count FROM jobs""")
def model_calls(spark, d):
    """A stub model answers for each distinct article; equal articles share a call."""
    first = F.min_by(F.coalesce("fetched_text", F.lit("")), F.struct("row_id", "result_id"))
    rows = table(spark, d, "scrape_results").withColumn("ai_key", _reuse_key()).groupBy("ai_key").agg(first.alias("text"))
    jobs = rows.select("ai_key", X.evidence_pack(F.col("text")).alias("pack"))
    return enrich.analysed(jobs, _stub).select("ai_key", "ai_verification_status", "quality_score", "evidence_count")


def _stub(pack: str) -> str:
    return '```json\n{"status": "verified", "quality_score": ' + str(len(pack) % 101) + ', "evidence": [{"point": "length"}]}\n```'


@query("log_lines", "SELECT row_id, concat(coalesce(run_id, ''), ' ', row_id, ': ', coalesce(quality_label, ''), ' (', coalesce(recovery_route, ''), ')') AS line FROM scrape_results")
def log_lines(spark, d):
    return io.log_lines(table(spark, d, "scrape_results"))


@query("blank_rows", f"SELECT row_id FROM manifest WHERE {' OR '.join(f"{_strip(f"coalesce({c}, '')")} != ''" for c in ('url', 'title', 'summary', 'outlet'))}")
def blank_rows(spark, d):
    rows = table(spark, d, "manifest")
    values = F.array(*(F.coalesce(c, F.lit("")) for c in ("url", "title", "summary", "outlet")))
    return rows.where(F.exists(values, lambda x: X.strip(x) != "")).select("row_id")


@query("run_history", "SELECT run_id, max(loaded_at) AS loaded_at, count(*) AS n FROM scrape_results GROUP BY run_id ORDER BY 2 DESC, 1 LIMIT 30")
def run_history(spark, d):
    """The history keeps 30 runs."""
    runs = table(spark, d, "scrape_results").groupBy("run_id").agg(F.max("loaded_at").alias("loaded_at"), F.count("*").alias("n"))
    return io.newest(runs, "run_id", "loaded_at", 30)
