"""The registry of the queries on training text: name -> query, name -> SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import layout, leakage, lines, ranking, reading, repetition, tokenizer, truncation
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


_REPEATED = r"""
WITH texts AS (SELECT result_id, regexp_extract_all(lower(fetched_text), '\p{L}+') AS w FROM scrape_results WHERE fetched_text != ''),
runs AS (SELECT result_id, list_transform(range(1, len(w) - 3), lambda i: {'at': i, 'run': array_to_string(w[i:i + 4], ' ')}) AS r FROM texts WHERE len(w) >= 30),
flat AS (SELECT result_id, unnest(r, recursive := true) FROM runs),
first AS (SELECT result_id, run, min("at") AS first_at FROM flat GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT DISTINCT result_id, "at" + k.k AS place FROM flat JOIN first USING (result_id, run), (SELECT unnest(range(5)) AS k) k WHERE "at" > first_at),
counted AS (SELECT result_id, count(*) AS n FROM covered GROUP BY result_id)
SELECT result_id FROM counted JOIN texts USING (result_id) WHERE n * 10 >= len(w) * 3
"""


@query("p3_found", _REPEATED)
def p3_found(spark, d):
    return repetition.found(table(spark, d, "scrape_results"))


@query("p3_repetition")
def p3_repetition(spark, d):
    return repetition.measured(table(spark, d, "scrape_results"))


@query("p3_shares", _REPEATED.replace("length(w) >= 30", "TRUE").replace("WHERE len(w) >= 30", "").rsplit("SELECT result_id FROM counted", 1)[0] + """SELECT s.result_id, coalesce(len(w), 0)::INT AS words, coalesce(n, 0)::INT AS repeated,
  coalesce(n::DOUBLE / nullif(len(w), 0), 0.0::DOUBLE) AS repeated_share FROM scrape_results s LEFT JOIN texts USING (result_id) LEFT JOIN counted USING (result_id)""")
def p3_shares(spark, d):
    """The share of repeated wording in each text."""
    return repetition.measured(table(spark, d, "scrape_results")).drop("score")


@query("p8_ids")
def p8_ids(spark, d):
    return tokenizer.encoded(table(spark, d, "documents"))


_STANDING = r"""
WITH texts AS (
  SELECT result_id, fetched_text AS t, regexp_replace(lower(regexp_extract(CASE WHEN trim(coalesce(source_url_used, '')) != '' THEN source_url_used ELSE canonical_url END,
    '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@\s]*@)?([^/?#:\s]*)', 1)), '^www\.', '') AS domain
  FROM scrape_results WHERE fetched_text != ''),
lines AS (
  SELECT result_id, domain, t, unnest(range(len(string_split(t, chr(10))))) AS line_no, regexp_replace(lower(unnest(string_split(t, chr(10)))), '[^\p{L}]+', '', 'g') AS line
  FROM texts WHERE domain != ''),
total AS (SELECT domain, count(DISTINCT t) AS n FROM texts GROUP BY domain),
standing AS (
  SELECT domain, line FROM lines JOIN total USING (domain) WHERE line != '' GROUP BY domain, line, n HAVING count(DISTINCT t) >= 5 AND count(DISTINCT t) * 10 >= n)
"""


@query("p4_found", _STANDING + "SELECT result_id, line_no::INT AS line_no FROM lines JOIN standing USING (domain, line)")
def p4_found(spark, d):
    return lines.occurrences(table(spark, d, "scrape_results"))


@query("p4_cleaned", _STANDING + """, gone AS (SELECT DISTINCT result_id, line_no FROM lines JOIN standing USING (domain, line)),
split AS (SELECT result_id, unnest(range(len(string_split(fetched_text, chr(10))))) AS line_no, unnest(string_split(fetched_text, chr(10))) AS line FROM scrape_results WHERE fetched_text IS NOT NULL),
kept AS (SELECT result_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM split ANTI JOIN gone USING (result_id, line_no) GROUP BY 1)
SELECT s.result_id, coalesce(n, 0)::INT AS removed, CASE WHEN fetched_text IS NOT NULL THEN coalesce(t, '') END AS cleaned_text FROM scrape_results s LEFT JOIN kept USING (result_id) LEFT JOIN (SELECT result_id, count(*) AS n FROM gone GROUP BY 1) USING (result_id)""")
def p4_cleaned(spark, d):
    return lines.cleaned(table(spark, d, "scrape_results"))


@query("p5_found")
def p5_found(spark, d):
    return layout.judged(table(spark, d, "scrape_results")).select("result_id", F.explode("furniture").alias("line_no"))


@query("p5_reasons")
def p5_reasons(spark, d):
    """The lines of p5_found with what each is: menu, furniture, teaser, head or item of a side list, error, or beside the body by its markup."""
    both = F.explode(F.arrays_zip("furniture", "reasons")).alias("x")
    return layout.judged(table(spark, d, "scrape_results")).select("result_id", both).select("result_id", F.col("x.furniture").alias("line_no"), F.col("x.reasons").alias("reason"))


@query("p5_body")
def p5_body(spark, d):
    return layout.judged(table(spark, d, "scrape_results")).select("result_id", "body")


@query("p6_found")
def p6_found(spark, d):
    return layout.judged(table(spark, d, "scrape_results")).where("leftover != ''").select("result_id")


@query("p6_reasons")
def p6_reasons(spark, d):
    """The rows of p6_found with what is left of a template: an unfilled variable or slot, filler, or an error page."""
    return layout.judged(table(spark, d, "scrape_results")).where("leftover != ''").select("result_id", F.col("leftover").alias("reason"), "whole")


@query("p6_clean")
def p6_clean(spark, d):
    """The table without the rows of p6_found; rows without a text stay."""
    results = table(spark, d, "scrape_results")
    return results.join(p6_found(spark, d), "result_id", "left_anti")


@query("p10_found")
def p10_found(spark, d):
    return reading.levels(table(spark, d, "documents"), table(spark, d, "labels")).select("doc_id", "reading_level")


@query("p10_profile")
def p10_profile(spark, d):
    """How many documents and words of each source stand at each level."""
    levels = reading.levels(table(spark, d, "documents"), table(spark, d, "labels"))
    source = table(spark, d, "documents").select("doc_id", F.lower("source").alias("source"))
    return levels.join(source, "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("documents"), F.sum("words").alias("words"))


@query("p9_found")
def p9_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


@query("p9_items")
def p9_items(spark, d):
    """The items that leaked, with the number of documents that give them away and of those that hold the answer as well."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.sum(F.col("answer").cast("long")).alias("with_answer"))


_RANKING = """
WITH long AS (
  SELECT row_id, 'extraction_score' AS score, '' AS population, extraction_score::DOUBLE AS value FROM scrape_results WHERE row_id IS NOT NULL AND fetched_text != ''
  UNION ALL
  SELECT row_id, score, population, value FROM (
    SELECT row_id, coalesce(rubric_version, '') AS population, unnest(['quality_score', 'summary_alignment_score', 'source_reliability_score']) AS score,
      unnest([quality_score::DOUBLE, summary_alignment_score::DOUBLE, source_reliability_score::DOUBLE]) AS value
    FROM ai_results WHERE row_id IS NOT NULL AND upper(trim(coalesce(ai_verification_status, ''))) != 'API_ERROR') WHERE value BETWEEN 0 AND 100),
one AS (SELECT row_id, score, population, median(value) AS value FROM long WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
centre AS (SELECT score, population, median(value) AS centre FROM one GROUP BY ALL),
spread AS (SELECT score, population, any_value(centre) AS centre, median(abs(value - centre)) AS mad, avg(abs(value - centre)) AS mean_off FROM one JOIN centre USING (score, population) GROUP BY ALL),
bounded AS (
  SELECT row_id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(value - centre) / CASE WHEN mad > 0 THEN 1.4826::DOUBLE * mad WHEN mean_off > 0 THEN 1.2533::DOUBLE * mean_off ELSE 1.0::DOUBLE END)) AS b
  FROM one JOIN spread USING (score, population)),
combined AS (SELECT row_id, round(exp(avg(ln(b))), 12) AS value FROM bounded GROUP BY row_id)
SELECT row_id, row_number() OVER (ORDER BY value DESC, row_id) AS rank FROM combined
"""


@query("p7_ranking", _RANKING)
def p7_ranking(spark, d):
    return ranking.ranking(table(spark, d, "scrape_results"), table(spark, d, "ai_results")).select("row_id", "rank")


@query("p2_found")
def p2_found(spark, d):
    return truncation.fields(table(spark, d, "scrape_results")).where("cut").select("result_id", "field")


@query("p2_sources")
def p2_sources(spark, d):
    """How often each domain's values are cut, by field."""
    rows = truncation.fields(table(spark, d, "scrape_results"))
    return rows.groupBy("domain", "field").agg(F.count("*").alias("n_values"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("share"))
