"""Choice among candidates: top k per job, early stop over routes, the best, and the trace of all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as X

ORDER = ("route_no", "seq")


def top(candidates: DataFrame, k: int = 12, job: str = "job_key") -> DataFrame:
    """The k best of each job by score, then length, then order of generation."""
    w = Window.partitionBy(job).orderBy(F.desc("score"), F.desc(F.length("text")), *ORDER)
    return candidates.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def measured(candidates: DataFrame, min_chars: int = 300) -> DataFrame:
    """candidates with the label of their own text."""
    out = X.judged(candidates, "text", F.col("http_status"), min_chars)
    return out


def until_full(candidates: DataFrame, job: str = "job_key", everything: bool = False) -> DataFrame:
    """Candidates of the routes up to the first whose best text is whole (text_label full_text); all of them with ``everything``.

    Both windows are over a job's own candidates, of which routes and TOP bound the number, and share one shuffle.
    """
    if everything:
        return candidates
    route = Window.partitionBy(job, "route_no").orderBy(F.desc("score"), F.desc(F.length("text")), "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.partitionBy(job).orderBy("route_no").rangeBetween(Window.unboundedPreceding, -1)
    marked = candidates.repartition(job).withColumn("_full", (F.first(F.col("text_label") == "full_text").over(route)).cast("int"))
    return marked.withColumn("_done", F.coalesce(F.max("_full").over(before), F.lit(0))).where("_done = 0").drop("_full", "_done")


def best(candidates: DataFrame, job: str = "job_key") -> DataFrame:
    """One row per job: its best candidate, the number of candidates, their routes and the trace as JSON."""
    rank = F.struct("score", F.length("text").alias("n"), (-F.col("route_no")).alias("r"), (-F.col("seq")).alias("s"))
    attempt = F.struct(
        F.col("route_no"), F.col("seq"), F.col("route"), F.col("source_url").alias("sourceUrl"), F.col("http_status").alias("statusCode"), "chars", "words", "paragraphs", X.tenth(F.col("score")).alias("score"),
        F.col("text_label").alias("label"), "error", "title", "author", F.col("boilerplate_ratio").alias("boilerplateRatio"), F.col("duplicate_paragraph_ratio").alias("duplicateParagraphRatio"),
    )
    cols = [c for c in candidates.columns if c != job]
    agg = candidates.groupBy(job).agg(F.max_by(F.struct(*cols), rank).alias("b"), F.count("*").alias("candidate_count"), F.sort_array(F.collect_list(attempt)).alias("attempts"))
    chosen = lambda a: (a["route_no"] == F.col("b.route_no")) & (a["seq"] == F.col("b.seq"))
    trace = F.transform("attempts", lambda a: a.dropFields("route_no", "seq").withField("selected", chosen(a)))
    routes = F.array_join(F.array_distinct(F.transform("attempts", lambda a: a["route"])), " | ")
    return agg.select(job, "b.*", "candidate_count", routes.alias("candidate_routes"), F.to_json(trace).alias("extraction_trace_json"))


def snapshots(index: DataFrame, limit: int = 8) -> DataFrame:
    """Usable rows of an archive index: whole HTML pages, equal neighbours once, the first ``limit`` of each url, latest first as ``place``."""
    w = Window.partitionBy("url").orderBy("timestamp", "digest")
    good = index.where("statuscode = '200' and mimetype = 'text/html'").withColumn("before", F.lag("digest").over(w)).where("before is null or before != digest").drop("before")
    first = good.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return first.withColumn("place", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("timestamp"), "digest"))).drop("n")


def snapshot_stop(candidates: DataFrame, per_snapshot: int = 4, enough: float = 82, job: str = "job_key") -> DataFrame:
    """The best few of each snapshot, up to the first snapshot that is good enough."""
    w = Window.partitionBy(job, "place").orderBy(F.desc("score"), F.desc(F.length("text")), "seq")
    few = candidates.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_snapshot).drop("n")
    tops = few.groupBy(job, "place").agg(F.max("score").alias("top"))
    before = F.max("top").over(Window.partitionBy(job).orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    kept = tops.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") < enough)).select(job, "place")
    return few.join(kept, [job, "place"], "left_semi")
