"""Problem 7: one ranking of articles from scores on different scales.

Each score is standardised robustly within its own population (ratings under another rubric are a population of their
own): (x - median) / (1.4826 MAD), with the mean absolute deviation where the MAD is 0. A logistic squashes it into
(0, 1), which bounds outliers, and the weighted geometric mean of an article's scores ranks it, so no score counts more for
its range. The median and the MAD are exact and never gathered in one task: values are counted in BUCKETS equal steps between a
population's least and greatest, and only those of the middle's bucket are counted one by one, as often as one bucket still
holds more than ONE_TASK distinct values.

Failed calls (status API_ERROR), extraction scores of rows without a text, nulls, and ratings outside 0..100 are missing
scores and leave their weight to the others; extraction scores may be negative or above 100. Of repeated rows of an article
the median counts. Articles without any score are not ranked. Ties of the value
are broken by row_id. A table without rows gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import broadcastable, checkpointed

#: Facts of up to so many populations (a score under a rubric) are broadcast; of more they are joined by shuffle.
POPULATIONS = 100_000

#: Weights; equal, since no score is known to matter more.
WEIGHTS = {"extraction_score": 1.0, "quality_score": 1.0, "summary_alignment_score": 1.0, "source_reliability_score": 1.0}


def long_scores(scrapes: DataFrame, results: DataFrame) -> DataFrame:
    """(row_id, score, population, value): every usable score."""
    usable = (F.upper(F.trim(F.coalesce("ai_verification_status", F.lit("")))) != "API_ERROR") & F.col("row_id").isNotNull()
    names = [n for n in WEIGHTS if n != "extraction_score"]
    stack = f"stack({len(names)}, " + ", ".join(f"'{n}', cast({n} as double)" for n in names) + ") as (score, value)"
    rated = results.where(usable).select("row_id", F.coalesce("rubric_version", F.lit("")).alias("population"), *names).selectExpr("row_id", stack, "population").where("value between 0 and 100")
    extracted = scrapes.where("row_id is not null and length(fetched_text) > 0").select("row_id", F.lit("extraction_score").alias("score"), F.col("extraction_score").alias("value"), F.lit("").alias("population"))
    return extracted.unionByName(rated).where("value is not null and not isnan(value)")


BUCKETS, ONE_TASK = 4096, 200_000
_GROUP = ["score", "population"]


def middles(values: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(score, population, middle): exact medians of (score, population, value, n), n being how often a value stands.

    ``rank`` are the places still looked for, one or two; each round narrows a population to the buckets that hold them, and the last
    sorts what is left. Two values that are next to each other in the order may lie in two buckets.
    """
    bounds = values.groupBy(*_GROUP).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("total"))
    bounds = bounds.select(*_GROUP, "low", "high", F.explode(F.array_distinct(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)))).alias("rank")).withColumn("which", F.col("rank"))
    bounds = checkpointed(bounds)
    for _ in range(64):  # a double has 64 bits, and each round takes at least twelve of them off a range
        inside = _joined(values, bounds).where(F.col("value").between(F.col("low"), F.col("high")))
        if inside.groupBy(*_GROUP, "which").agg(F.count_distinct("value").alias("d")).where(F.col("d") > one_task).isEmpty():
            break
        step = (F.col("high") - F.col("low")) / BUCKETS
        bucket = F.when(step > 0, F.least(F.lit(BUCKETS - 1), F.floor((F.col("value") - F.col("low")) / step))).otherwise(0)
        sums = inside.withColumn("bucket", bucket).groupBy(*_GROUP, "which", "rank", "bucket").agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*_GROUP, "which").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = sums.withColumn("before", before).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        bounds = checkpointed(held.select(*_GROUP, "low", "high", (F.col("rank") - F.col("before")).alias("rank"), "which"))
    left = _joined(values, bounds).where(F.col("value").between(F.col("low"), F.col("high"))).groupBy(*_GROUP, "which", "rank", "value").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*_GROUP, "which").orderBy("value"))
    places = left.withColumn("upto", upto).where(F.col("upto") > F.col("rank")).groupBy(*_GROUP, "which").agg(F.min("value").alias("value"))
    return places.groupBy(*_GROUP).agg(F.avg("value").alias("middle"))


def _joined(values: DataFrame, few: DataFrame) -> DataFrame:
    return values.join(F.broadcast(few) if broadcastable(few, POPULATIONS) else few, _GROUP)


def standardised(scores: DataFrame) -> DataFrame:
    """(row_id, score, bounded): the squashed standard score of each article's score."""
    one = checkpointed(scores.groupBy("row_id", *_GROUP).agg(F.expr("percentile(value, 0.5)").alias("value")))
    counted = checkpointed(one.groupBy(*_GROUP, "value").agg(F.count("*").alias("n")))
    centre = checkpointed(middles(counted).withColumnRenamed("middle", "centre"))
    off = _joined(counted, centre).select(*_GROUP, F.abs(F.col("value") - F.col("centre")).alias("value"), "n")
    mean = off.groupBy(*_GROUP).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean_off"))
    spread = middles(off).withColumnRenamed("middle", "mad").join(mean, _GROUP)
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("mean_off") > 0, 1.2533 * F.col("mean_off")).otherwise(1.0)
    base = checkpointed(spread.join(centre, _GROUP).select(*_GROUP, "centre", scale.alias("scale")))
    z = (F.col("value") - F.col("centre")) / F.col("scale")
    return _joined(one, base).select("row_id", "score", (1.0 / (1.0 + F.exp(-z))).alias("bounded"))


def combined(scrapes: DataFrame, results: DataFrame) -> DataFrame:
    """(row_id, value): the weighted geometric mean of each article's bounded scores, rounded to 12 places so that ties are ties."""
    weight = F.lit(0.0)
    for name, w in WEIGHTS.items():
        weight = F.when(F.col("score") == name, w).otherwise(weight)
    rows = standardised(long_scores(scrapes, results)).withColumn("w", weight)
    return rows.groupBy("row_id").agg(F.round(F.exp(F.sum(F.col("w") * F.log("bounded")) / F.sum("w")), 12).alias("value"))


def ranking(scrapes: DataFrame, results: DataFrame) -> DataFrame:
    """(row_id, rank, value): 1 is the best.

    The order is total, so the rows are sorted by range; a row's rank is its place in its partition plus the rows of
    the partitions before it, of which there is one number each. No single task sees all rows.
    """
    ordered = checkpointed(combined(scrapes, results).orderBy(F.desc("value"), "row_id"))
    placed = ordered.select("row_id", "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")).withColumn("place", F.col("id") - F.col("part").cast("long") * (1 << 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "part").select("row_id", (F.col("place") + F.col("before") + 1).alias("rank"), "value")
