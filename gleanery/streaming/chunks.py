"""An extension: a manifest that arrives in files is run chunk by chunk with the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, source: str, schema: str, plan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Each new Parquet file of ``source`` goes through ``plan`` into its own batch folder of ``sink``, so a repeated batch replaces itself."""

    def one(chunk: DataFrame, epoch: int) -> None:
        plan(chunk).write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
