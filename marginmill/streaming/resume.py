"""Resumable processing of arriving JSON-lines files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import jsonl


def process_files(spark: SparkSession, inbox: str, name: str, work: Callable[[DataFrame], DataFrame], out: str, state: str) -> StreamingQuery:
    """Each file of the inbox once: work() on every micro-batch, its rows in a folder of the batch, so that a retried batch overwrites itself."""
    rows = spark.readStream.schema(jsonl.schema(name)).json(inbox)

    def sink(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()


def status_counts(spark: SparkSession, inbox: str, schema: str, status: Callable) -> DataFrame:
    """Running counts by status family of a stream of results."""
    return spark.readStream.schema(schema).json(inbox).groupBy(status(F.col("status")).alias("family")).count()
