"""Articles as a stream: repeats dropped within a watermark, relevance judged batch by batch, counts by window.

An extension: batch runs give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def without_repeats(stream: DataFrame, key: str = "pmid", time: str = "arrived", late: str = "1 hour") -> DataFrame:
    """The state that is kept is bounded by the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, keys: list[str], time: str = "arrived", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    counted = stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def each_batch(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """step over each micro-batch, written under the batch's number: a batch that is repeated replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
