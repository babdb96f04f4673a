"""A landing folder read as a stream: canonical rows are upserted batch by batch, windows count them with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import bucketed


def stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upsert_into(target: str, key: list[str], seq: str, buckets: int = bucketed.BUCKETS):
    """A foreachBatch function that keeps the last row of each key under target (read it with bucketed.read).

    A batch writes the hash buckets that its keys fall into and commits them under its number; one that is run again finds its
    number taken and changes nothing."""

    def batch(df: DataFrame, number: int) -> None:
        bucketed.upsert(df, target, key, seq, number, buckets)

    return batch


def windowed_counts(events: DataFrame, at: str, window: str, late: str, by: list[str]) -> DataFrame:
    """Counts by event-time window; rows later than the watermark are left out, as evidence published too late is."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")
