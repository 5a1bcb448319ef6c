"""Reports as they arrive: an append-only feed and running failure counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_feed(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """New files under ``path`` as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def append_feed(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream to a table, each file once, also across restarts. ``once`` stops when all that is there has been taken up."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def failures_per_window(stream: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    """(window_start, sample_name, n, n_failed) per tumbling window of ``timestamp``; rows later than ``late`` do not count."""
    grouped = stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", size).alias("w"), "sample_name")
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_successful")).alias("n_failed"))
    return out.select(F.col("w.start").alias("window_start"), "sample_name", "n", "n_failed")
