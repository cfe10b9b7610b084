"""Disclosure events as they come in. The reference serves a fixed release; these are extras.

The same function describes a batch and a stream, so the batch form is what streams are
tested against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Events from parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, length: str, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """events: ts, type, value. type, begin, n, value (decimal) in tumbling or sliding windows. lateness: on a stream, how late an event may be."""
    if lateness:
        events = events.withWatermark("ts", lateness)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.groupBy("type", window.alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(15,2)")).alias("value"))
    return out.select("type", F.col("w.start").alias("begin"), "n", "value")


def sessions(events: DataFrame, gap: str, lateness: str | None = None) -> DataFrame:
    """corp, begin, end, n: runs of a company's events with no pause of ``gap``."""
    if lateness:
        events = events.withWatermark("ts", lateness)
    return events.groupBy("corp", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("corp", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def appended(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends finished windows to parquet, exactly once."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
