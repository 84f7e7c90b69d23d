"""Event flow as it arrives: late and repeated rows, groups closed by gaps, running status.

These are the batch operators' counterparts on Structured Streaming. State is bounded by the
watermark: rows later than it are dropped, groups and files older than it are closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def without_repeats(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each key once, as long as its repeats come within ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def gap_sessions(stream: DataFrame, by: list[str], time: str, gap: str, value: str, late: str = "1 hour") -> DataFrame:
    """Groups of rows less than ``gap`` apart per key, emitted once the watermark has passed them.

    The streaming form of ``gaps.gap_groups``: first, last, number and sum of ``value``.
    """
    s = stream.withWatermark(time, late)
    return s.groupBy(*by, F.session_window(time, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*by, F.col("_w.start").alias("first"), F.col("_w.end").alias("until"), "n", "total")


def period_counts(stream: DataFrame, by: list[str], time: str, period: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows per key and period, updated until the watermark passes the period."""
    s = stream.withWatermark(time, late)
    return s.groupBy(*by, F.window(time, period).alias("_w")).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("_w.start").alias("period"), "n")


def event_status(stream: DataFrame, time: str, late: str = "1 day", period: str = "1 day") -> DataFrame:
    """Per file and period: reports, failed ones, distinct events (approximate)."""
    s = stream.withWatermark(time, late)
    return s.groupBy("file", F.window(time, period).alias("_w")).agg(
        F.count(F.lit(1)).alias("n_reports"), F.count_if(~F.col("ok")).alias("n_failed"), F.approx_count_distinct("event_id").alias("n_events")
    ).select("file", F.col("_w.start").alias("period"), "n_reports", "n_failed", "n_events")
