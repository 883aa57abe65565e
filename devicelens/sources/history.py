"""Month-partitioned history table of enriched readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_event_month(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumn("event_month", F.date_format(ts, "yyyy-MM"))


def write_history(df: DataFrame, path: str, ts: str = "timestamp", mode: str = "append") -> None:
    """Append to the history, partitioned by month and clustered by device and time in each file.

    Clustering makes the Parquet row-group statistics selective for device and time filters.  Rows
    are spread over tasks by month and device hash, so one busy month is written by many tasks.
    """
    monthly = with_event_month(df, ts)
    (
        monthly.repartition("event_month", F.pmod(F.xxhash64("device_id", ts), F.lit(64)))
        .sortWithinPartitions("event_month", "device_id", ts)
        .write.mode(mode)
        .partitionBy("event_month")
        .parquet(path)
    )


def recent_history(df: DataFrame, low_us: int, high_us: int) -> DataFrame:
    """Rows with low < timestamp <= high, in epoch microseconds.

    The bounds are literals on the stored columns: they reach the scan, and whole months are
    pruned where the table has ``event_month``.
    """
    low, high = F.timestamp_micros(F.lit(low_us)), F.timestamp_micros(F.lit(high_us))
    if "event_month" in df.columns:
        month = F.col("event_month").cast("string")
        df = df.filter(
            (month >= F.date_format(low, "yyyy-MM")) & (month <= F.date_format(high, "yyyy-MM"))
        )
    return df.filter((F.col("timestamp") > low) & (F.col("timestamp") <= high))


def compact_history(spark: SparkSession, batches: str, path: str) -> None:
    """Rewrite the small files of the ingest's batch folders as one clustered history table."""
    write_history(spark.read.parquet(batches).drop("batch_id"), path, mode="overwrite")


def read_history(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """History in [start, end); whole months outside are pruned before any file is opened."""
    df = spark.read.parquet(path).withColumn("event_month", F.col("event_month").cast("string"))
    return in_range(df, start, end)


def in_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a table with ``event_month`` in [start, end), by month and by time."""
    kind = df.schema["timestamp"].dataType
    if start is not None:
        df = df.filter(F.col("event_month") >= start[:7]).filter(
            F.col("timestamp") >= F.lit(start).cast(kind)
        )
    if end is not None:
        df = df.filter(F.col("event_month") <= end[:7]).filter(
            F.col("timestamp") < F.lit(end).cast(kind)
        )
    return df
