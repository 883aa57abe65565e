"""Streaming sources and sinks.

``fmt`` is ``kafka`` on a cluster and a file format in tests; everything after the payload column is
the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def kafka_rows(records: DataFrame) -> DataFrame:
    """Kafka records (stream or batch) -> ``payload``, ``position``, ``received_at``."""
    return records.select(
        F.col("value").cast("string").alias("payload"),
        F.concat_ws("/", "topic", "partition", "offset").alias("position"),
        F.col("timestamp").alias("received_at"),
    )


def read_messages(
    spark: SparkSession, source: str, fmt: str = "kafka", per_trigger: int = 0, **options: str
) -> DataFrame:
    """``payload`` text with its source position, from the start of the source.

    For Kafka ``source`` is the topic and ``options`` hold the connection; ``per_trigger`` bounds
    the messages (files for file sources) of a micro-batch, 0 (the default) leaves it open.
    """
    reader = spark.readStream.format("kafka" if fmt == "kafka" else "text")
    for key, value in options.items():
        reader = reader.option(key.replace("__", "."), value)
    if fmt == "kafka":
        reader = reader.option("subscribe", source).option("startingOffsets", "earliest")
        if per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", per_trigger)
        return kafka_rows(reader.load())
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(source).select(
        F.col("value").alias("payload"),
        F.col("_metadata.file_name").alias("position"),
        F.col("_metadata.file_modification_time").alias("received_at"),
    )


def read_raw_stream(spark: SparkSession, source: str, fmt: str = "kafka", **options) -> DataFrame:
    """Raw readings; at-least-once, since offsets are committed after the batch."""
    return read_messages(spark, source, fmt, **options)


def read_anomaly_stream(
    spark: SparkSession, source: str, fmt: str = "kafka", **options
) -> DataFrame:
    return read_messages(spark, source, fmt, **options)


def message_writer(
    messages: DataFrame, sink: str, checkpoint: str, fmt: str = "kafka", **options: str
) -> DataStreamWriter:
    """Streaming write of ``(key, value)`` rows to a topic or a folder."""
    writer = messages.writeStream.option("checkpointLocation", checkpoint)
    for key, value in options.items():
        writer = writer.option(key.replace("__", "."), value)
    if fmt == "kafka":
        return writer.format("kafka").option("topic", sink)
    return writer.format(fmt).option("path", sink)


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
    """Write one micro-batch to its own folder; a replayed batch replaces itself."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
