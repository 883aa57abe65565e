"""JSON messages between the stages, keyed by device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelens.operators.anomalies import anomaly_message


def to_messages(df: DataFrame, key: str = "device_id") -> DataFrame:
    """``(key, value)`` rows; equal keys go to the same topic partition, in order."""
    return df.select(
        F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value")
    )


def enriched_messages(enriched: DataFrame) -> DataFrame:
    return to_messages(enriched)


def anomaly_messages(anomalies: DataFrame) -> DataFrame:
    return to_messages(anomaly_message(anomalies))


def parse_anomaly_messages(messages: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Anomaly records of the readable messages.

    An unreadable message has no anomaly; count it under phase 'context' with
    :func:`malformed_anomaly_messages`.
    """
    return (
        messages.withColumn("_a", F.from_json(column, schema))
        .filter(F.col("_a.device_id").isNotNull() & F.col("_a.severity").isNotNull())
        .select("_a.*")
    )


def malformed_anomaly_messages(messages: DataFrame, schema: str, column: str = "value") -> DataFrame:
    parsed = F.from_json(column, schema)
    return messages.filter(parsed["device_id"].isNull() | parsed["severity"].isNull()).withColumn(
        "failed_phase", F.lit("context")
    )
