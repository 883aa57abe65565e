"""Dead-letter envelopes, counts and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW_TOPIC = "telemetry.raw"


def _texts(device: Column, detail: Column) -> dict[str, Column]:
    # The reject reasons and their wording.
    return {
        "validation_failed": F.concat(F.lit("Schema validation failed: "), detail),
        "device_not_found": F.concat(F.lit("Device "), device, F.lit(" not found during enrichment")),
        "fk_violation": F.concat(
            F.lit("Foreign key violation: device "), device, F.lit(" not registered")
        ),
        "db_error": F.concat(F.lit("Database error: "), detail),
    }


REASONS = ("validation_failed", "device_not_found", "fk_violation", "db_error")


def to_dlq(
    bad: DataFrame,
    reason: str,
    payload: str = "payload",
    detail: str | None = "reason",
    topic: str = RAW_TOPIC,
    failed_at: Column | None = None,
) -> DataFrame:
    """Envelope of one reject branch."""
    device = (
        F.coalesce(F.col("device_id").cast("string"), F.lit("unknown"))
        if "device_id" in bad.columns
        else F.lit("unknown")
    )
    detail_col = F.col(detail) if detail and detail in bad.columns else F.lit("")
    return bad.select(
        F.lit(topic).alias("original_topic"),
        F.col(payload).alias("original_payload"),
        _texts(device, detail_col)[reason].alias("error_reason"),
        F.lit(reason).alias("reason"),
        (F.current_timestamp() if failed_at is None else failed_at).alias("failed_at"),
    )


def union_rejects(*branches: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), branches)


def stored_payload(payload: Column) -> Column:
    """What the table stores: the payload if it is JSON, else ``{"raw": payload}``."""
    return F.when(F.try_parse_json(payload).isNotNull(), payload).otherwise(
        F.to_json(F.struct(payload.alias("raw")))
    )


def dlq_message(dlq: DataFrame) -> DataFrame:
    """What the topic carries: the whole envelope as JSON."""
    return dlq.select(
        F.to_json(F.struct("original_payload", "error_reason", "original_topic")).alias("value")
    )


def dlq_by_reason(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def reconcile(sent: DataFrame, persisted: DataFrame, dlq: DataFrame) -> DataFrame:
    """sent = persisted + dead letters?  One row, from one tagged aggregation."""
    tagged = union_rejects(
        *[
            df.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(tag).alias("part"), "n")
            for tag, df in (("sent", sent), ("persisted", persisted), ("dlq", dlq))
        ]
    )
    counts = tagged.groupBy().agg(
        *[
            F.sum(F.when(F.col("part") == tag, F.col("n")).otherwise(0)).alias(tag)
            for tag in ("sent", "persisted", "dlq")
        ]
    )
    lost = F.greatest(F.lit(0), F.col("sent") - F.col("persisted") - F.col("dlq"))
    return counts.withColumn(
        "drop_rate", lost / F.greatest(F.lit(1), F.col("sent"))
    )
