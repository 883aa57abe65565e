"""Continuous ingest: validate, check the registry, enrich, and fan out to the sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from devicelens.functions.times import MICROS, micros
from devicelens.operators.dead_letters import dlq_message, stored_payload, to_dlq, union_rejects
from devicelens.operators.enrichment import enrich_or_mark
from devicelens.operators.validation import check_raw, with_event_id
from devicelens.sources.history import with_event_month
from devicelens.sources.messages import enriched_messages
from devicelens.sources.streams import write_batch


@dataclass(frozen=True)
class IngestPaths:
    history: str
    enriched: str
    dlq_table: str
    dlq_topic: str


def judge(
    raw: DataFrame, devices: DataFrame, id_kind: str = "uuid", late_after_s: int | None = None
) -> DataFrame:
    """Every raw message, parsed and enriched, with its ``outcome``.

    'accepted', 'validation_failed' (``reason`` names the check), 'device_not_found', or 'late': a
    reading more than ``late_after_s`` older than its receipt.  By default late ones are accepted.
    """
    marked = enrich_or_mark(check_raw(raw, id_kind=id_kind), devices)
    behind = F.lit(False)
    if late_after_s is not None:
        behind = micros("received_at") - micros("timestamp") > late_after_s * MICROS
    return marked.withColumn(
        "outcome",
        F.when(F.col("reason").isNotNull(), "validation_failed")
        .when(behind, "late")
        .when(~F.col("known"), "device_not_found")
        .otherwise("accepted"),
    ).withColumn("reason", F.when(F.col("outcome") == "late", "late").otherwise(F.col("reason")))


def split_outcomes(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(enriched readings, dead letters)."""
    source = ["position"] if "position" in judged.columns else []
    accepted = judged.filter(F.col("outcome") == "accepted")
    enriched = with_event_id(accepted, *source).drop(
        "payload", "position", "outcome", "reason", "known"
    )
    failed_at = F.col("received_at")

    def letters(outcome: str, wording: str) -> DataFrame:
        rows = judged.filter(F.col("outcome") == outcome)
        return to_dlq(rows, wording, failed_at=failed_at).withColumn("reason", F.lit(outcome))

    return enriched, union_rejects(
        letters("validation_failed", "validation_failed"),
        letters("late", "validation_failed"),
        letters("device_not_found", "device_not_found"),
    )


def ingest_batch(
    raw: DataFrame, devices: DataFrame, id_kind: str = "uuid", late_after_s: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(enriched readings, dead letters) of raw messages; works on a batch or a micro-batch."""
    return split_outcomes(judge(raw, devices, id_kind, late_after_s))


def ingest_writer(
    devices: Callable[[], DataFrame],
    paths: IngestPaths,
    id_kind: str = "uuid",
    late_after_s: int | None = None,
):
    """``foreachBatch`` function with four sinks.

    The judged micro-batch is kept for the sinks (recomputed from the source if an executor is
    lost).  Each sink writes a folder per batch id and replaces it on replay, so the tables hold each
    batch once although delivery is at-least-once.  ``devices`` is read per batch, so that newly
    registered devices are seen.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        judged = judge(batch, devices(), id_kind, late_after_s).persist()
        try:
            enriched, dead = split_outcomes(judged)
            # Rebalanced by month: few files for a small batch, many tasks for a large one.
            monthly = with_event_month(enriched).hint("rebalance", "event_month")
            clustered = monthly.sortWithinPartitions("event_month", "device_id", "timestamp")
            write_batch(clustered, paths.history, batch_id, ("event_month",))
            write_batch(enriched_messages(enriched.drop("received_at")), paths.enriched, batch_id)
            write_batch(
                dead.withColumn("original_payload", stored_payload(F.col("original_payload"))),
                paths.dlq_table,
                batch_id,
            )
            write_batch(dlq_message(dead), paths.dlq_topic, batch_id)
        finally:
            judged.unpersist()

    return write


def start_ingest(
    raw: DataFrame,
    devices: Callable[[], DataFrame],
    paths: IngestPaths,
    checkpoint: str,
    id_kind: str = "uuid",
    trigger: dict | None = None,
    late_after_s: int | None = None,
) -> StreamingQuery:
    return (
        raw.writeStream.foreachBatch(ingest_writer(devices, paths, id_kind, late_after_s))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def dedupe_replays(events: DataFrame, delay: str = "10 minutes", ts: str = "timestamp") -> DataFrame:
    """Drop redelivered readings: the same event id within the watermark delay (a batch: anywhere)."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"])
