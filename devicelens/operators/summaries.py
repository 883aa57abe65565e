"""Grouped summaries of the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelens.functions.times import MICROS, micros
from devicelens.operators.histograms import DELIVERY_BUCKETS, HTTP_BUCKETS, to_buckets

# The gauges that are shown as 0 when nothing fires.
KNOWN_SEVERITIES = ("critical", "warning", "info")
KNOWN_PIPELINES = ("ingestion", "detection", "diagnosis", "api", "alerting")


def firing_breakdown(active: DataFrame) -> DataFrame:
    """Firing alerts in total, by severity and by pipeline, in one aggregation."""
    out = active.groupingSets(
        [[], [F.col("severity")], [F.col("pipeline")]], F.col("severity"), F.col("pipeline")
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    # grouping_id: 3 = total, 1 = by severity, 2 = by pipeline.
    return out.select(
        F.when(F.col("_g") == 3, "total")
        .when(F.col("_g") == 1, "severity")
        .otherwise("pipeline")
        .alias("dimension"),
        F.when(F.col("_g") == 3, "all")
        .when(F.col("_g") == 1, F.col("severity"))
        .otherwise(F.col("pipeline"))
        .alias("name"),
        "n",
    )


def firing_gauges(active: DataFrame) -> DataFrame:
    """As :func:`firing_breakdown`, with the known names present even at 0."""
    spark = active.sparkSession
    known = spark.createDataFrame(
        [("total", "all")]
        + [("severity", s) for s in KNOWN_SEVERITIES]
        + [("pipeline", p) for p in KNOWN_PIPELINES],
        "dimension STRING, name STRING",
    )
    return known.join(firing_breakdown(active), ["dimension", "name"], "full_outer").select(
        "dimension", "name", F.coalesce("n", F.lit(0)).alias("n")
    )


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def alert_events_received(log: DataFrame) -> DataFrame:
    return count_by(log, "status", "severity")


def affected_devices_and_causes(
    rows: DataFrame, group: list[str], device: str, cause: str, order: Column
) -> tuple[DataFrame, DataFrame]:
    """(distinct devices per group, distinct causes per group in first-seen order)."""
    devices = rows.groupBy(*group).agg(F.countDistinct(device).alias("devices"))
    first_seen = rows.groupBy(*group, cause).agg(F.min(order).alias("first_seen"))
    return devices, first_seen


def http_requests(log: DataFrame, ignore: str = "/metrics") -> DataFrame:
    return count_by(
        log.filter(F.col("endpoint") != ignore), "method", "endpoint", "status_code"
    )


def http_latency(log: DataFrame, duration: str = "duration", ignore: str = "/metrics") -> DataFrame:
    return to_buckets(
        log.filter(F.col("endpoint") != ignore), ["method", "endpoint"], duration, HTTP_BUCKETS
    )


def with_delivery_latency(
    log: DataFrame, started: str = "started_at", received: str = "received_at"
) -> DataFrame:
    """Seconds from alert start to receipt; only 0 < x < 3600 counts."""
    seconds = (micros(received) - micros(started)) / MICROS
    return log.withColumn("delivery_s", seconds).filter(
        (F.col("delivery_s") > 0) & (F.col("delivery_s") < 3600)
    )


def delivery_latency(log: DataFrame) -> DataFrame:
    return to_buckets(with_delivery_latency(log), [], "delivery_s", DELIVERY_BUCKETS)


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    """Documents ingested / failed and chunks written, from one outcome row per document."""
    return outcomes.groupBy().agg(
        F.count_if("ok").alias("ingested"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("chunk_count"))), F.lit(0)).alias("chunks"),
    )


def diagnosis_outcomes(outcomes: DataFrame) -> DataFrame:
    """Diagnoses generated by severity and failed by phase."""
    failed = F.col("failed_phase").isNotNull()
    return (
        outcomes.groupBy(
            F.when(failed, "failed").otherwise("generated").alias("outcome"),
            F.when(failed, F.col("failed_phase")).otherwise(F.col("severity")).alias("label"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
