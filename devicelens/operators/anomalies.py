"""Anomaly detection: window statistics -> z-score -> severity -> anomaly records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelens.config import DetectorConfig
from devicelens.functions.scoring import classify, expected_range, z_score
from devicelens.functions.times import micros
from devicelens.operators.rolling import rolling_stats


def min_samples_gate(stats: DataFrame, min_samples: int = 10) -> DataFrame:
    """Readings whose window (including themselves) holds enough samples to be analysed."""
    return stats.filter(F.col("window_count") >= min_samples)


def score(stats: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Add z_score and severity (NULL = normal) to window statistics."""
    return stats.withColumn(
        "z_score", z_score(F.col("value"), F.col("mean"), F.col("stddev"))
    ).withColumn("severity", classify(F.col("z_score"), cfg.profile))


def scored_readings(
    enriched: DataFrame, cfg: DetectorConfig = DetectorConfig(), method: str = "slots"
) -> DataFrame:
    """Every analysed reading with its statistics, z-score and severity."""
    stats = rolling_stats(
        enriched, cfg.keys, window_s=cfg.window_s, dedupe=cfg.dedupe, method=method, slots=cfg.slots
    )
    return score(min_samples_gate(stats, cfg.min_samples), cfg)


def to_anomalies(scored: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Anomaly records of the readings that have a severity.

    The id is a hash of the reading, so a re-run or a retried task writes the same id.  The time
    of the reading stands for the time of detection, which makes batch results repeatable.
    """
    optional = [
        F.col(c) if c in scored.columns else F.lit(None).cast("string").alias(c)
        for c in ("device_type", "device_location")
    ]
    source = [c for c in ("event_id",) if c in scored.columns]
    identity = F.concat_ws(
        "|",
        F.col("device_id").cast("string"),
        F.col("metric_type"),
        micros("timestamp").cast("string"),
        F.col("value").cast("string"),
        *[F.col(c).cast("string") for c in source],
    )
    return scored.filter(F.col("severity").isNotNull()).select(
        *source,
        F.sha2(identity, 256).alias("anomaly_id"),
        "device_id",
        "metric_type",
        F.col("value").alias("observed_value"),
        expected_range(
            F.col("mean"), F.col("stddev"), F.col("window_count"), cfg.profile
        ).alias("expected_range"),
        "z_score",
        "severity",
        F.col("timestamp").alias("detected_at"),
        *optional,
        F.lit("open").alias("status"),
    )


def detect_anomalies(
    enriched: DataFrame, cfg: DetectorConfig = DetectorConfig(), method: str = "slots"
) -> DataFrame:
    return to_anomalies(scored_readings(enriched, cfg, method), cfg)


def anomaly_message(anomalies: DataFrame) -> DataFrame:
    """The published form: z rounded to 4 (the table keeps the raw value)."""
    return anomalies.withColumn("z_score", F.round("z_score", 4)).drop("status")


def detection_summary(scored: DataFrame) -> DataFrame:
    """Readings analysed and anomalies found, by severity ('analysed' counts normal ones too)."""
    return (
        scored.groupBy(F.coalesce("severity", F.lit("none")).alias("severity"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "severity",
            "n",
        )
    )
