"""Anomaly detection and request limits (A*, K*, ST2, ST5, ST6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelens.catalog.domain import DETECTOR, END_S, MICROS, START_S, Domain
from devicelens.catalog.registry import Registry, r, us
from devicelens.catalog.sql import build, rd, round4
from devicelens.config import DEPLOYED_PROFILE, RateLimits
from devicelens.functions.scoring import classify, expected_range, z_score
from devicelens.functions.times import micros
from devicelens.operators import anomalies as an
from devicelens.operators.limits import rate_limit_checks, rate_limit_violations
from devicelens.operators.rolling import rolling_stats
from devicelens.sources.history import with_event_month
from devicelens.streaming.detect import score_batch, score_stream
from devicelens.streaming.replay import replay


def _stats(df):
    # Nine digits: means of two-decimal values have exact ties at fewer.
    return df.select(
        "event_id", "window_count", r("mean", 9), r("stddev", 9), "min_value", "max_value"
    )



STATS_SQL = f"""
    SELECT event_id, count(*) OVER w AS window_count, {rd("avg(value) OVER w", 9)} AS mean,
           {rd("CASE WHEN min(value) OVER w = max(value) OVER w THEN 0 ELSE stddev_pop(value) OVER w END", 9)}
             AS stddev, min(value) OVER w AS min_value, max(value) OVER w AS max_value
    FROM {{source}}
    WINDOW w AS (PARTITION BY metric_type ORDER BY ts_us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW)"""

LIMITS = RateLimits(limits={"ingestion": 8, "query": 12})


def _request_log(d: Domain):
    return d.requests.select(
        "event_id",
        F.col("job").alias("user"),
        F.when(F.col("endpoint") == "/api/v1/telemetry", "ingestion")
        .when(F.col("endpoint") == "/metrics", "other")
        .otherwise("query")
        .alias("bucket"),
        "timestamp",
    )


CHECKS_SQL = """
    SELECT event_id, requests, max_requests, requests > max_requests AS limited,
           CASE WHEN requests > max_requests
                THEN greatest(1, CAST(floor((oldest - ts_us) / 1000000.0 + 60) AS BIGINT)) END AS retry_after
    FROM (SELECT event_id, ts_us, count(*) OVER w AS requests, min(ts_us) OVER w AS oldest,
                 CASE bucket WHEN 'ingestion' THEN 8 ELSE 12 END AS max_requests
          FROM (SELECT event_id, ts_us, job, CASE endpoint WHEN '/api/v1/telemetry' THEN 'ingestion'
                       WHEN '/metrics' THEN 'other' ELSE 'query' END AS bucket FROM requests)
          WINDOW w AS (PARTITION BY job, bucket ORDER BY ts_us
                       RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW))"""


def _doubled(d: Domain):
    """Every reading delivered twice."""
    return d.readings.unionByName(d.readings.withColumn("event_id", -F.col("event_id") - 1))


BATCH_S = 3600


def _micro_batches(d: Domain):
    """All readings as consecutive micro-batches of an hour, each scored against the stored history."""
    t = micros("timestamp")
    history = with_event_month(d.enriched)
    scored = []
    for start in range(START_S, END_S + 1, BATCH_S):
        low, high = start * MICROS, (start + BATCH_S) * MICROS - 1
        batch = d.enriched.filter((t >= low) & (t <= high))
        scored.append(score_batch(history, batch, DETECTOR, low, high))
    return reduce(DataFrame.unionByName, scored).select(
        "event_id", F.round("z_score", 4).alias("z_score"), "window_count", "severity"
    )


def register(reg: Registry) -> None:
    reg.add(
        "a1_rolling_stats",
        lambda d: _stats(rolling_stats(d.readings, ["metric_type"])),
        build(STATS_SQL.format(source="readings")),
    )
    reg.add(
        "a2_rolling_stats_dedupe",
        lambda d: _stats(rolling_stats(_doubled(d), ["metric_type"], dedupe=True)),
        build(
            f"""SELECT unnest([event_id, -event_id - 1]) AS event_id, window_count, mean, stddev,
                min_value, max_value FROM ({STATS_SQL.format(source="readings")})"""
        ),
    )
    reg.add(
        "a3_min_samples_gate",
        lambda d: an.min_samples_gate(rolling_stats(d.enriched, ["metric_type"]))
        .groupBy("metric_type")
        .agg(F.count(F.lit(1)).alias("n"), F.min("window_count").alias("smallest")),
        build(
            """SELECT metric_type, count(*) AS n, min(n) AS smallest FROM windowed WHERE n >= 10
               GROUP BY ALL"""
        ),
    )
    reg.add(
        "a4_z_scores",
        lambda d: rolling_stats(d.enriched, ["metric_type"], method="frame")
        .withColumn("z_score", z_score(F.col("value"), F.col("mean"), F.col("stddev")))
        .select("event_id", r("z_score", 4)),
        build(
            """SELECT event_id, round(CASE WHEN lo = hi THEN 0 ELSE (value - mean) / sd0 END, 4) + 0.0
               AS z_score FROM windowed"""
        ),
    )
    reg.add(
        "a5_severities_deployed",
        lambda d: d.scored.withColumn("severity", classify(F.col("z_score"), DEPLOYED_PROFILE))
        .groupBy(F.coalesce("severity", F.lit("none")).alias("severity"))
        .agg(F.count(F.lit(1)).alias("n")),
        build(
            """SELECT CASE WHEN abs(z) >= 4 THEN 'critical' WHEN abs(z) >= 3.5 THEN 'high'
               WHEN abs(z) >= 3 THEN 'medium' WHEN abs(z) >= 2.5 THEN 'low' ELSE 'none' END AS severity,
               count(*) AS n FROM scored GROUP BY ALL"""
        ),
    )
    reg.add(
        "a6_expected_ranges",
        lambda d: d.scored.select(
            "event_id",
            expected_range(F.col("mean"), F.col("stddev"), F.col("window_count")).alias("e"),
        ).select("event_id", "e.*"),
        build(
            f"""SELECT event_id, {round4("mean")} AS mean, {round4("sd")} AS stddev,
                {round4("mean - 2 * sd")} AS lower, {round4("mean + 2 * sd")} AS upper, n AS window_count
                FROM scored"""
        ),
    )
    reg.add(
        "a7_detect_anomalies",
        lambda d: an.detect_anomalies(d.enriched, DETECTOR).select(
            "event_id",
            "device_id",
            "metric_type",
            "observed_value",
            F.round("z_score", 4).alias("z_score"),
            "severity",
            us("detected_at"),
            "device_type",
            "device_location",
            "status",
            F.col("expected_range.window_count").alias("window_count"),
        ),
        build(
            """SELECT event_id, device_id, metric_type, value AS observed_value, round(z, 4) AS z_score,
               severity, detected_us AS detected_at_us, device_type, device_location, 'open' AS status,
               n AS window_count FROM anomalies"""
        ),
    )
    reg.add(
        "a8_detection_summary",
        lambda d: an.detection_summary(d.scored),
        build(
            "SELECT coalesce(severity, 'none') AS severity, count(*) AS n FROM scored GROUP BY ALL"
        ),
    )
    # In-order equivalent of the streaming detector.
    reg.add(
        "a9_stream_equivalent",
        lambda d: an.scored_readings(d.enriched, DETECTOR, "frame").select(
            "event_id", F.round("z_score", 4).alias("z_score"), "window_count", "severity"
        ),
        build("SELECT event_id, round(z, 4) AS z_score, n AS window_count, severity FROM scored"),
    )
    # The state function itself, on a stream that stops and resumes half way.
    reg.add(
        "a9_stream_state",
        lambda d: replay(d.enriched, "timestamp", lambda s: score_stream(s, DETECTOR)).select(
            "event_id", F.round("z_score", 4).alias("z_score"), "window_count", "severity"
        ),
        build("SELECT event_id, round(z, 4) AS z_score, n AS window_count, severity FROM scored"),
    )
    # What the micro-batch writer makes of the readings of all hours, over the stored history.
    reg.add(
        "st2_stream_detection",
        _micro_batches,
        build("SELECT event_id, round(z, 4) AS z_score, n AS window_count, severity FROM scored"),
    )
    reg.add(
        "st5_idle_windows",
        # Windows whose state would have expired before a reading: idle for twice the window.
        lambda d: _idle(d),
        build(
            """SELECT metric_type, device_id, count(*) FILTER (gap > 600000000) AS expired, count(*) AS n
               FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY device_id, metric_type
                     ORDER BY ts_us, event_id) AS gap FROM readings) GROUP BY ALL"""
        ),
    )
    reg.add(
        "st6_late_readings",
        # In arrival (event id) order: how far each reading is behind the newest one seen.
        lambda d: _late(d),
        build(
            """SELECT bucket, count(*) AS n FROM (
                 SELECT CASE WHEN delay_us > 600000000 THEN 'late' WHEN delay_us > 0 THEN 'behind'
                             ELSE 'newest' END AS bucket
                 FROM (SELECT max(arrived) OVER (PARTITION BY device_id ORDER BY event_id) - arrived AS delay_us
                       FROM (SELECT *, ts_us - CASE WHEN k >= 95 THEN 900000000 ELSE 0 END AS arrived
                             FROM readings))) GROUP BY ALL"""
        ),
    )
    reg.add(
        "k1_rate_limit_checks",
        lambda d: rate_limit_checks(_request_log(d), LIMITS).select(
            "event_id", "requests", F.col("max_requests").cast("bigint").alias("max_requests"), "limited"
        ),
        build(f"SELECT event_id, requests, max_requests, limited FROM ({CHECKS_SQL})"),
    )
    reg.add(
        "k2_retry_after",
        lambda d: rate_limit_violations(_request_log(d), LIMITS).select("event_id", "retry_after"),
        build(f"SELECT event_id, retry_after FROM ({CHECKS_SQL}) WHERE limited"),
    )


def _idle(d: Domain):
    from devicelens.functions.scans import with_previous
    from devicelens.functions.times import micros, slot_of

    timed = d.readings.withColumn("_t", micros("timestamp"))
    prev = with_previous(
        timed,
        ["device_id", "metric_type"],
        ["_t", "event_id"],
        F.col("_t"),
        slot_of(F.col("_t"), 600 * MICROS),
        "_before",
    )
    return prev.groupBy("metric_type", "device_id").agg(
        F.count_if(F.col("_t") - F.col("_before") > 600 * MICROS).alias("expired"),
        F.count(F.lit(1)).alias("n"),
    )


def _late(d: Domain):
    from devicelens.streaming.lateness import delay_classes

    arrived = d.readings.withColumn(
        "timestamp",
        F.when(
            F.col("k") >= 95, F.timestamp_micros(F.unix_micros("timestamp") - 900 * MICROS)
        ).otherwise(F.col("timestamp")),
    )
    return delay_classes(arrived, ["device_id"], "event_id", delay_s=600).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n")
    )
