"""Dashboard queries that are not already a recording rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelens.plans import recording as r
from devicelens.plans.metrics import Metrics

ALERT_EVENTS = "alert_events_received_total"
WEBHOOKS = "alert_webhook_requests_total"
ALERT_ERRORS = "alert_processing_errors_total"
DELIVERY_BUCKETS = "alert_webhook_delivery_seconds_bucket"
TRIAGE = "alert_triage_invocations_total"
TRIAGE_BUCKETS = "alert_triage_duration_seconds_bucket"

P50_95_99 = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
P50_95 = {"p50": 0.5, "p95": 0.95}


@dataclass(frozen=True)
class Panel:
    id: str
    key: str
    labels: tuple[str, ...]
    values: tuple[str, ...]
    over_time: bool
    compute: Callable[[Metrics], DataFrame]


def _rate(number, key, name, by=(), short=False, **matchers) -> Panel:
    def compute(m: Metrics) -> DataFrame:
        return m.rate_by(name, tuple(by), m.cfg.short_range_s if short else None, **matchers)

    return Panel(f"db{number}", key, tuple(by), ("value",), True, compute)


def _quantiles(number, key, name, qs, by=(), **matchers) -> Panel:
    return Panel(
        f"db{number}",
        key,
        tuple(by),
        tuple(qs),
        True,
        lambda m: m.quantiles(name, qs, tuple(by), **matchers),
    )


def _total(number, key, name, by=()) -> Panel:
    return Panel(
        f"db{number}", key, tuple(by), ("value",), False, lambda m: m.total(name, tuple(by))
    )


def _side_by_side(m: Metrics) -> DataFrame:
    """Analysed and detected rate per tick."""
    analysed = m.rate_by(r.ANALYZED, (), m.cfg.short_range_s)
    detected = m.rate_by(r.ANOMALIES, (), m.cfg.short_range_s)
    return analysed.withColumnRenamed("value", "analyzed").join(
        detected.withColumnRenamed("value", "detected"), "ts"
    )


def _diagnosis_totals(m: Metrics) -> DataFrame:
    made = m.total(r.DIAGNOSES).select(F.lit("generated").alias("outcome"), "value")
    return made.unionByName(
        m.total(r.DIAGNOSES_FAILED).select(F.lit("failed").alias("outcome"), "value")
    )


PANELS: list[Panel] = [
    _rate(1, "request_rate_by_endpoint", r.HTTP, ["endpoint"], short=True),
    _quantiles(2, "request_p95_by_endpoint", r.HTTP_BUCKETS, {"value": 0.95}, ["endpoint"]),
    _rate(
        3, "error_rate_by_status", r.HTTP, ["status_code"], short=True, status_code="4..|5.."
    ),
    Panel("db4", "service_up", ("job", "instance"), ("value",), True, lambda m: m.gauge(r.UP)),
    Panel(
        "db5", "process_memory", ("job", "instance"), ("value",), True, lambda m: m.gauge(r.MEMORY)
    ),
    Panel("db6", "ingestion_rate_1m", (), ("value",), True, r.BY_ID["rr9"].compute),
    _rate(7, "dlq_rate_1m", r.DLQ, ["reason"], short=True),
    _total(8, "events_ingested_total", r.INGESTED),
    _total(9, "dlq_total", r.DLQ),
    _total(10, "publish_errors_total", r.PUBLISH_ERRORS),
    _quantiles(
        11, "post_latency", r.HTTP_BUCKETS, P50_95_99, method="POST", endpoint="/api/v1/telemetry"
    ),
    _total(12, "anomalies_total", r.ANOMALIES),
    _total(13, "events_analyzed_total", r.ANALYZED),
    _rate(14, "anomaly_rate_1m", r.ANOMALIES, ["severity"], short=True),
    _total(15, "severity_distribution", r.ANOMALIES, ["severity"]),
    Panel("db16", "analyzed_vs_detected", (), ("analyzed", "detected"), True, _side_by_side),
    Panel("db17", "diagnosis_totals", ("outcome",), ("value",), False, _diagnosis_totals),
    _quantiles(18, "generation_time", r.DIAGNOSIS_BUCKETS, P50_95_99),
    # db19 (alerts firing in total, by severity, by pipeline) is summaries.firing_gauges.
    _rate(20, "alert_events_by_status", ALERT_EVENTS, ["status"]),
    _rate(21, "firing_rate_by_severity", ALERT_EVENTS, ["severity"], status="firing"),
    _quantiles(22, "webhook_delivery", DELIVERY_BUCKETS, P50_95_99),
    _rate(23, "triage_by_result", TRIAGE, ["result"]),
    _quantiles(24, "triage_latency", TRIAGE_BUCKETS, P50_95),
    _rate(25, "alert_errors_by_type", ALERT_ERRORS, ["error_type"]),
    _rate(26, "webhooks_by_status", WEBHOOKS, ["status_code"]),
    _total(27, "alerts_received_total", ALERT_EVENTS),
]
