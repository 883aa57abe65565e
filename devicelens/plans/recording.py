"""The 29 recording rules over :class:`Metrics`.

Ratios are taken at the grain both sides share (label-less where the sides carry different labels),
see README "Decisions".
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from devicelens.operators import series as s
from devicelens.plans.metrics import Metrics

# Metric names (fixed values).
HTTP = "http_requests_total"
HTTP_BUCKETS = "http_request_duration_seconds_bucket"
INGESTED = "telemetry_events_ingested_total"
DLQ = "telemetry_events_dlq_total"
ANALYZED = "telemetry_events_analyzed_total"
ANOMALIES = "anomalies_detected_total"
PUBLISH_ERRORS = "kafka_publish_errors_total"
DIAGNOSES = "diagnoses_generated_total"
DIAGNOSES_FAILED = "diagnoses_failed_total"
DIAGNOSIS_BUCKETS = "diagnosis_generation_seconds_bucket"
UP = "up"
MEMORY = "process_resident_memory_bytes"


@dataclass(frozen=True)
class RecordingRule:
    id: str
    key: str
    series: str
    labels: tuple[str, ...]
    compute: Callable[[Metrics], DataFrame]


def _total(m: Metrics, name: str) -> DataFrame:
    return m.rate_by(name)


def _error_ratio(m: Metrics) -> DataFrame:
    errors = m.rate_by(HTTP, ("job",), status_code="5..")
    return s.ratio(errors, m.rate_by(HTTP, ("job",)), 1.0, ("job",))


def _dlq_ratio(m: Metrics) -> DataFrame:
    dlq = _total(m, DLQ)
    return s.ratio(dlq, s.add(_total(m, INGESTED), dlq), 1.0)


def _detection_ratio(m: Metrics) -> DataFrame:
    return s.ratio(_total(m, ANOMALIES), _total(m, ANALYZED), 0.001)


def _failure_ratio(m: Metrics) -> DataFrame:
    failed = _total(m, DIAGNOSES_FAILED)
    return s.ratio(failed, s.add(_total(m, DIAGNOSES), failed), 0.001)


def _against_baseline(name: str) -> Callable[[Metrics], DataFrame]:
    def compute(m: Metrics) -> DataFrame:
        now = _total(m, name)
        return s.ratio(now, s.offset(now, m.cfg.offset_s), 0.001)

    return compute


def _throughput(m: Metrics) -> DataFrame:
    return s.ratio(_total(m, ANALYZED), _total(m, INGESTED), 0.001)


def _by(name: str, *by: str, **matchers: str) -> Callable[[Metrics], DataFrame]:
    return lambda m: m.rate_by(name, by, **matchers)


def _quantile(name: str, q: float, *by: str) -> Callable[[Metrics], DataFrame]:
    return lambda m: m.quantile(name, q, by)


def _rule(number, key, series, labels, compute):
    return RecordingRule(f"rr{number}", key, series, tuple(labels), compute)


RECORDING_RULES: list[RecordingRule] = [
    _rule(1, "http_rate_by_job", "job:http_requests:rate5m", ["job"], _by(HTTP, "job")),
    _rule(
        2,
        "http_rate_by_endpoint",
        "job:http_requests_by_endpoint:rate5m",
        ["job", "endpoint", "method"],
        _by(HTTP, "job", "endpoint", "method"),
    ),
    _rule(
        3, "http_5xx_rate", "job:http_errors_5xx:rate5m", ["job"], _by(HTTP, "job", status_code="5..")
    ),
    _rule(
        4, "http_4xx_rate", "job:http_errors_4xx:rate5m", ["job"], _by(HTTP, "job", status_code="4..")
    ),
    _rule(5, "http_5xx_ratio", "job:http_error_ratio_5xx:rate5m", ["job"], _error_ratio),
    _rule(
        6,
        "http_latency_p95",
        "job:http_latency_p95:rate5m",
        ["job", "endpoint"],
        _quantile(HTTP_BUCKETS, 0.95, "job", "endpoint"),
    ),
    _rule(
        7, "http_latency_p99", "job:http_latency_p99:rate5m", ["job"], _quantile(HTTP_BUCKETS, 0.99, "job")
    ),
    _rule(8, "ingestion_rate_5m", "ingestion:rate5m", [], lambda m: m.rate(INGESTED)),
    _rule(
        9,
        "ingestion_rate_1m",
        "ingestion:rate1m",
        [],
        lambda m: m.rate(INGESTED, m.cfg.short_range_s),
    ),
    _rule(10, "dlq_rate_by_reason", "dlq:rate5m", ["reason"], _by(DLQ, "reason")),
    _rule(11, "dlq_rate_total", "dlq_total:rate5m", [], _by(DLQ)),
    _rule(12, "dlq_ratio", "dlq_ratio:rate5m", [], _dlq_ratio),
    _rule(
        13, "publish_errors_by_type", "kafka_errors:rate5m", ["error_type"], _by(PUBLISH_ERRORS, "error_type")
    ),
    _rule(14, "publish_errors_total", "kafka_errors_total:rate5m", [], _by(PUBLISH_ERRORS)),
    _rule(15, "anomaly_rate_by_severity", "anomalies:rate5m", ["severity"], _by(ANOMALIES, "severity")),
    _rule(16, "anomaly_rate_total", "anomalies_total:rate5m", [], _by(ANOMALIES)),
    _rule(
        17,
        "anomaly_rate_critical_high",
        "anomalies_critical_high:rate5m",
        [],
        _by(ANOMALIES, severity="critical|high"),
    ),
    _rule(18, "analyzed_rate", "events_analyzed:rate5m", [], lambda m: m.rate(ANALYZED)),
    _rule(19, "detection_ratio", "anomaly_detection_ratio:rate5m", [], _detection_ratio),
    _rule(20, "diagnosis_rate_by_severity", "diagnoses:rate5m", ["severity"], _by(DIAGNOSES, "severity")),
    _rule(21, "diagnosis_rate_total", "diagnoses_total:rate5m", [], _by(DIAGNOSES)),
    _rule(
        22,
        "diagnosis_failures_by_phase",
        "diagnosis_failures:rate5m",
        ["phase"],
        _by(DIAGNOSES_FAILED, "phase"),
    ),
    _rule(23, "diagnosis_failures_total", "diagnosis_failures_total:rate5m", [], _by(DIAGNOSES_FAILED)),
    _rule(24, "diagnosis_failure_ratio", "diagnosis_failure_ratio:rate5m", [], _failure_ratio),
    _rule(25, "diagnosis_p95", "diagnosis_latency_p95:rate5m", [], _quantile(DIAGNOSIS_BUCKETS, 0.95)),
    _rule(26, "diagnosis_p99", "diagnosis_latency_p99:rate5m", [], _quantile(DIAGNOSIS_BUCKETS, 0.99)),
    _rule(
        27, "ingestion_vs_baseline", "ingestion_rate_vs_baseline:ratio", [], _against_baseline(INGESTED)
    ),
    _rule(
        28, "detection_vs_baseline", "detection_rate_vs_baseline:ratio", [], _against_baseline(ANOMALIES)
    ),
    _rule(29, "throughput_ratio", "pipeline_throughput_ratio:rate5m", [], _throughput),
]

BY_ID = {rule.id: rule for rule in RECORDING_RULES}


def recorded(m: Metrics, rule_id: str) -> DataFrame:
    """Series of a recording rule by id (``rr8``)."""
    return BY_ID[rule_id].compute(m)
