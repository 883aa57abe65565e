"""The alert rules, inhibitions and routes as data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelens.fixed_values import RULE_DESCRIPTIONS
from devicelens.functions.times import duration_seconds
from devicelens.operators import series as s
from devicelens.operators.alerts import Inhibition, Route, alert_states, render
from devicelens.plans import recording as r
from devicelens.plans.metrics import Metrics

LABELS = ("job", "instance", "endpoint")
# The pipeline label of rules that take it from the failing service.
FROM_JOB = "{job}"


@dataclass(frozen=True)
class AlertRule:
    id: str
    key: str
    name: str
    severity: str
    tier: str
    pipeline: str
    hold: str
    labels: tuple[str, ...]
    condition: Callable[[Metrics], DataFrame]
    summary: str
    compound: bool = False

    @property
    def for_s(self) -> int:
        return duration_seconds(self.hold)

    @property
    def description(self) -> str:
        """The long text, a template like the summary."""
        return RULE_DESCRIPTIONS[self.id]


def _above(rule_id: str, bound: float, **matchers: str) -> Callable[[Metrics], DataFrame]:
    return lambda m: s.compare(s.match(r.recorded(m, rule_id), **matchers), ">", bound)


def _down(m: Metrics, **matchers: str) -> DataFrame:
    return s.compare(s.match(m.gauge(r.UP), **matchers), "==", 0.0)


def _stalled(m: Metrics, rule_id: str) -> DataFrame:
    return s.compare(s.sum_by(r.recorded(m, rule_id)), "==", 0.0)


def _critical_burst(m: Metrics) -> DataFrame:
    return s.compare(m.rate_by(r.ANOMALIES, severity="critical"), ">", 0.1)


def _diagnosis_down(m: Metrics) -> DataFrame:
    attempts = s.add(r.recorded(m, "rr23"), r.recorded(m, "rr21"))
    return s.v_and(
        s.compare(r.recorded(m, "rr24"), ">", 0.9), s.compare(attempts, ">", 0.0)
    )


def _degradation(m: Metrics) -> DataFrame:
    return s.v_and(
        s.compare(r.recorded(m, "rr27"), "<", 0.5), s.compare(r.recorded(m, "rr28"), "<", 0.2)
    )


def _cascade(m: Metrics) -> DataFrame:
    down = s.v_or(
        _down(m, job="ingestion-consumer"), _down(m, job="anomaly-detection"), ["job", "instance"]
    )
    errors = s.compare(s.match(r.recorded(m, "rr5"), job="api-gateway"), ">", 0.1)
    return s.v_and(down, errors)


def _publish_failure(m: Metrics) -> DataFrame:
    return s.v_and(
        s.compare(r.recorded(m, "rr14"), ">", 0.01), s.compare(r.recorded(m, "rr27"), "<", 0.5)
    )


def _undiagnosed(m: Metrics) -> DataFrame:
    return s.v_and(
        s.compare(r.recorded(m, "rr17"), ">", 0.01), s.compare(r.recorded(m, "rr24"), ">", 0.5)
    )


def _full_stall(m: Metrics) -> DataFrame:
    up = s.compare(s.match(m.gauge(r.UP), job="api-gateway"), "==", 1.0)
    return s.v_and(s.v_and(_stalled(m, "rr8"), _stalled(m, "rr18")), up)


def _memory(m: Metrics) -> DataFrame:
    return s.compare(m.gauge(r.MEMORY), ">", 512.0 * 1024 * 1024)


# Names, severities, tiers, bounds, holding times and summaries of the rules.
ALERT_RULES: list[AlertRule] = [
    AlertRule(
        "ar1", "service_down", "ServiceDown", "critical", "platform", FROM_JOB, "1m",
        ("job", "instance"), _down,
        "Service {{ $labels.job }} is DOWN",
    ),
    AlertRule(
        "ar2", "ingestion_stalled", "IngestionPipelineStalled", "critical", "platform",
        "ingestion", "5m", (), lambda m: _stalled(m, "rr8"),
        "Ingestion pipeline has stalled — zero events for 5 minutes",
    ),
    AlertRule(
        "ar3", "critical_anomaly_burst", "CriticalAnomalyBurst", "critical", "product",
        "detection", "2m", (), _critical_burst,
        'Burst of critical anomalies detected ({{ $value | printf "%.2f" }}/sec)',
    ),
    AlertRule(
        "ar4", "diagnosis_down", "DiagnosisPipelineDown", "critical", "platform", "diagnosis",
        "5m", (), _diagnosis_down,
        'Diagnosis pipeline failure rate is {{ $value | printf "%.0f" }}%',
    ),
    AlertRule(
        "ar5", "alert_receiver_down", "AlertReceiverDown", "critical", "platform", "alerting",
        "1m", ("job", "instance"), lambda m: _down(m, job="alert-receiver"),
        "Alert receiver service is DOWN — alert delivery broken",
    ),
    AlertRule(
        "ar6", "high_api_error_rate", "HighAPIErrorRate", "warning", "platform", "api", "5m",
        ("job",), _above("rr5", 0.05, job="api-gateway"),
        'API 5xx error rate is {{ $value | printf "%.1f" }}% (threshold: 5%)',
    ),
    AlertRule(
        "ar7", "high_api_latency", "HighAPILatency", "warning", "platform", "api", "5m",
        ("job", "endpoint"), _above("rr6", 2.0, job="api-gateway"),
        'API p95 latency is {{ $value | printf "%.2f" }}s (threshold: 2s)',
    ),
    AlertRule(
        "ar8", "dlq_accumulating", "DLQAccumulating", "warning", "platform", "ingestion", "5m",
        (), _above("rr11", 0.05),
        'Dead-letter queue accumulating at {{ $value | printf "%.3f" }} events/sec',
    ),
    AlertRule(
        "ar9", "slow_diagnosis", "SlowDiagnosisGeneration", "warning", "platform", "diagnosis",
        "5m", (), _above("rr25", 60.0),
        'Diagnosis p95 latency is {{ $value | printf "%.0f" }}s (threshold: 60s)',
    ),
    AlertRule(
        "ar10", "high_anomaly_rate", "HighAnomalyRate", "warning", "product", "detection", "5m",
        (), _above("rr16", 0.033),
        'Anomaly rate elevated: {{ $value | printf "%.3f" }}/sec (>10 per 5min)',
    ),
    AlertRule(
        "ar11", "publish_errors", "KafkaPublishErrors", "warning", "platform", "ingestion", "3m",
        (), _above("rr14", 0.0),
        'Kafka publish errors occurring ({{ $value | printf "%.3f" }}/sec)',
    ),
    AlertRule(
        "ar12", "high_memory", "HighMemoryUsage", "warning", "platform", FROM_JOB, "10m",
        ("job", "instance"), _memory,
        "{{ $labels.job }} memory usage is {{ $value | humanize1024 }}B",
    ),
    AlertRule(
        "ar13", "diagnosis_partial_failures", "DiagnosisPartialFailures", "warning", "platform",
        "diagnosis", "10m", (), _above("rr24", 0.25),
        'Diagnosis failure rate is {{ $value | printf "%.0f" }}% (threshold: 25%)',
    ),
    AlertRule(
        "ar14", "anomalies_detected", "AnomaliesBeingDetected", "info", "product", "detection",
        "1m", (), _above("rr16", 0.0),
        'Anomalies being detected at {{ $value | printf "%.3f" }}/sec',
    ),
    AlertRule(
        "ar15", "dlq_events_present", "DLQEventsPresent", "info", "platform", "ingestion", "1m",
        (), _above("rr11", 0.0),
        "Dead-letter queue is receiving events",
    ),
    AlertRule(
        "ar16", "high_client_error_rate", "HighClientErrorRate", "info", "platform", "api", "5m",
        ("job",), _above("rr4", 1.0, job="api-gateway"),
        'Elevated client error rate: {{ $value | printf "%.2f" }}/sec',
    ),
    AlertRule(
        "ar17", "degradation", "PipelineDegradation", "critical", "platform", "detection", "5m",
        (), _degradation,
        'Pipeline degradation: ingestion down {{ $value | printf "%.0f" }}%, detection down >80%',
        compound=True,
    ),
    AlertRule(
        "ar18", "cascading_failure", "CascadingFailure", "critical", "platform", "ingestion",
        "2m", ("job", "instance"), _cascade,
        "Cascading failure: backend service down AND API errors spiking",
        compound=True,
    ),
    AlertRule(
        "ar19", "publish_ingestion_failure", "KafkaIngestionFailure", "critical", "platform",
        "ingestion", "3m", (), _publish_failure,
        "Kafka errors causing ingestion drop",
        compound=True,
    ),
    AlertRule(
        "ar20", "detection_without_diagnosis", "DetectionWithoutDiagnosis", "critical",
        "platform", "diagnosis", "5m", (), _undiagnosed,
        "Critical anomalies detected but diagnosis pipeline is >50% failing",
        compound=True,
    ),
    AlertRule(
        "ar21", "full_stall", "FullPipelineStall", "critical", "platform", "ingestion", "5m",
        (), _full_stall,
        "Complete pipeline stall — API is up but no data flowing",
        compound=True,
    ),
    AlertRule(
        "ar22", "dlq_ratio_spike", "DLQRatioSpike", "warning", "platform", "ingestion", "5m",
        (), _above("rr12", 0.1),
        '{{ $value | printf "%.0f" }}% of incoming events are going to DLQ',
        compound=True,
    ),
]


def states(m: Metrics, rule: AlertRule) -> DataFrame:
    """Pending / firing / resolved ticks of one rule."""
    return alert_states(
        rule.condition(m), rule.labels, rule.for_s, m.cfg.step_s, m.last_tick_s
    )


def labelled(frame: DataFrame, rule: AlertRule) -> DataFrame:
    """States with the alert's name, labels and rendered summary."""
    job = F.col("job") if "job" in rule.labels else F.lit("unknown")
    pipeline = job if rule.pipeline == FROM_JOB else F.lit(rule.pipeline)
    given = {name: F.col(name) for name in rule.labels}
    return frame.select(
        F.lit(rule.name).alias("alert_name"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.tier).alias("tier"),
        pipeline.alias("pipeline"),
        *[
            (F.col(c) if c in rule.labels else F.lit(None).cast("string")).alias(c)
            for c in LABELS
        ],
        "ts",
        "active_at",
        "state",
        "value",
        render(rule.summary, given, F.col("value")).alias("summary"),
        render(rule.description, given, F.col("value")).alias("description"),
    )


def all_states(m: Metrics, rules: list[AlertRule] | None = None) -> DataFrame:
    """States of many rules in one frame."""
    return reduce(
        DataFrame.unionByName, [labelled(states(m, rule), rule) for rule in rules or ALERT_RULES]
    )


def rule_catalogue(spark) -> DataFrame:
    return spark.createDataFrame(
        [
            (i, r_.name, r_.severity, r_.tier, r_.pipeline, r_.for_s, r_.summary, r_.compound, r_.description)
            for i, r_ in enumerate(ALERT_RULES)
        ],
        "rule INT, alert_name STRING, severity STRING, tier STRING, pipeline STRING, "
        "for_s INT, summary STRING, compound BOOLEAN, description STRING",
    )


# Which firing alert mutes which.
INHIBITIONS: list[Inhibition] = [
    Inhibition("in1", {"alert_name": "ServiceDown"}, {"severity": "warning"}, ("pipeline",)),
    Inhibition(
        "in2", {"alert_name": "FullPipelineStall"}, {"alert_name": "IngestionPipelineStalled"}
    ),
    Inhibition(
        "in3", {"alert_name": "CascadingFailure"}, {"alert_name": "ServiceDown"}, ("pipeline",)
    ),
    Inhibition(
        "in4", {"alert_name": "KafkaIngestionFailure"}, {"alert_name": "KafkaPublishErrors"}
    ),
    Inhibition(
        "in5", {"alert_name": "DiagnosisPipelineDown"}, {"alert_name": "DiagnosisPartialFailures"}
    ),
    Inhibition(
        "in6",
        {"alert_name": "DetectionWithoutDiagnosis"},
        {"alert_name": "DiagnosisPartialFailures"},
    ),
    Inhibition("in7", {"severity": "critical"}, {"severity": "info"}, ("pipeline",)),
]

# Receivers and timings; first match wins unless the route goes on.
DEFAULT_ROUTE = Route("webhook-all", {}, 30, 300, 14400)
ROUTES: list[Route] = [
    Route("pagerduty-critical", {"severity": "critical"}, 10, 60, 3600, go_on=True),
    Route("webhook-all", {"severity": "critical"}, 10, 60, 3600),
    Route("webhook-all", {"severity": "warning"}, 30, 300, 14400),
    Route("webhook-all", {"severity": "info"}, 60, 600, 43200),
    Route("webhook-all", {"compound": "true"}, 10, 60, 7200),
]
