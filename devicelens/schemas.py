"""Record schemas as DDL strings (Spark accepts them wherever a StructType goes)."""

from __future__ import annotations

RAW = (
    "device_id STRING, metric_type STRING, value DOUBLE, timestamp TIMESTAMP, "
    "metadata MAP<STRING,STRING>"
)

ENRICHED = (
    "event_id STRING, device_id STRING, metric_type STRING, value DOUBLE, timestamp TIMESTAMP, "
    "metadata MAP<STRING,STRING>, device_type STRING, device_location STRING, "
    "firmware_version STRING"
)

EXPECTED_RANGE = (
    "STRUCT<mean: DOUBLE, stddev: DOUBLE, lower: DOUBLE, upper: DOUBLE, window_count: BIGINT>"
)

ANOMALY = (
    "anomaly_id STRING, device_id STRING, metric_type STRING, observed_value DOUBLE, "
    f"expected_range {EXPECTED_RANGE}, z_score DOUBLE, severity STRING, detected_at TIMESTAMP, "
    "device_type STRING, device_location STRING"
)

DLQ = (
    "original_topic STRING, original_payload STRING, error_reason STRING, reason STRING, "
    "failed_at TIMESTAMP"
)

DEVICE = (
    "device_id STRING, device_name STRING, device_type STRING, location STRING, "
    "firmware_version STRING, metadata MAP<STRING,STRING>, registered_at TIMESTAMP, "
    "updated_at TIMESTAMP"
)

DIAGNOSIS = (
    "diagnosis_id STRING, anomaly_id STRING, root_cause_summary STRING, confidence_score DOUBLE, "
    "supporting_evidence ARRAY<STRING>, recommended_actions ARRAY<STRING>, "
    "retrieved_incident_ids ARRAY<STRING>, raw_response STRING, model_id STRING, "
    "generation_time_seconds DOUBLE, generated_at TIMESTAMP"
)

INCIDENT = (
    "title STRING, description STRING, affected_device_types ARRAY<STRING>, root_cause STRING, "
    "resolution_steps ARRAY<STRING>, severity STRING, failure_category STRING, tags ARRAY<STRING>"
)

CHUNK = (
    "chunk_id STRING, incident_id STRING, chunk_index INT, document STRING, "
    "embedding ARRAY<DOUBLE>, title STRING, severity STRING, failure_category STRING, "
    "affected_device_types ARRAY<STRING>"
)

WEBHOOK = (
    "version STRING, groupKey STRING, truncatedAlerts INT, status STRING, receiver STRING, "
    "groupLabels MAP<STRING,STRING>, commonLabels MAP<STRING,STRING>, "
    "commonAnnotations MAP<STRING,STRING>, externalURL STRING, "
    "alerts ARRAY<STRUCT<status: STRING, labels: MAP<STRING,STRING>, "
    "annotations: MAP<STRING,STRING>, startsAt: STRING, endsAt: STRING, "
    "generatorURL: STRING, fingerprint: STRING>>"
)

ALERT_EVENT = (
    "alert_name STRING, status STRING, severity STRING, pipeline STRING, tier STRING, "
    "labels MAP<STRING,STRING>, annotations MAP<STRING,STRING>, fingerprint STRING, "
    "started_at TIMESTAMP, resolved_at TIMESTAMP, generator_url STRING, "
    "triage_summary STRING, received_at TIMESTAMP"
)

MONITOR = (
    "id STRING, name STRING, expr STRING, duration STRING, severity STRING, pipeline STRING, "
    "summary STRING, description STRING, enabled BOOLEAN, created_at TIMESTAMP"
)

SAMPLE = "metric STRING, labels MAP<STRING,STRING>, ts TIMESTAMP, value DOUBLE"
