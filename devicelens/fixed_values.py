"""Texts and tables whose content has to be as it is for equal results.

``{pipe}`` is the alert's pipeline, ``{prefix}`` the deployment's container prefix; any other brace
is literal text.
"""

from __future__ import annotations

# Alert names by triage strategy.
PLATFORM_ALERTS = (
    "ServiceDown",
    "IngestionPipelineStalled",
    "DiagnosisPipelineDown",
    "AlertReceiverDown",
    "CascadingFailure",
    "FullPipelineStall",
    "KafkaIngestionFailure",
    "PipelineDegradation",
)
PRODUCT_ALERTS = ("CriticalAnomalyBurst", "DetectionWithoutDiagnosis")

# Triage texts per alert name.
TRIAGE_TEMPLATES = {
    "ServiceDown": {
        "root_cause": (
            "The {pipe} service process has stopped responding. "
            "Common causes: OOM kill, unhandled exception, or dependency failure "
            "(PostgreSQL/Redis/Kafka connection timeout)."
        ),
        "investigation": [
            "Check container/pod status: docker ps | grep {pipe}",
            "Review service logs for crash stacktrace: docker logs {prefix}{pipeline}",
            "Check system resources: docker stats (memory, CPU)",
            "Verify dependency connectivity (PostgreSQL, Redis, Kafka)",
        ],
        "blast_radius": (
            "All downstream services depending on {pipe} are affected. "
            "If ingestion-consumer: no new telemetry stored. "
            "If anomaly-detection: no anomalies detected. "
            "If diagnosis-service: no root-cause analysis generated."
        ),
        "actions": [
            "Restart the service: docker compose restart {pipeline}",
            "If OOM: increase memory limits in docker-compose.yml",
            "If dependency failure: check upstream services first",
        ],
    },
    "IngestionPipelineStalled": {
        "root_cause": (
            "Zero telemetry events ingested in 5+ minutes. The Kafka consumer "
            "in the ingestion service is likely disconnected or the API gateway "
            "cannot publish to Kafka."
        ),
        "investigation": [
            "Check Kafka broker health: docker exec {prefix}kafka kafka-broker-api-versions "
            "--bootstrap-server localhost:9092",
            "Check consumer group lag: docker exec {prefix}kafka kafka-consumer-groups "
            "--bootstrap-server localhost:9092 --group ingestion-consumer-group --describe",
            "Verify telemetry.raw topic exists and has recent offsets",
            "Check API gateway logs for Kafka publish errors",
            "Verify the simulator or producers are actually sending data",
        ],
        "blast_radius": (
            "Complete data pipeline halt. No new telemetry stored in PostgreSQL, "
            "no events flowing to anomaly detection, no diagnoses generated. "
            "Historical data is still queryable but stale."
        ),
        "actions": [
            "Restart ingestion consumer: docker compose restart ingestion-consumer",
            "If Kafka is down: docker compose restart kafka",
            "Check if topic was accidentally deleted: recreate via kafka-init",
        ],
    },
    "CascadingFailure": {
        "root_cause": (
            "A backend service failure is propagating errors to the API gateway. "
            "The root cause is the backend service (ingestion-consumer or anomaly-detection) "
            "being down, which causes the API to fail on dependent operations."
        ),
        "investigation": [
            "Identify which backend service is DOWN (check 'up' metric)",
            "Check if the failure started with a dependency (PostgreSQL, Redis, Kafka)",
            "Review API gateway error logs for the specific failing endpoint",
            "Check if the issue is network-related (container DNS resolution)",
        ],
        "blast_radius": (
            "User-facing API is returning 5xx errors. Read operations may still work "
            "(cache-aside from Redis) but write operations are failing. "
            "Downstream: anomaly detection and diagnosis are also impacted."
        ),
        "actions": [
            "Restart the DOWN backend service first",
            "Monitor API error rate — it should self-recover once backend is up",
            "If persists: restart the entire pipeline in dependency order",
        ],
    },
    "FullPipelineStall": {
        "root_cause": (
            "The API gateway is healthy but zero data is flowing through the pipeline. "
            "Most likely: Kafka is unreachable or all consumer groups are stuck. "
            "The API can accept requests but they dead-end at Kafka publish."
        ),
        "investigation": [
            "Check Kafka container: docker ps | grep kafka",
            "Check Zookeeper: docker ps | grep zookeeper",
            "Verify Kafka publish from API: check kafka_publish_errors_total metric",
            "Check all consumer group states",
        ],
        "blast_radius": (
            "Total pipeline failure. API accepts requests (appears healthy from outside) "
            "but no data reaches storage or detection. Silent failure — most dangerous kind."
        ),
        "actions": [
            "Restart Kafka + Zookeeper: docker compose restart zookeeper kafka",
            "Wait 30s for Kafka to stabilize, then restart consumers",
            "Verify topic recreation if needed: docker compose restart kafka-init",
        ],
    },
    "DiagnosisPipelineDown": {
        "root_cause": (
            "The RAG diagnosis pipeline is failing >90% of the time. "
            "Common causes: LLM API rate limiting, expired AWS credentials, "
            "ChromaDB connection failure, or embedding model unavailability."
        ),
        "investigation": [
            "Check diagnosis service logs: docker logs {prefix}diagnosis-service",
            "Verify AWS credentials are valid and not expired",
            "Check ChromaDB health: curl http://localhost:8100/api/v1/heartbeat",
            "Check diagnoses_failed_total metric by phase (context/retrieval/generation)",
        ],
        "blast_radius": (
            "Anomalies are being detected but no root-cause analysis is generated. "
            "Operators must triage anomalies manually without AI assistance. "
            "The anomaly detection pipeline itself is unaffected."
        ),
        "actions": [
            "If AWS credentials expired: refresh them and restart diagnosis service",
            "If ChromaDB is down: docker compose restart chromadb",
            "If rate limited: check AWS Bedrock quotas and reduce concurrency",
        ],
    },
    "PipelineDegradation": {
        "root_cause": (
            "Ingestion has dropped >50% AND detection has dropped >80% compared to "
            "15 minutes ago. This indicates a pipeline break between ingestion and "
            "anomaly detection — not simply fewer incoming events."
        ),
        "investigation": [
            "Check telemetry.enriched topic — are events being published?",
            "Check ingestion consumer: is it consuming but failing to enrich?",
            "Verify Redis connectivity (enrichment step uses Redis HGETALL)",
            "Compare consumer group lag on telemetry.raw vs telemetry.enriched",
        ],
        "blast_radius": (
            "Partial data loss. Some events may be ingested but not reaching detection. "
            "Anomaly detection is essentially blind. Diagnoses cannot be generated "
            "for anomalies that are never detected."
        ),
        "actions": [
            "Check Redis health: docker exec {prefix}redis redis-cli ping",
            "Restart ingestion consumer to reset consumer state",
            "If Redis is down: restart Redis, then restart all consumers",
        ],
    },
    "KafkaIngestionFailure": {
        "root_cause": (
            "Kafka publish errors are occurring simultaneously with ingestion rate drop. "
            "The API gateway cannot write to Kafka, so events are being lost."
        ),
        "investigation": [
            "Check Kafka broker status and disk space",
            "Verify network connectivity between API gateway and Kafka",
            "Check kafka_publish_errors_total breakdown by error_type",
            "Review Kafka broker logs for partition errors",
        ],
        "blast_radius": (
            "Incoming telemetry events are being dropped. The API returns 202 "
            "(accepted) but events never reach storage. Silent data loss."
        ),
        "actions": [
            "Restart Kafka broker if unresponsive",
            "Check and increase disk space if Kafka partitions are full",
            "Restart API gateway to reset Kafka producer connections",
        ],
    },
}

# Triage text of alerts without a template.
GENERIC_TRIAGE = """\
TRIAGE: {name}
Alert: {summary}
Pipeline: {pipe}

--- Likely Root Cause ---
Critical condition detected on {pipe} pipeline. Review the alert description and annotations for \
specific context.

--- Investigation Steps ---
1. Check {pipe} service logs
2. Verify dependency connectivity (PostgreSQL, Redis, Kafka)
3. Check related metrics in Grafana dashboards
4. Review recent deployments or configuration changes

--- Blast Radius ---
Depends on pipeline scope. Check downstream service health.

--- Immediate Actions ---
1. Follow runbook link in alert annotations
2. Check service status: docker compose ps
3. Escalate if not resolved within 15 minutes"""

# Diagnosis prompts.
SYSTEM_PROMPT = """\
You are a telemetry diagnosis assistant for an IoT monitoring platform. Your role is to analyze \
detected anomalies and provide root-cause diagnoses based on historical incident knowledge.

When given an anomaly with its context (device metadata, recent telemetry history) and relevant \
historical incidents retrieved from the knowledge base, you must:

1. Analyze the anomaly characteristics (metric type, deviation magnitude, timing, device context)
2. Compare against the retrieved historical incidents to identify the most likely root cause
3. Rate your confidence based on how closely the current anomaly matches historical patterns
4. List which retrieved incidents informed your diagnosis
5. Suggest immediate and long-term corrective actions

Be specific and actionable. Reference concrete details from the retrieved incidents when they \
support your diagnosis. If the retrieved incidents don't closely match the current anomaly, say so \
and lower your confidence score accordingly."""

USER_PROMPT = """\
## Anomaly Details

- **Anomaly ID:** {anomaly_id}
- **Device ID:** {device_id}
- **Device Type:** {device_type}
- **Device Location:** {device_location}
- **Metric Type:** {metric_type}
- **Observed Value:** {observed_value}
- **Z-Score:** {z_score}
- **Severity:** {severity}
- **Detected At:** {detected_at}

## Statistical Context

- **Expected Mean:** {expected_mean}
- **Expected Std Dev:** {expected_stddev}
- **Expected Range (+/- 2.5 std dev):** {expected_lower} to {expected_upper}
- **Window Sample Count:** {window_count}

## Recent Telemetry History (last {context_window_minutes} minutes)

{recent_telemetry}

## Retrieved Historical Incidents (top {retrieval_k} matches)

{retrieved_incidents}

## Required Output Format

Respond with ONLY a valid JSON object (no markdown, no code fences) with this exact structure:

{
  "root_cause_summary": "A 2-3 sentence explanation of the most likely root cause",
  "confidence_score": 0.0 to 1.0,
  "supporting_evidence": ["evidence point 1", "evidence point 2", ...],
  "recommended_actions": ["action 1", "action 2", ...],
  "retrieved_incident_ids": ["incident_id_1", "incident_id_2", ...]
}

Guidelines for confidence_score:
- 0.9-1.0: Strong match with historical pattern, clear root cause
- 0.7-0.8: Good match, likely root cause but some uncertainty
- 0.5-0.6: Partial match, plausible root cause
- 0.3-0.4: Weak match, speculative diagnosis
- 0.1-0.2: No matching historical patterns, best guess only"""

# Descriptions of the alert rules, by rule id, as they must read; parts that would query a metrics server are left out.
RULE_DESCRIPTIONS = {
    "ar1": """The service {{ $labels.job }} ({{ $labels.instance }}) has been
unreachable by Prometheus for more than 1 minute.
This means the /metrics endpoint is not responding.
""",
    "ar2": """No telemetry events have been ingested in the last 5 minutes.
This could indicate: Kafka consumer failure, upstream producer
outage, or database connection pool exhaustion.
Current rate: {{ $value }} events/sec.
""",
    "ar3": """More than 0.1 critical anomalies per second sustained for 2 minutes.
This indicates a serious system-wide issue affecting monitored devices.
Immediate investigation required.
""",
    "ar4": """More than 90% of diagnosis attempts are failing for 5+ minutes.
The system is detecting anomalies but cannot generate root-cause
analysis. Check LLM connectivity, ChromaDB health, and PostgreSQL.
""",
    "ar5": """The webhook alert receiver is unreachable. Alerts are firing but
cannot be persisted or forwarded. This is a meta-alert: the
alerting pipeline itself is degraded.
""",
    "ar6": """The API gateway is returning server errors at a rate exceeding 5%
of total requests for 5+ minutes. Check application logs and
downstream dependencies (PostgreSQL, Redis, Kafka).
""",
    "ar7": """The 95th percentile response time for the API gateway has exceeded
2 seconds for 5+ minutes. Users will experience degraded performance.
Check database query times and Redis cache hit rates.
""",
    "ar8": """Events are being routed to the dead-letter queue at a sustained rate.
This means telemetry validation is failing. Check the DLQ reason
breakdown.
""",
    "ar9": """The RAG diagnosis pipeline is taking over 60 seconds at the 95th
percentile. This may indicate LLM throttling, ChromaDB performance
issues, or large context windows. Diagnoses will still complete
but users will wait longer.
""",
    "ar10": """More than ~10 anomalies are being detected per 5-minute window
across all severities. This could indicate widespread device issues,
environmental changes, or detector miscalibration.
""",
    "ar11": """The API gateway is failing to publish events to Kafka.
Events may be lost if this persists.
""",
    "ar12": """Process RSS memory for {{ $labels.job }} has exceeded 512MB for
10+ minutes. This may indicate a memory leak or need for resource
limit adjustment.
""",
    "ar13": """More than 25% of diagnosis attempts are failing.
The system is partially degraded but still generating some diagnoses.
""",
    "ar14": """The anomaly detection system is actively flagging events.
""",
    "ar15": """Events are being routed to the DLQ. This is expected during
normal operation at low rates but should be monitored for trends.
""",
    "ar16": """High rate of 4xx responses from the API gateway. This could indicate
client misconfiguration, expired tokens, or rate limiting being hit.
""",
    "ar17": """COMPOUND CONDITION MET:
1. Ingestion rate has dropped >50% compared to 15 minutes ago
2. Anomaly detection rate has dropped >80% compared to 15 minutes ago

This strongly indicates a pipeline break between ingestion and
detection — not simply fewer incoming events. Check Kafka consumer
lag, enriched topic health, and anomaly detection service logs.
""",
    "ar18": """COMPOUND CONDITION MET:
1. A backend consumer service (ingestion-consumer or anomaly-detection) is DOWN
2. The API gateway 5xx error rate has spiked above 10%

This indicates a cascading failure pattern where a backend outage
is propagating errors to the user-facing API.
""",
    "ar19": """COMPOUND CONDITION MET:
1. Kafka publish errors are occurring at {{ $value | printf "%.3f" }}/sec
2. Ingestion rate has dropped >50% compared to baseline

Events are being lost because Kafka is unavailable or unhealthy.
Check Kafka broker health, topic availability, and network connectivity.
""",
    "ar20": """COMPOUND CONDITION MET:
1. Critical/high anomalies are being detected at {{ $value | printf "%.3f" }}/sec
2. The diagnosis pipeline failure rate exceeds 50%

The system is identifying serious problems but cannot generate
root-cause analysis. Operators are flying blind on critical issues.
Check LLM service, ChromaDB, and diagnosis service logs immediately.
""",
    "ar21": """COMPOUND CONDITION MET:
1. Zero ingestion throughput for 5+ minutes
2. Zero events being analyzed for 5+ minutes
3. API gateway is UP and reachable

The API is accepting connections but no telemetry data is flowing
through the pipeline. This points to Kafka connectivity issues,
consumer group problems, or all producers being offline.
""",
    "ar22": """More than 10% of all incoming telemetry events are failing
validation and being routed to the dead-letter queue. This
suggests a systematic issue with incoming data quality —
possibly a misconfigured producer or schema change.
""",
}
