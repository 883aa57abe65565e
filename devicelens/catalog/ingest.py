"""Sources, sinks, validation and enrichment queries (S*, V*, E1, E2, ST1, ST4, ST7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from devicelens import schemas
from devicelens.catalog.domain import Domain
from devicelens.catalog.registry import Registry, r, us
from devicelens.catalog.sql import build
from devicelens.operators import dead_letters as dl
from devicelens.operators import enrichment as en
from devicelens.operators import validation as va
from devicelens.operators.summaries import count_by
from devicelens.sources.history import in_range, with_event_month
from devicelens.sources.messages import (
    anomaly_messages,
    enriched_messages,
    parse_anomaly_messages,
)
from devicelens.sources.streams import kafka_rows
from devicelens.sources.tables import label_columns, parse_incidents
from devicelens.sources.webhooks import explode_webhooks, webhook_rejects
from devicelens.streaming.ingest import dedupe_replays, judge

ALLOWED = ("click", "view", "purchase", "signup")


def _webhook_payloads(d: Domain):
    """One webhook body per notification; every third also carries a resolved twin."""
    log = d.alert_log

    def alert(status, ends, suffix):
        return F.struct(
            status.alias("status"),
            F.when(
                F.col("fingerprint") % 7 == 0,
                F.create_map(F.lit("alertname"), F.col("alert_name")),
            )
            .otherwise(
                F.create_map(
                    F.lit("alertname"),
                    F.col("alert_name"),
                    F.lit("severity"),
                    F.col("severity"),
                    F.lit("pipeline"),
                    F.col("pipeline"),
                    F.lit("tier"),
                    F.col("tier"),
                )
            )
            .alias("labels"),
            F.create_map(F.lit("summary"), F.col("alert_name")).alias("annotations"),
            F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'123Z'").alias("startsAt"),
            ends.alias("endsAt"),
            F.lit("").alias("generatorURL"),
            F.concat(F.col("fingerprint").cast("string"), F.lit(suffix)).alias("fingerprint"),
        )

    zero = F.lit("0001-01-01T00:00:00Z")
    own = alert(F.col("status"), zero, "")
    twin = alert(
        F.lit("resolved"), F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"), "-twin"
    )
    return log.select(
        "notification_id",
        "received_at",
        F.to_json(
            F.struct(
                F.lit("4").alias("version"),
                F.lit("g").alias("groupKey"),
                F.col("status").alias("status"),
                F.lit("webhook-all").alias("receiver"),
                F.when(F.col("notification_id") % 3 == 0, F.array(own, twin))
                .otherwise(F.array(own))
                .alias("alerts"),
            )
        ).alias("payload"),
    )


def _webhooks(d: Domain):
    from devicelens.operators.alerts import project_alerts, with_alert_times

    return with_alert_times(project_alerts(explode_webhooks(_webhook_payloads(d))))


def _incident_files(d: Domain):
    """The documents as incident files, some damaged: every file is an incident or a failed one."""
    n = F.col("doc_id")
    record = F.to_json(
        F.struct(
            F.col("text").alias("description"),
            F.array("lang", "source").alias("affected_device_types"),
        )
    )
    content = (
        F.when(n % 9 == 4, F.concat(F.lit("x"), record))
        .when(n % 9 == 5, F.concat(F.lit("["), record, F.lit("]")))
        .when(n % 9 == 6, F.lit(""))
        .otherwise(record)
    )
    files = d.table("documents").select(n.cast("string").alias("source_path"), content.alias("content"))
    good, failed = parse_incidents(files)
    return good.select(
        F.col("source_file").cast("bigint").alias("file"),
        F.lit("ok").alias("outcome"),
        F.md5("description").alias("description_md5"),
        F.array_join("affected_device_types", "|").alias("devices"),
    ).unionByName(
        failed.select(F.col("source_path").cast("bigint").alias("file"), F.col("reason").alias("outcome")),
        allowMissingColumns=True,
    )


def _damaged_webhooks(d: Domain):
    """The bodies as sent, some cut off, some without alerts."""
    n = F.col("notification_id")
    return _webhook_payloads(d).withColumn(
        "payload",
        F.when(n % 11 == 3, F.expr("left(payload, length(payload) - 5)"))
        .when(n % 11 == 4, F.lit('{"alerts": []}'))
        .when(n % 11 == 5, F.lit('{"alerts": "none"}'))
        .when(n % 11 == 6, F.lit(None).cast("string"))
        .otherwise(F.col("payload")),
    )


def _webhook_outcomes(d: Domain):
    """Every body is either exploded or rejected."""
    bodies = _damaged_webhooks(d)
    good = explode_webhooks(bodies).select("notification_id", F.lit("alerts").alias("outcome"))
    bad = webhook_rejects(bodies).select("notification_id", F.col("error_type").alias("outcome"))
    return good.unionByName(bad).groupBy("notification_id", "outcome").agg(F.count("*").alias("n"))


WEBHOOK_SQL = """
    SELECT notification_id, fingerprint, status, alert_name,
           CASE WHEN lone THEN 'unknown' ELSE severity END AS severity,
           CASE WHEN lone THEN 'unknown' ELSE pipeline END AS pipeline,
           CASE WHEN lone THEN 'unknown' ELSE tier END AS tier,
           started_us AS started_at_us, resolved_us AS resolved_at_us
    FROM (SELECT *, fp % 7 = 0 AS lone FROM (
      SELECT notification_id, fingerprint AS fp, CAST(fingerprint AS VARCHAR) AS fingerprint, status, alert_name,
             severity, pipeline, tier, started_us,
             CASE WHEN status = 'resolved' THEN received_us END AS resolved_us FROM alert_log
      UNION ALL
      SELECT notification_id, fingerprint, fingerprint || '-twin', 'resolved', alert_name, severity, pipeline,
             tier, started_us, received_us - received_us % 1000000 - 7200000000
      FROM alert_log WHERE notification_id % 3 = 0))"""


def _stream_outcomes(d: Domain):
    """Each payload's way through the ingest job: validation, registry, acceptance."""
    return judge(d.payloads, d.devices, id_kind="long")


OUTCOME_SQL = """
    SELECT r.event_id, CASE WHEN reason IS NOT NULL THEN 'validation_failed'
           WHEN d.device_id IS NULL THEN 'device_not_found' ELSE 'accepted' END AS outcome,
           d.device_type
    FROM raw_checked r LEFT JOIN devices d ON TRY_CAST(r.dev AS BIGINT) = d.device_id"""


def _docs_as_devices(d: Domain):
    return d.table("documents").select(
        "doc_id",
        F.col("text").alias("device_name"),
        F.col("source").alias("device_type"),
        F.col("text").alias("location"),
        F.col("lang").alias("firmware_version"),
    )


def _docs_as_incidents(d: Domain):
    return d.incidents.withColumn("title", F.col("description")).withColumn(
        "severity", F.when(F.col("severity") == "low", "none").otherwise(F.col("severity"))
    )


def register(reg: Registry) -> None:
    # --- sources and sinks ---------------------------------------------------------------------
    reg.add(
        "s1_raw_readings",
        # The readings as records of a topic, through the projection the stream source uses.
        lambda d: kafka_rows(
            d.payloads.select(
                F.encode("payload", "UTF-8").alias("value"),
                F.lit("raw").alias("topic"),
                (F.col("event_id") % 4).cast("int").alias("partition"),
                F.col("event_id").alias("offset"),
                F.timestamp_seconds("event_id").alias("timestamp"),
            )
        ).select("position", F.md5("payload").alias("payload_md5"), us("received_at")),
        build(
            """SELECT 'raw/' || event_id % 4 || '/' || event_id AS position, md5(payload) AS payload_md5,
               event_id * 1000000 AS received_at_us FROM payloads"""
        ),
    )
    reg.add(
        "s2_enriched_messages",
        lambda d: enriched_messages(d.enriched).select(
            F.col("key").cast("bigint").alias("device_id"),
            F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"),
            F.get_json_object("value", "$.value").cast("double").alias("value"),
            F.get_json_object("value", "$.device_location").alias("device_location"),
            F.get_json_object("value", "$.firmware_version").alias("firmware_version"),
        ),
        build(
            "SELECT device_id, event_id, value, device_location, firmware_version FROM enriched"
        ),
    )
    reg.add(
        "s3_dead_letter_rows",
        lambda d: va.check_raw(d.payloads, id_kind="long")
        .filter(F.col("reason").isNotNull())
        .select(
            "event_id",
            F.md5(dl.stored_payload(F.col("payload"))).alias("stored_md5"),
            F.concat(F.lit("Schema validation failed: "), "reason").alias("error_reason"),
        ),
        build(
            """SELECT event_id, md5(CASE WHEN reason = 'invalid_json'
                 THEN '{"raw":"' || payload || '"}' ELSE payload END) AS stored_md5,
               'Schema validation failed: ' || reason AS error_reason
               FROM raw_checked WHERE reason IS NOT NULL"""
        ),
    )
    reg.add(
        "s4_history_by_month",
        lambda d: with_event_month(d.history)
        .groupBy("event_month", "metric_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")),
        build(
            """SELECT strftime(ts, '%Y-%m') AS event_month, event_type AS metric_type, count(*) AS n,
               round(sum(value), 2) AS total FROM events GROUP BY ALL"""
        ),
    )
    reg.add(
        "s4_history_range",
        lambda d: in_range(with_event_month(d.history), "2024-01-03 12:00:00", "2024-01-28 00:00:00")
        .groupBy("event_month", "metric_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")),
        build(
            """SELECT strftime(ts, '%Y-%m') AS event_month, event_type AS metric_type, count(*) AS n,
               round(sum(value), 2) AS total FROM events
               WHERE ts >= TIMESTAMP '2024-01-03 12:00:00' AND ts < TIMESTAMP '2024-01-28' GROUP BY ALL"""
        ),
    )
    reg.add(
        "s5_anomaly_rows",
        lambda d: d.anomalies.select(
            "event_id", r("z_score", 8), F.round("z_score", 4).alias("message_z"), "severity"
        ),
        build(
            """SELECT event_id, round(z, 8) + 0.0 AS z_score, round(z, 4) AS message_z, severity
               FROM anomalies"""
        ),
    )
    reg.add(
        "s6_anomaly_messages",
        lambda d: parse_anomaly_messages(anomaly_messages(d.anomalies), schemas.ANOMALY).select(
            F.col("device_id").cast("bigint").alias("device_id"),
            "metric_type",
            "observed_value",
            "z_score",
            "severity",
            F.col("expected_range.window_count").alias("window_count"),
            us("detected_at"),
        ),
        build(
            """SELECT device_id, metric_type, value AS observed_value, round(z, 4) AS z_score, severity,
               n AS window_count, detected_us // 1000 * 1000 AS detected_at_us FROM anomalies"""
        ),
    )
    reg.add(
        "s7_incident_files",
        _incident_files,
        build(
            """SELECT doc_id AS file, CASE doc_id % 9 WHEN 4 THEN 'invalid_json' WHEN 5 THEN 'not_an_object'
                        WHEN 6 THEN 'invalid_json' ELSE 'ok' END AS outcome,
                      CASE WHEN doc_id % 9 NOT IN (4, 5, 6) THEN md5(text) END AS description_md5,
                      CASE WHEN doc_id % 9 NOT IN (4, 5, 6) THEN lang || '|' || source END AS devices
               FROM documents"""
        ),
    )
    reg.add(
        "s8_webhook_alerts",
        lambda d: _webhooks(d).select(
            "notification_id",
            "fingerprint",
            "status",
            "alert_name",
            "severity",
            "pipeline",
            "tier",
            us("started_at"),
            us("resolved_at"),
        ),
        build(WEBHOOK_SQL),
    )
    reg.add(
        "s8_webhook_rejects",
        _webhook_outcomes,
        build(
            """SELECT notification_id, CASE notification_id % 11 WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'no_alerts'
               WHEN 5 THEN 'invalid_body' WHEN 6 THEN 'invalid_json' ELSE 'alerts' END AS outcome,
               CASE WHEN notification_id % 11 NOT IN (3, 4, 5, 6) AND notification_id % 3 = 0 THEN 2 ELSE 1 END AS n
               FROM alert_log"""
        ),
    )
    reg.add(
        "s9_metric_samples",
        lambda d: label_columns(
            d.up_samples.select(F.create_map(F.lit("job"), "job", F.lit("instance"), "instance").alias("labels"), "ts", "value"),
            "job",
            "instance",
        )
        .groupBy("job", "instance")
        .agg(
            F.count(F.lit(1)).alias("samples"), F.sum("value").alias("up_samples")
        ),
        build(
            """SELECT job, instance, count(*) AS samples,
               CAST(sum(CASE WHEN k < 50 THEN 0.0 ELSE 1.0 END) AS DOUBLE) AS up_samples
               FROM requests GROUP BY ALL"""
        ),
    )

    # --- validation ----------------------------------------------------------------------------
    reg.add(
        "v1_validate_raw",
        lambda d: va.check_raw(d.payloads, id_kind="long").select(
            "event_id",
            F.coalesce("reason", F.lit("ok")).alias("reason"),
            F.when(F.col("reason").isNull(), F.col("value")).alias("value"),
            F.when(F.col("reason").isNull(), F.unix_micros("timestamp")).alias("ts_us"),
        ),
        build(
            """SELECT event_id, coalesce(reason, 'ok') AS reason,
               CASE WHEN reason IS NULL THEN value END AS value,
               CASE WHEN reason IS NULL THEN epoch_us(tim) END AS ts_us FROM raw_checked"""
        ),
    )
    reg.add(
        "v2_validate_accept",
        lambda d: d.readings.withColumn("reason", va.accept_failure(ALLOWED)).select(
            "event_id", F.coalesce("reason", F.lit("ok")).alias("reason")
        ),
        build(
            """SELECT event_id, CASE WHEN length(metric_type) NOT BETWEEN 1 AND 100 THEN 'metric_length'
               WHEN metric_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'unknown_metric'
               WHEN isnan(value) OR isinf(value) THEN 'not_finite' ELSE 'ok' END AS reason FROM readings"""
        ),
    )
    reg.add(
        "v3_validate_devices",
        lambda d: _docs_as_devices(d).select(
            "doc_id", F.coalesce(va.device_failure(), F.lit("ok")).alias("reason")
        ),
        """SELECT doc_id, CASE WHEN length(text) NOT BETWEEN 1 AND 255 THEN 'device_name'
           WHEN length(source) NOT BETWEEN 1 AND 100 THEN 'device_type'
           WHEN length(text) > 255 THEN 'location' WHEN length(lang) > 50 THEN 'firmware_version'
           ELSE 'ok' END AS reason FROM documents""",
    )
    reg.add(
        "v4_validate_incidents",
        lambda d: _docs_as_incidents(d).select(
            "incident_id", F.coalesce(va.incident_failure(), F.lit("ok")).alias("reason")
        ),
        build(
            """SELECT incident_id, CASE WHEN length(description) NOT BETWEEN 1 AND 500 THEN 'title'
               WHEN length(description) < 10 THEN 'description' WHEN severity = 'low' THEN 'severity'
               ELSE 'ok' END AS reason FROM incidents"""
        ),
    )
    reg.add(
        "v5_unknown_devices",
        lambda d: en.split_unknown_devices(d.readings, d.devices)[1].select(
            "event_id", "device_id", "value"
        ),
        build(
            """SELECT event_id, device_id, value FROM readings
               WHERE device_id NOT IN (SELECT device_id FROM devices)"""
        ),
    )
    reg.add(
        "v6_dlq_envelopes",
        lambda d: d.dead_letters.select(
            "event_id", "original_topic", "original_payload", "error_reason", us("failed_at")
        ),
        build(
            """SELECT event_id, original_topic, original_payload, error_reason,
               failed_us AS failed_at_us FROM dead_letters"""
        ),
    )
    reg.add(
        "v7_dlq_by_reason",
        lambda d: dl.dlq_by_reason(d.dead_letters),
        build("SELECT reason, count(*) AS n FROM dead_letters GROUP BY reason"),
    )
    reg.add(
        "v8_reconcile",
        lambda d: dl.reconcile(d.readings, d.accepted, d.dead_letters).select(
            "sent", "persisted", "dlq", r("drop_rate")
        ),
        build(
            """SELECT *, greatest(0, sent - persisted - dlq) / greatest(1, sent) AS drop_rate FROM (
               SELECT (SELECT count(*) FROM readings) AS sent, (SELECT count(*) FROM accepted) AS persisted,
                      (SELECT count(*) FROM dead_letters) AS dlq)"""
        ),
    )
    reg.add(
        "v9_blank_to_null",
        lambda d: d.enriched.groupBy("device_type").agg(
            F.count_if(F.col("firmware_version").isNull()).alias("without_firmware"),
            F.count_if(F.col("firmware_version") == "").alias("blank_firmware"),
        ),
        build(
            """SELECT device_type, count(*) FILTER (firmware_version IS NULL) AS without_firmware,
               count(*) FILTER (firmware_version = '') AS blank_firmware FROM enriched GROUP BY ALL"""
        ),
    )
    reg.add(
        "v10_event_ids",
        lambda d: va.with_event_id(d.readings.withColumnRenamed("event_id", "row"), "row").select(
            "row", "event_id"
        ),
        build(
            """SELECT event_id AS row, sha256(device_id || '|' || metric_type || '|' || ts_us || '|' ||
               CAST(value AS VARCHAR) || '|' || event_id) AS event_id FROM readings"""
        ),
    )

    # --- registry joins ------------------------------------------------------------------------
    reg.add(
        "e1_enrich",
        lambda d: d.enriched.select(
            "event_id", "device_id", "value", "device_type", "device_location", "firmware_version"
        ),
        build(
            """SELECT event_id, device_id, value, device_type, device_location, firmware_version
               FROM enriched"""
        ),
    )
    reg.add(
        "e2_registered_split",
        lambda d: en.enrich_or_mark(d.readings, d.devices)
        .groupBy("known", "metric_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("known").cast("string").alias("known"), "metric_type", "n"),
        build(
            """SELECT CASE WHEN d.device_id IS NULL THEN 'false' ELSE 'true' END AS known, metric_type,
               count(*) AS n FROM readings LEFT JOIN devices d USING (device_id) GROUP BY ALL"""
        ),
    )

    # --- batch results the streaming jobs must reproduce -------------------------------------------
    reg.add(
        "st1_ingest_outcomes",
        lambda d: _stream_outcomes(d).select("event_id", "outcome", "device_type"),
        build(OUTCOME_SQL),
    )
    reg.add(
        "st4_replay_dedupe",
        lambda d: dedupe_replays(
            va.with_event_id(
                d.readings.unionByName(d.readings).withColumnRenamed("event_id", "row"), "row"
            )
        )
        .groupBy("metric_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")),
        build(
            """SELECT metric_type, count(*) AS n, round(sum(value), 2) AS total FROM readings
               GROUP BY ALL"""
        ),
    )
    reg.add(
        "st7_malformed_by_reason",
        lambda d: count_by(
            va.check_raw(d.payloads, id_kind="long").filter(F.col("reason").isNotNull()), "reason"
        ),
        build(
            "SELECT reason, count(*) AS n FROM raw_checked WHERE reason IS NOT NULL GROUP BY ALL"
        ),
    )
