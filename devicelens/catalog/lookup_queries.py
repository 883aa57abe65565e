"""Lookups, updates and counts (Q*, G1, G11, L3, S10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from devicelens.catalog.domain import START_S, Domain
from devicelens.catalog.registry import Registry, r, us
from devicelens.catalog.sql import PARTS, START_US, build
from devicelens.operators import lookups as lo
from devicelens.operators import monitors as mo

HISTORY = ["event_id", "device_id", "metric_type", "value"]
HISTORY_SQL = "event_id, user_id AS device_id, event_type AS metric_type, value, epoch_us(ts) AS timestamp_us"
ANOMALY = ["event_id", "device_id", "severity"]

PARTS["updated_monitors"] = """
    SELECT m.id, m.name, coalesce(u.expr, m.expr) AS expr, coalesce(u.duration, m.duration) AS duration,
           coalesce(u.severity, m.severity) AS severity, m.pipeline, m.summary, m.description,
           coalesce(u.enabled, m.enabled) AS enabled, created_us
    FROM full_monitors m LEFT JOIN (
      SELECT lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS id,
             arg_max('value > ' || l_linenumber, seq) FILTER (l_returnflag = 'R') AS expr,
             arg_max(l_linenumber || 'h', seq) FILTER (l_linestatus = 'O') AS duration,
             max('warning') FILTER (l_returnflag = 'A') AS severity,
             arg_max(l_linenumber % 2 = 0, seq) FILTER (l_returnflag = 'N') AS enabled
      FROM (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS seq
            FROM lineitem) GROUP BY 1) u USING (id)"""


def _updated(d: Domain):
    return mo.apply_monitor_updates(mo.with_defaults(d.monitors), d.monitor_updates, "seq")


MONITOR = ["id", "name", "expr", "duration", "severity", "pipeline", "summary", "description", "enabled"]


def _status_updates(d: Domain):
    """Every reading asks for a new status of the anomaly with its id, some of them invalid."""
    return d.readings.select(
        F.col("event_id").alias("anomaly_id"),
        F.when(F.col("k") < 30, "acknowledged")
        .when(F.col("k") < 60, "resolved")
        .when(F.col("k") < 90, "open")
        .otherwise("closed")
        .alias("new_status"),
        F.col("timestamp").alias("updated_at"),
    )


def _anomalies(d: Domain):
    return d.anomaly_table.withColumn("anomaly_id", F.col("event_id"))


STATUS_SQL = """CASE WHEN r.k < 30 THEN 'acknowledged' WHEN r.k < 60 THEN 'resolved'
                WHEN r.k < 90 THEN 'open' ELSE 'closed' END"""


def register(reg: Registry) -> None:
    start, end = "2024-01-05 00:00:00", "2024-01-25 00:00:00"
    telemetry_where = (
        f"event_type = 'click' AND ts >= TIMESTAMP '{start}' AND ts < TIMESTAMP '{end}'"
    )
    reg.add(
        "q1_query_telemetry",
        lambda d: lo.query_telemetry(
            d.history, metric_type="click", start=start, end=end, limit=200, offset=50
        ).select(*HISTORY, us("timestamp")),
        f"""SELECT {HISTORY_SQL} FROM events WHERE {telemetry_where}
            ORDER BY ts DESC, event_id LIMIT 200 OFFSET 50""",
    )
    reg.add(
        "q1_device_history",
        lambda d: lo.query_telemetry(d.history, device_id=7, limit=5000).select(
            *HISTORY, us("timestamp")
        ),
        f"SELECT {HISTORY_SQL} FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 5000",
    )
    reg.add(
        "g1_telemetry_total",
        lambda d: lo.total_count(
            lo.select_rows(d.history, {"metric_type": "click"}, "timestamp", start, end)
        ),
        f"SELECT count(*) AS total FROM events WHERE {telemetry_where}",
    )
    reg.add(
        "q2_query_dlq",
        lambda d: lo.query_dlq(d.dead_letters, limit=150, offset=10).select(
            "event_id", "error_reason", us("failed_at")
        ),
        build(
            """SELECT event_id, error_reason, failed_us AS failed_at_us FROM dead_letters
               ORDER BY failed_us DESC, event_id LIMIT 150 OFFSET 10"""
        ),
    )
    reg.add(
        "q3_query_anomalies",
        lambda d: lo.query_anomalies(
            d.anomalies,
            severity="high",
            status="open",
            start="2024-01-01 00:30:00",
            end="2024-01-01 02:30:00",
            limit=50,
            tie="event_id",
        ).select(*ANOMALY, us("detected_at")),
        build(
            f"""SELECT event_id, device_id, severity, detected_us AS detected_at_us FROM anomalies
                WHERE severity = 'high' AND detected_us >= {START_US + 1800 * 10**6}
                  AND detected_us < {START_US + 9000 * 10**6}
                ORDER BY detected_us DESC, event_id LIMIT 50"""
        ),
    )
    reg.add(
        "q4_lookup_by_id",
        lambda d: lo.by_id(d.history, "event_id", 4242)
        .select("event_id", "value")
        .unionByName(
            lo.by_id(d.notifications, "notification_id", 4243).select(
                F.col("notification_id").alias("event_id"), F.col("price").alias("value")
            )
        ),
        build(
            """SELECT event_id, value FROM events WHERE event_id = 4242 UNION ALL
               SELECT notification_id, price FROM notifications WHERE notification_id = 4243"""
        ),
    )
    reg.add(
        "q6_query_incidents",
        lambda d: lo.query_incidents(d.incidents, severity="high", limit=80).select(
            "incident_id", "failure_category", us("ingested_at")
        ),
        build(
            """SELECT incident_id, source AS failure_category, ingested_us AS ingested_at_us FROM incidents
               WHERE severity = 'high' ORDER BY ingested_us DESC, incident_id LIMIT 80"""
        ),
    )
    reg.add(
        "q7_query_devices",
        lambda d: lo.query_devices(d.devices_all, "type_2").select(
            "device_id", "device_name", "location", us("registered_at")
        ),
        build(
            f"""SELECT c_custkey AS device_id, c_name AS device_name, n_name AS location,
                {START_US} + c_custkey * 60000000 AS registered_at_us
                FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 4 = 2"""
        ),
    )
    reg.add(
        "q8_query_alerts",
        lambda d: lo.query_alerts(
            d.episodes.withColumn("tie", F.concat_ws("-", "fingerprint", "episode")),
            status="resolved",
            severity="critical",
            limit=500,
            offset=5,
            tie="tie",
        ).select("fingerprint", "episode", "alert_name", us("received_at")),
        build(
            """SELECT fingerprint, episode, alert_name, received_us AS received_at_us FROM episodes
               WHERE status = 'resolved' AND severity = 'critical'
               ORDER BY received_us DESC, fingerprint || '-' || episode LIMIT 500 OFFSET 5"""
        ),
    )
    reg.add(
        "q9_active_alerts",
        lambda d: lo.active_alerts(d.episodes).select("fingerprint", "episode", us("started_at")),
        build(
            """SELECT fingerprint, episode, started_us AS started_at_us FROM episodes
               WHERE status = 'firing'"""
        ),
    )
    reg.add(
        "q10_list_monitors",
        lambda d: lo.list_monitors(mo.with_defaults(d.monitors)).select(*MONITOR, us("created_at")),
        build(f"SELECT {', '.join(MONITOR)}, created_us AS created_at_us FROM full_monitors"),
    )
    reg.add(
        "l3_monitor_updates",
        lambda d: _updated(d).select(*MONITOR),
        build(f"SELECT {', '.join(MONITOR)} FROM updated_monitors"),
    )
    rules = """
        SELECT name AS alert_name, expr, duration AS "for",
               CAST(regexp_extract(duration, '\\d+') AS BIGINT) * CASE right(duration, 1) WHEN 'm' THEN 60 ELSE 3600 END
                 AS for_s, severity, 'custom' AS tier, pipeline, 'monitor-api' AS managed_by, summary
        FROM {source} WHERE enabled"""
    columns = ["alert_name", "expr", "for", "for_s", "severity", "tier", "pipeline", "managed_by", "summary"]
    reg.add(
        "s10_load_rules",
        lambda d: mo.monitors_to_rules(mo.with_defaults(d.monitors)).select(*columns),
        build(rules.format(source="full_monitors")),
    )
    reg.add(
        "l3_monitors_to_rules",
        lambda d: mo.monitors_to_rules(_updated(d)).select(*columns),
        build(rules.format(source="updated_monitors")),
    )
    reg.add(
        "q11_status_updates",
        lambda d: lo.apply_status_updates(_anomalies(d), _status_updates(d))[0].select(
            "anomaly_id", "status"
        ),
        build(
            f"""SELECT a.event_id AS anomaly_id, CASE WHEN {STATUS_SQL} = 'closed' THEN 'open' ELSE {STATUS_SQL} END
                AS status FROM anomalies a JOIN readings r ON r.event_id = a.event_id"""
        ),
    )
    reg.add(
        "q11_rejected_updates",
        lambda d: lo.apply_status_updates(_anomalies(d), _status_updates(d))[1]
        .groupBy("reason", "new_status")
        .agg(F.count(F.lit(1)).alias("n")),
        build(
            f"""SELECT CASE WHEN s = 'closed' THEN 'invalid_status' ELSE 'not_found' END AS reason,
                s AS new_status, count(*) AS n
                FROM (SELECT {STATUS_SQL} AS s, a.event_id AS known FROM readings r
                      LEFT JOIN anomalies a ON a.event_id = r.event_id)
                WHERE s = 'closed' OR known IS NULL GROUP BY ALL"""
        ),
    )
    reg.add(
        "q12_register_devices",
        lambda d: lo.register_devices(
            d.devices_all.drop("device_id"), F.timestamp_seconds(F.lit(START_S))
        ).select("device_id", "device_name", "device_type", us("registered_at")),
        build(
            f"""SELECT sha256(c_name || '|type_' || (c_nationkey % 4) || '|' || n_name) AS device_id,
                c_name AS device_name, 'type_' || (c_nationkey % 4) AS device_type,
                {START_US} AS registered_at_us
                FROM customer JOIN nation ON c_nationkey = n_nationkey"""
        ),
    )
    reg.add(
        "q13_delete_monitors",
        lambda d: mo.delete_monitors(
            d.monitors,
            d.monitor_updates.filter(
                (F.col("severity") == "warning") & (F.col("seq.l_linenumber") == 7)
            )
            .select("id")
            .distinct(),
        ).select("id", "name"),
        build(
            """SELECT id, name FROM monitors WHERE id NOT IN
               (SELECT lpad(CAST(l_partkey AS VARCHAR), 8, '0') FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 7)"""
        ),
    )
    reg.add(
        "g11_top_anomalies",
        lambda d: lo.top_per_key(d.anomaly_table, "device_id", "detected_at", "event_id", 5).select(
            "device_id", "event_id", F.col("rank").cast("bigint").alias("rank"), "total"
        ),
        build(
            """SELECT device_id, event_id, rn AS rank, total FROM (
                 SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY detected_us DESC, event_id) AS rn,
                        count(*) OVER (PARTITION BY device_id) AS total FROM anomalies) WHERE rn <= 5"""
        ),
    )
