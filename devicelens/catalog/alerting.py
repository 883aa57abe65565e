"""Alert evaluation, lifecycle, inhibition, routing and triage (L*, AR*, IN*, T*, E3, E7, E10, G2-G5, ST8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from devicelens.catalog.domain import END_S, Domain
from devicelens.catalog.metric_series import RULE_SQL
from devicelens.catalog.registry import Registry, r, us
from devicelens.catalog.sql import PARTS, build, counter, quote, rate, rate_by, rd
from devicelens.fixed_values import (
    GENERIC_TRIAGE,
    PLATFORM_ALERTS,
    PRODUCT_ALERTS,
    TRIAGE_TEMPLATES,
)
from devicelens.functions.times import MICROS, parse_alert_ts, parse_resolved_ts
from devicelens.operators import alerts as al
from devicelens.operators import summaries as su
from devicelens.operators import triage as tr
from devicelens.operators.monitors import monitor_condition, monitor_states, set_rejects, with_defaults
from devicelens.operators.validation import alert_failure
from devicelens.plans import alert_rules as ar
from devicelens.plans import rule_engine
from devicelens.plans.recording import recorded
from devicelens.streaming.alerts import number_episodes_stream
from devicelens.streaming.replay import replay

# --- rule conditions in SQL: ``labels, t, v`` where the condition holds ---------------------------


def _where(rule: str, test: str) -> str:
    return f"SELECT * FROM ({RULE_SQL[rule]}) WHERE round({test.replace(' ', ', 9) ', 1)}"


def _and(left: str, right: str) -> str:
    return f"SELECT * FROM ({left}) WHERE t IN (SELECT t FROM ({right}))"


UP = "SELECT job, instance, t, v FROM up_ticks WHERE {}"
STALLED = "SELECT t, sum(v) AS v FROM ({}) GROUP BY t HAVING sum(v) = 0"
ATTEMPTS = f"""SELECT t, a.v + b.v AS v FROM ({RULE_SQL["rr23"]}) a JOIN ({RULE_SQL["rr21"]}) b USING (t)
               WHERE a.v + b.v > 0"""

CONDITION_SQL: dict[str, str] = {
    "ar1": UP.format("v = 0"),
    "ar2": STALLED.format(RULE_SQL["rr8"]),
    "ar3": f"SELECT * FROM ({rate_by('anom_c', ('severity',), where="severity = 'critical'")}) WHERE v > 0.1",
    "ar4": _and(_where("rr24", "v > 0.9"), ATTEMPTS),
    "ar5": UP.format("v = 0 AND job = 'alert-receiver'"),
    "ar6": _where("rr5", "v > 0.05 AND job = 'api-gateway'"),
    "ar7": _where("rr6", "v > 2 AND job = 'api-gateway'"),
    "ar8": _where("rr11", "v > 0.05"),
    "ar9": _where("rr25", "v > 60"),
    "ar10": _where("rr16", "v > 0.033"),
    "ar11": _where("rr14", "v > 0"),
    "ar12": f"SELECT job, instance, t, v FROM memory_ticks WHERE v > {512 * 1024 * 1024}",
    "ar13": _where("rr24", "v > 0.25"),
    "ar14": _where("rr16", "v > 0"),
    "ar15": _where("rr11", "v > 0"),
    "ar16": _where("rr4", "v > 1 AND job = 'api-gateway'"),
    "ar17": _and(_where("rr27", "v < 0.5"), _where("rr28", "v < 0.2")),
    "ar18": _and(
        UP.format("v = 0 AND job IN ('ingestion-consumer', 'anomaly-detection')"),
        _where("rr5", "v > 0.1 AND job = 'api-gateway'"),
    ),
    "ar19": _and(_where("rr14", "v > 0.01"), _where("rr27", "v < 0.5")),
    "ar20": _and(_where("rr17", "v > 0.01"), _where("rr24", "v > 0.5")),
    "ar21": _and(
        _and(STALLED.format(RULE_SQL["rr8"]), STALLED.format(RULE_SQL["rr18"])),
        UP.format("v = 1 AND job = 'api-gateway'"),
    ),
    "ar22": _where("rr12", "v > 0.1"),
}


# The same for the shipments, where every rule of these holds somewhere.
counter("ship_http", "shipments", ("job", "status_code"), "ts_us")
counter("ship_ingested", "busy_shipments", (), "ts_us")
counter("ship_anom", "busy_shipments", ("severity",), "ts_us")
counter("ship_puberr", "failed_shipments", ("error_type",), "ts_us")
_SHIP_HTTP = rate_by("ship_http_c", ("job", "status_code"), ("job",))
_SHIP_5XX = rate_by("ship_http_c", ("job", "status_code"), ("job",), where="status_code LIKE '5__'")
_SHIP_4XX = rate_by("ship_http_c", ("job", "status_code"), ("job",), where="status_code LIKE '4__'")
_SHIP_INGESTED, _SHIP_ANOMALIES = rate("ship_ingested_c"), rate_by("ship_anom_c", ("severity",))
_SHIP_ERRORS = rate_by("ship_puberr_c", ("error_type",))


def _fallen(rates: str, bound: float) -> str:
    return f"""SELECT t, a.v / greatest(b.v, 0.001) AS v FROM ({rates}) a JOIN (SELECT t + 900 AS t, v FROM ({rates})) b
               USING (t) WHERE round(a.v / greatest(b.v, 0.001), 9) < {bound}"""


SHIPMENT_SQL: dict[str, str] = {
    "ar2": STALLED.format(_SHIP_INGESTED),
    "ar3": f"""SELECT * FROM ({rate_by("ship_anom_c", ("severity",), where="severity = 'critical'")}) WHERE v > 0.1""",
    "ar16": f"SELECT * FROM ({_SHIP_4XX}) WHERE v > 1 AND job = 'api-gateway'",
    "ar17": _and(_fallen(_SHIP_INGESTED, 0.5), _fallen(_SHIP_ANOMALIES, 0.2)),
    "ar18": _and(
        "SELECT job, instance, t, v FROM ship_up_ticks WHERE v = 0 AND job IN ('ingestion-consumer', 'anomaly-detection')",
        f"""SELECT t FROM ({_SHIP_5XX}) a JOIN ({_SHIP_HTTP}) b USING (job, t)
            WHERE round(a.v / greatest(b.v, 1.0), 9) > 0.1 AND job = 'api-gateway'""",
    ),
    "ar19": _and(f"SELECT * FROM ({_SHIP_ERRORS}) WHERE v > 0.01", _fallen(_SHIP_INGESTED, 0.5)),
    "ar21": _and(STALLED.format(_SHIP_INGESTED), "SELECT t FROM ship_up_ticks WHERE v = 1 AND job = 'api-gateway'"),
}


def states_sql(condition: str, labels, for_s: int | str) -> str:
    lab = "".join(f"{c}, " for c in labels)
    part = f"PARTITION BY {', '.join(labels)} " if labels else ""
    return f"""
      SELECT {lab}x.t * 1000000 AS ts_us, active * 1000000 AS active_us, x.state AS state, x.v AS value
      FROM (SELECT *, unnest(CASE WHEN state = 'firing' AND (nxt IS NULL OR nxt - t > 15) AND t + 15 <= {END_S}
                    THEN [{{'t': t, 'state': state, 'v': v}}, {{'t': t + 15, 'state': 'resolved', 'v': NULL}}]
                    ELSE [{{'t': t, 'state': state, 'v': v}}] END) AS x
            FROM (SELECT *, CASE WHEN t - active >= {for_s} THEN 'firing' ELSE 'pending' END AS state
                  FROM (SELECT *, min(t) OVER ({f"PARTITION BY {lab}run" if labels else "PARTITION BY run"}) AS active
                        FROM (SELECT *, sum(fresh) OVER ({part}ORDER BY t) AS run
                              FROM (SELECT {lab}CAST(t AS BIGINT) AS t, v,
                                           lead(CAST(t AS BIGINT)) OVER ({part}ORDER BY t) AS nxt,
                                           CASE WHEN t - lag(t) OVER ({part}ORDER BY t) <= 15 THEN 0 ELSE 1 END AS fresh
                                    FROM ({condition}))))))"""


def _states_out(frame, labels, digits):
    return frame.select(*labels, us("ts"), us("active_at", "active_us"), "state", r("value", digits))


def _muted(d: Domain, rules):
    return al.inhibited_by(d.firing_alerts, rules, ("ts",)).select(
        "notification_id", "rule", us("ts")
    )


def _inhibition_sql(rule) -> str:
    def cond(side, name):
        return " AND ".join(f"{side}.{k} = {quote(v)}" for k, v in name.items())

    equal = "".join(f" AND s.{c} = a.{c}" for c in rule.equal)
    return f"""SELECT notification_id, {quote(rule.id)} AS rule, ts_us FROM firing_alerts a
               WHERE {cond("a", rule.target)} AND EXISTS (SELECT 1 FROM firing_alerts s
                 WHERE s.ts_us = a.ts_us AND {cond("s", rule.source)}{equal})"""


ALL_MUTED = " UNION ALL ".join(_inhibition_sql(rule) for rule in ar.INHIBITIONS)


def _triage_alerts(d: Domain):
    marked = al.mark_new(
        d.alert_log, ["received_at", "notification_id"], segment_us=600 * MICROS
    )
    return tr.triage_candidates(marked).withColumn(
        "summary", F.concat(F.col("alert_name"), F.lit(" on "), F.col("pipeline"))
    )


PARTS["triage_alerts"] = """
    SELECT *, alert_name || ' on ' || pipeline AS summary FROM numbered_log
    WHERE is_new AND status = 'firing' AND severity = 'critical'"""


def _names(names) -> str:
    return ", ".join(quote(n) for n in names)


STRATEGY = f"""CASE WHEN alert_name IN ({_names(PRODUCT_ALERTS)}) OR tier = 'product' THEN 'diagnoses'
    WHEN alert_name IN ({_names(PLATFORM_ALERTS)}) OR tier = 'platform' THEN 'template'
    ELSE 'diagnoses' END"""


def _flat(template: dict) -> str:
    """A template as one text with its placeholders."""
    steps = "\n".join(f"{i}. {x}" for i, x in enumerate(template["investigation"], 1))
    actions = "\n".join(f"{i}. {x}" for i, x in enumerate(template["actions"], 1))
    return (
        "TRIAGE: {name}\nAlert: {summary}\n\n--- Likely Root Cause ---\n"
        + template["root_cause"]
        + "\n\n--- Investigation Steps ---\n"
        + steps
        + "\n\n--- Blast Radius ---\n"
        + template["blast_radius"]
        + "\n\n--- Immediate Actions ---\n"
        + actions
    )


TEMPLATE_SQL = (
    "replace(replace(replace(replace(CASE alert_name "
    + " ".join(
        f"WHEN {quote(name)} THEN {quote(_flat(t))}" for name, t in TRIAGE_TEMPLATES.items()
    )
    + f" ELSE {quote(GENERIC_TRIAGE)} END, '{{name}}', alert_name), '{{summary}}', summary), "
    "'{pipe}', pipeline), '{prefix}', '')"
)

PARTS["recent_diagnoses"] = """
    SELECT * FROM (
      SELECT t.notification_id, t.alert_name, t.pipeline, d.event_id, d.severity, d.device_id, d.root_cause_summary,
             d.confidence_score, d.actions,
             row_number() OVER (PARTITION BY notification_id ORDER BY detected_us DESC, d.anomaly_id DESC) AS rn
      FROM triage_alerts t JOIN severe_diagnoses d
        ON d.detected_us > t.received_us - 1800000000 AND d.detected_us <= t.received_us) WHERE rn <= 10"""
PARTS["severe_diagnoses"] = """
    SELECT *, event_id AS anomaly_id FROM diagnoses WHERE severity IN ('critical', 'high')"""
PARTS["cause_lines"] = """
    SELECT notification_id, string_agg('• [' || upper(severity) || '] ' || root_cause_summary ||
             ' (confidence: ' || CAST(round_even(confidence_score * 100, 0) AS BIGINT) || '%)', chr(10) ORDER BY rn) AS causes
    FROM (SELECT *, row_number() OVER (PARTITION BY notification_id, root_cause_summary ORDER BY rn) AS k
          FROM recent_diagnoses) WHERE k = 1 GROUP BY 1"""
PARTS["action_lines"] = """
    SELECT notification_id, string_agg(i || '. ' || action, chr(10) ORDER BY i) AS actions
    FROM (SELECT *, row_number() OVER (PARTITION BY notification_id ORDER BY rn, j) AS i
          FROM (SELECT notification_id, action, min(rn) AS rn, arg_min(j, rn * 100 + j) AS j
                FROM (SELECT notification_id, rn, unnest(actions) AS action,
                             unnest(range(1, len(actions) + 1)) AS j FROM recent_diagnoses)
                GROUP BY ALL)) WHERE i <= 5 GROUP BY 1"""
PARTS["diagnosis_texts"] = """
    SELECT c.notification_id, 'TRIAGE SUMMARY (from ' || n || ' recent diagnosis(es))' || chr(10) ||
           'Alert: ' || alert_name || chr(10) ||
           'Source: Existing Diagnosis Service output (last 30 minutes)' || chr(10) || chr(10) ||
           '--- Root Causes Identified ---' || chr(10) || causes || chr(10) || chr(10) ||
           '--- Blast Radius ---' || chr(10) || '• Devices affected: ' || devices || chr(10) ||
           '• Anomalies in last 30min: ' || n ||
           coalesce(chr(10) || chr(10) || '--- Recommended Actions (from diagnoses) ---' || chr(10) || actions, '') AS txt
    FROM (SELECT notification_id, alert_name, count(*) AS n, count(DISTINCT device_id) AS devices
          FROM recent_diagnoses GROUP BY 1, 2) b
    JOIN cause_lines c USING (notification_id) LEFT JOIN action_lines a USING (notification_id)"""

TIMES = {
    0: ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'789Z'", "%Y-%m-%dT%H:%M:%S.%f789Z"),
    1: ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", None),
    2: ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", None),
    3: ("'not a time'", None),
    4: ("'0001-01-01T00:00:00Z'", None),
}


def _alert_times(d: Domain):
    text = F.lit(None).cast("string")
    for digit, (pattern, _) in TIMES.items():
        text = F.when(
            F.col("notification_id") % 5 == digit, F.date_format("started_at", pattern)
        ).otherwise(text)
    raw = d.alert_log.withColumn("raw", text)
    now = F.col("received_at")
    return raw.select(
        "notification_id",
        F.when(F.year(parse_alert_ts(F.col("raw"), now)) > 1, parse_alert_ts(F.col("raw"), now))
        .alias("started"),
        parse_resolved_ts(F.col("raw"), now).alias("resolved"),
    ).select("notification_id", us("started"), us("resolved"))


TIMES_SQL = """
    SELECT notification_id, CASE notification_id % 5 WHEN 0 THEN started_us
             WHEN 1 THEN started_us - started_us % 1000000 - 7200000000 WHEN 2 THEN started_us
             WHEN 3 THEN received_us END AS started_us,
           CASE notification_id % 5 WHEN 0 THEN started_us
             WHEN 1 THEN started_us - started_us % 1000000 - 7200000000 WHEN 2 THEN started_us
             ELSE received_us END AS resolved_us FROM alert_log"""


def _routed(d: Domain):
    alerts = d.alert_log.withColumn("compound", F.col("compound").cast("string"))
    return al.route(alerts, ar.ROUTES, ar.DEFAULT_ROUTE)


def _schedule(d: Domain):
    """Notification times of the episodes, up to the end of the replay."""
    firing_first = d.episodes.filter(~F.col("unmatched"))
    groups = firing_first.select(
        "fingerprint",
        "episode",
        "severity",
        F.col("received_at").alias("last_at"),
        "started_at",
        "resolved_at",
        F.lit("false").alias("compound"),
        F.timestamp_seconds(F.lit(END_S)).alias("horizon_at"),
    )
    return al.notification_schedule(
        al.route(groups, ar.ROUTES, ar.DEFAULT_ROUTE), until="resolved_at"
    )


SCHEDULE_SQL = f"""
    SELECT fingerprint, episode, receiver, unnest(list_concat(
             list_transform(range(first_s, end_s + 1, repeat_s), lambda t: {{'t': t, 's': 'firing'}}),
             CASE WHEN resolved_us IS NOT NULL AND first_s <= end_s
                  THEN [{{'t': first_s + CAST(ceil((end_s - first_s) / interval_s) AS BIGINT) * interval_s, 's': 'resolved'}}]
                  ELSE [] END)) AS x
    FROM (SELECT fingerprint, episode, resolved_us, receiver, CAST(interval_s AS BIGINT) AS interval_s,
                 CAST(repeat_s AS BIGINT) AS repeat_s, started_us // 1000000 + wait_s AS first_s,
                 coalesce(resolved_us // 1000000, {END_S}) AS end_s
          FROM episodes JOIN (VALUES ('critical', 'pagerduty-critical', 10, 60, 3600),
               ('critical', 'webhook-all', 10, 60, 3600), ('warning', 'webhook-all', 30, 300, 14400),
               ('info', 'webhook-all', 60, 600, 43200)) AS v(sev, receiver, wait_s, interval_s, repeat_s)
            ON sev = severity WHERE NOT unmatched)"""


def _rendered(d: Domain, kind: str = "summary"):
    """Summaries or descriptions of all notifications, rendered from the rule templates."""
    labels = {"job": F.col("pipeline")}
    value = F.col("price") + 0.0137  # no ties in the printed digits
    text = F.lit("")
    for rule in ar.ALERT_RULES:
        text = F.when(
            F.col("alert_name") == rule.name, al.render(getattr(rule, kind), labels, value)
        ).otherwise(text)
    return d.alert_log.select("notification_id", text.alias(kind))


def _rendered_sql(kind: str = "summary") -> str:
    import re

    cases = []
    for rule in ar.ALERT_RULES:
        sql = quote(getattr(rule, kind))
        for m in re.finditer(r"\{\{\s*(.*?)\s*\}\}", getattr(rule, kind)):
            body = m.group(1)
            if body.startswith("$labels"):
                by = "pipeline" if body == "$labels.job" else "''"
            elif body == "$value":
                by = "CAST((price + CAST(0.0137 AS DOUBLE)) AS VARCHAR)"
            elif "printf" in body:
                by = f"printf('{re.search(r'%[^"]+', body).group(0)}', (price + CAST(0.0137 AS DOUBLE)))"
            else:
                by = """CASE WHEN (price + CAST(0.0137 AS DOUBLE)) >= 1024 THEN regexp_replace(regexp_replace(CASE
                    WHEN (price + CAST(0.0137 AS DOUBLE)) / 1024 >= 100 THEN printf('%.1f', (price + CAST(0.0137 AS DOUBLE)) / 1024)
                    WHEN (price + CAST(0.0137 AS DOUBLE)) / 1024 >= 10 THEN printf('%.2f', (price + CAST(0.0137 AS DOUBLE)) / 1024)
                    ELSE printf('%.3f', (price + CAST(0.0137 AS DOUBLE)) / 1024) END, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || 'ki'
                    ELSE CAST((price + CAST(0.0137 AS DOUBLE)) AS VARCHAR) END"""
            sql = f"replace({sql}, {quote(m.group(0))}, {by})"
        cases.append(f"WHEN {quote(rule.name)} THEN {sql}")
    return f"SELECT notification_id, CASE alert_name {' '.join(cases)} END AS {kind} FROM alert_log"


def _fingerprints(d: Domain):
    labels = F.create_map(
        F.lit("severity"), F.col("severity"), F.lit("alertname"), F.col("alert_name"),
        F.lit("pipeline"), F.col("pipeline"),
    )
    turned = F.create_map(
        F.lit("pipeline"), F.col("pipeline"), F.lit("severity"), F.col("severity"),
        F.lit("alertname"), F.col("alert_name"),
    )
    chosen = F.when(F.col("notification_id") % 2 == 0, labels).otherwise(turned)
    return d.alert_log.select("notification_id", al.fingerprint(chosen).alias("fingerprint"))


FINGERPRINT_SQL = """
    SELECT notification_id, sha256('[{"key":"alertname","value":"' || alert_name || '"},{"key":"pipeline","value":"' ||
      pipeline || '"},{"key":"severity","value":"' || severity || '"}]') AS fingerprint FROM alert_log"""


def _all_notifications_judged(d: Domain):
    severity = F.col("priority")
    mapped = (
        F.when(severity == "1-URGENT", "critical")
        .when(severity == "2-HIGH", "warning")
        .when(severity == "3-MEDIUM", "info")
        .when(severity == "4-NOT SPECIFIED", "unknown")
        .otherwise("low")
    )
    return (
        d.notifications.withColumn("severity", mapped)
        .withColumn("reason", F.coalesce(alert_failure(), F.lit("ok")))
        .groupBy("reason", "status")
        .agg(F.count(F.lit(1)).alias("n"))
    )


EPISODE_COLS = ["fingerprint", "episode", "priority", "price", "status", "notifications", "unmatched"]


def _streamed_episodes(d: Domain):
    order = ["received_at", "notification_id"]
    numbered = replay(d.alert_log, "received_at", lambda s: number_episodes_stream(s, order))
    return al.fold_episodes(
        numbered,
        order,
        first=["started_at", "priority", "alert_name", "severity", "pipeline", "tier"],
        latest_firing=["price"],
    )


# --- the alert chain: rule states, inhibition, routes, group notifications ------------------------

IDENTITY = ("alert_name", "severity", "pipeline", "compound", "job", "instance", "endpoint")


def _chain_marked(d: Domain):
    """Firing ticks of all rules, marked where an inhibition mutes them."""
    return al.mark_inhibited(al.firing(rule_engine.labelled_states(d.feed)), ar.INHIBITIONS)


def _chain_routed(d: Domain):
    """Firing runs of alerts that some tick leaves unmuted, with their receivers."""
    runs = al.firing_runs(_chain_marked(d), IDENTITY, END_S)
    return al.route(runs, ar.ROUTES, ar.DEFAULT_ROUTE)


def _chain_sql() -> str:
    parts = []
    for rule in ar.ALERT_RULES:
        by_job = "job" in rule.labels
        pipeline = ("job" if by_job else "'unknown'") if rule.pipeline == ar.FROM_JOB else quote(rule.pipeline)
        labels = ", ".join(c if c in rule.labels else f"NULL::VARCHAR AS {c}" for c in ar.LABELS)
        parts.append(
            f"""SELECT {quote(rule.name)} AS alert_name, {quote(rule.severity)} AS severity, {pipeline} AS pipeline,
                {quote(str(rule.compound).lower())} AS compound, {labels},
                ts_us, active_us, state FROM ({states_sql(CONDITION_SQL[rule.id], rule.labels, rule.for_s)})"""
        )
    return " UNION ALL ".join(parts)


PARTS["chain_firing"] = f"SELECT * FROM ({_chain_sql()}) WHERE state = 'firing'"


def _chain_muted_sql() -> str:
    def cond(side, name):
        return " AND ".join(f"{side}.{k} = {quote(v)}" for k, v in name.items())

    tests = []
    for rule in ar.INHIBITIONS:
        equal = "".join(f" AND s.{c} = a.{c}" for c in rule.equal)
        tests.append(
            f"""({cond("a", rule.target)} AND EXISTS (SELECT 1 FROM chain_firing s
                 WHERE s.ts_us = a.ts_us AND {cond("s", rule.source)}{equal}))"""
        )
    return " OR ".join(tests)


PARTS["chain_loud"] = f"SELECT * FROM chain_firing a WHERE NOT ({_chain_muted_sql()})"
PARTS["chain_runs"] = f"""
    SELECT alert_name, severity, pipeline, compound, job, instance, endpoint, min(ts_us) // 1000000 AS started,
           CASE WHEN max(ts_us) // 1000000 + 15 <= {END_S} THEN max(ts_us) // 1000000 + 15 END AS ended
    FROM chain_firing f WHERE EXISTS (SELECT 1 FROM chain_loud l WHERE l.alert_name = f.alert_name
      AND l.pipeline = f.pipeline AND l.job IS NOT DISTINCT FROM f.job
      AND l.instance IS NOT DISTINCT FROM f.instance AND l.endpoint IS NOT DISTINCT FROM f.endpoint
      AND l.active_us = f.active_us)
    GROUP BY alert_name, severity, pipeline, compound, job, instance, endpoint, active_us"""
PARTS["chain_routed"] = """
    SELECT r.*, v.* FROM chain_runs r JOIN (VALUES ('critical', 'pagerduty-critical', 10, 60, 3600),
      ('critical', 'webhook-all', 10, 60, 3600), ('warning', 'webhook-all', 30, 300, 14400),
      ('info', 'webhook-all', 60, 600, 43200)) AS v(sev, receiver, wait_s, interval_s, repeat_s) ON sev = severity"""
GROUP_SQL = f"""
    SELECT * FROM (WITH t0 AS (SELECT alert_name, pipeline, severity, receiver, min(started) + any_value(wait_s) AS first
                FROM chain_routed GROUP BY ALL),
    changes AS (SELECT alert_name, pipeline, severity, receiver, interval_s, repeat_s, started AS t, 1 AS d FROM chain_routed
      UNION ALL SELECT alert_name, pipeline, severity, receiver, interval_s, repeat_s, ended, -1 FROM chain_routed
      WHERE ended IS NOT NULL),
    looks AS (SELECT alert_name, pipeline, severity, receiver, interval_s, repeat_s,
                CAST(first + ceil(greatest(0, t - first) / interval_s) * interval_s AS BIGINT) AS look, sum(d) AS d
              FROM changes JOIN t0 USING (alert_name, pipeline, severity, receiver) GROUP BY ALL),
    summed AS (SELECT *, CAST(sum(d) OVER w AS BIGINT) AS firing,
                 least(coalesce(lead(look) OVER w, {END_S + 1}), {END_S + 1}) AS until,
                 CAST(ceil(repeat_s / interval_s) * interval_s AS BIGINT) AS every
               FROM looks WINDOW w AS (PARTITION BY alert_name, pipeline, severity, receiver ORDER BY look))
    SELECT alert_name, pipeline, severity, receiver,
      unnest(CASE WHEN firing > 0 AND until > look THEN range(look, until, every) ELSE [look] END) * 1000000 AS notify_at_us,
      CASE WHEN firing > 0 THEN 'firing' ELSE 'resolved' END AS notify_status, firing
    FROM summed WHERE look <= {END_S})"""


PARTS["rate_monitors"] = """
    SELECT id, name AS alert_name, severity, pipeline, CAST(regexp_extract(expr, '\\d+') AS BIGINT) AS bound,
           CAST(regexp_extract(duration, '\\d+') AS BIGINT) * 60 AS for_s,
           CAST(id AS BIGINT) % 3 = 0 AS only_a, CAST(id AS BIGINT) % 11 < 4 AS unread
    FROM full_monitors WHERE enabled"""
MONITOR_LABELS = ("alert_name", "severity", "pipeline", "job", "for_s")
PARTS["rate_monitors_held"] = f"""
    SELECT {", ".join(MONITOR_LABELS)}, t, v FROM rate_monitors m JOIN ({RULE_SQL["rr1"]}) s
    ON round(v * 300, 6) > bound AND (NOT only_a OR job LIKE 'a%') WHERE NOT unread"""


def register(reg: Registry) -> None:
    # --- rules -----------------------------------------------------------------------------------
    reg.add(
        "l1_rule_catalogue",
        # The rules joined with the notifications they raised.
        lambda d: ar.rule_catalogue(d.spark)
        .join(
            d.alert_log.groupBy("alert_name").agg(F.count(F.lit(1)).alias("raised")),
            "alert_name",
            "left",
        )
        .select(
            "alert_name", "severity", "tier", F.col("for_s").cast("bigint").alias("for_s"),
            "compound", "summary", F.coalesce("raised", F.lit(0)).alias("raised"),
        ),
        build(
            """SELECT u.alert_name, u.severity, u.tier, CAST(for_s AS BIGINT) AS for_s, u.compound, summary,
               count(notification_id) AS raised
               FROM rules u LEFT JOIN alert_log a ON a.alert_name = u.alert_name GROUP BY ALL"""
        ),
    )
    for rule in ar.ALERT_RULES:
        digits = 2 if rule.id == "ar12" else 6
        reg.add(
            f"{rule.id}_{rule.key}",
            lambda d, rule=rule, n=digits: _states_out(
                rule_engine.rule_states(d.feed, [rule]), rule.labels, n
            ),
            build(
                f"""SELECT {"".join(f"{c}, " for c in rule.labels)}ts_us, active_us, state,
                    {rd("value", digits)} AS value
                    FROM ({states_sql(CONDITION_SQL[rule.id], rule.labels, rule.for_s)})"""
            ),
        )
        if rule.id in SHIPMENT_SQL:
            reg.add(
                f"{rule.id}_{rule.key}_shipments",
                lambda d, rule=rule: _states_out(
                    rule_engine.rule_states(d.shipment_feed, [rule]), rule.labels, 6
                ),
                build(
                    f"""SELECT {"".join(f"{c}, " for c in rule.labels)}ts_us, active_us, state, {rd("value")} AS value
                        FROM ({states_sql(SHIPMENT_SQL[rule.id], rule.labels, rule.for_s)})"""
                ),
            )
    reg.add(
        "in3_muted_shipment_alerts",
        lambda d: al.inhibited_by(d.shipment_alerts, [x for x in ar.INHIBITIONS if x.id == "in3"])
        .select("notification_id", "rule", us("ts")),
        build(_inhibition_sql(ar.INHIBITIONS[2]).replace("firing_alerts", "shipment_alerts")),
    )
    reg.add(
        "l2_alert_states",
        lambda d: al.alert_states(
            recorded(d.metrics, "rr2").filter(F.col("value") > 0.02),
            ["job", "endpoint", "method"],
            120,
            15,
            END_S,
        )
        .groupBy("job", "endpoint", "method", "state")
        .agg(F.count(F.lit(1)).alias("ticks")),
        build(
            f"""SELECT job, endpoint, method, state, count(*) AS ticks FROM (
                {states_sql(f"SELECT * FROM ({RULE_SQL['rr2']}) WHERE v > 0.02", ("job", "endpoint", "method"), 120)})
                GROUP BY ALL"""
        ),
    )
    reg.add(
        "l3_monitor_condition",
        lambda d: al.alert_states(
            monitor_condition(recorded(d.metrics, "rr1"), "value > 0.1 AND job LIKE 'a%'"),
            ["job"],
            60,
            15,
            END_S,
        ).select("job", us("ts"), us("active_at", "active_us"), "state", r("value")),
        build(
            f"""SELECT job, ts_us, active_us, state, {rd("value")} AS value FROM (
                {states_sql(f"SELECT * FROM ({RULE_SQL['rr1']}) WHERE v > 0.1 AND job LIKE 'a%'", ("job",), 60)})"""
        ),
    )
    reg.add(
        "l3_monitor_set_states",
        lambda d: monitor_states(
            recorded(d.metrics, "rr1"),
            with_defaults(d.rate_monitors),
            ["job"],
            last_tick_s=END_S,
            counted=["alert_name", "severity", "pipeline"],
        ).select("alert_name", "severity", "pipeline", "job", "state", "ticks", "runs", us("first")),
        build(
            f"""SELECT alert_name, severity, pipeline, job, state, count(*) AS ticks, count(DISTINCT active_us) AS runs,
                min(ts_us) AS first_us
                FROM ({states_sql("SELECT * FROM rate_monitors_held", MONITOR_LABELS, "for_s")}) GROUP BY ALL"""
        ),
    )
    reg.add(
        "l3_monitor_set_rejects",
        lambda d: set_rejects(recorded(d.metrics, "rr1"), with_defaults(d.rate_monitors)),
        build("SELECT id, alert_name AS name, 'expression' AS reason FROM rate_monitors WHERE unread"),
    )

    # --- lifecycle -------------------------------------------------------------------------------
    reg.add(
        "l4_project_alerts",
        lambda d: al.project_alerts(
            d.alert_log.select(
                "notification_id",
                F.when(F.col("fingerprint") % 7 == 0, F.create_map().cast("map<string,string>"))
                .otherwise(
                    F.create_map(
                        F.lit("alertname"), F.col("alert_name"), F.lit("tier"), F.col("tier")
                    )
                )
                .alias("labels"),
            )
        ).drop("labels"),
        build(
            """SELECT notification_id, CASE WHEN fingerprint % 7 = 0 THEN 'unknown' ELSE alert_name END AS alert_name,
               'unknown' AS severity, 'unknown' AS pipeline,
               CASE WHEN fingerprint % 7 = 0 THEN 'unknown' ELSE tier END AS tier FROM alert_log"""
        ),
    )
    for name in ("l5_alert_episodes", "st8_stream_episodes"):
        reg.add(
            name,
            lambda d: d.episodes.select(
                *EPISODE_COLS, us("started_at"), us("received_at"), us("resolved_at")
            ),
            build(
                f"""SELECT {", ".join(EPISODE_COLS)}, started_us AS started_at_us,
                    received_us AS received_at_us, resolved_us AS resolved_at_us FROM episodes"""
            ),
        )
    # Numbered by the state function, on a stream that stops and resumes half way.
    reg.add(
        "st8_stream_state",
        lambda d: _streamed_episodes(d).select(
            *EPISODE_COLS, us("started_at"), us("received_at"), us("resolved_at")
        ),
        build(
            f"""SELECT {", ".join(EPISODE_COLS)}, started_us AS started_at_us,
                received_us AS received_at_us, resolved_us AS resolved_at_us FROM episodes"""
        ),
    )
    reg.add("l6_alert_times", _alert_times, build(TIMES_SQL))
    reg.add(
        "l7_inhibit",
        lambda d: al.inhibit(
            d.firing_alerts, ar.INHIBITIONS, ("ts",), ("notification_id",)
        ).select("notification_id", "alert_name", "pipeline", us("ts")),
        build(
            f"""SELECT notification_id, alert_name, pipeline, ts_us FROM firing_alerts
                WHERE notification_id NOT IN (SELECT notification_id FROM ({ALL_MUTED}))"""
        ),
    )
    reg.add("e7_inhibited_by", lambda d: _muted(d, ar.INHIBITIONS), build(ALL_MUTED))
    for rule in ar.INHIBITIONS:
        reg.add(
            f"{rule.id}_muted_alerts",
            lambda d, rule=rule: _muted(d, [rule]),
            build(_inhibition_sql(rule)),
        )
    reg.add(
        "l8_group_alerts",
        lambda d: al.group_alerts(d.alert_log).select(
            "alert_name", "pipeline", "severity", "alerts", "firing", "fingerprints",
            us("first_started_at"),
        ),
        build(
            """SELECT alert_name, pipeline, severity, count(*) AS alerts,
               count(*) FILTER (status = 'firing') AS firing, count(DISTINCT fingerprint) AS fingerprints,
               min(started_us) AS first_started_at_us FROM alert_log GROUP BY ALL"""
        ),
    )
    reg.add(
        "l9_route",
        lambda d: _routed(d).select(
            "notification_id", "receiver", F.col("repeat_interval_s").cast("bigint").alias("repeat_s")
        ),
        build(
            """SELECT notification_id, receiver, CAST(repeat_s AS BIGINT) AS repeat_s FROM alert_log
               JOIN (VALUES ('critical', 'pagerduty-critical', 3600), ('critical', 'webhook-all', 3600),
                 ('warning', 'webhook-all', 14400), ('info', 'webhook-all', 43200)) AS v(sev, receiver, repeat_s)
               ON sev = severity"""
        ),
    )
    reg.add(
        "l10_notification_schedule",
        lambda d: _schedule(d).select(
            "fingerprint", "episode", "receiver", us("notify_at"), "notify_status"
        ),
        build(
            f"""SELECT fingerprint, episode, receiver, x.t * 1000000 AS notify_at_us, x.s AS notify_status
                FROM ({SCHEDULE_SQL})"""
        ),
    )
    reg.add(
        "l7_chain_unmuted",
        lambda d: _chain_marked(d)
        .filter(~F.col("muted"))
        .groupBy("alert_name", "severity", "pipeline", "compound")
        .agg(F.count("*").alias("ticks")),
        build("SELECT alert_name, severity, pipeline, compound, count(*) AS ticks FROM chain_loud GROUP BY ALL"),
    )
    reg.add(
        "l9_chain_receivers",
        lambda d: _chain_routed(d).select(
            "alert_name", "pipeline", "compound", "job", "instance", "endpoint", "receiver", us("started_at"), us("ended_at")
        ),
        build(
            """SELECT alert_name, pipeline, compound, job, instance, endpoint, receiver, started * 1000000 AS started_at_us,
               ended * 1000000 AS ended_at_us FROM chain_routed"""
        ),
    )
    reg.add(
        "l10_group_notifications",
        lambda d: al.group_notifications(_chain_routed(d), END_S).select(
            *al.GROUP_BY, "receiver", us("notify_at"), "notify_status", "firing"
        ),
        build(GROUP_SQL),
    )
    reg.add("l11_render_summaries", _rendered, build(_rendered_sql()))
    reg.add(
        "l11_render_descriptions", lambda d: _rendered(d, "description"), build(_rendered_sql("description"))
    )
    reg.add("l12_fingerprints", _fingerprints, build(FINGERPRINT_SQL))
    reg.add(
        "l13_validate_alerts",
        _all_notifications_judged,
        build(
            """SELECT CASE WHEN status = 'pending' THEN 'invalid_status' WHEN priority = '5-LOW'
               THEN 'invalid_severity' ELSE 'ok' END AS reason, status, count(*) AS n
               FROM notifications GROUP BY ALL"""
        ),
    )

    # --- summaries --------------------------------------------------------------------------------
    active = "SELECT * FROM episodes WHERE status = 'firing'"
    breakdown = f"""
        SELECT 'total' AS dimension, 'all' AS name, count(*) AS n FROM ({active})
        UNION ALL SELECT 'severity', severity, count(*) FROM ({active}) GROUP BY severity
        UNION ALL SELECT 'pipeline', pipeline, count(*) FROM ({active}) GROUP BY pipeline"""
    reg.add(
        "g2_firing_breakdown",
        lambda d: su.firing_breakdown(al.active_firing(d.episodes)),
        build(breakdown),
    )
    gauges = f"""
        SELECT dimension, name, CAST(sum(n) AS BIGINT) AS n FROM ({breakdown} UNION ALL
          SELECT * FROM (VALUES ('total', 'all', 0), ('severity', 'critical', 0), ('severity', 'warning', 0),
            ('severity', 'info', 0), ('pipeline', 'ingestion', 0), ('pipeline', 'detection', 0),
            ('pipeline', 'diagnosis', 0), ('pipeline', 'api', 0), ('pipeline', 'alerting', 0))) GROUP BY ALL"""
    for name in ("g3_firing_gauges", "db19_alerts_firing"):
        reg.add(name, lambda d: su.firing_gauges(al.active_firing(d.episodes)), build(gauges))
    reg.add(
        "g4_alert_events_received",
        lambda d: su.alert_events_received(d.alert_log),
        build("SELECT status, severity, count(*) AS n FROM alert_log GROUP BY ALL"),
    )
    reg.add("g5_affected_devices", lambda d: _devices(d), build(
        "SELECT severity, count(DISTINCT device_id) AS devices FROM diagnoses GROUP BY ALL"
    ))
    reg.add("g5_first_seen_causes", lambda d: _causes(d), build(
        """SELECT severity, root_cause_summary, min(detected_us) AS first_seen FROM diagnoses GROUP BY ALL"""
    ))

    # --- triage -----------------------------------------------------------------------------------
    reg.add(
        "t1_triage_candidates",
        lambda d: _triage_alerts(d).select("notification_id", "alert_name"),
        build("SELECT notification_id, alert_name FROM triage_alerts"),
    )
    reg.add(
        "t2_triage_strategy",
        lambda d: tr.triage_strategy(d.alert_log).select("notification_id", "strategy"),
        build(f"SELECT notification_id, {STRATEGY} AS strategy FROM alert_log"),
    )
    with_summary = "(SELECT *, alert_name || ' on ' || pipeline AS summary FROM alert_log)"
    for name in ("t3_template_triage", "e10_template_lookup"):
        reg.add(
            name,
            lambda d: tr.template_triage(
                d.alert_log.withColumn(
                    "summary", F.concat(F.col("alert_name"), F.lit(" on "), F.col("pipeline"))
                )
            ).select("notification_id", F.md5("template_text").alias("text_md5")),
            build(f"SELECT notification_id, md5({TEMPLATE_SQL}) AS text_md5 FROM {with_summary}"),
        )
    reg.add(
        "e3_recent_severe_diagnoses",
        lambda d: tr.recent_diagnoses(
            _triage_alerts(d), _by_event(d.diagnosed), None, "notification_id"
        )
        .select(
            "notification_id",
            F.col("r.anomaly_id").alias("event_id"),
            F.col("r.severity").alias("severity"),
            r("r.confidence_score", 6, "confidence_score"),
        ),
        build(
            f"""SELECT notification_id, event_id, severity, {rd("confidence_score")} AS confidence_score
                FROM recent_diagnoses"""
        ),
    )
    reg.add(
        "t4_diagnosis_triage",
        lambda d: tr.diagnosis_triage(
            _triage_alerts(d), _by_event(d.diagnosed), None, "notification_id"
        )
        .filter(F.col("diagnosis_text").isNotNull())
        .select("notification_id", F.md5("diagnosis_text").alias("text_md5"), F.length("diagnosis_text").cast("bigint").alias("chars")),
        build(
            """SELECT notification_id, md5(txt) AS text_md5, length(txt) AS chars FROM diagnosis_texts"""
        ),
    )
    chosen = f"""
        SELECT notification_id, CASE WHEN {STRATEGY} = 'diagnoses' AND txt IS NOT NULL THEN txt
               ELSE {TEMPLATE_SQL} END AS txt
        FROM triage_alerts LEFT JOIN diagnosis_texts USING (notification_id)"""
    reg.add(
        "t5_alerts_with_triage",
        lambda d: tr.with_triage(
            d.alert_log,
            tr.triage(_triage_alerts(d), _by_event(d.diagnosed), None),
            "notification_id",
        ).select(
            "notification_id", "triage_status", F.md5("triage_summary").alias("text_md5")
        ),
        build(
            f"""SELECT notification_id, CASE WHEN txt IS NULL THEN 'none' ELSE 'available' END AS triage_status,
                md5(txt) AS text_md5 FROM alert_log LEFT JOIN ({chosen}) USING (notification_id)"""
        ),
    )


def _by_event(frame):
    """Use the event id as anomaly id, which SQL can name too."""
    return frame.withColumn("anomaly_id", F.col("event_id")).drop("event_id")


def _severe(d: Domain):
    return d.diagnosed


def _devices(d: Domain):
    return su.affected_devices_and_causes(
        _severe(d), ["severity"], "device_id", "root_cause_summary", F.unix_micros("detected_at")
    )[0]


def _causes(d: Domain):
    return su.affected_devices_and_causes(
        _severe(d), ["severity"], "device_id", "root_cause_summary", F.unix_micros("detected_at")
    )[1]
