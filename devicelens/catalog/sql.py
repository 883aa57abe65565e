"""DuckDB CTEs mirroring :mod:`devicelens.catalog.domain`, and a builder that adds what is needed."""

from __future__ import annotations

import re

from devicelens.catalog.domain import (
    END_S,
    ENDPOINTS,
    EVENT_SPEED,
    JOBS,
    MAX_VALUE,
    ORDER_SPEED,
    ORDERS_START_S,
    SHIPMENT_SPEED,
    SHIPMENTS_START_S,
    START_S,
)
from devicelens.plans.alert_rules import ALERT_RULES, FROM_JOB

START_US = START_S * 1_000_000
ORDERS_START_US = ORDERS_START_S * 1_000_000
INF = "CAST('infinity' AS DOUBLE)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rd(x: str, digits: int = 6) -> str:
    """Half up, decided on ten digits (so that float noise does not decide a tie)."""
    return f"CAST(round(CAST({x} AS DECIMAL(28, 10)), {digits}) AS DOUBLE)"


def round4(x: str) -> str:
    return rd(x, 4)


def case(col: str, mapping: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items()) + " END"


def pick(values: tuple[str, ...], index: str) -> str:
    return "[" + ", ".join(quote(v) for v in values) + f"][{index} + 1]"


GOOD = (
    """'{"device_id": "' || device_id || '", "metric_type": "' || metric_type || '", "value": ' """
    """|| CAST(value AS VARCHAR) || ', "timestamp": "' """
    """|| strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}'"""
)

BODY = (
    """'{"root_cause_summary": "cause ' || (k % 7) || '", "confidence_score": ' || """
    """(CASE WHEN event_id % 11 = 2 THEN '"high"' ELSE CAST(k / 50.0 AS VARCHAR) END) || """
    """', "supporting_evidence": ["e' || k || '"], "recommended_actions": ["act ' || (k % 3) || """
    """'", "act ' || (k % 4) || '"], "retrieved_incident_ids": ["' || k || '"]}'"""
)

RULE_ROWS = ", ".join(
    f"({i}, {quote(x.name)}, {quote(x.severity)}, {quote(x.tier)}, {quote(x.pipeline)}, "
    f"{str(x.compound).lower()}, {x.for_s}, {quote(x.summary)})"
    for i, x in enumerate(ALERT_RULES)
)

PARTS: dict[str, str] = {
    "readings": f"""
        SELECT event_id, user_id AS device_id, event_type AS metric_type, value,
               {START_US} + (epoch_us(ts) - {START_US}) // {EVENT_SPEED} AS ts_us,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
        FROM events""",
    "devices": f"""
        SELECT s_suppkey AS device_id, s_name AS device_name,
               'type_' || (s_nationkey % 4) AS device_type, n_name AS location,
               CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE 'v1.' || (s_suppkey % 3) END AS firmware_version,
               {START_US} + s_suppkey * 60000000 AS registered_us
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "enriched": """
        SELECT a.*, nullif(d.device_type, '') AS device_type, nullif(d.location, '') AS device_location,
               nullif(d.firmware_version, '') AS firmware_version
        FROM readings a JOIN devices d USING (device_id)""",
    "payloads": f"""
        SELECT event_id, CASE WHEN event_id % 10 <> 7 THEN good ELSE
            CASE k % 10
              WHEN 0 THEN replace(good, '"device_id"', '"bad"')
              WHEN 1 THEN replace(good, '"device_id": "', '"device_id": "x')
              WHEN 2 THEN 'completely invalid json {{{{{{{{'
              WHEN 3 THEN '42'
              WHEN 4 THEN ''
              WHEN 5 THEN replace(good, '"value": ', '"value": "high", "was": ')
              WHEN 6 THEN regexp_replace(good, '"value": ([0-9.]+)', '"value": "\\1"')
              WHEN 7 THEN replace(good, '"timestamp": "', '"timestamp": "not a time ')
              WHEN 8 THEN replace(good, '"metric_type"', '"metric"')
              ELSE regexp_replace(good, '\\}}$', ', "metadata": 5}}') END END AS payload
        FROM (SELECT event_id, k, {GOOD} AS good FROM readings)""",
    "raw_checked": """
        SELECT event_id, payload, CASE
          WHEN NOT ok THEN 'invalid_json'
          WHEN json_type(doc) <> 'OBJECT' THEN 'not_an_object'
          WHEN dev IS NULL THEN 'missing_device_id'
          WHEN met IS NULL THEN 'missing_metric_type'
          WHEN val IS NULL THEN 'missing_value'
          WHEN tim IS NULL THEN 'missing_timestamp'
          WHEN NOT regexp_matches(dev, '^-?\\d+$') THEN 'invalid_device_id'
          WHEN TRY_CAST(val AS DOUBLE) IS NULL THEN 'invalid_value'
          WHEN TRY_CAST(tim AS TIMESTAMP) IS NULL THEN 'invalid_timestamp'
          WHEN json_type(doc, '$.metadata') <> 'OBJECT' THEN 'invalid_metadata' END AS reason,
          dev, met, TRY_CAST(val AS DOUBLE) AS value, TRY_CAST(tim AS TIMESTAMP) AS tim
        FROM (SELECT *, json_extract_string(doc, '$.device_id') AS dev,
                     json_extract_string(doc, '$.metric_type') AS met,
                     json_extract_string(doc, '$.value') AS val,
                     json_extract_string(doc, '$.timestamp') AS tim
              FROM (SELECT event_id, payload, payload <> '' AND json_valid(payload) AS ok,
                           CASE WHEN payload <> '' AND json_valid(payload) THEN payload::JSON END AS doc
                    FROM payloads))""",
    "dead_letters": f"""
        SELECT r.event_id, 'telemetry.raw' AS original_topic,
               '{{"device_id":' || r.device_id || ',"metric_type":"' || metric_type || '","value":' ||
                 CAST(value AS VARCHAR) || '}}' AS original_payload,
               CASE WHEN value > {MAX_VALUE} THEN 'Schema validation failed: value out of range'
                    ELSE 'Device ' || r.device_id || ' not found during enrichment' END AS error_reason,
               CASE WHEN value > {MAX_VALUE} THEN 'validation_failed' ELSE 'device_not_found' END AS reason,
               ts_us AS failed_us
        FROM readings r LEFT JOIN devices d ON r.device_id = d.device_id
        WHERE value > {MAX_VALUE} OR d.device_id IS NULL""",
    "accepted": f"SELECT * FROM enriched WHERE value <= {MAX_VALUE}",
    "windowed": """
        SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mean, min(value) OVER w AS lo,
               max(value) OVER w AS hi, stddev_pop(value) OVER w AS sd0
        FROM enriched
        WINDOW w AS (PARTITION BY metric_type ORDER BY ts_us
                     RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW)""",
    "scored": """
        SELECT *, CASE WHEN abs(z) >= 4 THEN 'critical' WHEN abs(z) >= 3 THEN 'high'
                       WHEN abs(z) >= 2.5 THEN 'medium' WHEN abs(z) >= 2 THEN 'low' END AS severity
        FROM (SELECT *, CASE WHEN lo = hi THEN 0.0 ELSE sd0 END AS sd,
                     CASE WHEN lo = hi THEN 0.0 ELSE (value - mean) / sd0 END AS z
              FROM windowed WHERE n >= 10)""",
    "anomalies": "SELECT *, ts_us AS detected_us FROM scored WHERE severity IS NOT NULL",
    "answers": f"""
        SELECT event_id, device_id, severity, detected_us, k,
               CASE WHEN event_id % 5 = 0 THEN ''
                    WHEN event_id % 7 = 1 THEN '{{"root_cause_summary": "only"}}'
                    WHEN event_id % 3 = 0 THEN '```json' || chr(10) || body || chr(10) || '```'
                    ELSE body END AS raw_response,
               CASE event_id % 13 WHEN 0 THEN 'context' WHEN 1 THEN 'retrieval'
                    WHEN 2 THEN 'generation' WHEN 3 THEN 'persistence' END AS failed_phase,
               k * 1.5 AS generation_s, detected_us + 20000000 AS generated_us
        FROM (SELECT *, {BODY} AS body FROM anomalies)""",
    "normalised": """
        SELECT *, CASE WHEN ok THEN coalesce(json_extract_string(doc, '$.root_cause_summary'), '')
                       ELSE 'Unable to parse structured diagnosis. Raw response: ' || left(txt, 200)
                  END AS root_cause_summary,
               CASE WHEN ok AND json_type(doc, '$.confidence_score') IN ('DOUBLE', 'BIGINT', 'UBIGINT')
                    THEN greatest(0.0, least(1.0, CAST(json_extract(doc, '$.confidence_score') AS DOUBLE)))
                    ELSE 0.1 END AS confidence_score,
               CASE WHEN ok THEN coalesce(CAST(json_extract(doc, '$.supporting_evidence') AS VARCHAR[]), [])
                    ELSE ['LLM response parsing failed'] END AS evidence,
               CASE WHEN ok THEN coalesce(CAST(json_extract(doc, '$.recommended_actions') AS VARCHAR[]), [])
                    ELSE ['Review raw LLM response manually', 'Check prompt template formatting']
                    END AS actions,
               CASE WHEN ok THEN coalesce(CAST(json_extract(doc, '$.retrieved_incident_ids') AS VARCHAR[]), [])
                    ELSE [] END AS ids
        FROM (SELECT *, txt <> '' AND json_valid(txt) AS ok,
                     CASE WHEN txt <> '' AND json_valid(txt) THEN txt::JSON END AS doc
              FROM (SELECT *, CASE WHEN starts_with(raw_response, '```')
                                   THEN trim(array_to_string(string_split(raw_response, chr(10))[2:-2], chr(10)))
                                   ELSE trim(raw_response) END AS txt
                    FROM answers))""",
    "diagnoses": "SELECT * FROM normalised WHERE failed_phase IS NULL",
    "requests": f"""
        SELECT event_id, device_id, {pick(JOBS, "device_id % 5")} AS job,
               'node-' || (device_id % 16) AS instance,
               CASE WHEN k % 2 = 0 THEN 'POST' ELSE 'GET' END AS method,
               {case("metric_type", ENDPOINTS)} AS endpoint,
               CASE metric_type WHEN 'error' THEN '500' WHEN 'signup' THEN '404' ELSE '200' END AS status_code,
               value / 100 AS duration, value, k, ts_us
        FROM readings""",
    "instrumented": "SELECT * FROM requests WHERE endpoint <> '/metrics'",
    "rules": f"""
        SELECT * FROM (VALUES {RULE_ROWS})
        AS t(rule, alert_name, severity, tier, rule_pipeline, compound, for_s, summary)""",
    "notifications": f"""
        SELECT o_orderkey AS notification_id, o_custkey AS fingerprint,
               CASE o_orderstatus WHEN 'O' THEN 'firing' WHEN 'F' THEN 'resolved' ELSE 'pending' END AS status,
               alert_name, severity, tier,
               CASE WHEN rule_pipeline = {quote(FROM_JOB)} THEN {pick(JOBS, "o_custkey % 5")}
                    ELSE rule_pipeline END AS pipeline,
               compound, o_orderpriority AS priority, o_totalprice AS price,
               {START_US} + (epoch_us(o_orderdate) - {ORDERS_START_US}) // {ORDER_SPEED} AS received_us,
               {START_US} + (epoch_us(o_orderdate) - {ORDERS_START_US}) // {ORDER_SPEED}
                 - (o_orderkey % 5000) * 1000000 AS started_us,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 6 <> 0 THEN
                 {START_US} + (epoch_us(o_orderdate) - {ORDERS_START_US}) // {ORDER_SPEED} END AS resolved_us
        FROM orders JOIN rules ON rule = o_custkey % {len(ALERT_RULES)}""",
    "alert_log": "SELECT * FROM notifications WHERE status IN ('firing', 'resolved')",
    "numbered_log": """
        SELECT *, sum(is_new::INT) OVER (PARTITION BY fingerprint ORDER BY received_us, notification_id) AS episode
        FROM (SELECT *, coalesce(lag(status) OVER (PARTITION BY fingerprint ORDER BY received_us,
                     notification_id), 'resolved') = 'resolved' AS is_new FROM alert_log)""",
    "episodes": """
        SELECT fingerprint, CAST(episode AS BIGINT) AS episode,
               first(started_us ORDER BY received_us, notification_id) AS started_us,
               first(priority ORDER BY received_us, notification_id) AS priority,
               first(alert_name) AS alert_name, first(severity) AS severity,
               first(pipeline) AS pipeline, first(tier) AS tier,
               coalesce(last(price ORDER BY received_us, notification_id) FILTER (status = 'firing'),
                        last(price ORDER BY received_us, notification_id)) AS price,
               last(status ORDER BY received_us, notification_id) AS status,
               max(received_us) AS received_us,
               max(coalesce(resolved_us, received_us)) FILTER (status = 'resolved') AS resolved_us,
               count(*) AS notifications,
               first(status ORDER BY received_us, notification_id) = 'resolved' AS unmatched
        FROM numbered_log GROUP BY fingerprint, episode""",
    "firing_alerts": """
        SELECT *, received_us - received_us % 15000000 AS ts_us FROM alert_log WHERE status = 'firing'""",
    "triage_runs": """
        SELECT received_us, ['success', 'failure', 'skipped'][notification_id % 3 + 1] AS result,
               price / 8000 AS triage_s
        FROM alert_log WHERE status = 'firing' AND severity = 'critical'""",
    "deliveries": """
        SELECT *, (received_us - started_us) / 1000000.0 AS delivery_s FROM alert_log
        WHERE received_us > started_us AND received_us - started_us < 3600000000""",
    "monitors": f"""
        SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id,
               'Monitor ' || p_name || ' ' || p_partkey AS name, 'value > ' || p_size AS expr,
               CASE WHEN p_partkey % 3 <> 0 THEN (p_size % 9 + 1) || 'm' END AS duration,
               CASE p_partkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'info' END AS severity,
               CASE WHEN p_partkey % 2 = 0 THEN 'ingestion' END AS pipeline,
               CASE WHEN p_partkey % 5 = 0 THEN 'Summary of ' || p_name ELSE '' END AS summary,
               '' AS description, CASE WHEN p_partkey % 7 = 0 THEN false END AS enabled,
               {START_US} + (p_partkey * 7919 % 10000) * 1000000 AS created_us
        FROM part""",
    "full_monitors": """
        SELECT id, name, expr, coalesce(duration, '5m') AS duration, coalesce(severity, 'warning') AS severity,
               coalesce(pipeline, 'custom') AS pipeline,
               coalesce(nullif(summary, ''), name || ' is firing') AS summary,
               coalesce(nullif(description, ''), 'Custom monitor: ' || name) AS description,
               coalesce(enabled, true) AS enabled, created_us
        FROM monitors""",
    "incidents": f"""
        SELECT doc_id AS incident_id, 'doc ' || doc_id AS title, text AS description, lang, source,
               CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 1 THEN 'high'
                    WHEN quality = 0 THEN 'medium' ELSE 'low' END AS severity,
               {START_US} + doc_id * 1000000 AS ingested_us
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "vectors": """
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, CAST(label AS BIGINT) AS incident_id
        FROM embeddings""",
    "hits": """
        SELECT * FROM (
          SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.incident_id,
                 1 - list_cosine_similarity(q.embedding, c.embedding) AS distance,
                 row_number() OVER (PARTITION BY q.vec_id
                   ORDER BY 1 - list_cosine_similarity(q.embedding, c.embedding), c.vec_id) AS rank
          FROM vectors q, vectors c) WHERE rank <= 5""",
    "up_ticks": None,  # filled below
    "memory_ticks": None,
    "grid": f"SELECT unnest(range({START_S}, {END_S} + 1, 15)) AS t",
}


def _gauge(value: str, source: str = "requests") -> str:
    """Latest sample per series within 300 s before each 15 s tick."""
    return f"""
        SELECT job, instance, t, arg_max(v, ts_us) AS v
        FROM (SELECT job, instance, ts_us, {value} AS v,
                     unnest(range(((ts_us + 14999999) // 15000000) * 15,
                                  ((ts_us + 299999999) // 15000000) * 15 + 1, 15)) AS t FROM {source})
        GROUP BY job, instance, t"""


PARTS["up_ticks"] = _gauge("CASE WHEN k < 50 THEN 0.0 ELSE 1.0 END")
PARTS["memory_ticks"] = _gauge("value * 10 * 1024 * 1024")


PARTS["shipments"] = f"""
    SELECT l_orderkey * 10 + l_linenumber AS notification_id, l_partkey, l_suppkey,
           {START_US} + (epoch_us(CAST(l_shipdate AS TIMESTAMP)) - {SHIPMENTS_START_S * 1_000_000}) // {SHIPMENT_SPEED} AS ts_us,
           month(l_shipdate) AS month,
           CASE l_linenumber WHEN 4 THEN 'ingestion-consumer' WHEN 5 THEN 'anomaly-detection'
             WHEN 6 THEN 'diagnosis-service' WHEN 7 THEN 'alert-receiver' ELSE 'api-gateway' END AS job,
           'node-' || (l_suppkey % 4) AS instance,
           CASE l_returnflag WHEN 'R' THEN '500' WHEN 'N' THEN '404' WHEN 'A' THEN '404' ELSE '200' END AS status_code,
           CASE WHEN l_linenumber = 1 THEN 'critical' ELSE 'low' END AS severity
    FROM lineitem"""
PARTS["busy_shipments"] = "SELECT * FROM shipments WHERE month <= 6"
PARTS["failed_shipments"] = "SELECT *, 'timeout' AS error_type FROM shipments WHERE l_suppkey % 5 = 0"
PARTS["ship_up_ticks"] = _gauge(
    "CASE WHEN month IN (3, 4) AND job IN ('ingestion-consumer', 'anomaly-detection') THEN 0.0 ELSE 1.0 END", "shipments"
)
PARTS["shipment_alerts"] = f"""
    SELECT notification_id, ts_us // 15000000 * 15000000 AS ts_us, alert_name, severity,
           ['ingestion', 'detection', 'diagnosis', 'api'][l_suppkey % 4 + 1] AS pipeline
    FROM (SELECT * EXCLUDE (severity) FROM shipments) JOIN rules r ON r.rule = l_partkey % {len(ALERT_RULES)}"""


def counter(name: str, source: str, labels: tuple[str, ...], ts: str, n: str = "count(*)") -> None:
    """CTEs ``{name}_c`` (cumulative on the grid)."""
    lab = "".join(f"{c}, " for c in labels)
    part = f"PARTITION BY {', '.join(labels)} " if labels else ""
    on = " AND ".join(["g.t = x.t", *[f"s.{c} = x.{c}" for c in labels]])
    sets = f"(SELECT DISTINCT {', '.join(labels)} FROM {source})" if labels else "(SELECT 1 AS one)"
    slab = "".join(f"s.{c}, " for c in labels)
    PARTS[f"{name}_c"] = f"""
        SELECT {lab}t, sum(n) OVER ({part}ORDER BY t) AS v FROM (
          SELECT {slab}g.t, CAST(coalesce(x.n, 0) AS DOUBLE) AS n
          FROM {sets} s CROSS JOIN grid g LEFT JOIN (
            SELECT {lab}((({ts}) + 14999999) // 15000000) * 15 AS t, {n} AS n
            FROM {source} GROUP BY ALL) x ON {on})"""


def bucket_counter(name: str, source: str, value: str, bounds, labels, ts: str) -> None:
    every = [*map(str, bounds), INF]
    lab = "".join(f"{c}, " for c in labels)
    PARTS[f"{name}_b"] = f"""
        SELECT {lab}le, x AS ts_us, m FROM (
          SELECT {lab}{ts} AS x, {value} AS val FROM {source}) q,
          (SELECT unnest([{", ".join(f"CAST({b} AS DOUBLE)" for b in every)}]) AS le) b,
          LATERAL (SELECT CASE WHEN val <= le THEN 1 ELSE 0 END AS m) z"""
    counter(name, f"{name}_b", (*labels, "le"), "ts_us", "sum(m)")


def rate(source: str, labels=(), range_s: int = 300, where: str = "true") -> str:
    """Extrapolated rate of a counter CTE without resets: ``labels, t, v``."""
    lab = "".join(f"{c}, " for c in labels)
    part = f"PARTITION BY {', '.join(labels)} " if labels else ""
    return f"""
      SELECT {lab}t, inc * ((sampled + least(start, coalesce(CASE WHEN inc > 0 THEN sampled * v0 / inc END, start)))
                     / sampled) / {range_s} AS v
      FROM (SELECT *, CASE WHEN t0 - (t - {range_s}) >= 1.1 * sampled / (n - 1)
                           THEN sampled / (n - 1) / 2 ELSE t0 - (t - {range_s}) END AS start
            FROM (SELECT {lab}t, v, v0, n, t0, v - v0 AS inc, CAST(t - t0 AS DOUBLE) AS sampled
                  FROM (SELECT *, count(*) OVER w AS n, first_value(v) OVER w AS v0, first_value(t) OVER w AS t0
                        FROM {source} WHERE {where}
                        WINDOW w AS ({part}ORDER BY t RANGE BETWEEN {range_s - 1} PRECEDING AND CURRENT ROW))
                  WHERE n >= 2))"""


def rate_by(source: str, labels, by=(), range_s: int = 300, where: str = "true") -> str:
    lab = "".join(f"{c}, " for c in by)
    return (
        f"SELECT {lab}t, sum(v) AS v FROM ({rate(source, labels, range_s, where)}) GROUP BY ALL"
    )


def quantile(source: str, labels, q: float, by=(), where: str = "true") -> str:
    """histogram_quantile over bucket rates."""
    lab = "".join(f"{c}, " for c in by)
    part = ", ".join([*by, "t"])
    return f"""
      SELECT {lab}t, CASE WHEN total <= 0 THEN NULL WHEN le = {INF} THEN low
                          ELSE low + (le - low) * coalesce(({q} * total - below) / nullif(v - below, 0), 0) END AS v
      FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY le) AS i FROM (
              SELECT *, coalesce(lag(le) OVER o, 0.0) AS low, coalesce(lag(v) OVER o, 0.0) AS below,
                     max(v) OVER (PARTITION BY {part}) AS total
              FROM (SELECT * REPLACE (max(v) OVER (PARTITION BY {part} ORDER BY le) AS v)
                    FROM ({rate_by(source, labels, ("le", *by), where=where)}))
              WINDOW o AS (PARTITION BY {part} ORDER BY le)) WHERE v >= {q} * total OR total <= 0)
      WHERE i = 1"""


def build(body: str) -> str:
    """Prefix ``body`` with the CTEs it names, directly or through another CTE."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", sql)):
            if name in PARTS and name not in needed and PARTS[name] is not sql:
                visit(PARTS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in needed) + "\n" + body
