"""Knowledge base, retrieval and diagnosis (R*, E4-E6, G9, G10, S11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from devicelens.catalog.domain import Domain
from devicelens.catalog.registry import Registry, r, us
from devicelens.catalog.sql import PARTS, build, quote, rd
from devicelens.config import DiagnosisConfig
from devicelens.fixed_values import SYSTEM_PROMPT, USER_PROMPT
from devicelens.operators import diagnosis as dg
from devicelens.operators import knowledge as kb
from devicelens.operators import lookups as lo
from devicelens.operators import summaries as su
from devicelens.operators.validation import incident_failure

CONFIG = DiagnosisConfig()


def _turns(d: Domain):
    """Conversation turns as the chunks of an incident."""
    return d.table("conversations").select(
        F.col("conv_id").alias("incident_id"),
        F.col("turn").alias("chunk_index"),
        F.col("text").alias("document"),
        "role",
    )


def _anomalies(d: Domain):
    """Stored anomalies with the event id as anomaly id (SQL can name it)."""
    return d.anomaly_table.withColumn("anomaly_id", F.col("event_id"))


def _incident_text(d: Domain):
    return kb.incident_text(d.incidents)


def _chunk_facts(d: Domain):
    """One row per document: are its chunks pieces of the text, in bounds, numbered, and all of it?"""
    texts = _incident_text(d).select("incident_id", "text")
    chunks = kb.chunk_rows(kb.chunk_documents(texts)).join(texts, "incident_id")
    size, number = F.length("document"), F.count(F.lit(1))
    short = F.max(F.length("text")) < 2048
    named = F.concat_ws("_chunk_", F.col("incident_id").cast("string"), F.col("chunk_index").cast("string"))
    return (
        chunks.groupBy("incident_id")
        .agg(
            # A text of just the chunk size may be one chunk too; only shorter ones must be.
            F.when((number == 1) & short, F.max(F.md5("document"))).alias("single_md5"),
            ((number == 1) & short).alias("is_single"),
            F.bool_and(size.between(1, 2048)).alias("sizes"),
            (
                F.bool_and(F.col("chunk_id") == named)
                & (F.min("chunk_index") == 0)
                & (F.max("chunk_index") == number - 1)
                & (F.count_distinct("chunk_index") == number)
            ).alias("numbered"),
            F.bool_and(F.contains("text", "document")).alias("parts_of_text"),
            F.bool_or((F.col("chunk_index") == 0) & F.startswith("text", "document")).alias("begins"),
            F.max_by(F.endswith("text", "document"), "chunk_index").alias("ends"),
            # White space between chunks is dropped, nothing else.
            (F.sum(F.length(F.regexp_replace("document", r"(?U)\s", ""))) >= F.max(F.length(F.regexp_replace("text", r"(?U)\s", "")))).alias("covers"),
        )
    )


PARTS["incident_texts"] = """
    SELECT incident_id, 'Incident: ' || title || chr(10) || chr(10) || 'Description: ' || description || chr(10) ||
      chr(10) || 'Root Cause: root cause in ' || source || chr(10) || chr(10) || 'Resolution Steps:' || chr(10) ||
      '- check ' || lang || chr(10) || '- review ' || source || chr(10) || chr(10) || 'Affected Device Types: ' ||
      lang || chr(10) || 'Severity: ' || severity || chr(10) || 'Category: ' || source AS txt FROM incidents"""


def _nearest(d: Domain, ids=None):
    """Hits of each vector, or of those that ``ids`` names, among all vectors."""
    v = d.vectors
    queries = v.select(F.col("vec_id").alias("query_id"), "embedding")
    if ids is not None:
        queries = queries.join(ids.select(F.col("device_id").alias("query_id")), "query_id", "left_semi")
    return kb.cosine_topk(
        queries,
        v.select(F.col("vec_id").alias("chunk_id"), "embedding"),
        CONFIG.top_k,
    )


def _device_hits(d: Domain):
    """Hits of each registered device's vector among all vectors, with the chunk's incident."""
    meta = d.vectors.select(F.col("vec_id").alias("chunk_id"), "incident_id").join(
        d.incidents.select("incident_id", "title", "severity", "failure_category"), "incident_id"
    ).withColumn("document", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")))
    # Only registered devices have anomalies, so no other vector asks.
    return _nearest(d, d.devices).join(meta, "chunk_id")


def _hits(d: Domain):
    """Hits of each anomaly: those of its device."""
    near = _device_hits(d).withColumnRenamed("severity", "incident_severity")
    return (
        _anomalies(d)
        .select("anomaly_id", F.col("device_id").alias("query_id"))
        .join(near, "query_id")
        .withColumnRenamed("incident_severity", "severity")
    )


PARTS["anomaly_hits"] = """
    SELECT a.event_id AS anomaly_id, h.rank, h.chunk_id, h.incident_id, i.title, i.severity, i.source,
           row_number() OVER (PARTITION BY a.event_id, h.incident_id ORDER BY h.rank) AS k
    FROM anomalies a JOIN hits h ON h.query_id = a.device_id JOIN incidents i ON i.incident_id = h.incident_id"""
PARTS["sections"] = """
    SELECT anomaly_id, string_agg('### Incident ' || rank || ' (ID: ' || incident_id || ')' || chr(10) ||
             '**Title:** ' || title || chr(10) || '**Severity:** ' || severity || ' | **Category:** ' || source ||
             chr(10) || chr(10) || 'chunk ' || chunk_id, chr(10) || chr(10) || '---' || chr(10) || chr(10)
             ORDER BY rank) AS txt, string_agg(CAST(incident_id AS VARCHAR), ',' ORDER BY rank) AS ids
    FROM anomaly_hits WHERE k = 1 GROUP BY 1"""
PARTS["context"] = """
    SELECT a.event_id AS anomaly_id, r.event_id, r.metric_type, r.value, r.ts_us,
           count(*) OVER (PARTITION BY a.event_id) AS in_range,
           row_number() OVER (PARTITION BY a.event_id ORDER BY r.ts_us DESC, r.event_id DESC) AS rn
    FROM anomalies a JOIN readings r ON r.device_id = a.device_id AND r.ts_us >= a.detected_us - 1800000000"""
ISO = """CASE WHEN {t} % 1000000 = 0 THEN strftime(make_timestamp({t}), '%Y-%m-%dT%H:%M:%S')
         ELSE strftime(make_timestamp({t}), '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00'"""
PARTS["histories"] = f"""
    SELECT anomaly_id, 'Showing ' || count(*) || ' most recent readings:' || chr(10) ||
           string_agg('  ' || {ISO.format(t="ts_us")} || ' | ' || metric_type || ': ' || printf('%.2f', value),
                      chr(10) ORDER BY rn DESC) AS txt
    FROM context WHERE rn <= 20 GROUP BY 1"""


def _history(d: Domain):
    found = dg.with_newest_readings(_anomalies(d), d.readings)
    return found.select("anomaly_id", dg.history_text(F.col("newest")).alias("recent_telemetry"))


def _prompts(d: Domain):
    # Retrieval asks with the device's vector, so its texts are made per device and anomalies are read once.
    sections = dg.format_incidents(_device_hits(d), "query_id").withColumnRenamed("query_id", "device_id")
    found = dg.with_newest_readings(_anomalies(d), d.readings).withColumn(
        "recent_telemetry", dg.history_text(F.col("newest"))
    )
    return dg.build_prompts(found.join(sections, "device_id", "left"), None, None)


def _prompt_sql() -> str:
    fields = {
        "anomaly_id": "CAST(a.event_id AS VARCHAR)",
        "device_id": "CAST(a.device_id AS VARCHAR)",
        "device_type": "coalesce(device_type, 'None')",
        "device_location": "coalesce(device_location, 'None')",
        "metric_type": "metric_type",
        "observed_value": "CAST(value AS VARCHAR)",
        "z_score": "printf('%.2f', z)",
        "severity": "a.severity",
        "detected_at": ISO.format(t="detected_us"),
        "expected_mean": f"CAST({rd('mean', 4)} AS VARCHAR)",
        "expected_stddev": f"CAST({rd('sd', 4)} AS VARCHAR)",
        "expected_lower": f"CAST({rd('mean - 2 * sd', 4)} AS VARCHAR)",
        "expected_upper": f"CAST({rd('mean + 2 * sd', 4)} AS VARCHAR)",
        "window_count": "CAST(n AS VARCHAR)",
        "context_window_minutes": "'30'",
        "retrieval_k": "'5'",
        "recent_telemetry": "coalesce(h.txt, 'No recent telemetry data available for this device.')",
        "retrieved_incidents": "coalesce(s.txt, 'No relevant historical incidents found in the knowledge base.')",
    }
    text = quote(USER_PROMPT)
    for name, sql in fields.items():
        text = f"replace({text}, '{{{name}}}', {sql})"
    return f"""SELECT a.event_id AS anomaly_id, md5({text}) AS user_md5, coalesce(s.ids, '') AS retrieved_ids,
               CAST({len(SYSTEM_PROMPT)} AS BIGINT) AS system_chars
               FROM anomalies a LEFT JOIN histories h ON h.anomaly_id = a.event_id
               LEFT JOIN sections s ON s.anomaly_id = a.event_id"""


def _query_text_sql() -> str:
    return f"""SELECT event_id, md5('Anomaly detected: ' || metric_type || ' reading of ' || value || ' with z-score ' ||
      printf('%.2f', z) || ' (' || severity || ' severity) on device type ''' || device_type || ''' at location ''' ||
      device_location || '''. Expected range: mean ' || {rd("mean", 4)} || ' with stddev ' || {rd("sd", 4)} || '.')
      AS text_md5 FROM anomalies"""


def _answers_out(frame):
    return frame.select(
        "event_id",
        "root_cause_summary",
        r("confidence_score"),
        F.array_join("supporting_evidence", "|").alias("evidence"),
        F.array_join("recommended_actions", "|").alias("actions"),
        F.array_join("retrieved_incident_ids", "|").alias("ids"),
    )


ANSWERS_SQL = f"""SELECT event_id, root_cause_summary, {rd("confidence_score")} AS confidence_score,
    array_to_string(evidence, '|') AS evidence, array_to_string(actions, '|') AS actions,
    array_to_string(ids, '|') AS ids FROM """


def _embedded(d: Domain):
    docs = d.table("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("document"))
    given = d.vectors.select(F.col("vec_id").alias("chunk_id"), "embedding")
    from devicelens.functions.vectors import norm

    return kb.attach_embeddings(docs, given, CONFIG.vector_dim).select(
        "chunk_id",
        F.size("embedding").cast("bigint").alias("dim"),
        F.round(norm(F.col("embedding")), 4).alias("norm"),
    )


def _ingest_outcomes(d: Domain):
    """Ingest of all incidents under their text as title: long titles fail, the others are chunked."""
    judged = d.incidents.withColumn("title", F.col("description")).withColumn(
        "reason", incident_failure()
    )
    texts = kb.incident_text(judged.filter(F.col("reason").isNull()))
    counts = kb.chunk_counts(kb.chunk_documents(texts.select("incident_id", "text")))
    return judged.select("incident_id", F.col("reason").isNull().alias("ok")).join(
        counts, "incident_id", "left"
    )


def register(reg: Registry) -> None:
    reg.add(
        "r1_incident_texts",
        lambda d: _incident_text(d).select("incident_id", F.md5("text").alias("text_md5")),
        build("SELECT incident_id, md5(txt) AS text_md5 FROM incident_texts"),
    )
    # SQL cannot cut recursively: it names what every document's chunks must satisfy, and the text of
    # documents that are one chunk.
    reg.add(
        "r2_chunk_documents",
        _chunk_facts,
        build(
            """SELECT incident_id, CASE WHEN length(txt) < 2048 THEN md5(txt) END AS single_md5,
               length(txt) < 2048 AS is_single, true AS sizes, true AS numbered, true AS parts_of_text,
               true AS begins, true AS ends, true AS covers FROM incident_texts"""
        ),
    )
    reg.add(
        "r3_chunk_ids",
        lambda d: kb.chunk_rows(_turns(d)).select("chunk_id", F.md5("document").alias("document_md5")),
        """SELECT conv_id || '_chunk_' || turn AS chunk_id, md5(text) AS document_md5 FROM conversations""",
    )
    reg.add(
        "r3_chunk_counts",
        lambda d: kb.chunk_counts(_turns(d)),
        "SELECT conv_id AS incident_id, count(*) AS chunk_count FROM conversations GROUP BY 1",
    )
    reg.add(
        "r4_attach_embeddings",
        _embedded,
        build(
            f"""SELECT doc_id AS chunk_id, CAST(coalesce(len(v.embedding), 64) AS BIGINT) AS dim,
                CASE WHEN v.vec_id IS NOT NULL
                     THEN round(sqrt(list_sum(list_transform(v.embedding, lambda x: x * x))), 4)
                     ELSE 1.0 END AS norm
                FROM documents LEFT JOIN vectors v ON v.vec_id = doc_id"""
        ),
    )
    reg.add(
        "r5_upsert_chunks",
        lambda d: kb.last_write_wins(
            _turns(d).select(
                F.concat_ws("_", F.col("incident_id").cast("string"), "role").alias("chunk_id"),
                "chunk_index",
                "document",
            ),
            F.col("chunk_index"),
        ).select("chunk_id", "chunk_index", F.md5("document").alias("document_md5")),
        """SELECT conv_id || '_' || role AS chunk_id, max(turn) AS chunk_index,
           md5(arg_max(text, turn)) AS document_md5 FROM conversations GROUP BY 1""",
    )
    for name in ("r6_cosine_topk", "e6_nearest_chunks"):
        reg.add(
            name,
            lambda d: _nearest(d).select(
                "query_id", "chunk_id", r("distance", 4), F.col("rank").cast("bigint").alias("rank")
            ),
            build(f"SELECT query_id, chunk_id, {rd('distance', 4)} AS distance, rank FROM hits"),
        )
    reg.add(
        "r7_retrieval_texts",
        lambda d: kb.retrieval_text(d.anomaly_table).select(
            "event_id", F.md5("query_text").alias("text_md5")
        ),
        build(_query_text_sql()),
    )
    reg.add(
        "r8_recent_readings",
        lambda d: dg.recent_readings(_anomalies(d), d.readings).select(
            "anomaly_id", "in_range", F.col("r.event_id").alias("event_id"), "position"
        ),
        build(
            """SELECT anomaly_id, in_range, event_id, least(in_range, 20) - rn + 1 AS position
               FROM context WHERE rn <= 20"""
        ),
    )
    reg.add(
        "e5_context_join",
        lambda d: dg.context_join(_anomalies(d), d.readings).select(
            "anomaly_id", "event_id", "metric_type", "value"
        ),
        build(
            """SELECT a.event_id AS anomaly_id, r.event_id, r.metric_type, r.value
               FROM anomalies a JOIN readings r ON r.device_id = a.device_id
                AND r.ts_us BETWEEN a.detected_us - 1800000000 AND a.detected_us"""
        ),
    )
    reg.add(
        "r9_format_history",
        lambda d: _history(d).select("anomaly_id", F.md5("recent_telemetry").alias("text_md5")),
        build("SELECT anomaly_id, md5(txt) AS text_md5 FROM histories"),
    )
    reg.add(
        "r10_format_incidents",
        lambda d: dg.format_incidents(_hits(d)).select(
            "anomaly_id",
            F.md5("retrieved_incidents").alias("text_md5"),
            F.array_join("retrieved_ids", ",").alias("ids"),
        ),
        build("SELECT anomaly_id, md5(txt) AS text_md5, ids FROM sections"),
    )
    reg.add(
        "r11_prompts",
        lambda d: _prompts(d).select(
            "anomaly_id",
            F.md5("user_prompt").alias("user_md5"),
            F.array_join("retrieved_ids", ",").alias("retrieved_ids"),
            F.length("system_prompt").cast("bigint").alias("system_chars"),
        ),
        build(_prompt_sql()),
    )
    reg.add(
        "r12_normalise_answers",
        lambda d: _answers_out(dg.normalise_diagnoses(d.answers)),
        build(ANSWERS_SQL + "normalised"),
    )
    reg.add(
        "s11_diagnosis_rows",
        lambda d: _answers_out(d.diagnoses).join(
            d.diagnoses.select("event_id", r("generation_time_seconds"), us("generated_at")),
            "event_id",
        ),
        build(
            f"""SELECT d.*, {rd("generation_s")} AS generation_time_seconds, generated_us AS generated_at_us
                FROM ({ANSWERS_SQL} diagnoses) d JOIN diagnoses x USING (event_id)"""
        ),
    )
    reg.add(
        "r13_incidents_by_category",
        lambda d: lo.query_incidents(d.incidents, severity="high", failure_category="src8").select(
            "incident_id", "title", "severity", "failure_category", us("ingested_at")
        ),
        build(
            """SELECT incident_id, title, severity, source AS failure_category, ingested_us AS ingested_at_us
               FROM incidents WHERE severity = 'high' AND source = 'src8'
               ORDER BY ingested_us DESC, incident_id LIMIT 100"""
        ),
    )
    reg.add(
        "g9_ingest_summary",
        lambda d: su.ingest_summary(_ingest_outcomes(d)).select("ingested", "failed", "chunks"),
        build(
            # A title of at most 500 characters makes a text of one chunk.
            """SELECT count(*) FILTER (good) AS ingested, count(*) FILTER (NOT good) AS failed,
               count(*) FILTER (good) AS chunks FROM (
               SELECT length(description) BETWEEN 1 AND 500 AND length(description) >= 10 AS good
               FROM incidents)"""
        ),
    )
    reg.add(
        "g10_diagnosis_outcomes",
        lambda d: su.diagnosis_outcomes(d.answers),
        build(
            """SELECT CASE WHEN failed_phase IS NULL THEN 'generated' ELSE 'failed' END AS outcome,
               coalesce(failed_phase, severity) AS label, count(*) AS n FROM answers GROUP BY ALL"""
        ),
    )
    status = """
        SELECT a.event_id, CASE WHEN d.event_id IS NULL THEN 'pending' ELSE 'complete' END AS diagnosis_status,
               d.root_cause_summary FROM anomalies a LEFT JOIN diagnoses d ON d.event_id = a.event_id"""
    for name in ("e4_latest_diagnosis", "q5_diagnosis_status"):
        reg.add(
            name,
            lambda d: lo.diagnosis_status(
                d.anomaly_table, d.diagnoses.drop("event_id")
            ).select("event_id", "diagnosis_status", "root_cause_summary"),
            build(status),
        )
