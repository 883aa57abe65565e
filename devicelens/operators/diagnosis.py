"""Diagnosis data jobs: context, prompt tables and answer normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicelens.config import DiagnosisConfig
from devicelens.fixed_values import SYSTEM_PROMPT, USER_PROMPT
from devicelens.functions.asof import count_since, last_in_range, newest_before, newest_since
from devicelens.functions.text import fill, fixed
from devicelens.functions.times import MICROS, iso_utc, micros, slot_of

NO_HISTORY = "No recent telemetry data available for this device."
NO_INCIDENTS = "No relevant historical incidents found in the knowledge base."


def context_join(anomalies: DataFrame, readings: DataFrame, minutes: int = 30) -> DataFrame:
    """Every reading of the anomaly's device in the ``minutes`` up to the detection.

    This is what the live system sees when it diagnoses.  A time slot is part of the join key, so
    the join is an equi-join on (device, slot).  For prompts use :func:`recent_readings`, which
    returns a bounded number of rows per anomaly and can leave the end open.
    """
    width = minutes * 60 * MICROS
    at = micros("detected_at")
    left = anomalies.select(
        "anomaly_id",
        "device_id",
        at.alias("_at"),
        F.explode(F.array(slot_of(at, width) - 1, slot_of(at, width))).alias("_slot"),
    )
    t = micros("timestamp")
    right = readings.select(
        "device_id",
        "event_id",
        "metric_type",
        "value",
        "timestamp",
        t.alias("_t"),
        slot_of(t, width).alias("_slot"),
    )
    return (
        left.join(right, ["device_id", "_slot"])
        .filter(F.col("_t").between(F.col("_at") - width, F.col("_at")))
        .drop("_at", "_t", "_slot")
    )


def recent_readings(
    anomalies: DataFrame,
    readings: DataFrame,
    minutes: int = 30,
    n: int = 20,
    upper: bool = False,
) -> DataFrame:
    """The newest ``n`` readings of each anomaly's context and the size of the whole context.

    The context starts ``minutes`` before the detection; literally it has no end, with ``upper`` it
    ends at the detection.
    """
    asked = anomalies.select("anomaly_id", "device_id", "detected_at")
    at, width = micros("detected_at"), minutes * 60 * MICROS
    day = 24 * 3600 * MICROS
    if upper:
        rows = readings.select("device_id", "event_id", "metric_type", "value", "timestamp")
        return last_in_range(
            rows, asked, ["device_id"], micros("timestamp"), "event_id", "anomaly_id", at - width, at, n, day
        )
    counted = count_since(readings, asked, ["device_id"], micros("timestamp"), at - width, day)
    found = with_newest_readings(counted, readings, minutes, n)
    return found.select(
        "anomaly_id", "in_range", F.posexplode_outer(F.reverse("newest")).alias("position", "r")
    ).withColumn("position", F.col("position") + 1)


def with_newest_readings(
    anomalies: DataFrame,
    readings: DataFrame,
    minutes: int = 30,
    n: int = 20,
    upper: bool = False,
    out: str = "newest",
) -> DataFrame:
    """Anomalies with the newest ``n`` readings of their context as an array, newest first.

    The context is that of :func:`recent_readings`; its size is not counted, so anomalies and readings
    are read once.
    """
    rows = readings.select("device_id", "event_id", "metric_type", "value", "timestamp")
    at, width = micros("detected_at"), minutes * 60 * MICROS
    t = micros("timestamp")
    if upper:
        return newest_before(rows, anomalies, ["device_id"], t, "event_id", at, width + 1, n, out)
    return newest_since(rows, anomalies, ["device_id"], t, "event_id", at - width, n, out)


def _history_text(lines: Column) -> Column:
    """Text of at most ``n`` lines in order of time."""
    body = F.concat(
        F.lit("Showing "),
        F.size(lines).cast("string"),
        F.lit(" most recent readings:\n"),
        F.array_join(lines, "\n"),
    )
    return F.when(F.size(lines) == 0, F.lit(NO_HISTORY)).otherwise(body)


def _reading_line(r: Column) -> Column:
    return F.concat(
        F.lit("  "),
        iso_utc(r["timestamp"]),
        F.lit(" | "),
        r["metric_type"],
        F.lit(": "),
        fixed(r["value"], 2),
    )


def history_text(newest: Column) -> Column:
    """``recent_telemetry`` of the array that :func:`with_newest_readings` gives."""
    return _history_text(F.transform(F.reverse(newest), _reading_line))


def format_history(recent: DataFrame) -> DataFrame:
    """``(anomaly_id, recent_telemetry)`` text of at most ``n`` lines per anomaly."""
    packed = recent.groupBy("anomaly_id").agg(
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("r").isNotNull(),
                    F.struct("position", _reading_line(F.col("r")).alias("line")),
                )
            )
        ).alias("_l")
    )
    return packed.select(
        "anomaly_id",
        _history_text(F.transform("_l", lambda x: x["line"])).alias("recent_telemetry"),
    )


def dedupe_incidents(hits: DataFrame, query_id: str = "anomaly_id") -> DataFrame:
    """Best-ranked hit per (query, incident); the shown number is the rank before this step."""
    best = Window.partitionBy(query_id, "incident_id").orderBy("rank")
    return (
        hits.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") == 1).drop("_rn")
    )


def format_incidents(hits: DataFrame, query_id: str = "anomaly_id") -> DataFrame:
    """``(query_id, retrieved_incidents, retrieved_ids)``; at most k sections per query."""
    section = F.concat(
        F.lit("### Incident "),
        F.col("rank").cast("string"),
        F.lit(" (ID: "),
        F.coalesce(F.col("incident_id").cast("string"), F.lit("unknown")),
        F.lit(")\n**Title:** "),
        F.coalesce("title", F.lit("Unknown incident")),
        F.lit("\n**Severity:** "),
        F.coalesce("severity", F.lit("unknown")),
        F.lit(" | **Category:** "),
        F.coalesce("failure_category", F.lit("unknown")),
        F.lit("\n\n"),
        F.col("document"),
    )
    packed = (
        dedupe_incidents(hits, query_id)
        .groupBy(query_id)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "rank",
                        F.col("incident_id").cast("string").alias("id"),
                        section.alias("section"),
                    )
                )
            ).alias("_s")
        )
    )
    return packed.select(
        query_id,
        F.array_join(F.transform("_s", lambda x: x["section"]), "\n\n---\n\n").alias(
            "retrieved_incidents"
        ),
        F.transform("_s", lambda x: x["id"]).alias("retrieved_ids"),
    )


def build_prompts(
    anomalies: DataFrame,
    history: DataFrame | None,
    incidents: DataFrame | None,
    cfg: DiagnosisConfig = DiagnosisConfig(),
) -> DataFrame:
    """System and user prompt per anomaly.

    Without ``history`` (``incidents``) the anomalies carry the columns that it would bring.
    """
    rng = F.col("expected_range")
    joined = anomalies
    for texts in (history, incidents):
        if texts is not None:
            joined = joined.join(texts, "anomaly_id", "left")
    fields = {
        "anomaly_id": F.col("anomaly_id"),
        "device_id": F.col("device_id"),
        "device_type": F.col("device_type"),
        "device_location": F.col("device_location"),
        "metric_type": F.col("metric_type"),
        "observed_value": F.col("observed_value"),
        "z_score": fixed(F.col("z_score"), 2),
        "severity": F.col("severity"),
        "detected_at": iso_utc(F.col("detected_at")),
        "expected_mean": rng["mean"],
        "expected_stddev": rng["stddev"],
        "expected_lower": rng["lower"],
        "expected_upper": rng["upper"],
        "window_count": rng["window_count"],
        "context_window_minutes": F.lit(cfg.context_minutes),
        "recent_telemetry": F.coalesce("recent_telemetry", F.lit(NO_HISTORY)),
        "retrieval_k": F.lit(cfg.top_k),
        "retrieved_incidents": F.coalesce("retrieved_incidents", F.lit(NO_INCIDENTS)),
    }
    return joined.select(
        "anomaly_id",
        F.lit(SYSTEM_PROMPT).alias("system_prompt"),
        fill(USER_PROMPT, fields).alias("user_prompt"),
        F.coalesce("retrieved_ids", F.array().cast("array<string>")).alias("retrieved_ids"),
    )


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def normalise_diagnoses(df: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Model answer text -> diagnosis columns.

    Code fences are dropped with their first and last line.  Text that is not a JSON object gives a
    fallback record; missing lists become empty, a missing summary ''; a numeric confidence is
    clamped to [0, 1], true and false are 1 and 0, and anything else becomes 0.1.  A text where a list
    belongs is a list of that text.
    """
    text = strip(F.col(raw))
    rows = F.split(text, "\n")
    inner = F.when(
        F.size(rows) > 2, F.array_join(F.slice(rows, F.lit(2), F.size(rows) - 2), "\n")
    ).otherwise(F.lit(""))
    text = F.when(text.startswith("```"), strip(inner)).otherwise(text)
    none = F.array().cast("array<string>")

    def texts(path: str) -> Column:
        given = F.try_variant_get("_doc", path, "variant")
        alone = F.when(
            F.schema_of_variant(given) == "STRING",
            F.array(F.try_variant_get("_doc", path, "string")),
        )
        return F.coalesce(alone, F.try_variant_get("_doc", path, "array<string>"), none)

    parsed = (
        df.withColumn("_text", text)
        # Behind a generator the text is parsed once, however many columns read the result.
        .select("*", F.explode(F.array(F.try_parse_json("_text"))).alias("_doc"))
        .withColumn(
            "parsed_ok",
            F.col("_doc").isNotNull()
            & F.coalesce(F.schema_of_variant("_doc").startswith("OBJECT"), F.lit(False)),
        )
        .withColumn("_kind", F.schema_of_variant(F.try_variant_get("_doc", "$.confidence_score", "variant")))
    )
    ok = F.col("parsed_ok")
    truth = F.try_variant_get("_doc", "$.confidence_score", "boolean").cast("double")
    number = F.when(F.col("_kind") == "BOOLEAN", truth).otherwise(
        F.try_variant_get("_doc", "$.confidence_score", "double")
    )
    numeric = F.col("_kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")
    return (
        parsed.withColumn(
            "root_cause_summary",
            F.when(
                ok,
                F.coalesce(F.try_variant_get("_doc", "$.root_cause_summary", "string"), F.lit("")),
            ).otherwise(
                F.concat(
                    F.lit("Unable to parse structured diagnosis. Raw response: "),
                    F.substring("_text", 1, 200),
                )
            ),
        )
        .withColumn(
            "confidence_score",
            F.when(
                ok & F.coalesce(numeric, F.lit(False)),
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)),
            ).otherwise(F.lit(0.1)),
        )
        .withColumn(
            "supporting_evidence",
            F.when(ok, texts("$.supporting_evidence")).otherwise(
                F.array(F.lit("LLM response parsing failed"))
            ),
        )
        .withColumn(
            "recommended_actions",
            F.when(ok, texts("$.recommended_actions")).otherwise(
                F.array(
                    F.lit("Review raw LLM response manually"),
                    F.lit("Check prompt template formatting"),
                )
            ),
        )
        .withColumn(
            "retrieved_incident_ids",
            F.when(ok, texts("$.retrieved_incident_ids")).otherwise(none),
        )
        .drop("_text", "_doc", "_kind")
    )
