"""Triage texts of critical alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelens.fixed_values import GENERIC_TRIAGE, PLATFORM_ALERTS, PRODUCT_ALERTS, TRIAGE_TEMPLATES
from devicelens.functions.asof import newest_before
from devicelens.functions.text import fill, numbered
from devicelens.functions.times import MICROS, micros


def triage_candidates(alerts: DataFrame, enabled: bool = True) -> DataFrame:
    """New, firing, critical alerts (none when triage is switched off)."""
    return alerts.filter(
        F.lit(enabled)
        & F.col("is_new")
        & (F.col("status") == "firing")
        & (F.col("severity") == "critical")
    )


def triage_strategy(alerts: DataFrame) -> DataFrame:
    """'diagnoses' (then template if there are none) or 'template'."""
    name, tier = F.col("alert_name"), F.col("tier")
    product = name.isin(*PRODUCT_ALERTS) | (tier == "product")
    platform = name.isin(*PLATFORM_ALERTS) | (tier == "platform")
    return alerts.withColumn(
        "strategy",
        F.when(product, "diagnoses").when(platform, "template").otherwise("diagnoses"),
    )


def _template_text(
    name: Column, summary: Column, pipeline: Column, template: dict, containers: str
) -> Column:
    values = {"pipe": pipeline, "prefix": F.lit(containers)}
    return F.concat_ws(
        "\n",
        F.concat(F.lit("TRIAGE: "), name),
        F.concat(F.lit("Alert: "), summary),
        F.lit(""),
        F.lit("--- Likely Root Cause ---"),
        fill(template["root_cause"], values),
        F.lit(""),
        F.lit("--- Investigation Steps ---"),
        numbered(F.array(*[fill(s, values) for s in template["investigation"]])),
        F.lit(""),
        F.lit("--- Blast Radius ---"),
        fill(template["blast_radius"], values),
        F.lit(""),
        F.lit("--- Immediate Actions ---"),
        numbered(F.array(*[fill(s, values) for s in template["actions"]])),
    )


def template_triage(alerts: DataFrame, containers: str = "") -> DataFrame:
    """Rule-based text from the template of the alert name, or the generic one.

    The templates are a handful of constants, so the lookup is a ``CASE`` inside the projection.
    ``containers`` is the name prefix of the deployment's containers.
    """
    name = F.coalesce("alert_name", F.lit("unknown"))
    pipeline = F.coalesce("pipeline", F.lit("unknown"))
    summary = F.coalesce("summary", F.lit("No summary available"))
    text = fill(GENERIC_TRIAGE, {"name": name, "summary": summary, "pipe": pipeline})
    for alert_name, template in TRIAGE_TEMPLATES.items():
        text = F.when(
            name == alert_name, _template_text(name, summary, pipeline, template, containers)
        ).otherwise(text)
    return alerts.withColumn("template_text", text)


def with_recent_diagnoses(
    alerts: DataFrame,
    diagnoses: DataFrame,
    anomalies: DataFrame | None = None,
    minutes: int = 30,
    n: int = 10,
    out: str = "recent",
) -> DataFrame:
    """Alerts with the ``n`` newest critical/high diagnoses of the ``minutes`` before, newest first.

    Without ``anomalies`` the diagnoses themselves carry severity, device_id and detected_at.
    """
    if anomalies is not None:
        diagnoses = diagnoses.join(
            anomalies.select("anomaly_id", "severity", "device_id", "detected_at"), "anomaly_id"
        )
    return newest_before(
        diagnoses.filter(F.col("severity").isin("critical", "high")),
        alerts,
        [],
        micros("detected_at"),
        "anomaly_id",
        micros("received_at"),
        minutes * 60 * MICROS,
        n,
        out,
    )


def recent_diagnoses(
    alerts: DataFrame,
    diagnoses: DataFrame,
    anomalies: DataFrame | None,
    alert_id: str,
    minutes: int = 30,
    n: int = 10,
) -> DataFrame:
    """``(alert_id, position, r)``: one row per recent severe diagnosis, position 1 the newest."""
    found = with_recent_diagnoses(alerts, diagnoses, anomalies, minutes, n)
    return found.select(alert_id, F.posexplode("recent").alias("position", "r")).withColumn(
        "position", F.col("position") + 1
    )


def _diagnosis_text(rows: Column, minutes: int) -> Column:
    """Summary of an alert's diagnoses (newest first, a small array); NULL if there are none."""
    first_of_cause = F.filter(
        rows,
        lambda x, i: ~F.exists(
            F.slice(rows, F.lit(1), i),
            lambda y: y["root_cause_summary"] == x["root_cause_summary"],
        ),
    )
    causes = F.transform(
        first_of_cause,
        lambda x: F.concat(
            F.lit("• ["),
            F.upper(x["severity"]),
            F.lit("] "),
            x["root_cause_summary"],
            F.lit(" (confidence: "),
            F.bround(x["confidence_score"] * 100, 0).cast("bigint").cast("string"),
            F.lit("%)"),
        ),
    )
    devices = F.size(F.array_distinct(F.transform(rows, lambda x: x["device_id"])))
    actions = F.slice(
        F.array_distinct(F.flatten(F.transform(rows, lambda x: x["recommended_actions"]))),
        1,
        5,
    )
    count = F.size(rows).cast("string")
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("TRIAGE SUMMARY (from "), count, F.lit(" recent diagnosis(es))")),
        F.concat(F.lit("Alert: "), F.coalesce("alert_name", F.lit("unknown"))),
        F.lit(f"Source: Existing Diagnosis Service output (last {minutes} minutes)"),
        F.lit(""),
        F.lit("--- Root Causes Identified ---"),
        F.array_join(causes, "\n"),
        F.lit(""),
        F.lit("--- Blast Radius ---"),
        F.concat(F.lit("• Devices affected: "), devices.cast("string")),
        F.concat(F.lit(f"• Anomalies in last {minutes}min: "), count),
        F.when(
            F.size(actions) > 0,
            F.concat(
                F.lit("\n--- Recommended Actions (from diagnoses) ---\n"), numbered(actions)
            ),
        ),
    )
    return F.when(F.size(rows) > 0, body)


def diagnosis_triage(
    alerts: DataFrame,
    diagnoses: DataFrame,
    anomalies: DataFrame | None,
    alert_id: str,
    minutes: int = 30,
    n: int = 10,
) -> DataFrame:
    """``(alert_id, diagnosis_text)``; NULL text where no diagnosis is recent enough."""
    found = with_recent_diagnoses(alerts, diagnoses, anomalies, minutes, n)
    return found.select(alert_id, _diagnosis_text(F.col("recent"), minutes).alias("diagnosis_text"))


def triage(
    alerts: DataFrame,
    diagnoses: DataFrame,
    anomalies: DataFrame | None,
    containers: str = "",
    minutes: int = 30,
    n: int = 10,
) -> DataFrame:
    """Alerts with ``strategy`` and ``triage_summary``, the text their strategy asks for."""
    chosen = template_triage(triage_strategy(alerts), containers)
    found = with_recent_diagnoses(chosen, diagnoses, anomalies, minutes, n, "_recent")
    by_diagnoses = F.when(
        F.col("strategy") == "diagnoses", _diagnosis_text(F.col("_recent"), minutes)
    )
    return found.withColumn("triage_summary", F.coalesce(by_diagnoses, "template_text")).drop(
        "_recent", "template_text"
    )


def with_triage(alerts: DataFrame, summaries: DataFrame, alert_id: str) -> DataFrame:
    """Alerts with their stored triage, 'none' where there is none."""
    return alerts.join(
        summaries.select(alert_id, "triage_summary"), alert_id, "left"
    ).withColumn(
        "triage_status",
        F.when(F.coalesce("triage_summary", F.lit("")) == "", "none").otherwise("available"),
    )
