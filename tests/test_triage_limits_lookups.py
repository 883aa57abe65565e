import datetime as dt

import pytest
from pyspark.sql import functions as F

from devicelens.config import RateLimits
from devicelens.fixed_values import PLATFORM_ALERTS, PRODUCT_ALERTS
from devicelens.functions.scans import with_previous, with_running_sum
from devicelens.operators import lookups as lo
from devicelens.operators import triage as tr
from devicelens.operators.limits import rate_limit_checks

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def alerts(spark, rows):
    return spark.createDataFrame(
        rows,
        "id INT, alert_name STRING, tier STRING, pipeline STRING, summary STRING, severity STRING, "
        "status STRING, is_new BOOLEAN, received_at TIMESTAMP",
    )


def one(spark, name, tier="platform", **kw):
    row = dict(id=1, alert_name=name, tier=tier, pipeline="ingestion", summary="S", severity="critical",
               status="firing", is_new=True, received_at=at(1800))
    row.update(kw)
    return alerts(spark, [tuple(row.values())])


def test_candidates(spark):
    base = one(spark, "ServiceDown")
    assert tr.triage_candidates(base).count() == 1
    assert tr.triage_candidates(base, enabled=False).count() == 0
    for change in ({"severity": "warning"}, {"status": "resolved"}, {"is_new": False}):
        assert tr.triage_candidates(one(spark, "ServiceDown", **change)).count() == 0


def test_strategy(spark):
    assert not set(PLATFORM_ALERTS) & set(PRODUCT_ALERTS)

    def strategy(name, tier):
        return tr.triage_strategy(one(spark, name, tier)).first()["strategy"]

    assert strategy("CriticalAnomalyBurst", "platform") == "diagnoses"
    assert strategy("Other", "product") == "diagnoses"
    assert strategy("ServiceDown", "unknown") == "template"
    assert strategy("Other", "platform") == "template"
    assert strategy("Other", "unknown") == "diagnoses"


def test_templates(spark):
    text = tr.template_triage(one(spark, "ServiceDown"), "box-").first()["template_text"]
    assert text.startswith("TRIAGE: ServiceDown\nAlert: S\n\n--- Likely Root Cause ---\nThe ingestion service")
    assert "1. Check container/pod status: docker ps | grep ingestion" in text
    assert "docker logs box-{pipeline}" in text
    generic = tr.template_triage(one(spark, "AlertReceiverDown")).first()["template_text"]
    assert "Pipeline: ingestion" in generic and "3. Escalate if not resolved within 15 minutes" in generic


def test_diagnosis_summary(spark):
    anomalies = spark.createDataFrame(
        [(i, "critical" if i % 2 else "high", f"d{i % 3}", at(60 * i)) for i in range(40)] + [(99, "low", "d9", at(1790))],
        "anomaly_id INT, severity STRING, device_id STRING, detected_at TIMESTAMP",
    )
    diagnoses = anomalies.select(
        "anomaly_id",
        F.concat(F.lit("cause "), (F.col("anomaly_id") % 2).cast("string")).alias("root_cause_summary"),
        F.lit(0.875).alias("confidence_score"),
        F.array(
            F.lit("same"), F.concat(F.lit("act "), F.col("anomaly_id").cast("string"))
        ).alias("recommended_actions"),
    )
    text = tr.diagnosis_triage(one(spark, "CriticalAnomalyBurst"), diagnoses, anomalies, "id").first()["diagnosis_text"]
    # Alert at minute 30: anomalies 21 .. 30 are the ten newest, newest first.
    assert text.split("\n") == [
        "TRIAGE SUMMARY (from 10 recent diagnosis(es))",
        "Alert: CriticalAnomalyBurst",
        "Source: Existing Diagnosis Service output (last 30 minutes)",
        "",
        "--- Root Causes Identified ---",
        "• [HIGH] cause 0 (confidence: 88%)",
        "• [CRITICAL] cause 1 (confidence: 88%)",
        "",
        "--- Blast Radius ---",
        "• Devices affected: 3",
        "• Anomalies in last 30min: 10",
        "",
        "--- Recommended Actions (from diagnoses) ---",
        "1. same",
        "2. act 30",
        "3. act 29",
        "4. act 28",
        "5. act 27",
    ]
    late = one(spark, "CriticalAnomalyBurst", received_at=at(100_000))
    assert tr.diagnosis_triage(late, diagnoses, anomalies, "id").first()["diagnosis_text"] is None
    fallback = tr.triage(late, diagnoses, anomalies).first()["triage_summary"]
    assert fallback.startswith("TRIAGE: CriticalAnomalyBurst")


def test_limits(spark):
    def checks(seconds, limit=3):
        rows = [(i, "u", "query", at(s)) for i, s in enumerate(seconds)]
        df = spark.createDataFrame(rows, "id INT, user STRING, bucket STRING, timestamp TIMESTAMP")
        cfg = RateLimits(limits={"ingestion": 1000, "query": limit})
        return {x["id"]: x for x in rate_limit_checks(df, cfg).collect()}

    got = checks([0, 10, 20, 30, 59, 60, 200])
    assert [got[i]["limited"] for i in range(7)] == [False, False, False, True, True, True, False]
    # The request at 0 has left at 60; refused requests still count.
    assert [got[i]["requests"] for i in range(7)] == [1, 2, 3, 4, 5, 5, 1]
    assert got[3]["retry_after"] == 30 and got[4]["retry_after"] == 1 and got[6]["retry_after"] is None
    other = RateLimits()
    df = spark.createDataFrame([("u", "else", at(0))], "user STRING, bucket STRING, timestamp TIMESTAMP")
    assert rate_limit_checks(df, other).first()["max_requests"] == 100


def test_segmented_scans_equal_plain_windows(spark):
    rows = [(k, i, (i * 13) % 7 if (i + k) % 5 else None) for k in range(3) for i in range(100)]
    df = spark.createDataFrame(rows, "k INT, i INT, v INT")
    for width in (1, 7, 1000):
        segment = F.floor(F.col("i") / width).cast("bigint")
        prev = with_previous(df, ["k"], ["i"], F.col("v"), segment, "p")
        runs = with_running_sum(df, ["k"], ["i"], F.coalesce("v", F.lit(0)), segment, "s")
        p = {(x["k"], x["i"]): x["p"] for x in prev.collect()}
        s = {(x["k"], x["i"]): x["s"] for x in runs.collect()}
        total = {}
        for k, i, v in rows:
            before = [x for x in rows if x[0] == k and x[1] == i - 1]
            assert p[k, i] == (before[0][2] if before else None), (width, k, i)
            total[k] = total.get(k, 0) + (v or 0)
            assert s[k, i] == total[k]


def test_lookups(spark):
    df = spark.createDataFrame(
        [(i, "a" if i % 2 else "b", at(i)) for i in range(50)], "event_id INT, metric_type STRING, timestamp TIMESTAMP"
    ).withColumn("device_id", F.lit(1))
    got = lo.query_telemetry(df, metric_type="a", start="2024-01-01 00:00:05", end="2024-01-01 00:00:15", limit=3, offset=1)
    assert [x["event_id"] for x in got.collect()] == [11, 9, 7]
    # A limit out of range is refused now; it used to become 1 without a word.
    with pytest.raises(ValueError):
        lo.query_telemetry(df, limit=0)
    top = lo.top_per_key(df, "metric_type", "timestamp", "event_id", 2).collect()
    assert sorted((x["event_id"], x["rank"], x["total"]) for x in top) == [(46, 2, 25), (47, 2, 25), (48, 1, 25), (49, 1, 25)]


def test_status_updates(spark):
    base = spark.createDataFrame([(1, "open"), (2, "open")], "anomaly_id INT, status STRING")
    updates = spark.createDataFrame(
        [(1, "acknowledged", 1), (1, "resolved", 3), (1, "closed", 9), (7, "open", 1)],
        "anomaly_id INT, new_status STRING, updated_at INT",
    )
    updated, rejected = lo.apply_status_updates(base, updates)
    assert {tuple(x) for x in updated.select("anomaly_id", "status").collect()} == {(1, "resolved"), (2, "open")}
    assert {(x["new_status"], x["reason"]) for x in rejected.collect()} == {
        ("closed", "invalid_status"), ("open", "not_found")
    }


def test_diagnosis_status(spark):
    a = spark.createDataFrame([(1,), (2,)], "anomaly_id INT")
    d = spark.createDataFrame(
        [(1, "x", "old", 0.1, at(0)), (1, "y", "new", 0.2, at(5))],
        "anomaly_id INT, diagnosis_id STRING, root_cause_summary STRING, confidence_score DOUBLE, generated_at TIMESTAMP",
    )
    got = {x["anomaly_id"]: (x["diagnosis_status"], x["root_cause_summary"]) for x in lo.diagnosis_status(a, d).collect()}
    assert got == {1: ("complete", "new"), 2: ("pending", None)}
