import datetime as dt

import pytest
from pyspark.sql import functions as F

from devicelens.operators import dead_letters as dl
from devicelens.operators import enrichment as en
from devicelens.operators import validation as va

UUID = "00000000-0000-0000-0000-000000000001"
TS = "2026-06-28T00:00:00Z"
GOOD = f'{{"device_id": "{UUID}", "metric_type": "temperature", "value": 50, "timestamp": "{TS}"}}'

PAYLOADS = {
    '{"bad": "no device_id field"}': "missing_device_id",
    '{"device_id": "not-a-uuid", "metric_type": "temperature", "value": 50}': "missing_timestamp",
    f'{{"device_id": "not-a-uuid", "metric_type": "t", "value": 50, "timestamp": "{TS}"}}': "invalid_device_id",
    "completely invalid json {{{{": "invalid_json",
    "": "invalid_json",
    '{"device_id": null}': "missing_device_id",
    "42": "not_an_object",
    '[1, 2]': "not_an_object",
    f'{{"device_id": "{UUID}", "value": "not_a_number"}}': "missing_metric_type",
    f'{{"device_id": "{UUID}", "metric_type": "t", "value": "abc", "timestamp": "{TS}"}}': "invalid_value",
    f'{{"device_id": "{UUID}", "metric_type": "temperature", "value": "NaN"}}': "missing_timestamp",
    f'{{"device_id": "{UUID}", "metric_type": "t", "value": 1, "timestamp": "soon"}}': "invalid_timestamp",
    f'{{"device_id": "{UUID}", "metric_type": "t", "value": 1, "timestamp": "{TS}", "metadata": 3}}': "invalid_metadata",
    GOOD: None,
    GOOD.replace("50", '"50"'): None,
    GOOD.replace("temperature", "invalid_metric"): None,
    GOOD.replace("50", '"NaN"'): None,
    GOOD.replace("}", ', "metadata": {"a": "b"}}'): None,
    GOOD.replace(f'"{TS}"', "1782604800"): None,
}


def test_raw_payloads(spark):
    df = spark.createDataFrame([(p,) for p in PAYLOADS], "payload STRING")
    got = {x["payload"]: x for x in va.check_raw(df).collect()}
    assert {p: got[p]["reason"] for p in PAYLOADS} == PAYLOADS
    assert got[GOOD.replace("50", '"50"')]["value"] == 50.0
    assert got[GOOD.replace(f'"{TS}"', "1782604800")]["timestamp"] == got[GOOD]["timestamp"]
    good, bad = va.validate_raw(df)
    assert good.count() + bad.count() == len(PAYLOADS)
    assert good.filter(F.size("metadata") == 1).count() == 1


def accept(spark, metric, value):
    df = spark.createDataFrame([(metric, value)], "metric_type STRING, value DOUBLE")
    return va.validate_accept(df)[0].count() == 1


@pytest.mark.parametrize(
    "metric,value,ok",
    [
        ("temperature", 20.0, True),
        ("temperature", -40.0, True),
        ("humidity", 0.0, True),
        ("wind", 1.0, False),
        ("x" * 101, 1.0, False),
        ("pressure", float("nan"), False),
        ("pressure", float("inf"), False),
        ("cpu_usage", float("-inf"), False),
        ("cpu_usage", None, False),
    ],
)
def test_accept_time_check(spark, metric, value, ok):
    assert accept(spark, metric, value) is ok


def test_device_and_incident_limits(spark):
    devices = spark.createDataFrame(
        [("a" * 255, "t", None, None), ("a" * 256, "t", None, None), ("", "t", None, None),
         ("a", "t" * 101, None, None), ("a", "t", "l" * 256, None), ("a", "t", "l", "f" * 51)],
        "device_name STRING, device_type STRING, location STRING, firmware_version STRING",
    )
    assert va.validate_devices(devices)[0].count() == 1
    base = ("t", "d" * 10, ["x"], "r" * 10, ["s"], "high", "c")
    rows = [base]
    for i, worse in enumerate(("", "short", [], "short", [], "urgent", "")):
        rows.append(base[:i] + (worse,) + base[i + 1 :])
    incidents = spark.createDataFrame(
        rows,
        "title STRING, description STRING, affected_device_types ARRAY<STRING>, root_cause STRING, "
        "resolution_steps ARRAY<STRING>, severity STRING, failure_category STRING",
    )
    good, bad = va.validate_incidents(incidents)
    assert good.count() == 1 and bad.count() == 7


def test_unknown_devices_dead_letters_and_reconciliation(spark):
    t = dt.datetime(2024, 1, 1)
    sent = spark.createDataFrame(
        [("a", "p1", t), ("b", "p2", t), ("z", "p3", t)], "device_id STRING, payload STRING, timestamp TIMESTAMP"
    )
    devices = spark.createDataFrame(
        [("a", "t", "", ""), ("b", "t", "here", "v1")],
        "device_id STRING, device_type STRING, location STRING, firmware_version STRING",
    )
    known, unknown = en.split_unknown_devices(sent, devices)
    assert known.count() == 2 and unknown.first()["device_id"] == "z"
    row = en.enrich(sent, devices).filter("device_id = 'a'").first()
    assert row["device_location"] is None and row["firmware_version"] is None
    dead = dl.to_dlq(unknown, "device_not_found", detail=None)
    assert dead.first()["error_reason"] == "Device z not found during enrichment"
    assert dl.dlq_by_reason(dead).first()["n"] == 1
    report = dl.reconcile(sent, known, dead).first()
    assert (report["sent"], report["persisted"], report["dlq"], report["drop_rate"]) == (3, 2, 1, 0.0)
    lost = dl.reconcile(sent, known, dead.limit(0)).first()
    assert lost["drop_rate"] == pytest.approx(1 / 3)


def test_stored_payload_and_event_ids(spark):
    df = spark.createDataFrame([("{\"a\": 1}",), ("oops",)], "p STRING")
    got = [x[0] for x in df.select(dl.stored_payload(F.col("p"))).collect()]
    assert got == ['{"a": 1}', '{"raw":"oops"}']
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [("d", "m", 1.0, t, 1), ("d", "m", 1.0, t, 2)],
        "device_id STRING, metric_type STRING, value DOUBLE, timestamp TIMESTAMP, offset INT",
    )
    assert va.with_event_id(rows).select("event_id").distinct().count() == 1
    assert va.with_event_id(rows, "offset").select("event_id").distinct().count() == 2


def test_alert_states(spark):
    rows = [("firing", "critical"), ("resolved", "unknown"), ("pending", "critical"), ("firing", "low")]
    df = spark.createDataFrame(rows, "status STRING, severity STRING")
    good, bad = va.validate_alerts(df)
    assert good.count() == 2
    assert sorted(x["reason"] for x in bad.collect()) == ["invalid_severity", "invalid_status"]
