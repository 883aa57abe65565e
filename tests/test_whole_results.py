"""Nothing is lost or cut silently: NULL keys and values, limits, unreadable bodies, ties."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from devicelens.functions.asof import last_in_range
from devicelens.functions.scans import with_previous, with_running_sum
from devicelens.functions.times import duration_col, duration_seconds, micros
from devicelens.operators import knowledge as kb
from devicelens.operators import lookups as lo
from devicelens.operators import monitors as mo
from devicelens.operators import rolling as ro
from devicelens.operators import series as se
from devicelens.operators.diagnosis import normalise_diagnoses
from devicelens.sources.webhooks import explode_webhooks, webhook_rejects
from devicelens.streaming.lateness import delay_classes

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_scans_keep_null_keys(spark):
    rows = [(None, 1, 1.0), (None, 2, 2.0), ("a", 1, 4.0), ("a", 300, 8.0), (None, 300, 16.0)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    segment = F.floor(F.col("t") / 100)
    sums = with_running_sum(df, ["k"], ["t"], F.col("v"), segment, "s").collect()
    assert {(r.k, r.t): r.s for r in sums} == {
        (None, 1): 1.0, (None, 2): 3.0, (None, 300): 19.0, ("a", 1): 4.0, ("a", 300): 12.0,
    }
    before = with_previous(df, ["k"], ["t"], F.col("v"), segment, "p").collect()
    assert {(r.k, r.t): r.p for r in before} == {
        (None, 1): None, (None, 2): 1.0, (None, 300): 2.0, ("a", 1): None, ("a", 300): 4.0,
    }
    alone = with_running_sum(df, [], ["t", "v"], F.col("v"), segment, "s").collect()
    assert max(r.s for r in alone) == 31.0 and len(alone) == 5


def test_last_in_range_keeps_null_keys_and_typed_order(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "a", at(5)) for i in range(8, 12)], "id long, k string, t timestamp")
    probes = spark.createDataFrame([(1, None, at(0)), (2, "a", at(0)), (3, "b", at(0))], "p long, k string, t timestamp")
    found = last_in_range(
        rows, probes, ["k"], micros("t"), "id", "p", micros("t"), micros("t") + 10_000_000, 1, 60_000_000
    ).collect()
    got = {r.p: (r.in_range, r.r and r.r.id) for r in found}
    # 9 and 11 (8 and 10) share a time; the larger number is the last one, though '9' > '11' as text.
    assert got == {1: (2, 11), 2: (2, 10), 3: (0, None)}


@pytest.mark.parametrize("method", ["slots", "frame", "plain"])
def test_dedupe_keeps_nulls_and_counts_copies_once(spark, method):
    rows = [(None, at(0), 1.0), ("d", at(0), None), ("d", at(1), 3.0), ("d", at(1), 3.0), ("d", at(2), 5.0), (None, at(0), 1.0)]
    df = spark.createDataFrame(rows, "device_id string, timestamp timestamp, value double")
    found = ro.rolling_stats(df, ["device_id"], dedupe=True, method=method).collect()
    assert len(found) == len(rows)
    by = {(r.device_id, r.timestamp.second, r.value): (r.window_count, r.mean) for r in found}
    assert by == {
        (None, 0, 1.0): (1, 1.0), ("d", 0, None): (0, None), ("d", 1, 3.0): (1, 3.0), ("d", 2, 5.0): (2, 4.0),
    }


def test_lateness_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1, at(0)), (None, 200, at(-5)), ("a", 2, at(9))], "k string, n long, timestamp timestamp")
    found = delay_classes(df, ["k"], "n", segment=100).collect()
    assert {(r.k, r.n): r.bucket for r in found} == {(None, 1): "newest", (None, 200): "behind", ("a", 2): "newest"}


def test_missing_labels_match(spark):
    left = spark.createDataFrame([(at(0), None, 1.0), (at(0), "x", 2.0)], "ts timestamp, job string, value double")
    right = spark.createDataFrame([(at(0), None, 10.0), (at(0), "y", 20.0)], "ts timestamp, job string, value double")
    assert [(r.job, r.value) for r in se.add(left, right, ["job"]).collect()] == [(None, 11.0)]
    assert [r.job for r in se.v_and(left, right, ["job"]).collect()] == [None]
    assert sorted(str(r.job) for r in se.v_or(left, right, ["job"]).collect()) == ["None", "x", "y"]


def test_instant_equals_the_definition(spark):
    times = [0, 3, 14, 15, 16, 47, 400]
    df = spark.createDataFrame([("j", at(t), float(t)) for t in times], "job string, ts timestamp, value double")
    got = {int((r.ts - T0).total_seconds()): r.value for r in se.instant(df, ["job"], 15, 60).collect()}
    want = {}
    for tick in range(0, 600, 15):
        seen = [t for t in times if tick - 60 < t <= tick]
        if seen:
            want[tick] = float(max(seen))
    assert got == want


def test_limits_are_kept_or_refused(spark):
    df = spark.createDataFrame([(i, at(i)) for i in range(1500)], "event_id long, failed_at timestamp")
    assert lo.query_dlq(df, limit=None).count() == 1500
    assert lo.query_dlq(df, limit=1200, offset=100).count() == 1200
    for bad in (dict(limit=0), dict(limit=11, max_limit=10), dict(limit=5, offset=-1)):
        with pytest.raises(ValueError):
            lo.query_dlq(df, **bad)


def test_null_status_is_rejected(spark):
    anomalies = spark.createDataFrame([(1, "open")], "anomaly_id long, status string")
    updates = spark.createDataFrame([(1, "acknowledged", 1), (1, None, 2)], "anomaly_id long, new_status string, updated_at int")
    updated, rejected = lo.apply_status_updates(anomalies, updates)
    assert updated.first().status == "acknowledged"
    assert [r.reason for r in rejected.collect()] == ["invalid_status"]


def test_every_webhook_body_is_accounted_for(spark):
    good = json.dumps({"receiver": "r", "status": "firing", "alerts": [{"status": "firing", "labels": {"a": "b"}}] * 2})
    bodies = [good, "no json", '{"alerts": []}', '{"alerts": 3}', "[1]", None, ""]
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, payload string")
    taken = {r.n for r in explode_webhooks(df).collect()}
    rejects = {r.n: r.error_type for r in webhook_rejects(df).collect()}
    assert taken == {0} and explode_webhooks(df).count() == 2
    assert rejects == {1: "invalid_json", 2: "no_alerts", 3: "invalid_body", 4: "invalid_body", 5: "invalid_json", 6: "invalid_json"}


def test_durations_of_several_units(spark):
    texts = ["5m", "1h30m", "500ms", "1500ms", "1d", "2w3s", "1y", "", "5", "m", "5m ", "1h30", "90x", "999999999999999999999s"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", duration_col(F.col("t")).alias("s")).collect()
    for r in got:
        try:
            want = duration_seconds(r.t)
        except ValueError:
            want = None
        assert r.s == (None if want is not None and want > 2**62 else want), r.t
    schema = "name string, expr string, duration string, severity string, pipeline string, summary string, description string, enabled boolean, created_at int"
    monitors = spark.createDataFrame(
        [("a", "e", "1h30m", "w", "p", "s", "d", True, 1), ("b", "e", "soon", "w", "p", "s", "d", True, 2), ("c", "e", "x", "w", "p", "s", "d", False, 3)],
        schema,
    )
    assert [(r.alert_name, r.for_s) for r in mo.monitors_to_rules(monitors).collect()] == [("a", 5400)]
    assert [r.name for r in mo.monitor_rejects(monitors).collect()] == ["b"]


def test_answers_of_odd_types(spark):
    answers = [
        '{"confidence_score": true, "supporting_evidence": "one line"}',
        '{"confidence_score": false, "supporting_evidence": ["a", "b"]}',
        '{"confidence_score": "high", "supporting_evidence": 3}',
        '{"confidence_score": 7}',
    ]
    df = spark.createDataFrame(list(enumerate(answers)), "n int, raw_response string")
    got = {r.n: (r.confidence_score, r.supporting_evidence) for r in normalise_diagnoses(df).collect()}
    assert got[0] == (1.0, ["one line"]) and got[1] == (0.0, ["a", "b"])
    assert got[2][0] == 0.1 and got[3] == (1.0, [])


def test_topk_returns_exactly_k_whatever_the_ties(spark):
    same = [[1.0, 0.0]] * 60 + [[0.0, 0.0]] * 20
    chunks = spark.createDataFrame(list(enumerate(same)), "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], "query_id long, embedding array<double>")
    near = kb.cosine_topk(queries, chunks, 5, chunk_block=16).collect()
    got = {q: sorted(r.chunk_id for r in near if r.query_id == q) for q in (1, 2, 3)}
    assert got == {q: [0, 1, 2, 3, 4] for q in (1, 2, 3)}


def test_cells_return_k_rows_per_query():
    import numpy as np
    import pandas as pd

    top = kb._nearest(5, 64)
    zero = [np.zeros(4)] * 3
    cell = top(
        pd.DataFrame({"id": [1, 2, 3], "v": zero}), pd.DataFrame({"id": range(500), "v": [np.ones(4)] * 500})
    )
    assert len(cell) == 15 and sorted(set(cell["chunk_id"])) == [0, 1, 2, 3, 4]
