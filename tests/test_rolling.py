import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from devicelens.config import DEPLOYED_PROFILE, DetectorConfig
from devicelens.functions.scoring import classify, z_score
from devicelens.operators.anomalies import detect_anomalies, scored_readings
from devicelens.operators.rolling import rolling_stats

T0 = dt.datetime(2024, 1, 1)


def readings(spark, rows, device="d1", metric="temperature"):
    """rows: (seconds, value)"""
    data = [
        (i, device, metric, float(v), T0 + dt.timedelta(seconds=s)) for i, (s, v) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data, "event_id BIGINT, device_id STRING, metric_type STRING, value DOUBLE, timestamp TIMESTAMP"
    )


def brute(rows, window=300.0, dedupe=False):
    """Window statistics by definition."""
    out = {}
    for i, (t, _) in enumerate(rows):
        inside = [(s, v) for s, v in rows if t - window < s <= t]
        if dedupe:
            inside = list(set(inside))
        values = [v for _, v in inside]
        n = len(values)
        mean = sum(values) / n
        spread = math.sqrt(sum((v - mean) ** 2 for v in values) / n)
        out[i] = (n, mean, 0.0 if min(values) == max(values) else spread, min(values), max(values))
    return out


def collect(df):
    return {
        x["event_id"]: (x["window_count"], x["mean"], x["stddev"], x["min_value"], x["max_value"])
        for x in df.collect()
    }


def same(a, b, tolerance=1e-9):
    assert a.keys() == b.keys()
    for key in a:
        assert a[key][0] == b[key][0], key
        for x, y in zip(a[key][1:], b[key][1:]):
            assert x == pytest.approx(y, abs=tolerance), key


@pytest.mark.parametrize("method", ["plain", "frame", "slots"])
def test_statistics_equal_the_definition(spark, method):
    rng = random.Random(1)
    # Whole seconds on purpose: window and slot edges are hit exactly; also long gaps and ties.
    rows = [(rng.randrange(0, 4000), rng.gauss(50, 5)) for _ in range(300)]
    rows += [(20_000 + i * 30, 7.0) for i in range(40)]
    df = readings(spark, rows)
    same(collect(rolling_stats(df, method=method)), brute(rows))


@pytest.mark.parametrize("slots", [1, 2, 5, 30])
def test_slot_count_does_not_matter(spark, slots):
    rng = random.Random(2)
    rows = [(rng.uniform(0, 2000), rng.uniform(-5, 5)) for _ in range(200)]
    rows = [(round(s, 3), v) for s, v in rows]
    same(collect(rolling_stats(readings(spark, rows), slots=slots)), brute(rows))


def test_large_offset_keeps_precision(spark):
    rng = random.Random(3)
    rows = [(i * 3, 1e9 + rng.uniform(-1e-3, 1e-3)) for i in range(200)]
    got, want = collect(rolling_stats(readings(spark, rows))), brute(rows)
    for key in want:
        assert got[key][2] == pytest.approx(want[key][2], rel=1e-2, abs=1e-7)


@pytest.mark.parametrize("method", ["plain", "slots"])
def test_copies_count_once_and_are_all_scored(spark, method):
    rows = [(i * 5, 50.0 + i % 3) for i in range(20)]
    df = readings(spark, rows + rows[5:8] * 4)
    got = collect(rolling_stats(df, dedupe=True, method=method))
    assert len(got) == 32
    same(got, brute(rows + rows[5:8] * 4, dedupe=True))


def test_one_key_with_most_rows(spark):
    hot = readings(spark, [(i * 0.05, float(i % 17)) for i in range(4000)])
    cold = readings(spark, [(i * 10, 1.0 * i) for i in range(20)], device="d2").withColumn(
        "event_id", F.col("event_id") + 10_000
    )
    df = hot.unionByName(cold)
    same(
        collect(rolling_stats(df, method="slots")), collect(rolling_stats(df, method="plain")), 1e-6
    )


def test_spike_after_fifteen_normal_readings(spark):
    rows = [(i, 63.5 + (i % 7) * 0.5) for i in range(15)] + [(20, 95.0)]
    found = detect_anomalies(readings(spark, rows)).collect()
    assert [x["observed_value"] for x in found] == [95.0]
    assert 3.0 < found[0]["z_score"] <= math.sqrt(15) + 1e-9
    assert found[0]["expected_range"]["window_count"] == 16


def test_hundred_readings_three_spikes(spark):
    rng = random.Random(5)
    rows = []
    for i in range(100):
        spike = i in (40, 70, 95)
        rows.append((i * 10, 92.0 + (i % 3) * 3 if spike else 50 + rng.uniform(-2, 2)))
    found = detect_anomalies(readings(spark, rows)).filter("observed_value > 85").collect()
    assert len(found) == 3


def test_minimum_samples_and_constant_series(spark):
    assert scored_readings(readings(spark, [(i, i) for i in range(9)])).count() == 0
    assert scored_readings(readings(spark, [(i, i) for i in range(10)])).count() == 1
    constant = scored_readings(readings(spark, [(i, 0.1) for i in range(50)]))
    assert {x["z_score"] for x in constant.collect()} == {0.0}


def test_reading_exactly_one_window_old_is_outside(spark):
    got = collect(rolling_stats(readings(spark, [(0, 1.0), (300, 2.0), (300.000001, 3.0)])))
    assert [got[i][0] for i in range(3)] == [1, 1, 2]


def test_z_is_bounded_by_the_sample_count(spark):
    rng = random.Random(6)
    rows = [(i * 4, rng.choice([0.0, 1.0, 1000.0])) for i in range(300)]
    for x in scored_readings(readings(spark, rows)).collect():
        assert abs(x["z_score"]) <= math.sqrt(x["window_count"] - 1) + 1e-9


def test_z_and_severity_bounds(spark):
    row = spark.range(1).select(
        *[
            z_score(F.lit(v), F.lit(65.0), F.lit(sd)).alias(f"z{i}")
            for i, (v, sd) in enumerate([(65.0, 5.0), (70.0, 5.0), (87.5, 5.0), (50.0, 5.0), (80.0, 0.0)])
        ]
    ).first()
    assert list(row) == [0.0, 1.0, 4.5, -3.0, 0.0]
    cases = {1.9: None, 2.0: "low", 2.4: "low", 2.5: "medium", 2.9: "medium", 3.0: "high",
             3.9: "high", 4.0: "critical", -4.5: "critical", -2.0: "low"}
    out = spark.createDataFrame([(z,) for z in cases], "z DOUBLE").select(
        "z", classify(F.col("z")).alias("s"), classify(F.col("z"), DEPLOYED_PROFILE).alias("p")
    )
    got = {x["z"]: x["s"] for x in out.collect()}
    assert got == cases
    assert {x["z"]: x["p"] for x in out.collect()}[2.4] is None


def test_anomaly_ids_repeat(spark):
    rows = [(i, 50 + i % 2) for i in range(30)] + [(31, 500.0)]
    cfg = DetectorConfig()
    ids = [detect_anomalies(readings(spark, rows), cfg).first()["anomaly_id"] for _ in range(2)]
    assert ids[0] == ids[1]


def test_frames_do_not_walk_a_window_per_reading(spark):
    """Every frame of the method starts or ends at the edge of its bucket; each is one running aggregate."""
    df = spark.createDataFrame([("d", "m", dt.datetime(2024, 1, 1), 1.0)], "device_id STRING, metric_type STRING, timestamp TIMESTAMP, value DOUBLE")
    plan = rolling_stats(df, method="frame")._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe" in plan
    for frame in plan.split("specifiedwindowframe(")[1:]:
        assert frame.split(")")[0].startswith("RangeFrame, unboundedpreceding")
    pruned = rolling_stats(df.withColumn("n", F.lit(1)), method="frame").select("n", "mean").collect()
    assert [tuple(row) for row in pruned] == [(1, 1.0)]
