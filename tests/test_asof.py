"""Newest rows of a time range per probe, against loops in Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from devicelens.functions.asof import count_since, last_in_range, newest_before, newest_since
from devicelens.functions.times import micros
from devicelens.operators import diagnosis as dg

T0 = dt.datetime(2024, 1, 1)
SECOND = 1_000_000


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def tables(spark, seed, n_rows=300, n_probes=80, span=900):
    """Rows crowd into few seconds (many ties), keys and times may be missing, half the rows share a key."""
    rng = random.Random(seed)
    keys = [None, "a", "a", "b"]
    rows = [
        (i, rng.choice(keys), None if rng.random() < 0.02 else int(rng.triangular(0, span, 700)))
        for i in range(n_rows)
    ]
    probes = [
        (i, rng.choice([*keys, "none"]), None if i % 40 == 7 else rng.randrange(-50, span + 400))
        for i in range(n_probes)
    ]
    return rows, probes


def frames(spark, rows, probes):
    return (
        spark.createDataFrame([(i, k, at(t)) for i, k, t in rows], "id long, k string, t timestamp"),
        # The column names clash on purpose.
        spark.createDataFrame([(i, k, at(t), "x") for i, k, t in probes], "p long, k string, t timestamp, id string"),
    )


def newest(rows, probe, n, keyed, fits):
    mine = [(t, i) for i, k, t in rows if t is not None and (not keyed or k == probe[1]) and fits(t)]
    return [i for _, i in sorted(mine, reverse=True)[:n]]


@pytest.mark.parametrize("keyed,n,width,parts", [(True, 3, 120, 6), (False, 10, 60, 6), (True, 1, 7, 4), (False, 400, 500, 1)])
def test_newest_before(spark, keyed, n, width, parts):
    rows, probes = tables(spark, n)
    r, p = frames(spark, rows, probes)
    keys = ["k"] if keyed else []
    found = newest_before(r, p, keys, micros("t"), "id", micros("t"), width * SECOND, n, "last", parts)
    assert found.columns == [*p.columns, "last"]
    got = {x.p: [y.id for y in x["last"]] for x in found.collect()}
    assert got == {
        q[0]: [] if q[2] is None else newest(rows, q, n, keyed, lambda t: q[2] - width < t <= q[2]) for q in probes
    }


def test_newest_before_agrees_with_the_numbered_way(spark):
    rows, probes = tables(spark, 5)
    r, p = frames(spark, rows, [q for q in probes if q[2] is not None])
    width = 100 * SECOND
    carried = newest_before(r, p, ["k"], micros("t"), "id", micros("t"), width, 4)
    numbered = last_in_range(
        r.filter("t IS NOT NULL"), p, ["k"], micros("t"), "id", "p", micros("t") - width + 1, micros("t"), 4, 60 * SECOND
    )
    wanted = {}
    for x in numbered.filter("r IS NOT NULL").collect():
        wanted.setdefault(x.p, {})[x.position] = x.r.id
    got = {x.p: [y.id for y in x.newest] for x in carried.collect() if x.newest}
    assert got == {k: [v[i] for i in sorted(v, reverse=True)] for k, v in wanted.items()}


@pytest.mark.parametrize("n", [1, 5])
def test_newest_since(spark, n):
    rows, probes = tables(spark, 40 + n)
    r, p = frames(spark, rows, probes)
    found = newest_since(r, p, ["k"], micros("t"), "id", micros("t"), n)
    got = {x.p: [y.id for y in x.newest] for x in found.collect()}
    assert got == {q[0]: [] if q[2] is None else newest(rows, q, n, True, lambda t: t >= q[2]) for q in probes}


@pytest.mark.parametrize("segment", [1, 60, 5000])
def test_count_since(spark, segment):
    rows, probes = tables(spark, segment)
    r, p = frames(spark, rows, probes)
    found = count_since(r, p, ["k"], micros("t"), micros("t"), segment * SECOND)
    assert found.columns == [*p.columns, "in_range"]
    got = {x.p: x.in_range for x in found.collect()}
    assert got == {
        q[0]: 0 if q[2] is None else len(newest(rows, q, len(rows), True, lambda t: t >= q[2])) for q in probes
    }
    assert {x.in_range for x in count_since(r.limit(0), p, ["k"], micros("t"), micros("t"), SECOND).collect()} == {0}
    assert count_since(r, p.limit(0), ["k"], micros("t"), micros("t"), SECOND).count() == 0


def test_empty_tables(spark):
    rows, probes = tables(spark, 1)
    r, p = frames(spark, rows, probes)
    for look in (
        lambda r, p: newest_before(r, p, ["k"], micros("t"), "id", micros("t"), SECOND, 2),
        lambda r, p: newest_since(r, p, ["k"], micros("t"), "id", micros("t"), 2),
    ):
        assert look(r, p.limit(0)).count() == 0
        assert {len(x.newest) for x in look(r.limit(0), p).collect()} == {0}


def test_a_burst_in_one_second_is_carried_whole(spark):
    r = spark.range(20_000).select("id", F.lit("a").alias("k"), F.lit(at(0)).cast("timestamp").alias("t"))
    p = spark.range(500).select(
        F.col("id").alias("p"), F.lit("a").alias("k"), F.lit(at(59)).cast("timestamp").alias("t")
    )
    found = newest_before(r, p, ["k"], micros("t"), "id", micros("t"), 60 * SECOND, 10)
    assert {tuple(y.id for y in x.newest) for x in found.collect()} == {tuple(range(19_999, 19_989, -1))}


@pytest.mark.parametrize("upper", [False, True])
def test_history_text_equals_that_of_numbered_readings(spark, upper):
    anomalies = spark.createDataFrame(
        [("a1", "d", at(600)), ("a2", "d", at(10)), ("a3", "gone", at(10)), ("a4", None, at(20_000))],
        "anomaly_id string, device_id string, detected_at timestamp",
    )
    readings = spark.createDataFrame(
        [(i, "d" if i % 3 else None, "m", i / 8, at(i // 2 * 40)) for i in range(400)],
        "event_id long, device_id string, metric_type string, value double, timestamp timestamp",
    )
    numbered = dg.format_history(dg.recent_readings(anomalies, readings, upper=upper)).collect()
    arrays = dg.with_newest_readings(anomalies, readings, upper=upper).select(
        "anomaly_id", dg.history_text(F.col("newest")).alias("recent_telemetry")
    )
    assert {tuple(x) for x in arrays.collect()} == {tuple(x) for x in numbered}
