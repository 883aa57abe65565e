import datetime as dt

import pytest
from pyspark.sql import functions as F

from devicelens.operators import series as s
from devicelens.operators.histograms import histogram_quantile, to_buckets

T0 = dt.datetime(2024, 1, 1)
INF = float("inf")


def samples(spark, points, label="a"):
    return spark.createDataFrame(
        [(label, T0 + dt.timedelta(seconds=t), float(v)) for t, v in points],
        "l STRING, ts TIMESTAMP, value DOUBLE",
    )


def by_second(df, column="value"):
    return {int((x["ts"] - T0).total_seconds()): x[column] for x in df.collect()}


def brute_rate(points, range_s=300, extrapolate=True):
    out = {}
    for t, _ in points:
        inside = [(a, v) for a, v in points if t - range_s < a <= t]
        if len(inside) < 2:
            continue
        inc = inside[-1][1] - inside[0][1]
        for (_, a), (_, b) in zip(inside, inside[1:]):
            if b < a:
                inc += a
        if not extrapolate:
            out[t] = inc / range_s
            continue
        sampled = inside[-1][0] - inside[0][0]
        gap = sampled / (len(inside) - 1)
        start = inside[0][0] - (t - range_s)
        if start >= 1.1 * gap:
            start = gap / 2
        if inc > 0 and inside[0][1] >= 0:
            start = min(start, sampled * inside[0][1] / inc)
        out[t] = inc * (sampled + start) / sampled / range_s
    return out


@pytest.mark.parametrize("extrapolate", [True, False])
def test_rate_with_resets_gaps_and_long_series(spark, extrapolate):
    points = [(i * 15, float((i * 7) % 53)) for i in range(200)]
    points += [(6000 + i * 100, i * 3.0) for i in range(30)] + [(20_000, 1.0)]
    got = by_second(s.rate(samples(spark, points), ["l"], 300, extrapolate))
    want = brute_rate(points, 300, extrapolate)
    assert got.keys() == want.keys()
    for t in want:
        assert got[t] == pytest.approx(want[t])


def test_rate_edges(spark):
    assert s.rate(samples(spark, [(0, 5)]), ["l"]).count() == 0
    # 300 s apart: the older sample is outside (t - r, t].
    assert s.rate(samples(spark, [(0, 5), (300, 9)]), ["l"]).count() == 0
    got = by_second(s.rate(samples(spark, [(0, 10), (15, 40), (30, 5)]), ["l"], 300, False))
    assert got[30] == pytest.approx((5 - 10 + 40) / 300)


def test_counter_is_filled(spark):
    events = spark.createDataFrame(
        [("a", T0 + dt.timedelta(seconds=t)) for t in (1, 2, 61)] + [("b", T0 + dt.timedelta(seconds=30))],
        "l STRING, timestamp TIMESTAMP",
    )
    counter = s.to_counter(events, ["l"], step_s=15)
    a = by_second(counter.filter("l = 'a'"))
    b = by_second(counter.filter("l = 'b'"))
    assert a == {15: 2, 30: 2, 45: 2, 60: 2, 75: 3}
    assert b == {15: 0, 30: 1, 45: 1, 60: 1, 75: 1}
    assert s.total(counter, ["l"]).first()["value"] == 4


def test_matching_and_comparison(spark):
    a, b = samples(spark, [(0, 1), (15, 2), (30, 3)]), samples(spark, [(15, 4), (30, 0)], "b")
    assert by_second(s.ratio(a, b.drop("l"), 1.0)) == {15: 0.5, 30: 3.0}
    assert by_second(s.v_and(a, s.compare(b.drop("l"), ">", 1))) == {15: 2}
    both = s.v_or(a, b, ["l"])
    assert both.count() == 5
    assert s.v_or(a, samples(spark, [(0, 9), (45, 9)]), ["l"]).count() == 4
    assert by_second(s.offset(a, 15)) == {15: 1, 30: 2, 45: 3}
    assert by_second(s.clamp_min(a, 2)) == {0: 2, 15: 2, 30: 3}
    codes = spark.createDataFrame([("500",), ("404",), ("1500",), ("50",)], "status_code STRING")
    assert s.match(codes, status_code="5..").count() == 1
    assert s.match(codes, status_code="4..|5..").count() == 2


def test_instant_lookback(spark):
    got = by_second(s.instant(samples(spark, [(1, 1), (16, 0)]), ["l"], 15, 60))
    assert got == {15: 1, 30: 0, 45: 0, 60: 0, 75: 0}


def test_quantiles(spark):
    def one(cells, q):
        df = spark.createDataFrame([(float(le), T0, float(v)) for le, v in cells], "le DOUBLE, ts TIMESTAMP, value DOUBLE")
        return histogram_quantile(df, q).first()["value"]

    cells = [(1, 10), (2, 20), (5, 20), (INF, 20)]
    assert one(cells, 0.5) == pytest.approx(1.0)
    assert one(cells, 0.75) == pytest.approx(1.5)
    assert one(cells, 0.25) == pytest.approx(0.5)
    assert one([(1, 1), (2, 1), (INF, 10)], 0.9) == 2.0
    assert one([(1, 0), (INF, 0)], 0.9) is None
    # A dip is raised to the bucket below.
    assert one([(1, 10), (2, 9), (INF, 10)], 0.95) == pytest.approx(0.95)


def test_buckets(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (7.0,)], "v DOUBLE")
    got = {x["le"]: x["cumulative"] for x in to_buckets(df, [], "v", (1.0, 5.0)).collect()}
    assert got == {1.0: 2, 5.0: 2, INF: 3}


def test_grid(spark):
    assert s.grid(spark, "2024-01-01 00:00:00", "2024-01-01 00:01:00", 15).count() == 5
    assert s.sum_by(samples(spark, [(0, 1), (15, 2)]).unionByName(samples(spark, [(0, 5)], "b"))).filter(
        F.col("ts") == F.lit(T0)
    ).first()["value"] == 6
