import datetime as dt

import pytest
from pyspark.sql import functions as F

from devicelens.functions.times import duration_seconds, parse_alert_ts, parse_resolved_ts
from devicelens.operators import alerts as al
from devicelens.operators import monitors as mo
from devicelens.operators.series import rate
from devicelens.plans import alert_rules as ar
from devicelens.plans import recording as rr
from devicelens.plans.metrics import Metrics, Series

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_for_state_machine(spark):
    true_at = [0, 15, 30, 45, 60, 75, 105, 120, 300]
    cond = spark.createDataFrame([(at(t), 1.0) for t in true_at], "ts TIMESTAMP, value DOUBLE")
    states = {
        int((x["ts"] - T0).total_seconds()): x["state"]
        for x in al.alert_states(cond, [], 60).collect()
    }
    assert states == {
        0: "pending", 15: "pending", 30: "pending", 45: "pending", 60: "firing", 75: "firing",
        90: "resolved", 105: "pending", 120: "pending", 300: "pending",
    }
    assert al.firing(al.alert_states(cond, [], 0)).count() == len(true_at)


def replay(statuses):
    """Episodes by the upsert rule, row by row."""
    out, open_ = [], None
    for i, status in enumerate(statuses):
        if status == "F":
            if open_ is None:
                open_ = {"first": i, "last_firing": i, "status": "firing"}
                out.append(open_)
            open_["last_firing"], open_["last"] = i, i
        elif open_ is not None:
            open_.update(status="resolved", last=i)
            open_ = None
        else:
            out.append({"first": i, "last_firing": i, "status": "resolved", "last": i})
    return out


def log(spark, sequences, step=60):
    rows = [
        (fp, "firing" if c == "F" else "resolved", at(i * step), i, f"label {i}", None)
        for fp, seq in sequences.items()
        for i, c in enumerate(seq)
    ]
    return spark.createDataFrame(
        rows,
        "fingerprint STRING, status STRING, received_at TIMESTAMP, seq INT, labels STRING, resolved_at TIMESTAMP",
    )


SEQUENCES = ["F", "FF", "FR", "FRF", "R", "RR", "FFR", "FFRRFFFRFR", "RFRFFF"]


def test_episode_fold(spark):
    sequences = {s: s for s in SEQUENCES}
    for segment_s in (30, 3600):
        got = al.alert_episodes(
            log(spark, sequences),
            ["received_at", "seq"],
            first=["seq"],
            latest_firing=["labels"],
            segment_us=segment_s * 1_000_000,
        ).collect()
        for fp, seq in sequences.items():
            mine = sorted((x for x in got if x["fingerprint"] == fp), key=lambda x: x["episode"])
            want = replay(seq)
            assert [x["status"] for x in mine] == [w["status"] for w in want], fp
            assert [x["seq"] for x in mine] == [w["first"] for w in want], fp
            assert [x["labels"] for x in mine] == [f"label {w['last_firing']}" for w in want], fp
            assert [x["received_at"] for x in mine] == [at(60 * w["last"]) for w in want], fp
            assert all((x["resolved_at"] is not None) == (x["status"] == "resolved") for x in mine)


def test_fold_is_idempotent_on_replayed_firing(spark):
    once = log(spark, {"x": "FFR"})
    doubled = once.unionByName(once.filter("seq = 1").withColumn("seq", F.lit(1)))
    assert al.alert_episodes(doubled, ["received_at", "seq"], first=["seq"]  , latest_firing=["labels"]).count() == 1


def test_alert_times(spark):
    now = dt.datetime(2030, 1, 1)
    cases = {
        "2024-01-15T10:30:00Z": dt.datetime(2024, 1, 15, 10, 30),
        "2024-01-15T10:30:00.000+00:00": dt.datetime(2024, 1, 15, 10, 30),
        "2024-01-15T10:30:00.123456789Z": dt.datetime(2024, 1, 15, 10, 30, 0, 123456),
        "2024-01-15T10:30:00.123456789+02:00": dt.datetime(2024, 1, 15, 8, 30, 0, 123456),
        "2024-01-15T10:30:00.5": dt.datetime(2024, 1, 15, 10, 30, 0, 500000),
        "not-a-timestamp": now,
        "": now,
    }
    df = spark.createDataFrame([(t, now) for t in cases], "t STRING, now TIMESTAMP")
    got = {
        x["t"]: x["p"]
        for x in df.select("t", parse_alert_ts(F.col("t"), F.col("now")).alias("p")).collect()
    }
    assert got == cases
    zero = spark.createDataFrame([("0001-01-01T00:00:00Z", now)], "t STRING, now TIMESTAMP")
    assert zero.select(parse_resolved_ts(F.col("t"), F.col("now"))).first()[0] == now


def firing_rows(spark, rows):
    return spark.createDataFrame(
        [(i, *row, at(0)) for i, row in enumerate(rows)],
        "fingerprint INT, alert_name STRING, severity STRING, pipeline STRING, ts TIMESTAMP",
    )


@pytest.mark.parametrize(
    "source,target,muted_same,muted_other",
    [
        (("ServiceDown", "critical"), ("HighMemoryUsage", "warning"), True, False),
        (("FullPipelineStall", "critical"), ("IngestionPipelineStalled", "critical"), True, True),
        (("CascadingFailure", "critical"), ("ServiceDown", "critical"), True, False),
        (("KafkaIngestionFailure", "critical"), ("KafkaPublishErrors", "warning"), True, True),
        (("DiagnosisPipelineDown", "critical"), ("DiagnosisPartialFailures", "warning"), True, True),
        (("DetectionWithoutDiagnosis", "critical"), ("DiagnosisPartialFailures", "warning"), True, True),
        (("CriticalAnomalyBurst", "critical"), ("AnomaliesBeingDetected", "info"), True, False),
    ],
)
def test_inhibition(spark, source, target, muted_same, muted_other):
    for pipeline, muted in (("p", muted_same), ("q", muted_other)):
        rows = firing_rows(spark, [(*source, "p"), (*target, pipeline)])
        left = [x["alert_name"] for x in al.inhibit(rows, ar.INHIBITIONS).collect()]
        assert left == ([source[0]] if muted else [source[0], target[0]]) or set(left) == (
            {source[0]} if muted else {source[0], target[0]}
        )


def test_inhibition_needs_the_same_tick(spark):
    rows = firing_rows(
        spark, [("FullPipelineStall", "critical", "p"), ("IngestionPipelineStalled", "critical", "p")]
    ).withColumn("ts", F.when(F.col("fingerprint") == 0, F.lit(at(15))).otherwise(F.col("ts")))
    assert al.inhibit(rows, ar.INHIBITIONS).count() == 2


def test_routing(spark):
    df = spark.createDataFrame(
        [("critical", "true"), ("warning", "true"), ("info", "false"), ("unknown", "true"), ("unknown", "false")],
        "severity STRING, compound STRING",
    )
    got = sorted(
        (x["severity"], x["compound"], x["receiver"], x["repeat_interval_s"])
        for x in al.route(df, ar.ROUTES, ar.DEFAULT_ROUTE).collect()
    )
    assert got == [
        ("critical", "true", "pagerduty-critical", 3600),
        ("critical", "true", "webhook-all", 3600),
        ("info", "false", "webhook-all", 43200),
        ("unknown", "false", "webhook-all", 14400),
        ("unknown", "true", "webhook-all", 7200),
        ("warning", "true", "webhook-all", 14400),
    ]


def test_notification_schedule(spark):
    df = spark.createDataFrame(
        [(at(0), at(7300), at(10_000), 10, 60, 3600)],
        "started_at TIMESTAMP, ended_at TIMESTAMP, horizon_at TIMESTAMP, group_wait_s INT, "
        "group_interval_s INT, repeat_interval_s INT",
    )
    got = [
        (int((x["notify_at"] - T0).total_seconds()), x["notify_status"])
        for x in al.notification_schedule(df).orderBy("notify_at").collect()
    ]
    assert got == [(10, "firing"), (3610, "firing"), (7210, "firing"), (7330, "resolved")]


def test_rendering(spark):
    row = spark.createDataFrame([("api", 0.12345, 600.0 * 1024 * 1024)], "job STRING, v DOUBLE, m DOUBLE")
    out = row.select(
        al.render('{{ $labels.job }}: {{ $value | printf "%.2f" }} ({{ $value }})', {"job": F.col("job")}, F.col("v")),
        al.render("{{ $value | humanize1024 }}B", {}, F.col("m")),
    ).first()
    assert list(out) == ["api: 0.12 (0.12345)", "600MiB"]


def test_fingerprint_ignores_order(spark):
    df = spark.range(1).select(
        al.fingerprint(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).alias("x"),
        al.fingerprint(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("y"),
        al.fingerprint(F.create_map(F.lit("a"), F.lit("2"))).alias("z"),
    )
    x, y, z = df.first()
    assert x == y != z


def test_monitors(spark):
    base = spark.createDataFrame(
        [("1", "Hot", "value > 1", None, None, None, "", "", None, at(0))],
        "id STRING, name STRING, expr STRING, duration STRING, severity STRING, pipeline STRING, "
        "summary STRING, description STRING, enabled BOOLEAN, created_at TIMESTAMP",
    )
    full = mo.with_defaults(base)
    row = full.first()
    assert (row["duration"], row["severity"], row["pipeline"], row["enabled"]) == ("5m", "warning", "custom", True)
    assert (row["summary"], row["description"]) == ("Hot is firing", "Custom monitor: Hot")
    updates = spark.createDataFrame(
        [("1", None, None, "1h", None, None, None, None, None, 1),
         ("1", None, None, None, "critical", None, None, None, False, 2)],
        "id STRING, name STRING, expr STRING, duration STRING, severity STRING, pipeline STRING, "
        "summary STRING, description STRING, enabled BOOLEAN, seq INT",
    )
    changed = mo.apply_monitor_updates(full, updates, "seq")
    row = changed.first()
    assert (row["duration"], row["severity"], row["enabled"], row["name"]) == ("1h", "critical", False, "Hot")
    assert mo.monitors_to_rules(changed).count() == 0
    rule = mo.monitors_to_rules(full).first()
    assert (rule["for_s"], rule["tier"], rule["managed_by"]) == (300, "custom", "monitor-api")
    assert duration_seconds("1h30m") == 5400
    with pytest.raises(ValueError):
        duration_seconds("5x")


# --- rules that the driver tables never trip ----------------------------------------------------


def counter(spark, per_tick, labels=None, ticks=200):
    """Counter with the given increment per tick."""
    value, rows = 0.0, []
    for i in range(ticks):
        value += per_tick(i)
        rows.append((*(labels or {}).values(), at(15 * i), value))
    schema = "".join(f"{n} STRING, " for n in (labels or {})) + "ts TIMESTAMP, value DOUBLE"
    return Series(spark.createDataFrame(rows, schema), tuple(labels or ()))


def up(spark, values, ticks=200):
    rows = [
        (job, "i", at(15 * i), float(value(i))) for job, value in values.items() for i in range(ticks)
    ]
    return Series(
        spark.createDataFrame(rows, "job STRING, instance STRING, ts TIMESTAMP, value DOUBLE"),
        ("job", "instance"),
    )


def fired(m, name):
    rule = next(x for x in ar.ALERT_RULES if x.name == name)
    return al.firing(ar.states(m, rule)).count()


def test_stall_and_degradation_rules(spark):
    stops = lambda i: 30 if i < 100 else 0
    m = Metrics(
        {
            rr.INGESTED: lambda: counter(spark, stops),
            rr.ANALYZED: lambda: counter(spark, stops),
            rr.ANOMALIES: lambda: counter(spark, stops, {"severity": "low"}),
            rr.PUBLISH_ERRORS: lambda: counter(spark, lambda i: 1, {"error_type": "timeout"}),
            rr.UP: lambda: up(spark, {"api-gateway": lambda i: 1}),
        }
    )
    for name in ("IngestionPipelineStalled", "FullPipelineStall", "PipelineDegradation", "KafkaIngestionFailure"):
        assert fired(m, name) > 0, name
    steady = Metrics({**m.build, rr.INGESTED: lambda: counter(spark, lambda i: 30)})
    for name in ("IngestionPipelineStalled", "FullPipelineStall", "PipelineDegradation", "KafkaIngestionFailure"):
        assert fired(steady, name) == 0, name


def test_cascade_burst_and_client_errors(spark):
    http = lambda code, n: counter(
        spark, lambda i: n, {"job": "api-gateway", "endpoint": "e", "method": "GET", "status_code": code}
    ).samples
    m = Metrics(
        {
            rr.HTTP: lambda: Series(
                http("500", 10).unionByName(http("404", 30)).unionByName(http("200", 20)),
                ("job", "endpoint", "method", "status_code"),
            ),
            rr.UP: lambda: up(spark, {"ingestion-consumer": lambda i: i < 50, "anomaly-detection": lambda i: 1}),
            rr.ANOMALIES: lambda: counter(spark, lambda i: 3, {"severity": "critical"}),
        }
    )
    for name in ("CascadingFailure", "CriticalAnomalyBurst", "HighClientErrorRate", "HighAPIErrorRate", "ServiceDown"):
        assert fired(m, name) > 0, name
    assert rate(m[rr.ANOMALIES].samples, ["severity"]).agg(F.max("value")).first()[0] == pytest.approx(0.2)


def test_catalogue_is_complete():
    assert len(ar.ALERT_RULES) == 22 and len({x.name for x in ar.ALERT_RULES}) == 22
    assert len(rr.RECORDING_RULES) == 29
    assert len(ar.INHIBITIONS) == 7
