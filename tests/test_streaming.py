import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from devicelens import schemas
from devicelens.config import DetectorConfig
from devicelens.operators import alerts as al
from devicelens.operators.anomalies import scored_readings
from devicelens.sources.history import read_history, write_history
from devicelens.sources import tables
from devicelens.sources.messages import (
    enriched_messages,
    malformed_anomaly_messages,
    parse_anomaly_messages,
)
from devicelens.sources.streams import message_writer, read_anomaly_stream, read_raw_stream
from devicelens.streaming.alerts import number_episodes_stream
from devicelens.streaming.detect import detection_writer, score_stream
from devicelens.streaming.ingest import IngestPaths, dedupe_replays, ingest_batch, start_ingest
from devicelens.streaming.rates import sliding_counts
from devicelens.streaming.replay import replay

T0 = dt.datetime(2024, 1, 1)
UUID = "00000000-0000-0000-0000-00000000000{}"


def write_lines(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def payload(device, value, second):
    return json.dumps(
        {
            "device_id": UUID.format(device),
            "metric_type": "temperature",
            "value": value,
            "timestamp": (T0 + dt.timedelta(seconds=second)).isoformat() + "Z",
        }
    )


def devices(spark):
    return spark.createDataFrame(
        [(UUID.format(i), "gateway", f"room {i}", "") for i in range(3)],
        "device_id STRING, device_type STRING, location STRING, firmware_version STRING",
    )


def run(writer, sink, checkpoint, tmp):
    return (
        writer.option("checkpointLocation", str(tmp / checkpoint)).trigger(availableNow=True).start(str(tmp / sink))
    )


def test_ingest_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "raw"
    lines = [payload(i % 5, 20.0 + i, i) for i in range(60)] + ["broken {", "42"]
    for n in range(4):
        write_lines(source, f"{n}.txt", lines[n::4])
    paths = IngestPaths(*[str(tmp_path / x) for x in ("history", "enriched", "dlq", "dlq_topic")])

    def go():
        raw = read_raw_stream(spark, str(source), "text", per_trigger=1)
        query = start_ingest(
            raw, lambda: devices(spark), paths, str(tmp_path / "cp"), trigger={"availableNow": True}
        )
        query.awaitTermination()

    go()
    history = spark.read.parquet(paths.history)
    dead = spark.read.parquet(paths.dlq_table)
    batch = spark.createDataFrame([(x, "f", T0) for x in lines], "payload STRING, position STRING, received_at TIMESTAMP")
    good, bad = ingest_batch(batch, devices(spark))
    key = ["device_id", "value", "timestamp", "device_type", "device_location", "firmware_version"]
    assert sorted(map(tuple, history.select(*key).collect()), key=str) == sorted(
        map(tuple, good.select(*key).collect()), key=str
    )
    assert history.count() + dead.count() == len(lines)
    counts = lambda df: {x["reason"]: x["count"] for x in df.groupBy("reason").count().collect()}
    assert counts(dead) == counts(bad) == {"validation_failed": 2, "device_not_found": 24}
    assert '{"raw":"broken {"}' in [x[0] for x in dead.select("original_payload").collect()]
    assert spark.read.parquet(paths.enriched).count() == history.count()
    assert spark.read.parquet(paths.dlq_topic).count() == dead.count()
    # A restart with nothing new adds nothing; new input is appended.
    go()
    assert spark.read.parquet(paths.history).count() == history.count()
    write_lines(source, "late.txt", [payload(1, 5.0, 999)])
    go()
    assert spark.read.parquet(paths.history).filter("value = 5.0").count() == 1


def test_replayed_batch_replaces_itself(spark, tmp_path):
    from devicelens.streaming.ingest import ingest_writer

    paths = IngestPaths(*[str(tmp_path / x) for x in ("history", "enriched", "dlq", "dlq_topic")])
    write = ingest_writer(lambda: devices(spark), paths)
    batch = spark.createDataFrame(
        [(payload(0, 1.0, 1), "f", T0), ("x", "f", T0)], "payload STRING, position STRING, received_at TIMESTAMP"
    )
    write(batch, 7)
    write(batch, 7)
    assert spark.read.parquet(paths.history).count() == 1
    assert spark.read.parquet(paths.dlq_table).count() == 1


def test_late_rows_can_be_rejected(spark):
    batch = spark.createDataFrame(
        [(payload(0, 1.0, 0), "f", T0 + dt.timedelta(seconds=s)) for s in (10, 5000)],
        "payload STRING, position STRING, received_at TIMESTAMP",
    )
    good, bad = ingest_batch(batch, devices(spark), late_after_s=600)
    assert good.count() == 1 and bad.first()["reason"] == "late"
    assert ingest_batch(batch, devices(spark))[0].count() == 2


def readings(spark, rows):
    return spark.createDataFrame(
        [(i, "d", "t", float(v), T0 + dt.timedelta(seconds=s)) for i, (s, v) in enumerate(rows)],
        "event_id BIGINT, device_id STRING, metric_type STRING, value DOUBLE, timestamp TIMESTAMP",
    )


SCHEMA = "event_id BIGINT, device_id STRING, metric_type STRING, value DOUBLE, timestamp TIMESTAMP"


def stream_scores(spark, tmp_path, batches, cfg):
    source = tmp_path / "in"
    for n, rows in enumerate(batches):
        rows.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = run(score_stream(stream, cfg, "event_id").writeStream.format("parquet"), "out", "cp", tmp_path)
    query.awaitTermination()
    return {x["event_id"]: x for x in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_stream_scores_equal_batch_in_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i * 7, rng.gauss(50, 4)) for i in range(150)]
    rows[100] = (700, 95.0)
    df = readings(spark, rows)
    cfg = DetectorConfig()
    got = stream_scores(
        spark, tmp_path, [df.filter("event_id < 60"), df.filter("event_id BETWEEN 60 AND 110"), df.filter("event_id > 110")], cfg
    )
    want = {x["event_id"]: x for x in scored_readings(df, cfg).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key]["z_score"] == pytest.approx(want[key]["z_score"])
        assert got[key]["severity"] == want[key]["severity"]


def test_late_reading_sees_newer_values(spark, tmp_path):
    # Arrival order: 0..9 s, then 100 s, then a late one at 5 s.
    rows = [(i, 10.0) for i in range(10)] + [(100, 10.0), (5.5, 99.0)]
    got = stream_scores(spark, tmp_path, [readings(spark, rows)], DetectorConfig())
    assert got[11]["window_count"] == 12 and got[11]["max_value"] == 99.0
    assert got[10]["window_count"] == 11


def test_detection_by_micro_batch(spark, tmp_path):
    rng = random.Random(2)
    df = readings(spark, [(i * 7, rng.gauss(50, 4)) for i in range(99)] + [(700, 500.0)])
    history = str(tmp_path / "h")
    df.write.parquet(history)
    write = detection_writer(history, str(tmp_path / "a"), str(tmp_path / "m"))
    write(df.filter("event_id >= 90"), 1)
    write(df.filter("event_id >= 90"), 1)
    found = spark.read.parquet(str(tmp_path / "a"))
    assert found.count() == found.select("anomaly_id").distinct().count()
    assert {x["event_id"] for x in found.collect()} <= set(range(90, 100))
    messages = spark.read.parquet(str(tmp_path / "m"))
    spike = "observed_value = 500"
    back = parse_anomaly_messages(messages, schemas.ANOMALY)
    assert back.count() == found.count()
    assert back.filter(spike).first()["severity"] == "critical"
    assert round(found.filter(spike).first()["z_score"], 4) == back.filter(spike).first()["z_score"]


def test_anomaly_messages(spark, tmp_path):
    write_lines(tmp_path / "an", "a.txt", ['{"device_id": "d", "severity": "high", "z_score": 3.5}', "oops", '{"x": 1}'])
    stream = read_anomaly_stream(spark, str(tmp_path / "an"), "text")
    assert stream.isStreaming
    rows = spark.read.text(str(tmp_path / "an"))
    assert parse_anomaly_messages(rows, schemas.ANOMALY).count() == 1
    assert {x["failed_phase"] for x in malformed_anomaly_messages(rows, schemas.ANOMALY).collect()} == {"context"}


def test_replays_are_dropped(spark, tmp_path):
    df = readings(spark, [(i, i) for i in range(20)])
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(dedupe_replays(stream).writeStream.format("parquet"), "out", "cp", tmp_path).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_episode_numbers_on_a_stream(spark, tmp_path):
    schema = "fingerprint STRING, status STRING, received_at TIMESTAMP, seq INT, resolved_at TIMESTAMP"
    sequences = ["FFRRFFFRFR", "RFRFFF", "F", "RR"]
    rows = [
        (f, "firing" if c == "F" else "resolved", T0 + dt.timedelta(minutes=i), i, None)
        for f in sequences
        for i, c in enumerate(f)
    ]
    log = spark.createDataFrame(rows, schema)
    for low, high in ((0, 3), (4, 5), (6, 99)):
        log.filter(F.col("seq").between(low, high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    numbered = number_episodes_stream(stream, ["received_at", "seq"])
    run(numbered.writeStream.format("parquet"), "out", "cp", tmp_path).awaitTermination()
    args = dict(order=["received_at", "seq"], first=["seq"], latest_firing=["seq"][:0])
    got = al.fold_episodes(spark.read.parquet(str(tmp_path / "out")), **args)
    want = al.alert_episodes(log, **args)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_sliding_counts_on_a_stream(spark, tmp_path):
    df = readings(spark, [(i * 20, 1) for i in range(60)])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    windows = sliding_counts(stream, ["metric_type"], watermark="1 second")
    query = windows.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sliding_counts(df, ["metric_type"])
    assert sorted(map(str, spark.table("windows").collect())) == sorted(map(str, want.collect()))


def test_history_is_pruned(spark, tmp_path):
    df = readings(spark, [(i * 86400, i) for i in range(90)])
    write_history(df, str(tmp_path / "h"))
    part = read_history(spark, str(tmp_path / "h"), "2024-02-01 00:00:00", "2024-02-03 00:00:00")
    assert sorted(x["value"] for x in part.collect()) == [31.0, 32.0]
    files = {f.split("event_month=")[1][:7] for f in part.inputFiles()}
    assert files >= {"2024-02"}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_month" in plan


def test_enriched_sink_is_keyed_by_device(spark, tmp_path):
    readings(spark, [(i, i) for i in range(5)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    writer = message_writer(
        enriched_messages(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "json"
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert {x["key"] for x in rows} == {"d"} and len(rows) == 5
    assert json.loads(rows[0]["value"])["metric_type"] == "t"


def test_sample_and_diagnosis_tables(spark, tmp_path):
    samples = spark.createDataFrame(
        [("up", {"job": "a", "instance": "i"}, T0, 1.0), ("rss", {"job": "a"}, T0, 5.0)], schemas.SAMPLE
    )
    tables.write_samples(samples, str(tmp_path / "s"))
    up = tables.read_samples(spark, str(tmp_path / "s"), "up")
    row = tables.label_columns(up, "job", "instance").first()
    assert (row["job"], row["instance"], row["value"]) == ("a", "i", 1.0)
    done = spark.createDataFrame([("x", "a")], "diagnosis_id STRING, anomaly_id STRING")
    for _ in range(2):
        tables.write_diagnoses(done, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2


def test_ordered_windows_equal_arrival_windows():
    import numpy as np

    from devicelens.streaming.detect import arrival_windows, ordered_windows

    rng = random.Random(5)
    for dedupe in (True, False):
        t = np.sort(np.array([rng.randrange(0, 4000) for _ in range(300)], "int64")) * 1_000_000
        v = np.array([float(rng.randrange(0, 6)) for _ in range(300)])
        t[50:60], v[50:60] = t[50], v[50]
        old = (np.empty(0, "int64"), np.empty(0))
        for at in range(0, 300, 75):
            args = (t[at : at + 75], v[at : at + 75], 300_000_000, dedupe)
            one, two = arrival_windows(*old, *args), ordered_windows(*old, *args)
            assert np.allclose(one[0].to_numpy(float), two[0].to_numpy(float))
            assert (np.sort(one[1]) == np.sort(two[1])).all() and (np.sort(one[2]) == np.sort(two[2])).all()
            old = one[1:]


def test_micro_batch_reads_only_recent_months(spark, tmp_path):
    from devicelens.sources.history import compact_history, recent_history, with_event_month
    from devicelens.sources.streams import write_batch

    rows = [(i, "d", "t", float(i), T0 + dt.timedelta(days=20 * i)) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for n in range(3):
        write_batch(with_event_month(df.filter(f"event_id % 3 = {n}")), str(tmp_path / "h"), n, ("event_month",))
    low, high = ((T0 + dt.timedelta(days=d)).replace(tzinfo=dt.timezone.utc).timestamp() * 10**6 for d in (41, 80))
    recent = recent_history(spark.read.parquet(str(tmp_path / "h")), int(low), int(high))
    assert sorted(r.event_id for r in recent.collect()) == [3, 4]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan and "GreaterThan(timestamp" in plan
    compact_history(spark, str(tmp_path / "h"), str(tmp_path / "c"))
    assert read_history(spark, str(tmp_path / "c"), "2024-02-01", "2024-03-01").count() == 1
    assert spark.read.parquet(str(tmp_path / "c")).count() == 9


def test_incident_files_that_fail_are_reported(spark, tmp_path):
    for name, content in (("a/1.json", '{"title": "x"}'), ("b/1.json", '{"title": "y"}'), ("2.json", "{"), ("3.json", "[]")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(content)
    files = tables.incident_files(spark, str(tmp_path / "*.json")).unionByName(tables.incident_files(spark, str(tmp_path / "*/*.json")))
    good, failed = tables.parse_incidents(files)
    assert sorted(r.title for r in good.collect()) == ["x", "y"] and good.select("incident_id").distinct().count() == 2
    assert {r.source_path.rsplit("/", 1)[1]: r.reason for r in failed.collect()} == {"2.json": "invalid_json", "3.json": "not_an_object"}


def test_replay_resumes_and_takes_empty_tables(spark):
    """Windows reach back over the stop; rows without a time, one time only, and no rows at all."""
    rng = random.Random(3)
    df = readings(spark, [(i * 7, rng.gauss(50, 4)) for i in range(120)])
    cfg = DetectorConfig()
    got = {x["event_id"]: x["z_score"] for x in replay(df, "timestamp", lambda s: score_stream(s, cfg), 3).collect()}
    want = {x["event_id"]: x["z_score"] for x in scored_readings(df, cfg).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)

    def kept(s):
        return s.select("event_id", "timestamp")

    untimed = df.limit(3).withColumn("timestamp", F.lit(None).cast("timestamp"))
    assert replay(untimed.unionByName(df.limit(4)), "timestamp", kept).count() == 7
    assert replay(df.limit(1), "timestamp", kept, 4).count() == 1
    assert replay(df.limit(0), "timestamp", kept).count() == 0


def test_replay_ends_where_sessions_run_batches_without_data(spark):
    """Spark's default: an operator with timeouts by the clock asks for one batch after another."""
    import threading

    name, found = "spark.sql.streaming.noDataMicroBatches.enabled", []
    before = spark.conf.get(name)
    df = readings(spark, [(i * 7, 50.0 + i % 5) for i in range(60)])
    spark.conf.set(name, "true")
    try:
        work = threading.Thread(
            target=lambda: found.append(replay(df, "timestamp", score_stream, slice_rows=25).count()), daemon=True
        )
        work.start()
        work.join(180)
        for query in spark.streams.active:
            query.stop()
        work.join(30)
        assert spark.conf.get(name) == "true"
    finally:
        spark.conf.set(name, before)
    assert found == [scored_readings(df).count()]


class Kept:
    """State of one bucket, at a time the test sets."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.now = None, False, False, 0

    def update(self, value):
        self.get, self.exists = value, True

    def getCurrentProcessingTimeMs(self):  # noqa: N802
        return self.now

    def setTimeoutDuration(self, ms):  # noqa: N802
        pass


def test_a_bucket_numbers_all_its_fingerprints_and_forgets_idle_ones():
    import pandas as pd

    from devicelens.streaming.alerts import _numberer

    run, state = _numberer(["seq"], 10, ["seq", "status"]), Kept()

    def numbers(rows):
        given = pd.DataFrame(rows, columns=["_key", "seq", "status"])
        (out,) = run((0,), iter([given]), state)
        return dict(zip(out["seq"], zip(out["episode"], out["is_new"])))

    first = numbers([("=b", 4, "firing"), ("=a", 2, "resolved"), ("=a", 1, "firing"), ("=a", 3, "firing"), ("", 5, None)])
    assert first == {1: (1, True), 2: (1, False), 3: (2, True), 4: (1, True), 5: (1, True)}
    state.now = 9_000
    assert numbers([("=a", 6, "firing"), ("", 7, "firing")]) == {6: (2, False), 7: (2, True)}
    state.now = 12_000  # b was last met at 0
    assert numbers([("=b", 8, "firing"), ("=a", 9, "resolved")]) == {8: (1, True), 9: (2, False)}
    assert sorted(state.get[0]) == ["", "=a", "=b"]
