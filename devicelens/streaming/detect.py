"""Continuous detection.

``detect_anomalies_stream`` keeps each key's window in state and scores in arrival order: a late
reading sees newer values, and trims by its own time.  ``detection_writer`` scores micro-batches with
the batch operator over the recent history instead; it follows event time and spreads a key whose
readings are too many for one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from devicelens.config import DetectorConfig
from devicelens.functions.times import MICROS, micros
from devicelens.operators.anomalies import anomaly_message, score, scored_readings, to_anomalies
from devicelens.sources.history import recent_history
from devicelens.sources.messages import to_messages
from devicelens.sources.streams import write_batch

STATE = "times ARRAY<BIGINT>, readings ARRAY<DOUBLE>"


STATS = ["window_count", "mean", "stddev", "min_value", "max_value"]


def arrival_windows(times, values, new_t, new_v, width: int, dedupe: bool):
    """Window statistics of each new reading in arrival order, and the window that remains.

    A reading sees what has arrived and was not trimmed by an earlier one, newer readings included.
    """
    import numpy as np

    out = []
    for t, v in zip(new_t.tolist(), new_v.tolist()):
        if not (dedupe and ((times == t) & (values == v)).any()):
            times, values = np.append(times, t), np.append(values, v)
        keep = times > t - width
        if not keep.all():
            times, values = times[keep], values[keep]
        low, high = values.min(), values.max()
        spread = 0.0 if low == high else float(values.std())
        out.append((len(values), float(values.mean()), spread, float(low), float(high)))
    return pd.DataFrame(out, columns=STATS), times, values


def ordered_windows(times, values, new_t, new_v, width: int, dedupe: bool):
    """:func:`arrival_windows` for readings that arrive in time order: one pass over sorted times."""
    import numpy as np

    order = np.argsort(times, kind="stable")
    t, v = np.append(times[order], new_t), np.append(values[order], new_v)
    first = ~pd.DataFrame({"t": t, "v": v}).duplicated().to_numpy() if dedupe else np.full(len(t), True)
    first[: len(times)] = True
    # A copy sees its window but is no member of it.
    member = pd.Series(np.where(first, v, np.nan), index=pd.to_datetime(t, unit="us"))
    window = member.rolling(pd.Timedelta(microseconds=width), min_periods=1)
    stats = pd.DataFrame(
        {
            "window_count": window.count().to_numpy().astype("int64"),
            "mean": window.mean().to_numpy(),
            "stddev": window.std(ddof=0).to_numpy(),
            "min_value": window.min().to_numpy(),
            "max_value": window.max().to_numpy(),
        }
    )
    stats.loc[stats["min_value"] == stats["max_value"], "stddev"] = 0.0
    keep = first & (t > t[-1] - width)
    return stats.iloc[len(times) :].reset_index(drop=True), t[keep], v[keep]


def _window_scorer(cfg: DetectorConfig, arrival: str):
    """State function: one key's new readings, in arrival order."""
    import numpy as np

    width = cfg.window_s * MICROS

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        times, values = (
            (np.asarray(state.get[0], "int64"), np.asarray(state.get[1], "float64"))
            if state.exists
            else (np.empty(0, "int64"), np.empty(0))
        )
        # One key's readings of one micro-batch; the source's per-trigger limit bounds them.
        rows = pd.concat(list(batches)).sort_values([arrival, "_t"], kind="stable")
        t, v = rows["_t"].to_numpy("int64"), rows["value"].to_numpy("float64")
        in_order = (np.diff(t) >= 0).all() and (not len(times) or t[0] >= times.max())
        step = ordered_windows if in_order else arrival_windows
        stats, times, values = step(times, values, t, v, width, cfg.dedupe)
        state.update((times.tolist(), values.tolist()))
        state.setTimeoutDuration(2 * cfg.window_s * 1000)
        scored = pd.concat([rows.reset_index(drop=True), stats], axis=1)
        scored = scored[scored["window_count"] >= cfg.min_samples]
        if len(scored):
            yield scored.drop(columns=["_t"])

    return run


def score_stream(
    enriched: DataFrame, cfg: DetectorConfig = DetectorConfig(), arrival: str = "timestamp"
) -> DataFrame:
    """Analysed readings with statistics, z-score and severity, from a stream.

    ``arrival`` orders the readings of a key inside a micro-batch (e.g. the source offset).  The state
    of a key expires after two windows without a reading.
    """
    keys = list(cfg.keys)
    timed = enriched.withColumn("_t", micros("timestamp"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in enriched.schema.fields]
    schema = ", ".join(
        [
            *fields,
            "window_count BIGINT, mean DOUBLE, stddev DOUBLE, min_value DOUBLE, max_value DOUBLE",
        ]
    )
    stats = timed.groupBy(*keys).applyInPandasWithState(
        _window_scorer(cfg, arrival),
        schema,
        STATE,
        "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
    return score(stats, cfg)


def detect_anomalies_stream(
    enriched: DataFrame, cfg: DetectorConfig = DetectorConfig(), arrival: str = "timestamp"
) -> DataFrame:
    return to_anomalies(score_stream(enriched, cfg, arrival), cfg)


def score_batch(history: DataFrame, batch: DataFrame, cfg: DetectorConfig, low_us: int, high_us: int) -> DataFrame:
    """The batch's analysed readings, scored against the stored history that holds them too.

    ``low_us`` and ``high_us`` are the batch's first and last time.  Only readings up to one window
    older are read back, and only the batch's own readings are returned.
    """
    recent = recent_history(history, low_us - cfg.window_s * MICROS, high_us)
    fresh = batch.select("event_id").distinct()
    return scored_readings(recent.dropDuplicates(["event_id"]), cfg).join(fresh, "event_id", "left_semi")


def detection_writer(history: str, anomalies: str, messages: str, cfg: DetectorConfig = DetectorConfig()):
    """``foreachBatch`` function: score a micro-batch against the stored history.

    The history table (see ``streaming.ingest``) already holds the batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bounds = batch.agg(
            F.min(micros("timestamp")).alias("low"), F.max(micros("timestamp")).alias("high")
        ).first()
        if bounds["low"] is None:
            return
        scored = score_batch(
            spark.read.parquet(history), batch, cfg, bounds["low"], bounds["high"]
        )
        found = to_anomalies(scored, cfg).persist()
        # Two independent sinks: the message goes out even if the table write fails.
        failure = None
        try:
            write_batch(found, anomalies, batch_id)
        except Exception as error:  # noqa: BLE001
            failure = error
        write_batch(to_messages(anomaly_message(found)), messages, batch_id)
        found.unpersist()
        if failure is not None:
            raise failure

    return write
