"""Sliding-window counts and rates, the same plan on batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(
    df: DataFrame,
    labels: list[str],
    ts: str = "timestamp",
    range_s: int = 300,
    step_s: int = 15,
    watermark: str | None = None,
) -> DataFrame:
    """Events per label set and window ``[start, start + range)``, a window every ``step``.

    On a stream give a ``watermark``; a window is then emitted once and its state dropped when the
    watermark passes its end.  A batch is counted per step first, and only the counts are copied
    into the ``range / step`` windows that hold them.
    """
    if watermark is not None:
        df = df.withWatermark(ts, watermark)
    sliding = f"{range_s} seconds", f"{step_s} seconds"
    if df.isStreaming or range_s % step_s:
        counts = df.groupBy(F.window(ts, *sliding).alias("w"), *labels).agg(
            F.count(F.lit(1)).alias("n")
        )
    else:
        per_step = df.groupBy(F.window(ts, sliding[1]).alias("_s"), *labels).agg(
            F.count(F.lit(1)).alias("n")
        )
        counts = (
            per_step.withColumn("_at", F.col("_s.start"))
            .groupBy(F.window("_at", *sliding).alias("w"), *labels)
            .agg(F.sum("n").alias("n"))
        )
    return (
        counts.select(
            *labels,
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "n",
            (F.col("n") / F.lit(float(range_s))).alias("rate"),
        )
    )
