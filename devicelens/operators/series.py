"""Metric series algebra over long frames ``(labels..., ts, value)``.

A series is one label combination; labels are plain columns, so matching and aggregation are
ordinary equi-joins and group-bys.  ``ts`` is a timestamp on a regular grid.  Raw rows are counted
per (labels, tick) first, so every window below runs over at most one row per series and tick,
however many rows one label set has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicelens.functions.times import MICROS, micros
from devicelens.operators.rolling import with_window_buckets

# Ticks of a segment in which a series is ordered at once.
SEGMENT_TICKS = 240


def tick_of(ts: str, step_s: int) -> Column:
    """First grid tick at or after ``ts``, in epoch seconds."""
    step_us = step_s * MICROS
    t = micros(ts)
    up = t + F.pmod(-t, F.lit(step_us))
    return F.floor(up / MICROS).cast("bigint")


def grid(spark, start: str, end: str, step_s: int) -> DataFrame:
    """Evaluation ticks from ``start`` to ``end`` (both included)."""
    return spark.range(1).select(
        F.explode(
            F.sequence(
                F.lit(start).cast("timestamp"),
                F.lit(end).cast("timestamp"),
                F.make_dt_interval(secs=F.lit(step_s)),
            )
        ).alias("ts")
    )


def data_bounds(events: DataFrame, ts: str, step_s: int) -> tuple[Column, Column]:
    """First and last tick of the data as scalar subqueries (no driver round trip)."""
    ticks = events.select(tick_of(ts, step_s).alias("t"))
    return ticks.agg(F.min("t")).scalar(), ticks.agg(F.max("t")).scalar()


def to_counter(
    events: DataFrame,
    labels: list[str],
    ts: str = "timestamp",
    step_s: int = 15,
    start_s: int | Column | None = None,
    end_s: int | Column | None = None,
    increment: Column | None = None,
) -> DataFrame:
    """Events -> cumulative count per label set, one sample per tick, gaps filled.

    Every label set seen anywhere in the data has samples on the whole grid (0 before its first
    event).  Only ticks with events are shuffled and ordered.
    """
    if start_s is None or end_s is None:
        low, high = data_bounds(events, ts, step_s)
        start_s, end_s = (low if start_s is None else start_s), (high if end_s is None else end_s)
    amount = F.sum(F.lit(1) if increment is None else increment)
    per_tick = (
        events.withColumn("_tick", tick_of(ts, step_s))
        .groupBy(*labels, "_tick")
        .agg(amount.cast("double").alias("_n"))
    )
    return fill_counter(per_tick, labels, step_s, start_s, end_s)


def fill_counter(
    per_tick: DataFrame,
    labels: list[str],
    step_s: int,
    start_s: int | Column,
    end_s: int | Column,
    segment_ticks: int = SEGMENT_TICKS,
) -> DataFrame:
    """Increments ``(labels, _tick, _n)``, one per series and tick -> samples on the grid.

    A series is cut into time segments.  Ticks are ordered and summed inside (series, segment); a segment's
    summary (its total and its at most ``segment_ticks`` ticks) is all that is ordered along the series, so a
    series without labels is ordered by segments and not by ticks.  A gap is filled segment by segment.
    """
    start = (F.lit(start_s) if isinstance(start_s, int) else start_s).cast("bigint")
    end = (F.lit(end_s) if isinstance(end_s, int) else end_s).cast("bigint")
    step, span = F.lit(step_s).cast("bigint"), step_s * segment_ticks
    segment = lambda t: F.floor(t / span).cast("bigint")
    key = F.struct(*labels) if labels else F.struct(F.lit(0).alias("none"))

    inside = Window.partitionBy("_key", "_seg").orderBy("_tick")
    summed = (
        per_tick.select(key.alias("_key"), segment(F.col("_tick")).alias("_seg"), "_tick", "_n")
        .repartition("_key", "_seg")
        .withColumn("_cum", F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_key", "_seg")
        .agg(
            F.sum("_n").alias("_total"),
            F.array_sort(F.collect_list(F.struct(F.col("_tick").alias("t"), F.col("_cum").alias("v")))).alias("_runs"),
        )
    )
    along = Window.partitionBy("_key").orderBy("_seg")
    none = F.array().cast("array<struct<t:bigint,v:double>>")
    low, high = segment(start), segment(end)
    carried = (
        summed.withColumn("_low", low)
        .withColumn("_high", high)
        .withColumn(
            "_before", F.coalesce(F.sum("_total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        )
        .withColumn("_opens", F.lag("_seg").over(along).isNull())
        .withColumn("_upto", F.coalesce(F.lead("_seg").over(along) - 1, F.col("_high")))
    )

    def quiet(first: Column, last: Column, value: Column, when: Column) -> Column:
        """Segments without events."""
        numbers = F.when(when & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda n: F.struct(n.alias("seg"), value.alias("carry"), none.alias("runs")))

    seg = F.col("_seg")
    every = F.concat(
        quiet(F.col("_low"), seg - 1, F.lit(0.0), F.col("_opens")),
        F.array(F.struct(seg.alias("seg"), F.col("_before").alias("carry"), F.col("_runs").alias("runs"))),
        quiet(seg + 1, F.col("_upto"), F.col("_before") + F.col("_total"), F.lit(True)),
    )
    first = F.greatest(F.col("_s.seg") * span, F.ceil(start / step).cast("bigint") * step)
    last = F.least((F.col("_s.seg") + 1) * span - step, end)
    points = F.concat(
        F.array(F.struct(first.alias("t"), F.col("_s.carry").alias("v"))),
        F.transform("_s.runs", lambda x: F.struct(x["t"].alias("t"), (F.col("_s.carry") + x["v"]).alias("v"))),
    )

    def held(point: Column, index: Column) -> Column:
        """A value from its tick to the next one."""
        following = F.get("_points", index + 1)["t"] - step
        until = F.least(F.coalesce(following, F.col("_last")), F.col("_last"))
        ticks = F.when(point["t"] <= until, F.sequence(point["t"], until, step)).otherwise(
            F.array().cast("array<bigint>")
        )
        return F.transform(ticks, lambda t: F.struct(t.alias("t"), point["v"].alias("v")))

    names = [f"_key.{c}" for c in labels]
    return (
        carried.select("_key", F.explode(every).alias("_s"))
        .select("_key", points.alias("_points"), last.alias("_last"))
        .select("_key", F.explode(F.flatten(F.transform("_points", held))).alias("_p"))
        .select(*names, F.timestamp_seconds("_p.t").alias("ts"), F.col("_p.v").alias("value"))
    )


def rate(
    samples: DataFrame,
    labels: list[str],
    range_s: int = 300,
    extrapolate: bool = True,
) -> DataFrame:
    """Per-second increase over (t - range_s, t] at every sample time, counter resets corrected.

    A drop in value means the counter restarted from 0.  At least two samples are needed.  With
    ``extrapolate`` the increase is stretched to the edges of the range as in the public
    definition; without it the result is increase / range.

    A series is cut into overlapping time buckets (a long or dense one is many tasks).  Inside a
    bucket the counter is made continuous with a running sum of its resets, so an increase is one
    difference; the first sample of each range is carried along by an event at the time its
    predecessor leaves.  Work is linear in the samples, with one shuffle.
    """
    range_us = range_s * MICROS
    copies = with_window_buckets(
        samples.select(*labels, "ts", "value", micros("ts").alias("_t")), "_t", range_us
    ).repartition(*labels, "_bucket")
    ordered = Window.partitionBy(*labels, "_bucket").orderBy("_t")
    prev = F.lag("value").over(ordered)
    resets = F.when(F.col("value") < prev, prev).otherwise(F.lit(0.0))
    sample = F.struct("_t", "value", "_cum", "_i")
    numbered = (
        copies.withColumn("_reset", resets)
        .withColumn(
            "_cum",
            F.col("value")
            + F.sum("_reset").over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .withColumn("_i", F.row_number().over(ordered))
        .withColumn("_next", F.lead(sample).over(ordered))
    )
    none = F.lit(None).cast(numbered.schema["_next"].dataType)
    upto = (
        Window.partitionBy(*labels, "_bucket")
        .orderBy("_at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    events = numbered.select(
        *labels,
        "_bucket",
        "_home",
        "ts",
        F.inline(
            F.array(
                F.struct(F.col("_t").alias("_at"), sample.alias("_s"), none.alias("_left")),
                F.struct(
                    (F.col("_t") + range_us).alias("_at"), none.alias("_s"), F.col("_next").alias("_left")
                ),
            )
        ),
    )
    first = F.coalesce(
        F.last("_left", ignorenulls=True).over(upto), F.first("_s", ignorenulls=True).over(upto)
    )
    windowed = (
        events.withColumn("_f", first)
        .filter(F.col("_s").isNotNull() & F.col("_home") & (F.col("_s._i") > F.col("_f._i")))
        .select(
            *labels,
            "ts",
            (F.col("_s._i") - F.col("_f._i") + 1).alias("_n"),
            (F.col("_s._cum") - F.col("_f._cum")).alias("_inc"),
            F.col("_f.value").alias("_v0"),
            ((F.col("_s._t") - F.col("_f._t")) / MICROS).alias("_sampled"),
        )
    )
    if not extrapolate:
        return windowed.select(*labels, "ts", (F.col("_inc") / range_s).alias("value"))
    sampled = F.col("_sampled")
    gap = sampled / (F.col("_n") - 1)
    to_start = F.lit(float(range_s)) - sampled
    to_start = F.when(to_start >= gap * 1.1, gap / 2).otherwise(to_start)
    to_zero = F.when(
        (F.col("_inc") > 0) & (F.col("_v0") >= 0), sampled * F.col("_v0") / F.col("_inc")
    )
    to_start = F.coalesce(F.least(to_start, to_zero), to_start)
    # Evaluated at sample times, so there is nothing to stretch at the end.
    return windowed.select(
        *labels,
        "ts",
        (F.col("_inc") * ((sampled + to_start) / sampled) / range_s).alias("value"),
    )


def sum_by(series: DataFrame, labels: list[str] | tuple[str, ...] = ()) -> DataFrame:
    return series.groupBy(*labels, "ts").agg(F.sum("value").alias("value"))


def match(series: DataFrame, **patterns: str) -> DataFrame:
    """Label matchers; patterns are anchored regular expressions, plain text is equality."""
    for label, pattern in patterns.items():
        plain = pattern.replace("-", "").replace("_", "").replace("/", "").isalnum()
        series = series.filter(
            F.col(label) == pattern if plain else F.col(label).rlike(f"^(?:{pattern})$")
        )
    return series


def clamp_min(series: DataFrame, floor: float) -> DataFrame:
    return series.withColumn("value", F.greatest("value", F.lit(floor)))


def binary_op(
    left: DataFrame, right: DataFrame, op, on: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """One-to-one matching on ts and the labels ``on``; ``op`` combines the two values.

    A missing (NULL) label matches a missing one.
    """
    other = _matching(right, on).select("_on", F.col("value").alias("_right"))
    return (
        _matching(left, on)
        .join(other, "_on")
        .withColumn("value", op(F.col("value"), F.col("_right")))
        .select(left.columns)
    )


def _matching(series: DataFrame, on: list[str] | tuple[str, ...]) -> DataFrame:
    """The matching key as one struct: its NULL fields are equal, unlike NULL columns."""
    return series.withColumn("_on", F.struct("ts", *on))


def add(left: DataFrame, right: DataFrame, on=()) -> DataFrame:
    return binary_op(left, right, lambda a, b: a + b, on)


def ratio(left: DataFrame, right: DataFrame, floor: float, on=()) -> DataFrame:
    """left / clamp_min(right, floor)."""
    return binary_op(left, right, lambda a, b: a / F.greatest(b, F.lit(floor)), on)


def offset(series: DataFrame, seconds: int) -> DataFrame:
    """The value ``seconds`` earlier, at each tick."""
    return series.withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.lit(seconds)))


def compare(series: DataFrame, op: str, bound: float) -> DataFrame:
    """Comparison as a filter (keeps the left value)."""
    value = F.col("value")
    tests = {
        ">": value > bound,
        ">=": value >= bound,
        "<": value < bound,
        "<=": value <= bound,
        "==": value == bound,
        "!=": value != bound,
    }
    return series.filter(tests[op])


def v_and(left: DataFrame, right: DataFrame, on: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Left elements that have a match; ``on=()`` matches on the tick alone."""
    other = _matching(right, on).select("_on").distinct()
    return _matching(left, on).join(other, "_on", "left_semi").select(left.columns)


def v_or(left: DataFrame, right: DataFrame, on: list[str] | tuple[str, ...]) -> DataFrame:
    """All of left, plus the right elements without a match in left."""
    known = _matching(left, on).select("_on").distinct()
    extra = _matching(right, on).join(known, "_on", "left_anti").select(right.columns)
    return left.unionByName(extra, allowMissingColumns=True)


def instant(
    samples: DataFrame, labels: list[str], step_s: int = 15, lookback_s: int = 300
) -> DataFrame:
    """Value of each series at every tick: its latest sample within the look-back.

    Only the last sample in front of a tick can be seen there, so samples are first reduced to one
    per series and tick; that one is copied to the ticks it can serve (look-back / step of them, a
    constant) and the newest per tick wins.  There is no range join.
    """
    t = micros("ts")
    # Ticks t' with ts <= t' < ts + lookback.
    last = F.floor((F.col("_t") + lookback_s * MICROS - 1) / MICROS / step_s).cast("bigint") * step_s
    first = F.col("_first")
    ticks = F.when(first <= last, F.sequence(first, last, F.lit(step_s).cast("bigint")))
    return (
        samples.withColumn("_t", t)
        .groupBy(*labels, tick_of("ts", step_s).alias("_first"))
        .agg(F.max("_t").alias("_t"), F.max_by("value", "_t").alias("value"))
        .withColumn("_tick", F.explode(ticks))
        .groupBy(*labels, "_tick")
        .agg(F.max_by("value", "_t").alias("value"))
        .select(*labels, F.timestamp_seconds("_tick").alias("ts"), "value")
    )


def total(counter: DataFrame, labels: list[str], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Latest cumulative value per series, summed."""
    latest = counter.groupBy(*labels).agg(F.max_by("value", "ts").alias("value"))
    return latest.groupBy(*by).agg(F.sum("value").alias("value"))


def union_series(*series: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), series)
