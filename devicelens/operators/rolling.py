"""Rolling-window statistics over (t - window, t] per key.

Three ways to compute the same numbers:

``slots`` (default)
    The window is cut into ``slots`` equal time slots.  A reading's window is then the head of its
    own slot, the full slots in between and the tail of the oldest slot.  Head and tail are running
    aggregates inside one (key, slot), the full slots are a partial aggregate.  Work per reading is
    constant however dense a key is, and a task holds one slot of one key, so a key with a third
    of all rows is spread over time.
``frame``
    The window as two running aggregates: time is cut into buckets one window long, and the readings
    of the bucket before enter a bucket too, moved by one window, so a reading's window is what its
    own bucket holds up to it and what of the bucket before leaves after it.  One shuffle; work per
    reading is constant, a task holds one window of one key.
``plain``
    The RANGE frame over the whole key; the definition the other two are tested against.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicelens.functions.times import MICROS, micros, slot_of

STATS = ("window_count", "mean", "stddev", "min_value", "max_value")


def with_window_buckets(df: DataFrame, t_us: str, window_us: int, span: int = 4) -> DataFrame:
    """Copy each row into every time bucket whose readings can see it.

    A bucket is ``span`` windows long; rows of its last window are repeated in the next bucket, so a
    RANGE frame of up to one window is complete inside a bucket.  ``_home`` marks the original.
    """
    width = window_us * span
    bucket = slot_of(F.col(t_us), width)
    late = F.pmod(F.col(t_us), F.lit(width)) >= F.lit(width - window_us)
    return (
        df.withColumn("_b0", bucket)
        .withColumn(
            "_bucket",
            F.explode(
                F.when(late, F.array(F.col("_b0"), F.col("_b0") + 1)).otherwise(
                    F.array(F.col("_b0"))
                )
            ),
        )
        .withColumn("_home", F.col("_bucket") == F.col("_b0"))
        .drop("_b0")
    )


def _framed(df: DataFrame, value: str, window: Window) -> DataFrame:
    n = F.count(value).over(window)
    low, high = F.min(value).over(window), F.max(value).over(window)
    return (
        df.withColumn("window_count", n)
        .withColumn("mean", F.avg(value).over(window))
        .withColumn("min_value", low)
        .withColumn("max_value", high)
        .withColumn(
            "stddev",
            F.when(F.col("min_value") == F.col("max_value"), F.lit(0.0)).otherwise(
                F.stddev_pop(value).over(window)
            ),
        )
    )


def _moments(value: str, window: Window | None = None) -> Column:
    """struct(n, mean, m2, lo, hi) as an aggregate, or over a window."""
    parts = {
        "n": F.count(value),
        "mean": F.avg(value),
        "m2": F.var_pop(value),
        "lo": F.min(value),
        "hi": F.max(value),
    }
    if window is not None:
        parts = {name: agg.over(window) for name, agg in parts.items()}
    parts["m2"] = parts["m2"] * parts["n"]
    return F.struct(*[col.alias(name) for name, col in parts.items()])


def _merge(parts: Column) -> Column:
    """Merge an array of moment structs without subtracting large sums."""
    n = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + p["n"])
    mean = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["n"] * p["mean"]) / F.nullif(n, F.lit(0))
    return F.struct(
        n.alias("n"),
        mean.alias("mean"),
        F.aggregate(
            parts,
            F.lit(0.0),
            lambda a, p: a + p["m2"] + p["n"] * (p["mean"] - mean) * (p["mean"] - mean),
        ).alias("m2"),
        F.array_min(F.transform(parts, lambda p: p["lo"])).alias("lo"),
        F.array_max(F.transform(parts, lambda p: p["hi"])).alias("hi"),
    )


def _slotted(
    df: DataFrame, keys: list[str], t_us: str, value: str, window_us: int, slots: int
) -> DataFrame:
    if window_us % slots:
        raise ValueError(f"{slots} slots do not divide the window")
    width = window_us // slots
    payload = [c for c in df.columns if c not in (*keys, t_us, value)]
    slotted = df.withColumn("_s", slot_of(F.col(t_us), width))

    # Full slots, once per (key, slot): slots s-B+1 .. s-1, and the whole of slot s-B.  A second
    # scan of the key, time and value columns only, combined before it is shuffled.
    per_slot = slotted.groupBy(*keys, "_s").agg(_moments(value).alias("m"))
    ordered = Window.partitionBy(*keys).orderBy("_s")
    between = F.collect_list("m").over(ordered.rangeBetween(-(slots - 1), -1))
    oldest = F.collect_list("m").over(ordered.rangeBetween(-slots, -slots))
    moment = per_slot.schema["m"].dataType
    number = df.schema[value].dataType
    row = F.struct(*(payload or [value]))
    opening = per_slot.select(
        *keys,
        "_s",
        (F.col("_s") * width - 1).alias(t_us),
        F.lit(None).cast(number).alias(value),
        F.lit(None).cast(slotted.select(row.alias("x")).schema["x"].dataType).alias("_row"),
        F.when(F.size(between) > 0, _merge(between)).alias("mid"),
        F.get(oldest, F.lit(0)).alias("tail"),
    )

    # Each reading enters its own slot and, one window later, leaves the slot B further on.  When
    # it leaves, what remains of its slot is the part strictly after it.
    after = (
        Window.partitionBy(*keys, "_s")
        .orderBy(F.col(t_us).desc())
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    none = F.lit(None).cast(moment)
    steps = F.array(
        F.struct(
            F.col("_s").alias("_s"),
            F.col(t_us).alias(t_us),
            F.col(value).alias(value),
            F.col("_row").alias("_row"),
            none.alias("tail"),
        ),
        F.struct(
            (F.col("_s") + slots).alias("_s"),
            (F.col(t_us) + window_us).alias(t_us),
            F.lit(None).cast(number).alias(value),
            F.lit(None).cast(slotted.select(row.alias("x")).schema["x"].dataType).alias("_row"),
            F.col("_after").alias("tail"),
        ),
    )
    moves = (
        # Hash on the slot too: otherwise an upstream shuffle on the key alone would be reused.
        slotted.repartition(*keys, "_s")
        .select(*keys, "_s", t_us, value, row.alias("_row"), _moments(value, after).alias("_after"))
        .select(*keys, F.inline(steps))
        .withColumn("mid", none)
    )
    events = moves.unionByName(opening).repartition(*keys, "_s")
    upto = (
        Window.partitionBy(*keys, "_s")
        .orderBy(t_us)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    combined = (
        events.select(
            *keys,
            t_us,
            value,
            "_row",
            _moments(value, upto).alias("_head"),
            F.last("mid", ignorenulls=True).over(upto).alias("_mid"),
            F.last("tail", ignorenulls=True).over(upto).alias("_tail"),
        )
        .filter(F.col("_row").isNotNull())
    )
    return _combine(combined, ["_head", "_mid", "_tail"]).select(
        *keys, t_us, value, *[F.col(f"_row.{c}").alias(c) for c in payload], *STATS
    )


def _settled(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns behind a generator, so that later filters read them instead of copying their
    expressions (repeated copies outgrow the limit of generated code)."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def _combine(df: DataFrame, names: list[str]) -> DataFrame:
    """Add the statistics of several moment structs (NULL or empty ones count nothing).

    Plain arithmetic: it stays inside generated code, and no large sums are subtracted.
    """
    n = [F.coalesce(F.col(f"{name}.n"), F.lit(0)) for name in names]
    m = [F.coalesce(F.col(f"{name}.mean"), F.lit(0.0)) for name in names]
    q = [F.coalesce(F.col(f"{name}.m2"), F.lit(0.0)) for name in names]

    def total(columns: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, columns)

    some = F.nullif(total(n), F.lit(0))
    counted = _settled(
        df,
        total(n).alias("window_count"),
        (total([a * b for a, b in zip(n, m)]) / some).alias("mean"),
        F.least(*[F.col(f"{name}.lo") for name in names]).alias("min_value"),
        F.greatest(*[F.col(f"{name}.hi") for name in names]).alias("max_value"),
    )
    away = [b - F.col("mean") for b in m]
    spread = total(q) + total([a * d * d for a, d in zip(n, away)])
    return _settled(
        counted,
        F.when(F.col("min_value") == F.col("max_value"), F.lit(0.0))
        .otherwise(F.sqrt(spread / F.nullif(F.col("window_count"), F.lit(0))))
        .alias("stddev"),
    )


def _two_halves(df: DataFrame, keys: list[str], t_us: str, value: str, window_us: int) -> DataFrame:
    """Readings with a time, each with the statistics of its window from the two buckets it spans."""
    payload = [c for c in df.columns if c not in (*keys, t_us)]
    row, number = F.struct(*payload), df.schema[value].dataType
    timed = df.filter(F.col(t_us).isNotNull())
    none = F.lit(None).cast(timed.select(row.alias("x")).schema["x"].dataType)
    missing = F.lit(None).cast(number)
    bucket = slot_of(F.col(t_us), window_us)
    steps = F.array(
        F.struct(
            bucket.alias("_bucket"),
            F.col(t_us).alias(t_us),
            F.col(value).alias("_enters"),
            missing.alias("_leaves"),
            row.alias("_row"),
        ),
        F.struct(
            (bucket + 1).alias("_bucket"),
            (F.col(t_us) + window_us).alias(t_us),
            missing.alias("_enters"),
            F.col(value).alias("_leaves"),
            none.alias("_row"),
        ),
    )
    events = timed.select(*keys, F.inline(steps)).repartition(*keys, "_bucket")
    own = Window.partitionBy(*keys, "_bucket")
    upto = own.orderBy(t_us).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = own.orderBy(F.col(t_us).desc()).rangeBetween(Window.unboundedPreceding, -1)
    halves = (
        events.select(
            *keys, t_us, "_row", _moments("_enters", upto).alias("_head"), _moments("_leaves", after).alias("_tail")
        )
        .filter(F.col("_row").isNotNull())
        # Taken apart below the generators of _combine, which must not prune inside it.
        .select(*keys, t_us, *[F.col(f"_row.`{c}`").alias(c) for c in payload], "_head", "_tail")
    )
    return _combine(halves, ["_head", "_tail"]).select(*keys, t_us, *payload, *STATS)


def rolling_stats(
    df: DataFrame,
    keys: list[str] | tuple[str, ...] = ("device_id", "metric_type"),
    ts: str = "timestamp",
    value: str = "value",
    window_s: int = 300,
    dedupe: bool = False,
    method: str = "slots",
    slots: int = 10,
) -> DataFrame:
    """Add count, mean, population stddev, min and max of the window (t - window_s, t].

    The reading itself is included and readings of equal time see each other.  With ``dedupe`` the
    copies of one reading (same key, time and value, NULLs alike) count once, and each copy is
    still scored.  NULL values are not counted.
    """
    keys = list(keys)
    if dedupe:
        # One copy of each reading carries its value; the others see it like any other reading.
        copies = Window.partitionBy(*keys, ts, value).orderBy(ts)
        once = F.when(F.row_number().over(copies) == 1, F.col(value))
        stats = rolling_stats(
            df.withColumn("_once", once), keys, ts, "_once", window_s, False, method, slots
        )
        return stats.select(*df.columns, *STATS)
    window_us = window_s * MICROS
    timed = df.withColumn("_t", micros(ts))
    ordered = ["_t"]
    if method == "slots":
        out = _slotted(timed, keys, "_t", value, window_us, slots)
    elif method == "frame":
        out = _two_halves(timed, keys, "_t", value, window_us)
    elif method == "plain":
        window = (
            Window.partitionBy(*keys)
            .orderBy(*ordered)
            .rangeBetween(-(window_us - 1), Window.currentRow)
        )
        out = _framed(timed, value, window)
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.select(*df.columns, *STATS)
