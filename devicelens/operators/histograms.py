"""Histogram bucketing and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelens.operators.series import data_bounds, tick_of, to_counter

INF = float("inf")

# Bucket bounds of the four histograms.
HTTP_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
DIAGNOSIS_BUCKETS = (1.0, 2.5, 5.0, 10.0, 15.0, 20.0, 30.0, 45.0, 60.0, 90.0, 120.0)
DELIVERY_BUCKETS = (0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
TRIAGE_BUCKETS = (1.0, 2.5, 5.0, 10.0, 15.0, 20.0, 30.0, 45.0, 60.0)


def to_buckets(
    df: DataFrame, labels: list[str], value: str, bounds: tuple[float, ...]
) -> DataFrame:
    """Cumulative counts per ``le`` with total sum and count, one pass over the rows."""
    every = (*bounds, INF)
    counts = F.array(
        *[
            F.struct(
                F.lit(le).alias("le"), F.count_if(F.col(value) <= F.lit(le)).alias("cumulative")
            )
            for le in every
        ]
    )
    return (
        df.groupBy(*labels)
        .agg(
            counts.alias("_b"),
            F.sum(value).alias("total"),
            F.count(value).alias("n"),
        )
        .select(*labels, F.explode("_b").alias("_e"), "total", "n")
        .select(*labels, "_e.le", "_e.cumulative", "total", "n")
    )


def bucket_counter(
    df: DataFrame,
    labels: list[str],
    value: str,
    bounds: tuple[float, ...],
    ts: str = "timestamp",
    step_s: int = 15,
    start_s=None,
    end_s=None,
) -> DataFrame:
    """Cumulative bucket counters on the grid: ``(labels, le, ts, value)``.

    Each row is counted once per (labels, tick) and bound by conditional aggregation; only the
    aggregated ticks are unfolded into buckets.
    """
    every = (*bounds, INF)
    if start_s is None or end_s is None:
        start_s, end_s = data_bounds(df, ts, step_s)
    per_tick = (
        df.withColumn("_tick", tick_of(ts, step_s))
        .groupBy(*labels, "_tick")
        .agg(
            F.array(
                *[
                    F.struct(
                        F.lit(le).alias("le"), F.count_if(F.col(value) <= F.lit(le)).alias("n")
                    )
                    for le in every
                ]
            ).alias("_b")
        )
        .select(*labels, F.timestamp_seconds("_tick").alias(ts), F.explode("_b").alias("_e"))
        .select(*labels, ts, "_e.le", "_e.n")
    )
    return to_counter(per_tick, [*labels, "le"], ts, step_s, start_s, end_s, F.col("n"))


def quantile_of(cells: Column, q: float) -> Column:
    """The q-quantile of cumulative buckets, an array of (le, cum) sorted by le.

    The value is found by linear interpolation inside the bucket that holds rank q * total.  Each bucket is raised to
    the largest one below it first, as rates of cumulative buckets may dip slightly.  The first bucket starts at 0, a rank
    in the last (+Inf) bucket gives the highest finite bound, no observations give NULL.
    """
    start = F.struct(F.lit(0.0).alias("le"), F.lit(0.0).alias("cum"))
    top = F.array_max(F.transform(cells, lambda c: c["cum"]))
    # Along the buckets: the last one that stays below the rank, and the first one that reaches it.
    empty = F.struct(start.alias("low"), F.lit(None).cast("struct<le:double,cum:double>").alias("here"))

    def step(found: Column, cell: Column) -> Column:
        raised = F.struct(cell["le"].alias("le"), F.greatest(cell["cum"], found["low"]["cum"]).alias("cum"))
        below = raised["cum"] < top * q
        return F.when(found["here"].isNotNull(), found).otherwise(
            F.struct(
                F.when(below, raised).otherwise(found["low"]).alias("low"),
                F.when(~below, raised).alias("here"),
            )
        )

    def value(found: Column) -> Column:
        low, here = found["low"], found["here"]
        share = (top * q - low["cum"]) / F.nullif(here["cum"] - low["cum"], F.lit(0.0))
        return (
            F.when(top <= 0, F.lit(None).cast("double"))
            .when(here["le"] == INF, low["le"])
            .otherwise(low["le"] + (here["le"] - low["le"]) * F.coalesce(share, F.lit(0.0)))
        )

    return F.aggregate(cells, empty, step, value)


def histogram_quantiles(
    series: DataFrame, quantiles: dict[str, float], labels: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """Quantiles by linear interpolation inside the bucket that holds rank q * total.

    ``series`` has ``(labels, le, ts, value)`` with cumulative values; ``quantiles`` maps output
    columns to q.  Rates of cumulative buckets may dip slightly, so each bucket is raised to the
    largest one below it first.  The first bucket starts at 0, a rank in the last (+Inf) bucket gives the highest
    finite bound, no observations give NULL.  A group holds one row per bucket, so the sorted array
    is small, and all quantiles read the same one.
    """
    keys = [*labels, "ts"]
    cells = F.array_sort(F.collect_list(F.struct("le", F.col("value").alias("cum"))))
    out = series.groupBy(*keys).agg(cells.alias("_r"))
    out = out.withColumn(
        "_c",
        F.transform(
            "_r",
            lambda c, i: F.struct(
                c["le"].alias("le"),
                F.array_max(F.transform(F.slice("_r", F.lit(1), i + 1), lambda b: b["cum"])).alias(
                    "cum"
                ),
            ),
        ),
    )
    total = F.element_at("_c", -1)["cum"]
    for name, q in quantiles.items():
        rank = total * q
        out = out.withColumn("_rank", rank).withColumn(
            "_i", F.size(F.filter("_c", lambda c: c["cum"] < F.col("_rank"))) + 1
        )
        here = F.element_at("_c", F.col("_i"))
        below = F.when(F.col("_i") > 1, F.element_at("_c", F.greatest(F.col("_i") - 1, F.lit(1))))
        low = F.coalesce(below["le"], F.lit(0.0))
        low_cum = F.coalesce(below["cum"], F.lit(0.0))
        share = (rank - low_cum) / F.nullif(here["cum"] - low_cum, F.lit(0.0))
        out = out.withColumn(
            name,
            F.when(total <= 0, F.lit(None).cast("double"))
            .when(here["le"] == INF, low)
            .otherwise(low + (here["le"] - low) * F.coalesce(share, F.lit(0.0))),
        )
    return out.select(*keys, *quantiles)


def histogram_quantile(
    series: DataFrame, q: float, labels: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    return histogram_quantiles(series, {"value": q}, labels)
