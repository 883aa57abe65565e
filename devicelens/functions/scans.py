"""Running values over long sequences, split so that no key has to fit in one task.

``lag`` and running sums need an order within a key.  A key that holds a third of the rows would
be one sorted task.  Here every key is cut into time segments: rows are ordered inside (key,
segment) only, and one summary row per segment carries the value across the cut.  The summaries
are a partial aggregate, so their window is small.  ``segment`` must not decrease along ``order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _split(df: DataFrame, keys: list[str], segment: Column) -> DataFrame:
    """The keys as one struct: it joins NULL with NULL, and no keys at all are one key."""
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("none"))
    return df.withColumn("_seg", segment).withColumn("_key", key)


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], value: Column, segment: Column, out: str
) -> DataFrame:
    """``lag(value)`` per key along ``order``."""
    parts = _split(df, keys, segment).withColumn("_v", value)
    last = parts.groupBy("_key", "_seg").agg(
        F.max_by("_v", F.struct(*order)).alias("_last")
    )
    across = Window.partitionBy("_key").orderBy("_seg")
    carry = last.select("_key", "_seg", F.lag("_last").over(across).alias("_carry"))
    inside = Window.partitionBy("_key", "_seg").orderBy(*order)
    joined = parts.repartition("_key", "_seg").join(carry, ["_key", "_seg"])
    return (
        joined.withColumn("_rn", F.row_number().over(inside))
        .withColumn(
            out, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.lag("_v").over(inside))
        )
        .drop("_key", "_seg", "_v", "_carry", "_rn")
    )


def with_running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: Column, segment: Column, out: str
) -> DataFrame:
    """Running sum of ``value`` per key along ``order`` (order must be unique within a key)."""
    parts = _split(df, keys, segment).withColumn("_v", value)
    totals = parts.groupBy("_key", "_seg").agg(F.sum("_v").alias("_total"))
    before = (
        Window.partitionBy("_key")
        .orderBy("_seg")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        "_key", "_seg", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry")
    )
    inside = (
        Window.partitionBy("_key", "_seg")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        parts.repartition("_key", "_seg")
        .join(carry, ["_key", "_seg"])
        .withColumn(out, F.sum("_v").over(inside) + F.col("_carry"))
        .drop("_key", "_seg", "_v", "_carry")
    )


def with_run_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    is_start: Column,
    segment: Column,
    out: str,
) -> DataFrame:
    """Number the runs opened by ``is_start`` (1, 2, ... per key)."""
    flag = F.when(is_start, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return with_running_sum(df, keys, order, flag, segment, out)
