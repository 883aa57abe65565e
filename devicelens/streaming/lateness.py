"""How late readings arrive, to choose a watermark from a batch of history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from devicelens.functions.times import MICROS, micros


def delay_classes(
    df: DataFrame,
    keys: list[str],
    arrival: str,
    ts: str = "timestamp",
    delay_s: int = 600,
    segment: int = 100_000,
) -> DataFrame:
    """``bucket``: 'newest', 'behind' or 'late' (beyond ``delay_s``), in arrival order per key.

    The running maximum is split into segments of the arrival number, with the maximum of the
    earlier segments carried in, so a busy key is not one task.
    """
    # The keys as one struct, so that NULL keys find their carried value.
    parts = (
        df.withColumn("_t", micros(ts))
        .withColumn("_seg", F.floor(F.col(arrival) / segment).cast("bigint"))
        .withColumn("_key", F.struct(*keys))
    )
    across = (
        Window.partitionBy("_key").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        parts.groupBy("_key", "_seg")
        .agg(F.max("_t").alias("_top"))
        .select("_key", "_seg", F.max("_top").over(across).alias("_carry"))
    )
    inside = (
        Window.partitionBy("_key", "_seg").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = parts.repartition("_key", "_seg").join(carry, ["_key", "_seg"])
    newest = F.greatest(F.max("_t").over(inside), F.coalesce("_carry", F.col("_t")))
    return (
        joined.withColumn("_delay", newest - F.col("_t"))
        .withColumn(
            "bucket",
            F.when(F.col("_delay") > delay_s * MICROS, "late")
            .when(F.col("_delay") > 0, "behind")
            .otherwise("newest"),
        )
        .drop("_t", "_seg", "_key", "_carry", "_delay")
    )
