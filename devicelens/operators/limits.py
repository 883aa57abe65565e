"""Sliding-window request limits over a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelens.config import RateLimits
from devicelens.functions.times import MICROS, micros
from devicelens.operators.rolling import rolling_stats


def rate_limit_checks(
    log: DataFrame, cfg: RateLimits = RateLimits(), ts: str = "timestamp", slots: int = 10
) -> DataFrame:
    """Every request with the count of its (user, bucket) in (t - window, t] and the verdict.

    A request is recorded before it is checked, so refused requests use up the budget too.
    ``retry_after`` is the whole seconds until the oldest request leaves the window, at least 1.
    """
    timed = log.withColumn("_at", micros(ts).cast("double"))
    counted = rolling_stats(
        timed, ["user", "bucket"], ts=ts, value="_at", window_s=cfg.window_s, slots=slots
    )
    limit = F.lit(cfg.limits[cfg.default_bucket])
    for bucket, allowed in cfg.limits.items():
        limit = F.when(F.col("bucket") == bucket, F.lit(allowed)).otherwise(limit)
    wait = F.floor((F.col("min_value") - F.col("_at")) / MICROS + cfg.window_s).cast("bigint")
    return counted.select(
        *log.columns,
        F.col("window_count").alias("requests"),
        limit.alias("max_requests"),
        (F.col("window_count") > limit).alias("limited"),
        F.when(F.col("window_count") > limit, F.greatest(wait, F.lit(1))).alias("retry_after"),
    )


def rate_limit_violations(
    log: DataFrame, cfg: RateLimits = RateLimits(), ts: str = "timestamp", slots: int = 10
) -> DataFrame:
    return rate_limit_checks(log, cfg, ts, slots).filter("limited").drop("limited")
