"""z-score, severity and expected range as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from devicelens.config import CODE_PROFILE, SeverityProfile


def z_score(value: Column, mean: Column, stddev: Column) -> Column:
    return F.when(stddev == 0, F.lit(0.0)).otherwise((value - mean) / stddev)


def classify(z: Column, profile: SeverityProfile = CODE_PROFILE) -> Column:
    """Severity of |z|; bounds are inclusive, NULL below the lowest."""
    size = F.abs(z)
    return (
        F.when(size >= profile.critical, "critical")
        .when(size >= profile.high, "high")
        .when(size >= profile.medium, "medium")
        .when(size >= profile.low, "low")
    )


def round4(value: Column) -> Column:
    """Four digits, half up; ten digits first, so that float noise does not decide a tie."""
    return F.round(F.round(value, 10), 4)


def expected_range(
    mean: Column, stddev: Column, count: Column, profile: SeverityProfile = CODE_PROFILE
) -> Column:
    margin = stddev * F.lit(profile.low)
    return F.struct(
        round4(mean).alias("mean"),
        round4(stddev).alias("stddev"),
        round4(mean - margin).alias("lower"),
        round4(mean + margin).alias("upper"),
        count.cast("bigint").alias("window_count"),
    )
