"""Device enrichment and registry checks.

No broadcast hint is given: the registry grows with the fleet, so the join strategy is left to the
planner, which broadcasts only below its size threshold and otherwise shuffles (adaptive execution
splits a device that holds a large share of the readings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def device_attributes(devices: DataFrame) -> DataFrame:
    return devices.select(
        "device_id",
        blank_to_null(F.col("device_type")).alias("device_type"),
        blank_to_null(F.col("location")).alias("device_location"),
        blank_to_null(F.col("firmware_version")).alias("firmware_version"),
    )


def enrich(readings: DataFrame, devices: DataFrame) -> DataFrame:
    """Readings of registered devices with the device attributes."""
    return readings.join(device_attributes(devices), "device_id", "inner")


def split_unknown_devices(
    readings: DataFrame, devices: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(readings of registered devices, readings of unknown devices)."""
    ids = devices.select("device_id")
    return readings.join(ids, "device_id", "left_semi"), readings.join(ids, "device_id", "left_anti")


def enrich_or_mark(readings: DataFrame, devices: DataFrame) -> DataFrame:
    """Enrichment that keeps unknown devices, marked ``known = false``.

    One join instead of an inner and an anti join, for jobs that need both branches.
    """
    attributes = device_attributes(devices).withColumn("_known", F.lit(True))
    return (
        readings.join(attributes, "device_id", "left")
        .withColumn("known", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )
