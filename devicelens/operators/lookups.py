"""Filtered, ordered, paged lookups and updates of the result tables.

Filters are plain conjunctions on the stored columns, so they reach the scan; order + limit is a
distributed top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_rows(
    df: DataFrame,
    equals: dict[str, object] | None = None,
    ts: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Optional equality filters and the half-open range [start, end)."""
    for name, value in (equals or {}).items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    if ts is not None:
        kind = df.schema[ts].dataType
        # Cast the bound, not the column: a cast column cannot be pushed into the scan.
        if start is not None:
            df = df.filter(F.col(ts) >= F.lit(start).cast(kind))
        if end is not None:
            df = df.filter(F.col(ts) < F.lit(end).cast(kind))
    return df


def page(
    df: DataFrame,
    newest: str,
    tie: str,
    limit: int | None,
    offset: int = 0,
    max_limit: int | None = None,
) -> DataFrame:
    """Newest rows first; ``tie`` makes the order total.

    ``limit=None`` returns all rows.  A limit below 1 or above the caller's own ``max_limit`` is an
    error, never silently changed.
    """
    if limit is not None and (limit < 1 or (max_limit is not None and limit > max_limit)):
        raise ValueError(f"limit {limit} is not between 1 and {max_limit or 'any number'}")
    if offset < 0:
        raise ValueError("offset is negative")
    ordered = df.orderBy(F.col(newest).desc(), F.col(tie).asc())
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def total_count(df: DataFrame) -> DataFrame:
    """Size of the whole result under the page's filters."""
    return df.groupBy().agg(F.count(F.lit(1)).alias("total"))


def by_id(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def query_telemetry(
    readings: DataFrame,
    device_id=None,
    metric_type=None,
    start=None,
    end=None,
    limit: int | None = 100,
    offset: int = 0,
    ts: str = "timestamp",
    max_limit: int | None = None,
) -> DataFrame:
    rows = select_rows(
        readings, {"device_id": device_id, "metric_type": metric_type}, ts, start, end
    )
    return page(rows, ts, "event_id", limit, offset, max_limit)


def query_dlq(
    dlq: DataFrame,
    limit: int | None = 100,
    offset: int = 0,
    tie: str = "event_id",
    max_limit: int | None = None,
) -> DataFrame:
    return page(dlq, "failed_at", tie, limit, offset, max_limit)


def query_anomalies(
    anomalies: DataFrame,
    device_id=None,
    severity=None,
    status=None,
    start=None,
    end=None,
    limit: int | None = 100,
    offset: int = 0,
    tie: str = "anomaly_id",
    max_limit: int | None = None,
) -> DataFrame:
    rows = select_rows(
        anomalies,
        {"device_id": device_id, "severity": severity, "status": status},
        "detected_at",
        start,
        end,
    )
    return page(rows, "detected_at", tie, limit, offset, max_limit)


def query_incidents(
    incidents: DataFrame,
    severity=None,
    failure_category=None,
    limit: int | None = 100,
    offset: int = 0,
    max_limit: int | None = None,
) -> DataFrame:
    rows = select_rows(incidents, {"severity": severity, "failure_category": failure_category})
    return page(rows, "ingested_at", "incident_id", limit, offset, max_limit)


def query_devices(devices: DataFrame, device_type=None) -> DataFrame:
    """No limit: the whole registry of a type, newest first."""
    return select_rows(devices, {"device_type": device_type}).orderBy(
        F.col("registered_at").desc(), "device_id"
    )


def query_alerts(
    episodes: DataFrame,
    status=None,
    severity=None,
    pipeline=None,
    limit: int | None = 50,
    offset: int = 0,
    tie: str = "fingerprint",
    max_limit: int | None = None,
) -> DataFrame:
    rows = select_rows(
        episodes, {"status": status, "severity": severity, "pipeline": pipeline}
    )
    return page(rows, "received_at", tie, limit, offset, max_limit)


def active_alerts(episodes: DataFrame, tie: str = "fingerprint") -> DataFrame:
    return episodes.filter(F.col("status") == "firing").orderBy(
        F.col("started_at").desc(), tie
    )


def list_monitors(monitors: DataFrame) -> DataFrame:
    return monitors.orderBy(F.col("created_at").desc(), "id")


def latest_per(df: DataFrame, key: str, order: Column, keep: list[str]) -> DataFrame:
    """Latest row per key as a partial aggregate (no per-key sort)."""
    return df.groupBy(key).agg(F.max_by(F.struct(*keep), order).alias("_l")).select(key, "_l.*")


def diagnosis_status(anomalies: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Each anomaly with its latest diagnosis; status 'pending' until there is one."""
    newest = latest_per(
        diagnoses,
        "anomaly_id",
        F.struct("generated_at", "diagnosis_id"),
        ["diagnosis_id", "root_cause_summary", "confidence_score", "generated_at"],
    )
    return anomalies.join(newest, "anomaly_id", "left").withColumn(
        "diagnosis_status",
        F.when(F.col("diagnosis_id").isNull(), "pending").otherwise("complete"),
    )


ANOMALY_STATES = ("open", "acknowledged", "resolved")


def apply_status_updates(
    anomalies: DataFrame, updates: DataFrame, order: str = "updated_at"
) -> tuple[DataFrame, DataFrame]:
    """(anomalies with the last valid status, rejected updates with a reason)."""
    known = updates.join(
        anomalies.select("anomaly_id").withColumn("_known", F.lit(True)), "anomaly_id", "left"
    )
    judged = known.withColumn(
        "reason",
        F.when(
            ~F.coalesce(F.col("new_status").isin(*ANOMALY_STATES), F.lit(False)), "invalid_status"
        ).when(F.col("_known").isNull(), "not_found"),
    ).drop("_known")
    last = latest_per(
        judged.filter(F.col("reason").isNull()), "anomaly_id", F.col(order), ["new_status"]
    )
    updated = (
        anomalies.join(last, "anomaly_id", "left")
        .withColumn("status", F.coalesce("new_status", "status"))
        .drop("new_status")
    )
    return updated, judged.filter(F.col("reason").isNotNull())


def register_devices(df: DataFrame, now: Column) -> DataFrame:
    """New registry rows with defaults; the id is a hash of the record."""
    return df.select(
        F.sha2(F.concat_ws("|", "device_name", "device_type", "location"), 256).alias("device_id"),
        "device_name",
        "device_type",
        "location",
        "firmware_version",
        (
            F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
            if "metadata" in df.columns
            else F.create_map().cast("map<string,string>")
        ).alias("metadata"),
        now.alias("registered_at"),
        now.alias("updated_at"),
    )


def top_per_key(
    df: DataFrame, key: str, newest: str, tie: str, n: int, total: str = "total"
) -> DataFrame:
    """The ``n`` newest rows per key, with the size of the key's whole group.

    ``row_number <= n`` is applied before the shuffle as well (group limit), so at most ``n`` rows
    per key and task travel; the totals are a separate partial aggregate.
    """
    ranked = Window.partitionBy(key).orderBy(F.col(newest).desc(), F.col(tie).asc())
    top = df.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(total))
    return top.join(counts, key)
