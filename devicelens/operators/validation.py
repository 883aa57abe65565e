"""Record checks.  Each splits its input into accepted rows and rejects with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelens.functions.times import micros

# The accepted metrics, severities and alert states.
METRICS = ("temperature", "humidity", "pressure", "cpu_usage")
SEVERITIES = ("low", "medium", "high", "critical")
ALERT_STATES = ("firing", "resolved")
ALERT_SEVERITIES = ("critical", "warning", "info", "unknown")

UUID_PATTERN = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
LONG_PATTERN = r"^-?\d+$"
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def first_failure(*checks: tuple[str, Column]) -> Column:
    """Name of the first check that does not hold (an unknown outcome fails), NULL if all do."""
    out = F.lit(None).cast("string")
    for name, passes in reversed(checks):
        out = F.when(F.coalesce(passes, F.lit(False)), out).otherwise(F.lit(name))
    return out


def _split(checked: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    return checked.filter(F.col(reason).isNull()).drop(reason), checked.filter(
        F.col(reason).isNotNull()
    )


def parse_time(text: Column) -> Column:
    """ISO text or epoch seconds -> timestamp, NULL if neither."""
    return F.when(text.rlike(ISO_PATTERN), text.try_cast("timestamp")).otherwise(
        F.timestamp_micros((text.try_cast("double") * 1_000_000).try_cast("bigint"))
    )


def check_raw(df: DataFrame, payload: str = "payload", id_kind: str = "uuid") -> DataFrame:
    """Parse raw JSON readings; ``reason`` names the first failed check, NULL if the row is good.

    Numeric text is accepted as a number.  The metric name and finiteness are not checked here.
    """
    # Parse once: behind a generator, filters on the outcome cannot copy the parser into themselves.
    parsed = (
        df.select("*", F.explode(F.array(F.try_parse_json(F.col(payload)))).alias("_doc"))
        .withColumn("_kind", F.schema_of_variant("_doc"))
        .withColumn("_id", F.try_variant_get("_doc", "$.device_id", "string"))
        .withColumn("_metric", F.try_variant_get("_doc", "$.metric_type", "string"))
        .withColumn("_value", F.try_variant_get("_doc", "$.value", "string"))
        .withColumn("_time", F.try_variant_get("_doc", "$.timestamp", "string"))
        .withColumn("_meta", F.try_variant_get("_doc", "$.metadata", "variant"))
        .withColumn("value", F.col("_value").try_cast("double"))
        .withColumn("timestamp", parse_time(F.col("_time")))
    )
    pattern = UUID_PATTERN if id_kind == "uuid" else LONG_PATTERN
    reason = first_failure(
        ("invalid_json", F.col("_doc").isNotNull()),
        ("not_an_object", F.col("_kind").startswith("OBJECT")),
        ("missing_device_id", F.col("_id").isNotNull()),
        ("missing_metric_type", F.col("_metric").isNotNull()),
        ("missing_value", F.col("_value").isNotNull()),
        ("missing_timestamp", F.col("_time").isNotNull()),
        ("invalid_device_id", F.col("_id").rlike(pattern)),
        ("invalid_value", F.col("value").isNotNull()),
        ("invalid_timestamp", F.col("timestamp").isNotNull()),
        (
            "invalid_metadata",
            F.col("_meta").isNull() | F.schema_of_variant("_meta").startswith("OBJECT"),
        ),
    )
    id_type = "string" if id_kind == "uuid" else "bigint"
    return (
        parsed.withColumn("reason", reason)
        .withColumn("device_id", F.col("_id").try_cast(id_type))
        .withColumn("metric_type", F.col("_metric"))
        .withColumn(
            "metadata",
            F.coalesce(
                F.try_variant_get("_doc", "$.metadata", "map<string,string>"),
                F.create_map().cast("map<string,string>"),
            ),
        )
        .drop("_doc", "_kind", "_id", "_metric", "_value", "_time", "_meta")
    )


def validate_raw(
    df: DataFrame, payload: str = "payload", id_kind: str = "uuid"
) -> tuple[DataFrame, DataFrame]:
    """(good readings, rejects with ``reason``)."""
    return _split(check_raw(df, payload, id_kind))


def accept_failure(allowed_metrics: tuple[str, ...] = METRICS) -> Column:
    """Strict accept-time check: known metric, finite value, name length 1-100."""
    value = F.col("value")
    return first_failure(
        ("metric_length", F.length("metric_type").between(1, 100)),
        ("unknown_metric", F.col("metric_type").isin(*allowed_metrics)),
        ("not_finite", ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))),
    )


def validate_accept(
    df: DataFrame, allowed_metrics: tuple[str, ...] = METRICS
) -> tuple[DataFrame, DataFrame]:
    return _split(df.withColumn("reason", accept_failure(allowed_metrics)))


def _optional_length(name: str, limit: int) -> Column:
    return F.col(name).isNull() | (F.length(name) <= limit)


def device_failure() -> Column:
    return first_failure(
        ("device_name", F.length("device_name").between(1, 255)),
        ("device_type", F.length("device_type").between(1, 100)),
        ("location", _optional_length("location", 255)),
        ("firmware_version", _optional_length("firmware_version", 50)),
    )


def validate_devices(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df.withColumn("reason", device_failure()))


def incident_failure() -> Column:
    return first_failure(
        ("title", F.length("title").between(1, 500)),
        ("description", F.length("description") >= 10),
        ("affected_device_types", F.size("affected_device_types") >= 1),
        ("root_cause", F.length("root_cause") >= 10),
        ("resolution_steps", F.size("resolution_steps") >= 1),
        ("severity", F.col("severity").isin(*SEVERITIES)),
        ("failure_category", F.length("failure_category").between(1, 100)),
    )


def validate_incidents(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df.withColumn("reason", incident_failure()))


def alert_failure() -> Column:
    return first_failure(
        ("invalid_status", F.col("status").isin(*ALERT_STATES)),
        ("invalid_severity", F.col("severity").isin(*ALERT_SEVERITIES)),
    )


def validate_alerts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df.withColumn("reason", alert_failure()))


def with_event_id(df: DataFrame, *source: str) -> DataFrame:
    """Deterministic event id, so a redelivered reading gets the id it had before.

    ``source`` may add a source position (topic, partition, offset) where two equal readings have
    to stay apart.
    """
    return df.withColumn(
        "event_id",
        F.sha2(
            F.concat_ws(
                "|",
                F.col("device_id").cast("string"),
                F.col("metric_type"),
                micros("timestamp").cast("string"),
                F.col("value").cast("string"),
                *[F.col(c).cast("string") for c in source],
            ),
            256,
        ),
    )
