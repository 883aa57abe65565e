"""Alert webhook bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelens import schemas


def webhook_rejects(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Bodies without an alert, all columns kept, with ``error_type``.

    ``invalid_json``: NULL or not JSON; ``invalid_body``: JSON whose ``alerts`` is no list;
    ``no_alerts``: an empty list.  Together with :func:`explode_webhooks` every body is accounted for.
    """
    body = F.try_parse_json(payload)
    alerts = F.from_json(payload, schemas.WEBHOOK)["alerts"]
    kind = (
        F.when(body.isNull(), "invalid_json")
        .when(alerts.isNull(), "invalid_body")
        .when(F.size(alerts) == 0, "no_alerts")
    )
    # Behind a generator the body is judged once.
    judged = df.select("*", F.explode(F.array(kind)).alias("error_type"))
    return judged.filter(F.col("error_type").isNotNull())


def explode_webhooks(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per alert of each body; the other input columns are kept.

    Bodies that hold no alert are the rows of :func:`webhook_rejects`.
    """
    keep = [c for c in df.columns if c != payload]
    return (
        df.withColumn("_w", F.from_json(payload, schemas.WEBHOOK))
        .withColumn("_a", F.explode("_w.alerts"))
        .select(
            *keep,
            F.col("_w.receiver").alias("receiver"),
            F.col("_w.status").alias("group_status"),
            F.col("_a.status").alias("status"),
            F.coalesce("_a.labels", F.create_map().cast("map<string,string>")).alias("labels"),
            F.coalesce("_a.annotations", F.create_map().cast("map<string,string>")).alias(
                "annotations"
            ),
            F.col("_a.startsAt").alias("startsAt"),
            F.col("_a.endsAt").alias("endsAt"),
            F.coalesce("_a.generatorURL", F.lit("")).alias("generator_url"),
            F.coalesce("_a.fingerprint", F.lit("")).alias("fingerprint"),
        )
    )
