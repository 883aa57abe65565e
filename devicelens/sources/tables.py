"""Batch readers and writers of the remaining tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelens import schemas
from devicelens.operators.monitors import monitors_to_rules


def parse_incidents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(incidents, failed files) of ``(source_path, content)`` rows, one JSON object each.

    A file that is not a JSON object is a failed one, with ``reason``.  ``source_file`` is the
    path's last part; the id hashes the whole path, so equal names in two folders stay apart.
    """
    judged = files.select(
        "*",
        F.explode(
            F.array(
                F.struct(
                    F.try_parse_json("content").alias("doc"),
                    F.from_json("content", schemas.INCIDENT).alias("record"),
                )
            )
        ).alias("_r"),
    ).withColumn(
        "reason",
        F.when(F.col("_r.doc").isNull(), "invalid_json").when(
            ~F.schema_of_variant("_r.doc").startswith("OBJECT"), "not_an_object"
        ),
    )
    good = judged.filter(F.col("reason").isNull()).select(
        "_r.record.*",
        F.substring_index("source_path", "/", -1).alias("source_file"),
        F.sha2("source_path", 256).alias("incident_id"),
    )
    return good, judged.filter(F.col("reason").isNotNull()).select("source_path", "reason")


def incident_files(spark: SparkSession, path: str) -> DataFrame:
    """``(source_path, content)``: whole files."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("content")
    )


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incident documents, one JSON file each; ``source_file`` gives the order of the files.

    Files that cannot be read are the second result of :func:`parse_incidents`.
    """
    return parse_incidents(incident_files(spark, path))[0]


def read_samples(spark: SparkSession, path: str, metric: str | None = None) -> DataFrame:
    """Scraped samples ``(metric, labels, ts, value)``, partitioned by metric."""
    df = spark.read.schema(schemas.SAMPLE).parquet(path)
    return df if metric is None else df.filter(F.col("metric") == metric)


def write_samples(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("metric").parquet(path)


def label_columns(samples: DataFrame, *labels: str) -> DataFrame:
    """Label map -> typed label columns, the form the series algebra works on."""
    return samples.select(
        *[F.col("labels").getItem(name).alias(name) for name in labels], "ts", "value"
    )


def load_rules(monitors: DataFrame) -> DataFrame:
    return monitors_to_rules(monitors)


def write_diagnoses(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
