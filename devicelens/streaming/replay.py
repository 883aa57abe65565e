"""A table played through a streaming operator to its end, in slices of time that resume each other's state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from devicelens.functions.times import micros


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see; a scratch folder for a local session without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="replay-")


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def _only_data_batches(spark: SparkSession) -> Iterator[None]:
    """Queries started inside run no batch without rows; a query keeps the setting it was started with."""
    before = spark.conf.get(NO_DATA, None)
    spark.conf.set(NO_DATA, "false")
    try:
        yield
    finally:
        spark.conf.unset(NO_DATA) if before is None else spark.conf.set(NO_DATA, before)


def replay(
    rows: DataFrame,
    time: str,
    operator: Callable[[DataFrame], DataFrame],
    slices: int = 2,
    slice_rows: int = 4_000_000,
) -> DataFrame:
    """What ``operator`` emits when ``rows`` arrive as a stream in ``slices`` equal spans of ``time``.

    Each span is written as files, then a query of the operator runs until it has read them all and stops; the next one
    resumes from the same checkpoint, so state passes through the state store.  The rows are computed once.
    More than ``slice_rows`` rows a span make more spans, so a key's rows of one batch stay bounded as the table grows.
    Output is append mode, in a table of the shared folder.  Rows without a time come first; a table without
    rows is one empty span.  No batch runs without rows: an operator with timeouts by the clock asks for one after every
    batch, and a query that runs until all is read would never end.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    at = micros(time)
    low, high, n = stored.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    slices = 1 if low is None else max(slices, -(-n // slice_rows))
    span = 1 if low is None else max(1, -((low - high - 1) // slices))
    number = F.coalesce(F.least(F.floor((at - F.lit(low)) / span), F.lit(slices - 1)), F.lit(0))
    # Cut once: each span is then read by itself.
    stored.withColumn("_slice", number.cast("int")).write.partitionBy("_slice").parquet(f"{folder}/spans")
    spans = spark.read.schema(StructType([*rows.schema.fields, StructField("_slice", IntegerType())])).parquet(
        f"{folder}/spans"
    )
    for part in range(slices):
        spans.filter(F.col("_slice") == part).drop("_slice").write.mode("append").parquet(f"{folder}/in")
        found = operator(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        with _only_data_batches(spark):
            query = (
                found.writeStream.format("parquet")
                .option("checkpointLocation", f"{folder}/checkpoint")
                .trigger(availableNow=True)
                .start(f"{folder}/out")
            )
        query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")
