"""What the operators of this package share: table reading, lineage cuts, row filters."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, which all executors share.

    Only a local session that names none gets a scratch folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-checkpoint-")
        context.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    root = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 modulo 4; a missing id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def keep_rows(docs: DataFrame, kept: DataFrame, key: Column, once: bool = False) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is among ``kept["key"]``, all their columns unchanged.

    ``key`` must not be null (a struct of nullable columns is a good key).  With ``once`` one row of
    each key comes.  The rows travel as one struct, so no column name can clash.
    """
    found = docs.select(key.alias("key"), F.struct("*").alias("row")).join(kept.select("key"), "key", "left_semi")
    if once:
        place = F.row_number().over(Window.partitionBy("key").orderBy("key"))
        found = found.withColumn("place", place).where("place = 1")
    return found.select("row.*")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` (text or binary) holds about ``limit`` bytes in each.

    A single longer value still comes whole.
    """
    for batch in batches:
        lengths = batch.column(column)
        size = np.asarray(
            pc.fill_null(pc.binary_length(lengths), 0), dtype=np.int64
        )
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
