"""Incident knowledge base: text assembly, chunking, vectors, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from devicelens.functions.chunks import chunk_text
from devicelens.functions.text import bullets, fill, fixed
from devicelens.functions.vectors import hashed_vectors

#: Queries and chunks of one product within a cell.
CELL_TILE = 4096
#: Cells that a search of some size has, and tasks that cells are dealt to.
LEAST_CELLS = 16
MOST_CELL_TASKS = 2000

def incident_text(df: DataFrame, out: str = "text") -> DataFrame:
    """The text that is chunked and embedded."""
    body = F.concat(
        F.lit("Incident: "),
        F.col("title"),
        F.lit("\n\nDescription: "),
        F.col("description"),
        F.lit("\n\nRoot Cause: "),
        F.col("root_cause"),
        F.lit("\n\nResolution Steps:\n"),
        bullets(F.col("resolution_steps")),
        F.lit("\n\nAffected Device Types: "),
        F.array_join("affected_device_types", ", "),
        F.lit("\nSeverity: "),
        F.col("severity"),
        F.lit("\nCategory: "),
        F.col("failure_category"),
    )
    return df.withColumn(out, body)


def _chunker(text: str, keep: list[str], size: int, overlap: int, rows: int = 128):
    """Cut the texts of a batch, ``rows`` at a time: only their chunks are in Python at once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = [chunk_text(t, size, overlap) for t in part.column(text).to_pylist()]
                source = pa.array([i for i, chunks in enumerate(found) for _ in chunks], pa.int64())
                numbers = pa.array([n for chunks in found for n in range(len(chunks))], pa.int32())
                documents = pa.array([chunk for chunks in found for chunk in chunks], pa.string())
                kept = [part.column(c).take(source) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, numbers, documents], [*keep, "chunk_index", "document"])

    return cut


def chunk_documents(
    df: DataFrame, text: str = "text", size: int = 2048, overlap: int = 200
) -> DataFrame:
    """One row per chunk: input columns without the text, ``chunk_index`` and ``document``.

    A text without need for cutting (shorter than ``size``) is one chunk and never leaves the JVM;
    only long texts go through the Python chunker.
    """
    trimmed = F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", "")
    keep = [c for c in df.columns if c != text]
    short = F.length(text) < size
    whole = (
        df.filter(short)
        .withColumn("document", trimmed)
        .filter(F.col("document") != "")
        .select(*keep, F.lit(0).alias("chunk_index"), "document")
    )
    fields = [f for f in df.schema.fields if f.name != text]
    schema = StructType([*fields, StructField("chunk_index", IntegerType()), StructField("document", StringType())])
    cut = df.filter(~short).select(*keep, text).mapInArrow(_chunker(text, keep, size, overlap), schema)
    return whole.unionByName(cut)


def chunk_rows(chunks: DataFrame, incident_id: str = "incident_id") -> DataFrame:
    """Add the chunk id ``{incident_id}_chunk_{i}``."""
    return chunks.withColumn(
        "chunk_id", F.concat_ws("_chunk_", F.col(incident_id).cast("string"), "chunk_index")
    )


def chunk_counts(chunks: DataFrame, incident_id: str = "incident_id") -> DataFrame:
    return chunks.groupBy(incident_id).agg(F.count(F.lit(1)).alias("chunk_count"))


def attach_embeddings(
    chunks: DataFrame,
    vectors: DataFrame | None = None,
    dim: int = 64,
    text: str = "document",
    key: str = "chunk_id",
) -> DataFrame:
    """Vectors of the chunks: from the ``vectors`` table, else hashed word counts."""
    hashed = hashed_vectors(chunks, text, dim, "_hashed")
    if vectors is None:
        return hashed.withColumnRenamed("_hashed", "embedding")
    given = vectors.select(key, F.col("embedding").cast("array<double>").alias("_given"))
    return (
        hashed.join(given, key, "left")
        .withColumn("embedding", F.coalesce("_given", "_hashed"))
        .drop("_given", "_hashed")
    )


def upsert_chunks(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``new`` replaces ``old`` rows of the same id."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def last_write_wins(writes: DataFrame, order: Column, key: str = "chunk_id") -> DataFrame:
    """State after a log of upserts, as a partial aggregate."""
    rest = [c for c in writes.columns if c != key]
    return writes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_w")).select(
        key, "_w.*"
    )


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1; vectors of length zero, or not a number, are zero."""
    m = np.stack(vectors.to_numpy()).astype("float64")
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _first_copies(vectors: np.ndarray, k: int) -> np.ndarray:
    """The first k rows of every group of equal ones, in order."""
    rows = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    at = np.arange(len(rows))
    return np.sort(_best(group, at, at, k))


def _distances(q: np.ndarray, i: np.ndarray, c: np.ndarray, j: np.ndarray, some: int = 1 << 16) -> np.ndarray:
    """Cosine distances of rows i of q and j of c, pair by pair, so equal vectors get equal ones."""
    parts = [np.einsum("ij,ij->i", q[i[x : x + some]], c[j[x : x + some]]) for x in range(0, len(i), some)]
    return 1.0 - np.concatenate(parts) if parts else np.zeros(0)


def _best(rows: np.ndarray, columns: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k first of their row, by distance (not a number last) and column; in that order."""
    order = np.lexsort((columns, d, rows))
    ordered = rows[order]
    start = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < k]


def _nearest(k: int, tile: int):
    """Top k of one (query block, chunk block) cell, tile by tile.

    A product in single precision finds what may be nearer than the k best so far, with a margin above its error;
    the distances of those are made in double precision, equal for equal vectors.
    """

    def top(queries: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(chunks):
            return pd.DataFrame(
                {"query_id": pd.Series(dtype=object), "chunk_id": pd.Series(dtype=object), "distance": []}
            )
        # Chunks are sorted by id, so the smaller column breaks ties as the global rank does.
        chunks = chunks.sort_values("id", ignore_index=True, kind="stable")
        q, c = _unit(queries["v"]), _unit(chunks["v"])
        # Equal vectors are equally far from all: only the first k of them can be a result.
        first = _first_copies(c, k)
        c, names = c[first], chunks["id"].to_numpy()[first]
        q32, c32 = q.astype("float32"), c.astype("float32")
        # Above the error of a sum of products of unit vectors, in units of the precision.
        margin = 4 * (q.shape[1] + 8)
        parts = []
        for begin in range(0, len(q), tile):
            here = slice(begin, begin + tile)
            n = len(q[here])
            rows = columns = np.zeros(0, "int64")
            d = np.zeros(0)
            at, width = 0, max(k, 16)
            while at < len(c):
                there = slice(at, at + width)
                product = q32[here] @ c32[there].T
                if len(d) < n * k:
                    near = np.ones(product.shape, bool)
                else:
                    worst = d.reshape(n, k)[:, -1:]
                    least = np.where(np.isnan(worst), -np.inf, 1.0 - worst)
                    near = product >= (least - margin * 2.0**-24).astype("float32")
                    if 64 * np.count_nonzero(near) > near.size:
                        near = q[here] @ c[there].T >= least - margin * 2.0**-53
                i, j = np.divmod(np.flatnonzero(near), near.shape[1])
                j += at
                rows, columns = np.append(rows, i), np.append(columns, j)
                d = np.append(d, _distances(q[here], i, c, j))
                keep = _best(rows, columns, d, k)
                rows, columns, d = rows[keep], columns[keep], d[keep]
                # Short tiles first: the next ones are compared with what they found.
                at, width = at + width, min(2 * width, tile)
            parts.append((rows + begin, columns, d))
        rows, columns, d = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"query_id": queries["id"].to_numpy()[rows], "chunk_id": names[columns], "distance": d})

    return top


def cosine_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    query_id: str = "query_id",
    chunk_id: str = "chunk_id",
    vector: str = "embedding",
    query_block: int = 32768,
    chunk_block: int = 32768,
    counts: tuple[int, int] | None = None,
) -> DataFrame:
    """Exact k nearest chunks per query by cosine distance: ``(query, chunk, distance, rank)``.

    Both sides are cut into blocks by a hash of the id and every (query block, chunk block) cell is
    one cogroup that returns only its k best per query.  Neither side is broadcast and no pair is
    materialised, so both may grow; the final rank sees k rows per query and chunk block.  A vector travels
    once per block of the other side, so blocks are as large as a task can hold.
    ``counts`` saves the two counting jobs when the sizes are known.
    """
    n_queries, n_chunks = counts or (queries.count(), chunks.count())
    c_blocks = max(1, ceil(n_chunks / chunk_block))
    # Few cells are made more, as long as a block fills a product.
    more = min(ceil(n_queries / CELL_TILE), ceil(LEAST_CELLS / c_blocks))
    q_blocks = max(1, ceil(n_queries / query_block), more)
    q_type = queries.schema[query_id].dataType.simpleString()
    c_type = chunks.schema[chunk_id].dataType.simpleString()

    def blocks(df: DataFrame, name: str, own: str, n_own: int, other: str, n_other: int):
        return df.select(
            F.col(name).alias("id"),
            F.col(vector).cast("array<double>").alias("v"),
            F.pmod(F.xxhash64(name), F.lit(n_own)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other),
        )

    # A number of partitions keeps the planner from joining cells, which take long for their bytes, in one task.
    tasks = min(q_blocks * c_blocks, MOST_CELL_TASKS)
    left = blocks(queries, query_id, "qb", q_blocks, "cb", c_blocks).repartition(tasks, "qb", "cb")
    right = blocks(chunks, chunk_id, "cb", c_blocks, "qb", q_blocks).repartition(tasks, "qb", "cb")
    near = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(
        _nearest(k, CELL_TILE), f"query_id {q_type}, chunk_id {c_type}, distance double"
    )
    by_query = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return (
        near.withColumn("rank", F.row_number().over(by_query))
        .filter(F.col("rank") <= k)
        .select(
            F.col("query_id").alias(query_id),
            F.col("chunk_id").alias(chunk_id),
            "distance",
            "rank",
        )
    )


def retrieval_text(anomalies: DataFrame, out: str = "query_text") -> DataFrame:
    """Retrieval query of an anomaly."""
    expected = F.col("expected_range")
    text = fill(
        "Anomaly detected: {metric_type} reading of {observed_value} with z-score {z} "
        "({severity} severity) on device type '{device_type}' at location '{device_location}'. "
        "Expected range: mean {mean} with stddev {stddev}.",
        {
            "metric_type": F.col("metric_type"),
            "observed_value": F.col("observed_value"),
            "z": fixed(F.col("z_score"), 2),
            "severity": F.col("severity"),
            "device_type": F.col("device_type"),
            "device_location": F.col("device_location"),
            "mean": expected["mean"],
            "stddev": expected["stddev"],
        },
    )
    return anomalies.withColumn(out, text)
