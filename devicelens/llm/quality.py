"""Operator 1: quality scores by nearest-neighbour voting among latent-semantic vectors.

A text becomes square roots of term frequencies: pairs of adjacent characters (letters, digits,
punctuation signs, space, line end, other) and how far its words and word pairs repeat.  A truncated
singular value decomposition of a bounded labelled sample gives the latent space; the
sample's vectors are broadcast, every document's cosine with all of them is computed in blocks, and
its nearest neighbours vote with weights that grow with the cosine.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from devicelens.llm.common import held_out, slices

#: Labelled rows the space is fitted on and that vote: those with the smallest hash of their id.
MAX_LABELLED = 2000
DIMENSIONS, NEIGHBOURS, SHARPNESS, THRESHOLD = 48, 25, 16, 0.7
SYMBOLS = 64
TERMS = SYMBOLS * SYMBOLS + 4
BLOCK = 512  # documents whose term vectors are held at a time


def _symbols() -> bytes:
    """Byte -> symbol: letters by letter, capitals as one, digits as one, each ASCII sign, the rest."""
    kind = np.full(256, 30, np.uint8)
    for i, c in enumerate(string.ascii_lowercase):
        kind[ord(c)] = i
    for c in string.ascii_uppercase:
        kind[ord(c)] = 26
    for c in string.digits:
        kind[ord(c)] = 27
    kind[ord(" ")], kind[ord("\n")] = 28, 29
    for i, c in enumerate(string.punctuation):
        kind[ord(c)] = 31 + i
    kind[128:] = 63
    return kind.tobytes()


_TABLE = _symbols()


def terms(text: str | None) -> np.ndarray:
    """Square roots of the term frequencies of a whole text."""
    out = np.zeros(TERMS, np.float32)
    symbols = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_TABLE), np.uint8)
    if len(symbols) > 1:
        for at in range(0, len(symbols) - 1, 1 << 20):
            part = symbols[at : at + (1 << 20) + 1].astype(np.int32)
            out[:-4] += np.bincount(part[:-1] * SYMBOLS + part[1:], minlength=SYMBOLS * SYMBOLS)
        out[:-4] /= len(symbols) - 1
    words = (text or "").split()
    if words:
        once = len(set(words)) / len(words)
        pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1) if len(words) > 1 else 1
        out[-4:] = 1 - once, once, 1 - pairs, pairs
    return np.sqrt(out)


@dataclass
class Model:
    """Projection (terms x dimensions), the sample's unit vectors and their labels."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, rows: np.ndarray) -> np.ndarray:
        latent = (rows @ self.projection).astype(np.float64)
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        return np.divide(latent, norm, out=np.zeros_like(latent), where=norm > 0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1; a text without a word scores 0, and without any labelled row every other scores 1."""
        blank = np.array([not (t and t.strip()) for t in texts], bool)
        out = np.where(blank, 0.0, 1.0)
        if not len(self.labels):
            return out
        for at in range(0, len(texts), BLOCK):
            rows = np.stack([terms(t) for t in texts[at : at + BLOCK]])
            near = self.project(rows) @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            who = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, who, 1), 1e-3) ** SHARPNESS
            out[at : at + BLOCK] = (weight * self.labels[who]).sum(1) / weight.sum(1)
        return np.where(blank, 0.0, np.clip(out, 0.0, 1.0))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, label: str = "quality") -> Model:
    """Fit on at most ``max_labelled`` labelled rows that are not held out.

    The rows are those whose doc_id has the smallest hash, so the choice depends on neither their
    order nor their number.  Rows without id or label are passed over; a doc_id that repeats counts
    once, with its largest label and smallest text.  The sample's term vectors (16 KB each)
    go to the driver, so ``max_labelled`` bounds them.
    """
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .select("doc_id", F.col("label").cast("double").alias("label"), "text")
    )

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            values = [terms(t).astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(values, pa.binary())],
                names=["doc_id", "label", "terms"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(vectors, f"doc_id {kind}, label double, terms binary").collect()
    found.sort(key=lambda r: r.doc_id)
    votes = np.array([r.label for r in found], np.float64)
    if not len(found):
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1)), votes)
    matrix = np.stack([np.frombuffer(r.terms, np.float16).astype(np.float32) for r in found])
    rarity = np.log((1 + len(found)) / (1 + (matrix > 0).sum(0))) + 1
    weighted = matrix * rarity
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)
    # Right singular vectors through the Gram matrix of the (bounded) sample.
    values, left = np.linalg.eigh((weighted @ weighted.T).astype(np.float64))
    top = np.argsort(values)[::-1][: min(DIMENSIONS, len(values))]
    top = top[values[top] > 1e-9]
    right = weighted.T.astype(np.float64) @ (left[:, top] / np.sqrt(values[top]))
    model = Model((right * rarity[:, None]).astype(np.float32), np.zeros((0, 1)), votes)
    model.vectors = model.project(matrix)
    return model


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on) beside its columns.

    Only the whole text is read for a score.  Null, empty and blank texts score 0; rows that repeat
    score alike.  Existing columns of these names are replaced.
    """
    base = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = base.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = shared.value.score(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return base.mapInArrow(run, T.StructType([*base.schema.fields, *added]))


def drop_low_quality(docs: DataFrame, model: Model) -> DataFrame:
    """Rows whose predicted label is 1, with all their columns as they came, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score = shared.value.score(batch.column(at).to_pylist())
            yield batch.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
