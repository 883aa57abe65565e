"""Operator 2: near-duplicate vectors by sorted projection passes.

Every pass orders the distinct vectors by the concatenated signs of random projections and compares
each with at least its next ``window`` neighbours; pairs that reach the cosine, computed in double
precision, are links.  A window goes on, over any number of vectors, while its last neighbours still hold
links, so a dense run is compared whole.  The number of passes follows from the number of vectors.  Links of all
passes are united.  Equal vectors are one class from the start, so copies cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicelens.llm.common import cut
from devicelens.llm.components import components

PASSES, WINDOW, THRESHOLD, BITS, SEED = 12, 256, 0.9, 62, 29
#: Chance that a link just at the threshold is met in no pass; with ``PASSES`` at least, it sets their number.
MISSED = 0.001
#: Vectors that a task orders into one matrix; a block also gets the first ``window`` of the next.
BLOCK = 4096
#: Where the window of a step of vectors goes on.
MARK = pa.struct([("pass", pa.int32()), ("dim", pa.int32()), ("step", pa.int64()), ("next", pa.int64())])


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def projection_keys(rows: np.ndarray, number: int) -> np.ndarray:
    """The order of one pass: signs of ``BITS`` random projections, the first one highest."""
    planes = np.random.default_rng([SEED, number, rows.shape[1]]).standard_normal((rows.shape[1], BITS))
    weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return ((rows @ planes) > 0) @ weights


def passes_needed(n: int, window: int = WINDOW, threshold: float = THRESHOLD) -> int:
    """Passes over ``n`` vectors that leave a pair at the threshold unmet with a chance of ``MISSED`` at most.

    Such a pair agrees on one sign with the chance 1 - angle / pi, and it meets if it agrees on the first
    signs that split ``n`` vectors into windows.
    """
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    met = same ** max(0.0, math.log2(max(n, 1) / window))
    return PASSES if met >= 1 else max(PASSES, math.ceil(math.log(MISSED) / math.log1p(-met)))


def window_links(
    left: np.ndarray, right: np.ndarray, at: int, sure: int, window: int, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Positions (i, j) in ``left`` and ``right`` whose unit rows reach the cosine, from row ``at`` of ``right`` on.

    ``right`` is compared in steps of ``window`` rows, up to ``sure`` in any case and then to the first step that
    holds no link.  If there is none, the last item is ``None``: the window goes on behind ``right``.
    """
    for start in range(at, len(right), window):
        i, j = np.nonzero(left @ right[start : start + window].T >= threshold)
        if not len(i) and start >= sure:
            return
        yield i, j + start
    yield None


def _ordered(classes: DataFrame, passes: int, kind: str) -> DataFrame:
    """(pass, dim, cls, vector, place): classes numbered along the order of every pass."""
    code = "<f4" if kind == "float" else "<f8"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                cls = batch.column("cls").to_numpy()
                vectors = batch.column("embedding")
                values = vectors.flatten().to_numpy(zero_copy_only=False).astype(code)
                sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                for dim in np.unique(sizes):
                    who = np.flatnonzero(sizes == dim)
                    raw = values[starts[who][:, None] + np.arange(dim)]
                    unit = unit_rows(raw)
                    blobs = pa.array([r.tobytes() for r in raw], pa.binary())
                    for number in range(passes):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(who), number, np.int32)),
                                pa.array(np.full(len(who), dim, np.int32)),
                                pa.array(projection_keys(unit, number)),
                                pa.array(cls[who]),
                                blobs,
                            ],
                            names=["pass", "dim", "key", "cls", "vector"],
                        )

    order = ["pass", "dim", "key", "cls"]
    placed = cut(
        classes.select("cls", "embedding")
        .mapInArrow(keys, "pass int, dim int, key bigint, cls bigint, vector binary")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "pass",
            "dim",
            "cls",
            "vector",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"),
        )
    )
    before = Window.partitionBy("pass", "dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("pass", "dim", "part")
        .agg(F.min("row").alias("least"), F.count("*").alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least"))
        .select("pass", "dim", "part", "offset")
    )
    # One row per partition and per pass that begins in it.
    return placed.join(F.broadcast(offsets), ["pass", "dim", "part"]).select(
        "pass", "dim", "cls", "vector", (F.col("row") + F.col("offset")).alias("place")
    )


def projection_links(
    classes: DataFrame, kind: str, passes: int | None = None, window: int = WINDOW, threshold: float = THRESHOLD
) -> DataFrame:
    """(a, b), a < b: distinct verified links between the classes ``cls`` of (cls, embedding).

    Places are cut into steps of ``window`` and blocks of many steps.  The first round compares every step with
    itself and the ones behind it, as far as its block and the first step of the next one reach; steps whose window
    goes on meet the next block in the next round, until none does.
    """
    if passes is None:
        most = classes.groupBy(F.size("embedding").alias("dim")).count().agg(F.max("count")).first()[0]
        passes = passes_needed(most or 0, window, threshold)
    code = "<f4" if kind == "float" else "<f8"
    size = max(1, BLOCK // window) * window
    placed = _ordered(classes, passes, kind)
    own, after = F.floor(F.col("place") / size), F.floor(F.col("next") / size)
    same = ["pass", "dim"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("place")
        unit = unit_rows(np.frombuffer(b"".join(rows["vector"].to_pylist()), code).reshape(len(rows), -1))
        place, cls, start = (rows[n].to_numpy() for n in ("place", "cls", "start"))
        who = [rows[n][0].as_py() for n in same]
        others = np.flatnonzero(rows["other"].to_numpy())
        right, right_cls, right_place = unit[others], cls[others], place[others]
        mine = np.flatnonzero(start >= 0)
        for step in np.unique(place[mine] // window) if len(others) else ():
            chosen = mine[place[mine] // window == step]
            begin = start[chosen[0]]
            at = int(np.searchsorted(right_place, begin))
            sure = at + 2 * window if begin == step * window else 0
            if at == len(right):
                continue
            for found in window_links(unit[chosen], right, at, sure, window, threshold):
                if found is None:
                    mark = {"pass": who[0], "dim": who[1], "step": int(step), "next": int(right_place[-1]) + 1}
                    columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([mark], MARK)]
                else:
                    ahead = right_place[found[1]] > place[chosen[found[0]]]
                    x, y = cls[chosen[found[0][ahead]]], right_cls[found[1][ahead]]
                    columns = [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(x), MARK)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "mark"])

    def met(dealt: DataFrame) -> DataFrame:
        kind = "a bigint, b bigint, mark struct<pass: int, dim: int, step: bigint, next: bigint>"
        return cut(dealt.groupBy(*same, "block").applyInArrow(compare, kind).distinct())

    columns = [*same, "block", "place", "cls", "vector", "start", "other"]
    early = (F.col("place") % size < window) & (own > 0)
    begin = F.floor(F.col("place") / window) * window
    found = met(
        placed.withColumn("block", F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own))))
        .withColumn("start", F.when(F.col("block") == own, begin).otherwise(F.lit(-1)))
        .withColumn("other", F.lit(True))
        .select(columns)
    )
    parts = []
    while True:
        parts.append(found.where("mark is null").select("a", "b"))
        going = found.where("mark is not null").select("mark.*")
        if going.isEmpty():
            break
        left = placed.withColumn("step", F.floor(F.col("place") / window)).join(going, [*same, "step"])
        left = left.withColumn("block", after).withColumn("start", F.col("next")).withColumn("other", F.lit(False))
        wanted = going.select(*same, after.alias("block")).distinct()
        right = placed.withColumn("block", own).join(wanted, [*same, "block"])
        right = right.withColumn("start", F.lit(-1).cast("bigint")).withColumn("other", F.lit(True))
        found = met(left.select(columns).unionAll(right.select(columns)))
    if len(parts) == 1:
        return parts[0]
    return cut(reduce(DataFrame.unionAll, parts).distinct())


def embedding_groups(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    passes: int | None = None,
    window: int = WINDOW,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per distinct (vec_id, vector).

    Vectors that are null, empty or zero, or hold a null or non-finite component, link with
    nothing; vectors link only with those of their length.  Repeated rows count once.  A null
    vec_id names a component only if no other member has one.
    """
    kind = vectors.schema[embedding].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    base = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("embedding")
    ).distinct()
    good = base.where(usable(F.col("embedding")))
    classes = cut(
        good.groupBy("embedding")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
        .withColumn("cls", F.monotonically_increasing_id())
    )
    links = projection_links(classes, kind, passes, window, threshold)
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = (
        both.join(classes.select(F.col("cls").alias("b"), "n"), "b")
        .groupBy(F.col("a").alias("cls"))
        .agg(F.sum("n").alias("linked"))
    )
    reached = components(links).withColumnRenamed("node", "cls")
    placed = classes.join(reached, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    names = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    done = (
        placed.join(names, "component")
        .join(degrees, "cls", "left")
        .select(
            "embedding",
            (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            "component_id",
        )
    )
    alone = base.where(~usable(F.col("embedding"))).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return (
        good.join(done, "embedding")
        .select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
