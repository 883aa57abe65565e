"""Operator 10: SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Fingerprints are computed in Arrow batches.  The distinct ones form a binary trie; its upper
levels are cells (fingerprint prefixes) and only cell pairs whose prefixes differ in few enough bits
meet.  In a task two subtries are walked together: a node pair carries the bits that differ so far and is
dropped as soon as they exceed the budget.  Pairs of subtrees that are one component already
are dropped too, and a task returns a spanning forest of the links it found, so that a dense group
costs no more output rows than it has members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelens.llm.common import cut, keep_rows, slices
from devicelens.llm.components import components

SHINGLE, DISTANCE, SEED, BITS = 3, 3, 42, 64
CELL_ROWS = 16_384
MOST_TASKS = 50_000  # tasks that pairs of cells are dealt to
BLOCK = 1 << 16  # shingles hashed and counted at a time
FRONT = 1 << 18  # node pairs expanded at a time


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: A-Z lowered, words between ASCII white space, repeats counted."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.array(
            [digest(joined[i:j], SEED) for i, j in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])],
            dtype="<u8",
        )
        # Bits are added in bytes, 255 shingles at a time: a byte holds the sum.
        full = np.zeros((-(-len(hashes) // 255) * 255, 8), np.uint8)
        full[: len(hashes)] = hashes.view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(full, axis=1, bitorder="little").reshape(-1, 255, BITS)
        ones += np.add.reduce(bits, axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): a signed long holding the 64 bits of every row's whole text (null: zero)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values = [fingerprint(x, shingle) for x in batch.column("text").to_pylist()]
            fps = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp bigint"
    )


class Trie:
    """Levels of the binary trie over sorted distinct fingerprints that share their first ``top`` bits.

    ``child[d]`` has the two children of every node (-1: none), ``start`` and ``size`` its leaves.
    """

    def __init__(self, values: np.ndarray, top: int, depth: int) -> None:
        self.values = values
        start = np.zeros(1, np.int64)
        self.child, self.start, self.size = [], [], []
        for level in range(top, depth + 1):
            size = np.diff(np.append(start, len(values)))
            self.start.append(start)
            self.size.append(size)
            if level == depth:
                break
            bit = ((values >> np.uint64(BITS - 1 - level)) & np.uint64(1)).astype(np.int64)
            slot = np.repeat(np.arange(len(start)), size) * 2 + bit
            start = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            child = np.full(2 * len(size), -1, np.int64)
            child[slot[start]] = np.arange(len(start))
            self.child.append(child.reshape(-1, 2))


def _depth(values: np.ndarray) -> int:
    """Bits that tell all the sorted distinct values apart."""
    if len(values) < 2:
        return 0
    least = int((values[1:] ^ values[:-1]).min())
    return BITS + 1 - least.bit_length()


def _union(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Join the sets of u and v; every entry then points at the least member of its set."""
    while True:
        a, b = root[u], root[v]
        differ = a != b
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def link_forest(a: np.ndarray, b: np.ndarray | None, top: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all values within ``distance`` bits: of ``a`` alone, or between a and b.

    ``a`` and ``b`` are sorted distinct unsigned values; those of one side share ``top`` bits.
    """
    same = b is None
    both = a if same else np.concatenate([a, b])
    root = np.arange(len(both))
    if not len(a) or (not same and not len(b)):
        return both[:0], both[:0]
    depth = max(_depth(a), top) if same else max(_depth(a), _depth(b), top)
    left = Trie(a, top, depth)
    right = left if same else Trie(b, top, depth)
    shift = 0 if same else len(a)
    differ = 0
    if not same and top:
        head = np.uint64(BITS - top)
        differ = int(np.bitwise_count((a[0] >> head) ^ (b[0] >> head)))
    if differ > distance:
        return both[:0], both[:0]
    zero = np.zeros(1, np.int64)
    # (level, nodes of a, nodes of b, differing bits so far); twin: both are the same node
    stack = [(0, zero, zero, np.full(1, differ, np.int8), same)]
    linked, seen = 0, {}

    def whole(trie: Trie, level: int, offset: int, side: int) -> np.ndarray:
        """The set that holds a node's leaves, or -1 if they are in several."""
        if seen.get((side, level), (-1,))[0] != linked:
            own, start = root[offset : offset + len(trie.values)], trie.start[level]
            least, most = np.minimum.reduceat(own, start), np.maximum.reduceat(own, start)
            seen[side, level] = (linked, np.where(least == most, least, -1))
        return seen[side, level][1]

    while stack:
        level, x, y, d, twin = stack.pop()
        if len(x) > FRONT:
            for at in range(0, len(x), FRONT):
                stack.append((level, x[at : at + FRONT], y[at : at + FRONT], d[at : at + FRONT], twin))
            continue
        if linked:
            p, q = whole(left, level, 0, 0)[x], whole(right, level, shift, 0 if same else 1)[y]
            open_ = (p == -1) | (p != q)
            x, y, d = x[open_], y[open_], d[open_]
        if twin:
            many = left.size[level][x] > 1
            x, y, d = x[many], y[many], d[many]
        else:
            leaf = (left.size[level][x] == 1) & (right.size[level][y] == 1)
            i, j = left.start[level][x[leaf]], right.start[level][y[leaf]]
            near = np.bitwise_count(left.values[i] ^ right.values[j]) <= distance
            if near.any():
                root = _union(root, i[near], j[near] + shift)
                linked += 1
            x, y, d = x[~leaf], y[~leaf], d[~leaf]
        if not len(x):
            continue
        cx, cy = left.child[level][x], right.child[level][y]
        across, straight = [], []
        for p in (0, 1):
            for q in (0, 1):
                if twin and p > q:
                    continue
                bits = d + np.int8(p != q)
                ok = (cx[:, p] >= 0) & (cy[:, q] >= 0) & (bits <= distance)
                (straight if twin and p == q else across).append((cx[ok, p], cy[ok, q], bits[ok]))
        # Last in, first out: what lies inside one node is walked before what crosses it.
        for parts, is_twin in ((across, False), (straight, True)):
            if parts:
                nx, ny, nd = (np.concatenate(c) for c in zip(*parts))
                if len(nx):
                    stack.append((level + 1, nx, ny, nd, is_twin))
    far = np.flatnonzero(root != np.arange(len(root)))
    return both[far], both[root[far]]


def near_links(
    values: DataFrame, distance: int = DISTANCE, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all within ``distance`` bits.

    Cells are prefixes chosen so that one holds about ``cell_rows`` values; a fuller cell is
    dealt into parts by hash and all its parts meet.  A part is one row that holds an array, and a task
    walks a few pairs of parts.
    """
    total = values.count()
    top = min(20, max(0, math.ceil(math.log2(max(total, 1) / cell_rows))))
    cell = F.shiftrightunsigned("fp", BITS - top).cast("int") if top else F.lit(0)
    masks = [sum(1 << i for i in c) for k in range(min(distance, top) + 1) for c in combinations(range(top), k)]
    cells = values.withColumn("cell", cell)
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(cell_rows)).cast("int").alias("parts"))
    blocks = (
        cells.join(parts, "cell")
        .withColumn("part", F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("parts")).cast("int"))
        .groupBy("cell", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )
    others = blocks.select(
        F.col("cell").alias("other"), F.col("part").alias("other_part"), F.col("fps").alias("other_fps")
    )
    pairs = 1 + total * len(masks) // (8 * cell_rows)
    meet = (
        blocks.withColumn("other", F.explode(F.array(*[F.lit(m).bitwiseXOR(F.col("cell")) for m in masks])))
        .where("other >= cell")
        .join(others, "other")
        .where("other > cell or other_part >= part")
        .repartition(min(pairs, MOST_TASKS), "cell", "part", "other", "other_part")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                a, b = (
                    np.sort(one.column(name).flatten().to_numpy().view(np.uint64))
                    for name in ("fps", "other_fps")
                )
                same = all(
                    one.column(x)[0] == one.column(y)[0] for x, y in (("cell", "other"), ("part", "other_part"))
                )
                u, v = link_forest(a, None if same else b, top, distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["a", "b"]
                )

    return meet.mapInArrow(join, "a bigint, b bigint")


def simhash_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp): one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over fingerprints at most ``distance`` bits
    apart.  Null, empty and blank texts have fingerprint zero and link like any other.  Rows
    that repeat come back repeated; rows without doc_id take part in linking but never
    name a component unless they are alone (then it is null).
    """
    prints = cut(fingerprints(docs, doc_id, text, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(near_links(classes.select("fp"), distance, cell_rows))
    placed = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "fp",
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id, its columns as they came.

    A row without doc_id stays only if its whole group has none.
    """
    kept = (
        simhash_groups(docs, doc_id, text)
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select(F.struct("doc_id").alias("key"))
    )
    return keep_rows(docs, kept, F.struct(F.col(doc_id).alias("doc_id")))
