"""Operator 12: repair of conversation structure by a cost DP and prefix-doubling path ranking.

A conversation's role initials must read ``(s?(ua)+)?``.  Its rows in order and the four states of that pattern
(nothing yet, after s, after u, after a) are the nodes of a layered graph whose arcs are the edits Delete,
Insert, Keep and Rerole.  A cost DP from the end leaves the optimal arcs.  Then nodes are ranked by the least
audit of 1, 2, 4, ... letters that optimal arcs spell from them: the rank for twice the length is that of the pair (rank of
the node, rank where its pointer leads), and the pointers are doubled with it.  Ranks choose the arc of every node, and
the doubled pointers write the whole path down in as many steps as its length has binary digits.

Conversations are dealt to tasks by ranges of (conversation, turn), so a long one spans several segments.  A segment's
edits are a 4 x 4 least-cost matrix between the states at its ends; the matrices of a conversation's
segments are folded from its end (what each end costs) and the chosen exits from its start.  These folds
see a few numbers per segment.  Only the SHA-256 of a repaired conversation needs its rows one after
the other; they stream through a task, sorted by Spark, and are not held.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelens.llm.common import shared_folder

#: Rows of one segment at most.
SEGMENT = 1 << 14
# What edits cost, and their letters in ASCII order.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = b"DIKR"

FAR = 1 << 50
# Role classes by initial: s, u, a, any other.  States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
_NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
_SPOKEN = np.array([2, 2, 3, 2])  # the state after what may be said by a user or an assistant
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_EDGES = np.array([0, 6, 3, 0])  # what the end of a conversation costs in each state: inserts that close it
_BLANK, _DUPLICATE, _CUT = 1, 2, 3  # faults


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code (role class * 4 + fault) and state: Keep's cost and next state, Rerole's cost."""
    keep, to, rerole = np.full((16, 4), FAR), np.zeros((16, 4), np.int64), np.full((16, 4), FAR)
    for code in range(16):
        role, fault = divmod(code, 4)
        if fault in (_BLANK, _DUPLICATE):
            continue
        more = TRUNCATED if fault == _CUT else 0
        rerole[code] = REROLE + more
        for state in range(4):
            if (state, role) in _NEXT:
                keep[code, state], to[code, state] = KEEP + more, _NEXT[state, role]
    return keep, to, rerole


_KEEP_COST, _KEEP_TO, _REROLE_COST = _tables()


def _with_inserts(costs: np.ndarray) -> np.ndarray:
    """Costs in the four states (last axis) if any number of inserts may come first."""
    once = np.minimum(costs, INSERT + costs[..., _SPOKEN])
    return np.minimum(costs, INSERT + once[..., _SPOKEN])


def _before(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs to go in front of rows with ``codes``, from those behind them: (n, ..., 4)."""
    shape = (len(codes), *[1] * (after.ndim - 2), 4)
    keep_to = np.broadcast_to(_KEEP_TO[codes].reshape(shape), after.shape)
    kept = _KEEP_COST[codes].reshape(shape) + np.take_along_axis(after, keep_to, -1)
    rerolled = _REROLE_COST[codes].reshape(shape) + after[..., _SPOKEN]
    return _with_inserts(np.minimum(np.minimum(DELETE + after, kept), rerolled))


def _steps(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the segments, places of their rows), last rows first, for all segments at once."""
    order = np.argsort(-lengths, kind="stable")
    sizes = -lengths[order]
    for back in range(int(lengths.max(initial=0))):
        some = order[: np.searchsorted(sizes, -back, side="left")]
        yield some, lengths[some] - 1 - back


def matrices(codes: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(n, 4, 4): least cost from the state before a segment to the state before the row behind it."""
    costs = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(lengths), 4, 4)).copy()
    for some, place in _steps(lengths):
        costs[some] = np.minimum(_before(codes[firsts[some] + place], costs[some]), FAR)
    return costs.transpose(0, 2, 1)  # rows: the state in front


class Paths(NamedTuple):
    costs: np.ndarray  # (n, 4) to go in each state in front of a segment
    audits: list[list[str]]  # by state in front
    exits: np.ndarray  # (n, 4) states behind


def least_paths(
    codes: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, ends: np.ndarray, last: np.ndarray
) -> Paths:
    """The cheapest, then ASCII-least audits of segments, from each state in front of them.

    ``codes[firsts[i] : firsts[i] + lengths[i]]`` are a segment's rows, ``ends`` what the states behind it
    cost; behind a conversation's ``last`` segment inserts may follow.
    """
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    nodes = int(offsets[-1])
    costs = np.empty((nodes, 4), np.int64)
    costs[offsets[1:] - 1] = ends
    for some, place in _steps(lengths):
        at = offsets[some] + place
        costs[at] = _before(codes[firsts[some] + place], costs[at + 1])

    # Optimal arcs, a column per letter: the node an edit leads to, or -1.
    number = np.repeat(np.arange(len(lengths)), lengths + 1)
    place = np.arange(nodes) - offsets[number]
    row = np.flatnonzero(place < lengths[number])
    code = codes[firsts[number[row]] + place[row]]
    base = (np.arange(nodes) * 4)[:, None]
    arcs = np.full((nodes, 4, 4), -1, np.int64)

    def mark(letter: int, at: np.ndarray, cost: np.ndarray, to: np.ndarray) -> None:
        good = costs[at] == cost + costs.reshape(-1)[to]
        arcs[at, :, letter] = np.where(good, to, -1)

    state = np.arange(4)[None, :]
    behind = base[row] + 4
    mark(0, row, np.full((len(row), 4), DELETE), behind + state)
    mark(2, row, _KEEP_COST[code], behind + _KEEP_TO[code])
    mark(3, row, _REROLE_COST[code], behind + _SPOKEN[None, :])
    inner = np.flatnonzero((place < lengths[number]) | last[number])
    mark(1, inner, np.full((len(inner), 4), INSERT), base[inner] + _SPOKEN[None, :])
    arcs = arcs.reshape(-1, 4)

    # Letters of the arcs of one node differ, so the least letter is the least audit of length 1.
    some = arcs >= 0
    going = some.any(axis=1)
    letter = np.where(going, some.argmax(axis=1) + 1, 0)
    here = np.arange(len(arcs))
    hop = np.where(going, arcs[here, letter - 1], here)
    rank, length = letter, 1
    while going[hop].any():
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[hop], return_inverse=True)[1]
        hop, length = hop[hop], 2 * length
    # The arc of a node: least letter, then least rank of the node it leads to.
    weight = np.where(some, np.arange(1, 5) * (int(rank.max(initial=0)) + 1) + rank[arcs], FAR)
    chosen = weight.argmin(axis=1)
    letter = np.where(going, chosen + 1, 0)
    hop = np.where(going, arcs[here, chosen], here)

    path = (4 * offsets[:-1, None] + state).reshape(-1, 1)
    for _ in range(length.bit_length()):
        path = np.concatenate([path, hop[path]], axis=1)
        hop = hop[hop]
    spelled = np.frombuffer(b"\0" + LETTERS, np.uint8)[letter[path]]
    texts = [line[line > 0].tobytes().decode() for line in spelled]
    return Paths(
        costs[offsets[:-1]], [texts[i : i + 4] for i in range(0, len(texts), 4)], (path[:, -1] & 3).reshape(-1, 4)
    )


def edits(codes: bytes, audit: str, entry: int) -> Iterator[tuple[int, int, str | None]]:
    """(row, order, role) of what an audit leaves: order 2 is the row itself, its role None if kept;
    others are inserts in front of the row."""
    state, row, order = entry, 0, 0
    for letter in audit:
        if letter == "I":
            state = int(_SPOKEN[state])
            yield row, order, ("user", "assistant")[state - 2]
            order += 1
            continue
        if letter == "K":
            state = _NEXT[state, codes[row] // 4]
            yield row, 2, None
        elif letter == "R":
            state = int(_SPOKEN[state])
            yield row, 2, ("user", "assistant")[state - 2]
        row, order = row + 1, 0


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values, nulls included."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def _by_length(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of segments of about the same length, some 200,000 rows at a time."""
    size = np.frexp(lengths.astype(np.float64))[1]
    for of in np.unique(size):
        some = np.flatnonzero(size == of)
        step = max(1, 200_000 >> int(of))
        for at in range(0, len(some), step):
            yield some[at : at + step]


_SEGMENT_SCHEMA = (
    "first bigint, size bigint, codes binary, inner boolean, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, turns bigint, least bigint, most bigint, head_turn bigint, tail_turn bigint, matrix array<bigint>"
)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of facts that come sorted by place; ``inner`` ones are whole conversations."""
    some = [batch for batch in batches if batch.num_rows]
    if not some:
        return
    table = pa.Table.from_batches(some)
    place = table.column("place").to_numpy()
    part = table.column("part").to_numpy()
    code = table.column("code").to_numpy().astype(np.int64)
    turn = table.column("turn").combine_chunks()
    known = turn.is_valid().to_numpy(zero_copy_only=False)
    when = turn.fill_null(0).to_numpy()
    new_part = np.append(True, np.diff(part) != 0)
    opens = np.append(True, np.diff(_numbers(table.column("conv_id"))) != 0) | new_part
    runs = np.append(np.flatnonzero(opens), len(place))
    edge = new_part[runs[:-1]] | np.append(new_part, True)[runs[1:]]  # the part's first or last run
    starts, whole = [], []
    for a, b, border in zip(runs.tolist(), runs[1:].tolist(), edge.tolist()):
        pieces = range(a, b, SEGMENT)
        starts.extend(pieces)
        whole.extend([not border and len(pieces) == 1] * len(pieces))
    starts = np.array(starts)
    ends = np.append(starts[1:], len(place))
    fault, role = code & 3, code >> 2
    legal = np.zeros((4, 4), bool)
    for pair in _LEGAL:
        legal[pair] = True
    bad = np.append(False, ~legal[role[:-1], role[1:]])
    bad[starts] = False
    changed = known & np.append(True, (np.diff(when) != 0) | ~known[:-1])
    changed[starts] = known[starts]

    def total(marks: np.ndarray) -> np.ndarray:
        return np.add.reduceat(marks.astype(np.int64), starts)

    def turns_at(rows: np.ndarray) -> pa.Array:
        return pa.array(when[rows], pa.int64(), mask=~known[rows])

    first_known = np.minimum.reduceat(np.where(known, when, np.iinfo(np.int64).max), starts)
    whole = np.array(whole)
    open_ = np.flatnonzero(~whole)
    found: list[list[int] | None] = [None] * len(starts)
    for number, matrix in zip(open_, matrices(code, starts[open_], (ends - starts)[open_])):
        found[number] = matrix.reshape(-1).tolist()
    codes = code.astype(np.uint8).tobytes()
    rows = {
        "conv_id": table.column("conv_id").combine_chunks().take(pa.array(starts)),
        "first": pa.array(place[starts]),
        "size": pa.array(ends - starts),
        "codes": pa.array([codes[a:b] for a, b in zip(starts, ends)], pa.binary()),
        "inner": pa.array(whole),
        "blank": pa.array(total(fault == _BLANK)),
        "duplicate": pa.array(total(fault == _DUPLICATE)),
        "truncated": pa.array(total(fault == _CUT)),
        "illegal": pa.array(total(bad)),
        "turns": pa.array(total(changed)),
        "least": pa.array(first_known, mask=~np.logical_or.reduceat(known, starts)),
        "most": turns_at(ends - 1),
        "head_turn": turns_at(starts),
        "tail_turn": turns_at(ends - 1),
        "matrix": pa.array(found, pa.list_(pa.int64())),
    }
    yield pa.RecordBatch.from_pydict(rows)


def _fold_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the states behind each segment cost; segments of a conversation come last one first."""
    conv, costs = object(), None
    for batch in batches:
        firsts, ends, lasts = [], [], []
        for row in batch.to_pylist():
            last = row["conv_id"] != conv
            after = _EDGES if last else costs
            firsts.append(row["first"])
            ends.append(after.tolist())
            lasts.append(last)
            matrix = np.array(row["matrix"], np.int64).reshape(4, 4)
            conv, costs = row["conv_id"], (matrix + after[None, :]).min(axis=1)
        yield pa.RecordBatch.from_pydict({"first": firsts, "ends": ends, "last": lasts})


def _fold_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in front of each segment, and what happens at the seam; segments come in order."""
    before: dict | None = None
    state = 0
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            opens = before is None or before["conv_id"] != row["conv_id"]
            state = 0 if opens else before["exits"][state]
            pair = None if opens else (before["codes"][-1] >> 2, row["codes"][0] >> 2)
            same = not opens and row["head_turn"] is not None and before["tail_turn"] == row["head_turn"]
            rows.append(
                {
                    "first": row["first"],
                    "entry": state,
                    "opens": opens,
                    "seam_illegal": int(pair is not None and pair not in _LEGAL),
                    "seam_same": int(same),
                }
            )
            before = row
        yield pa.RecordBatch.from_pylist(
            rows,
            pa.schema(
                [("first", pa.int64()), ("entry", pa.int32()), ("opens", pa.bool_())]
                + [("seam_illegal", pa.int64()), ("seam_same", pa.int64())]
            ),
        )


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column("size").to_numpy()
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).astype(np.int64)
        firsts = np.cumsum(size) - size
        last = batch.column("last").fill_null(True).to_numpy(zero_copy_only=False)
        ends = np.array([e or _EDGES.tolist() for e in batch.column("ends").to_pylist()], np.int64)
        costs = np.zeros(len(size), np.int64)
        audits: list[list[str]] = [[]] * len(size)
        exits = np.zeros((len(size), 4), np.int32)
        for some in _by_length(size):
            found = least_paths(codes, firsts[some], size[some], ends[some], last[some])
            costs[some], exits[some] = found.costs[:, 0], found.exits
            for number, texts in zip(some, found.audits):
                audits[number] = texts
        yield pa.RecordBatch.from_pydict(
            {
                "first": batch.column("first"),
                "cost": pa.array(costs),
                "audits": pa.array(audits, pa.list_(pa.string())),
                "exits": pa.array(exits.tolist(), pa.list_(pa.int32())),
            }
        )


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields = ["conv_id", "place", "part_order", "new_role"]
        kinds = [batch.column("conv_id").type, pa.int64(), pa.int32(), pa.string()]
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=fields)

        columns = [batch.column(c).to_pylist() for c in ("conv_id", "first", "codes", "audit", "entry")]
        for conv, first, codes, audit, entry in zip(*columns):
            rows.extend((conv, first + row, order, role) for row, order, role in edits(codes, audit, entry))
            if len(rows) > 50_000:
                yield made()
                rows = []
        if rows:
            yield made()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation, which come in order."""
    conv, digest = None, None

    def row(kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"]
        )

    kind = None
    for batch in batches:
        kind = batch.column("conv_id").type
        for key, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
            if digest is not None and key == conv:
                digest.update(b"\n")
            else:
                if digest is not None:
                    yield row(kind)
                conv, digest = key, hashlib.sha256()
            digest.update(line.encode())
    if digest is not None:
        yield row(kind)


def damage(turns: DataFrame) -> DataFrame:
    """Damaged copies of conversations, by crc32(``conv_id:turn``) modulo 20; nulls are one space there
    and in roles and texts.  0 drops a row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it, 4 makes
    it the user's."""
    space = F.lit(" ")
    name = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    text = F.coalesce("text", space)
    rows = turns.select("conv_id", "turn", "role", "text", (F.crc32(F.concat_ws(":", *name)) % 20).alias("_way"))
    changed = F.when(F.col("_way") == 1, "").when(F.col("_way") == 2, F.regexp_replace(text, "[.!?]", ""))
    return (
        rows.where("_way <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_way") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
            changed.otherwise(text).alias("text"),
            F.explode(F.when(F.col("_way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_n"),
        )
        .drop("_n")
    )


class Repaired(NamedTuple):
    conversations: DataFrame
    rows: DataFrame


def _fault() -> Column:
    shown = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return F.when(~shown, _BLANK).when(F.col("is_first").isNull(), _DUPLICATE).when(~ended, _CUT).otherwise(0)


def repair(turns: DataFrame) -> Repaired:
    """Repair conversations of ``turns`` (conv_id, turn, role, text); other columns are not read.

    Null roles and texts count as one space; a null conv_id is a conversation.  Rows are taken by turn, nulls
    first; of equal turns by role and then by the text's SHA-256.  A row's first fault counts: blank (nothing but white space),
    duplicate (role and text seen earlier), truncated (last visible sign not ``.!?``).  Keep costs 0, Rerole to
    user or assistant 3, Delete 4 (a must for blank and duplicate), Insert of an empty text 3; an undeleted truncated row
    adds 3.  Of the cheapest edits the ASCII-least audit counts.  Any initial but s, u, a (the empty role
    included) cannot be kept.

    ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of the repaired
    ``role:text`` lines).  ``rows``: conv_id, place, part_order (order of the rows: both), role, text.  No turns give no
    conversations.  Two tables are written to the session's shared folder.
    """
    spark = turns.sparkSession
    folder = f"{shared_folder(spark)}/repair-{uuid.uuid4().hex}"
    space = F.lit(" ")
    rows = turns.select(
        F.col("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(count, *order, "_row").sortWithinPartitions(*order)
    ordered.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "digest",
        F.monotonically_increasing_id().alias("place"),
        F.spark_partition_id().cast("bigint").alias("part"),
    ).write.parquet(f"{folder}/rows")
    stored = spark.read.parquet(f"{folder}/rows")

    firsts = (
        stored.groupBy("conv_id", "role", "digest")
        .agg(F.min("place").alias("place"))
        .select("place", F.lit(True).alias("is_first"))
    )
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    facts = stored.join(firsts, "place", "left").select(
        "conv_id", "turn", "place", "part", (role * 4 + _fault()).cast("int").alias("code")
    )
    kind = stored.schema["conv_id"].dataType.simpleString()
    facts.repartition("part").sortWithinPartitions("place").mapInArrow(
        _segments, f"conv_id {kind}, {_SEGMENT_SCHEMA}"
    ).write.parquet(f"{folder}/segments")
    segments = spark.read.parquet(f"{folder}/segments")

    open_ = segments.where("not inner")
    ends = (
        open_.select("conv_id", "first", "matrix")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.desc("first"))
        .mapInArrow(_fold_ends, "first bigint, ends array<bigint>, last boolean")
    )
    paths = (
        segments.select("first", "size", "codes")
        .join(ends, "first", "left")
        .mapInArrow(_paths, "first bigint, cost bigint, audits array<string>, exits array<int>")
    )
    paths.write.parquet(f"{folder}/paths")
    paths = spark.read.parquet(f"{folder}/paths")
    entries = (
        open_.select("conv_id", "first", "codes", "head_turn", "tail_turn")
        .join(paths.select("first", "exits"), "first")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "first")
        .mapInArrow(
            _fold_entries, "first bigint, entry int, opens boolean, seam_illegal bigint, seam_same bigint"
        )
    )
    zero = F.lit(0).cast("bigint")
    chosen = (
        segments.join(paths, "first")
        .join(entries, "first", "left")
        .withColumn("entry", F.coalesce("entry", F.lit(0)))
        .withColumn("audit", F.element_at("audits", F.col("entry") + 1))
    )
    distinct = F.sum("turns") - F.sum(F.coalesce("seam_same", zero))
    per_conversation = chosen.groupBy("conv_id").agg(
        F.coalesce(F.max("most") - F.min("least") + 1 - distinct, zero).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + F.coalesce("seam_illegal", zero)).alias("illegal"),
        F.sum(F.when(F.coalesce("opens", F.lit(True)), F.col("cost")).otherwise(zero)).alias("cost"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("first", "audit"))), lambda x: x["audit"]), ""
        ).alias("audit"),
    )

    edited = chosen.select("conv_id", "first", "codes", "audit", "entry").mapInArrow(
        _edit_rows, f"conv_id {kind}, place bigint, part_order int, new_role string"
    )
    names = ["conv_id", "place", "part_order"]
    kept = edited.where("part_order = 2").join(stored.select("place", "role", "text"), "place")
    repaired = kept.select(*names, F.coalesce("new_role", "role").alias("role"), "text").unionByName(
        edited.where("part_order <> 2").select(*names, F.col("new_role").alias("role"), F.lit("").alias("text"))
    )
    lines = repaired.select(
        "conv_id", "place", "part_order", F.concat("role", F.lit(":"), "text").alias("line")
    )
    hashes = (
        lines.repartition("conv_id")
        .sortWithinPartitions("conv_id", "place", "part_order")
        .select("conv_id", "line")
        .mapInArrow(_hashes, f"conv_id {kind}, repaired_sha256 string")
    )
    key = F.struct("conv_id").alias("key")
    conversations = (
        per_conversation.withColumn("key", key)
        .join(hashes.select(key, "repaired_sha256"), "key", "left")
        .drop("key")
        .withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))
    )
    return Repaired(conversations, repaired)


def repaired_all(original: DataFrame, turns: DataFrame) -> DataFrame:
    """The conversations of :func:`repair` and, with zeros, those of ``original`` without turns."""
    found = repair(turns).conversations
    key = F.struct("conv_id").alias("key")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = original.select("conv_id").distinct().select("conv_id", key).join(
        found.select(key, *[c for c in found.columns if c != "conv_id"]), "key", "left"
    )
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
