"""Operator 6: sum-of-squares online packing of documents into token sequences.

Every task packs the documents of its partition as they come.  A document's full sequences are cut off
first; its rest goes to the fill level where the squared numbers of partly filled windows, kept
in an array by level, grow least.  What stays open is topped up with cut pieces, and the very
last window is split at powers of two, which need no padding.  No row is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelens.llm.common import slices
from devicelens.llm.encoding import encoder_of

WINDOW = 1024
#: Open windows a task holds (4 KB each); beyond, they are topped up and closed, as at the task's end.
MAX_OPEN = 4096
END = 0


class Packer:
    """Windows of one task; ``add`` and ``close`` yield finished pieces.

    A piece is [doc, start, ids]; rows are (doc, start, length, crc32, sequence, offset).
    """

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN, first: int = 0) -> None:
        self.window, self.max_open, self.next = window, max_open, first
        self.open: list[list[list[list]]] = [[] for _ in range(window)]
        self.counts = np.zeros(window + 1, np.int64)  # level 0 and the full level stay at zero

    def _emit(self, pieces: list[list]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids in pieces:
            yield doc, start, len(ids), zlib.crc32(ids), self.next, at
            at += len(ids)
        self.next += 1

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        rest = len(ids) % self.window
        for at in range(0, len(ids) - rest, self.window):
            yield from self._emit([[doc, at, ids[at : at + self.window]]])
        if not rest:
            return
        # Growth of the sum of squares if a window of this level takes the rest (level 0: a new one).
        old, new = self.counts[: self.window - rest + 1], self.counts[rest:]
        growth = 2 * new + 1 - np.where(old > 0, 2 * old - 1, 0)
        growth[-1] -= 1  # a window that gets full leaves the array
        growth[(old == 0) & (np.arange(len(old)) > 0)] = np.iinfo(np.int64).max
        level = len(growth) - 1 - int(np.argmin(growth[::-1]))
        pieces = self.open[level].pop() if level else []
        self.counts[level] -= level > 0
        pieces.append([doc, len(ids) - rest, ids[len(ids) - rest :]])
        if level + rest == self.window:
            yield from self._emit(pieces)
        else:
            self.open[level + rest].append(pieces)
            self.counts[level + rest] += 1
            if self.counts.sum() > self.max_open:
                yield from self._top_up(last=False)

    def close(self) -> Iterator[tuple]:
        yield from self._top_up(last=True)

    def _top_up(self, last: bool) -> Iterator[tuple]:
        """Fill the fullest windows with pieces cut off the emptiest ones."""
        windows = [(level, w) for level in range(self.window - 1, 0, -1) for w in self.open[level]]
        self.open = [[] for _ in range(self.window)]
        self.counts[:] = 0
        i, j = 0, len(windows) - 1
        while i < j:
            level, pieces = windows[i]
            while level < self.window and i < j:
                fill, donor = windows[j]
                doc, start, ids = donor.pop()
                take = min(self.window - level, len(ids))
                if take < len(ids):
                    donor.append([doc, start, ids[: len(ids) - take]])
                pieces.append([doc, start + len(ids) - take, ids[len(ids) - take :]])
                level += take
                windows[j] = (fill - take, donor)
                j -= not donor
            if level == self.window:
                yield from self._emit(pieces)
                i += 1
            else:
                windows[i] = (level, pieces)
        if i == j and windows[i][0]:
            level, pieces = windows[i]
            if last:
                yield from self._by_powers(level, pieces)
            else:
                self.open[level].append(pieces)
                self.counts[level] += 1

    def _by_powers(self, level: int, pieces: list[list]) -> Iterator[tuple]:
        while level:
            room = 1 << (level.bit_length() - 1)
            level -= room
            now = []
            while room:
                doc, start, ids = pieces.pop(0)
                now.append([doc, start, ids[:room]])
                if len(ids) > room:
                    pieces.insert(0, [doc, start + room, ids[room:]])
                room -= len(now[-1][2])
            yield from self._emit(now)


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row per piece.

    ``tokenizer`` is the path of a byte-level BPE file on the executors.  A document's ids are
    those of its whole text and an end sign 0; null counts as empty and is that sign alone.
    ``window`` is a power of two.  Sequences hold ``window`` ids, but for at most its binary logarithm of
    shorter ones per task, whose sizes are powers of two.  Sequence ids are unique: the task's number times
    2^33 and a count.  Rows that repeat are packed as documents of their own; other columns are not read.
    A task that holds more than ``MAX_OPEN`` open windows tops them all up early; no id is lost.
    Tasks follow the partitions of ``docs``; a table scan deals them alike on a retry.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    kind = docs.select(F.col(doc_id)).schema[0].dataType
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        packer = Packer(window, first=TaskContext.get().partitionId() << 33)
        rows: list[tuple] = []
        id_type = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            docs_, start, length, crc, sequence, offset = zip(*rows)
            ids, size = zip(*docs_)
            columns = [start, length, crc, size, sequence, offset]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), *[pa.array(c, pa.int64()) for c in columns]], names=names
            )

        for batch in slices(batches, "text", 8 << 20):
            id_type = batch.column("doc_id").type
            found = encoder.encode(batch.column("text")).ended(END)
            bounds = found.starts.tolist()
            for key, at, to in zip(batch.column("doc_id").to_pylist(), bounds, bounds[1:]):
                # A copy, so that what stays open does not hold the batch.
                rows.extend(packer.add((key, to - at), found.ids[at:to].copy()))
            if len(rows) > 10_000:
                yield batch_of(rows)
                rows = []
        rows.extend(packer.close())
        if rows:
            yield batch_of(rows)

    schema = ", ".join([f"doc_id {kind.simpleString()}", *[f"{n} bigint" for n in names[1:]]])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
