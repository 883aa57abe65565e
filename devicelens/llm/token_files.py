"""Operator 13: token ids as binary files of patched frame-of-reference blocks.

Documents are dealt to tasks by ranges of their order, and every task writes the ids of its range
to files.  A file is

    magic, payload, index, documents, length of the index and of the documents (two u64), magic.

The ids are cut into blocks of ``BLOCK``.  A block holds its least id (u32), the packed width (u8) and the number
of exceptions (u16), then the differences to the least id at that width, then the exceptions: their
places (u16 each) and what exceeds the width (u32 each).  The width is that of the difference at
``PERCENTILE`` of the block.  The index has every block's start in the payload (u64), so that any place can be
read alone; the documents are an Arrow table of identifiers and lengths in order.

Task attempts write files of their own; only those that the manifest names count, and it is a
table that Spark commits.  So a lost executor leaves unnamed files behind and nothing else.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from devicelens.llm.common import shared_folder, slices
from devicelens.llm.encoding import encoder_of

MAGIC = b"PFORIDS1"
BLOCK = 512
LANES = 16  # ids side by side, so that packing is a few operations on whole rows
PERCENTILE = 0.95
#: A file is closed at the first document's end beyond so many ids.
FILE_IDS = 1 << 24
#: Ids packed or unpacked in one step.
STEP_IDS = 1 << 20
END = 0
MANIFEST = "file string, part bigint, number bigint, n_docs bigint, n_ids bigint"
_HEAD = struct.Struct("<IBH")


def _width(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """(n, BLOCK) values below 2^width -> (n, width * LANES) words: place p is in lane p % LANES."""
    steps = BLOCK // LANES
    values = rows.reshape(len(rows), steps, LANES).astype(np.uint64)
    words = np.zeros((len(rows), -(-steps * width // 32), LANES), np.uint32)
    for step in range(steps if width else 0):
        word, shift = divmod(step * width, 32)
        moved = values[:, step] << np.uint64(shift)
        words[:, word] |= moved.astype(np.uint32)
        if shift + width > 32:
            words[:, word + 1] |= (moved >> np.uint64(32)).astype(np.uint32)
    return words.reshape(len(rows), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of :func:`_pack`."""
    steps = BLOCK // LANES
    lanes = words.reshape(len(words), -1, LANES)
    values = np.zeros((len(words), steps, LANES), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for step in range(steps if width else 0):
        word, shift = divmod(step * width, 32)
        found = lanes[:, word].astype(np.uint64)
        if shift + width > 32:
            found |= lanes[:, word + 1].astype(np.uint64) << np.uint64(32)
        values[:, step] = ((found >> np.uint64(shift)) & mask).astype(np.uint32)
    return values.reshape(len(words), BLOCK)


def _packed_bytes(width: int) -> int:
    return 4 * LANES * -(-(BLOCK // LANES) * width // 32)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of some ids; the last one is filled up with its least id."""
    count = -(-len(ids) // BLOCK)
    rows = np.empty(count * BLOCK, np.uint32)
    rows[: len(ids)] = ids
    if count * BLOCK > len(ids):
        rows[len(ids) :] = ids[(count - 1) * BLOCK :].min()
    rows = rows.reshape(count, BLOCK)
    least = rows.min(axis=1)
    rows = rows - least[:, None]
    at = math.ceil(percentile * BLOCK) - 1
    widths = _width(np.partition(rows, at, axis=1)[:, at])
    outlier = _width(rows) > widths[:, None]
    numbers = outlier.sum(axis=1)
    block, place = np.nonzero(outlier)
    excess = (rows[block, place].astype(np.uint64) >> widths[block].astype(np.uint64)).astype("<u4")
    place = place.astype("<u2")
    first = np.concatenate([[0], np.cumsum(numbers)])
    blocks: list[bytes] = [b""] * count
    for width in np.unique(widths):
        of = np.flatnonzero(widths == width)
        low = rows[of] & np.uint32((1 << int(width)) - 1)
        for number, words in zip(of, _pack(low, int(width)).astype("<u4")):
            a, b = first[number], first[number + 1]
            blocks[number] = b"".join(
                (
                    _HEAD.pack(int(least[number]), int(width), int(b - a)),
                    words.tobytes(),
                    place[a:b].tobytes(),
                    excess[a:b].tobytes(),
                )
            )
    return blocks


def decode_blocks(payload: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids of the blocks that begin at ``starts`` of the payload, the filling included."""
    heads = [_HEAD.unpack_from(payload, int(s)) for s in starts]
    widths = np.array([h[1] for h in heads], np.int64)
    rows = np.empty((len(heads), BLOCK), np.uint32)
    for width in np.unique(widths):
        of, size = np.flatnonzero(widths == width), _packed_bytes(int(width))
        words = np.empty((len(of), size // 4), np.uint32)
        for row, number in enumerate(of):
            words[row] = np.frombuffer(payload, "<u4", size // 4, int(starts[number]) + _HEAD.size)
        rows[of] = _unpack(words, int(width))
    for number, (start, (_, width, count)) in enumerate(zip(starts.tolist(), heads)):
        if count:
            at = start + _HEAD.size + _packed_bytes(width)
            place = np.frombuffer(payload, "<u2", count, at)
            excess = np.frombuffer(payload, "<u4", count, at + 2 * count)
            rows[number, place] |= excess << np.uint32(width)
    return (rows + np.array([h[0] for h in heads], np.uint32)[:, None]).reshape(-1)


class FileWriter:
    """One file of ids; memory is bounded by ``STEP_IDS``, the index and the documents' lengths."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        self.out = store.open_output_stream(path)
        self.out.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.starts: list[int] = []
        self.size = self.ids = self.held = 0
        self.keys: list = []
        self.lengths: list[int] = []

    def add(self, key: object, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.ids += len(ids)
        self.held += len(ids)
        if self.held >= STEP_IDS:
            self._write(whole=False)

    def _write(self, whole: bool) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.waiting])
        upto = len(ids) if whole else len(ids) - len(ids) % BLOCK
        for at in range(0, upto, STEP_IDS):
            for block in encode_blocks(ids[at : min(at + STEP_IDS, upto)]):
                self.starts.append(self.size)
                self.out.write(block)
                self.size += len(block)
        self.waiting, self.held = [ids[upto:].copy()], len(ids) - upto

    def close(self, kind: pa.DataType) -> None:
        self._write(whole=True)
        index = np.array(self.starts, "<u8").tobytes()
        table = pa.record_batch([pa.array(self.keys, kind), pa.array(self.lengths, pa.int64())], ["doc_id", "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_batch(table)
        documents = sink.getvalue().to_pybytes()
        self.out.write(index + documents + struct.pack("<QQ", len(index), len(documents)) + MAGIC)
        self.out.close()


class FileReader:
    """Random and sequential access to one file."""

    def __init__(self, store: fs.FileSystem, path: str) -> None:
        self.file = store.open_input_file(path)
        tail = 16 + len(MAGIC)
        end = self.file.size() - tail
        last = self.file.read_at(tail, end)
        if last[16:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is not a whole file of token ids")
        index, documents = struct.unpack("<QQ", last[:16])
        self.payload = end - index - documents - len(MAGIC)
        self.starts = np.frombuffer(self.file.read_at(index, end - index - documents), "<u8").astype(np.int64)
        self.documents = pa.ipc.open_stream(self.file.read_at(documents, end - documents)).read_all()
        lengths = self.documents.column("n").to_numpy()
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids at places ``first`` to ``last`` (excluded); only their blocks are read."""
        if first >= last:
            return np.zeros(0, np.uint32)
        low, high = first // BLOCK, -(-last // BLOCK)
        begin = int(self.starts[low])
        end = int(self.starts[high]) if high < len(self.starts) else self.payload
        found = decode_blocks(self.file.read_at(end - begin, begin + len(MAGIC)), self.starts[low:high] - begin)
        return found[first - low * BLOCK : last - low * BLOCK]

    def steps(self, step: int = STEP_IDS) -> Iterator[tuple[int, np.ndarray]]:
        """All ids in order, as (place, ids)."""
        for at in range(0, int(self.bounds[-1]), step):
            yield at, self.ids(at, min(at + step, int(self.bounds[-1])))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS
) -> DataFrame:
    """Write the ids of whole texts to files in ``folder``; returns the manifest.

    Documents are written in ascending ``doc_id`` order (a missing id first; rows that repeat an id by the
    hash of their text), each with an end sign 0; a null text counts as empty and is that sign alone.  Rows that
    repeat are documents of their own; other columns are not read.  ``folder`` is a URI or path that all
    executors share.  Ranges are dealt by (id, hash of the text, row number), so rows that repeat one id
    or are equal spread over tasks.  No documents give no files and an empty manifest.

    The manifest, also written to ``folder``, has one row per file: file (name), part and number (the files'
    order), n_docs, n_ids.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = rows.select("doc_id", "text", order[1].alias("_hash"), order[2].alias("_row")).repartitionByRange(
        parts, order[0], "_hash", "_row"
    )
    ranged = ranged.sortWithinPartitions(order[0], "_hash", "_row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        encoder = encoder_of(tokenizer)
        task = TaskContext.get()
        part, attempt = task.partitionId(), uuid.uuid4().hex[:12]
        writer, written, kind = None, [], None

        def close(writer: FileWriter) -> None:
            writer.close(kind)
            written.append((name, part, len(written), len(writer.keys), writer.ids))

        for batch in slices(batches, "text", 8 << 20):
            kind = batch.column("doc_id").type
            found = encoder.encode(batch.column("text")).ended(END)
            for key, a, b in zip(batch.column("doc_id").to_pylist(), found.starts, found.starts[1:]):
                if writer is None:
                    name = f"part-{part:06d}-{len(written):04d}-{attempt}.ids"
                    writer = FileWriter(store, f"{root}/{name}")
                writer.add(key, found.ids[a:b])
                if writer.ids >= file_ids:
                    close(writer)
                    writer = None
        if writer is not None:
            close(writer)
        if written:
            yield pa.RecordBatch.from_pylist([dict(zip(["file", "part", "number", "n_docs", "n_ids"], w)) for w in written])

    manifest = f"{folder}/manifest"
    ranged.mapInArrow(run, MANIFEST).write.parquet(manifest)
    return docs.sparkSession.read.schema(MANIFEST).parquet(manifest)


def read_tokens(spark: SparkSession, folder: str, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files that the manifest names.

    ``start`` is the number of ids of all documents before it; ``ids`` are little-endian unsigned 32-bit
    integers.  The files' first places are a running sum over the manifest, one row per file.  A file is
    read in steps, so a document's ids are held whole only if they are asked for.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = files.repartition(count, F.xxhash64("file"))
    schema = f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")

    def rows_of(reader: FileReader, first: int) -> Iterator[pa.RecordBatch]:
        bounds = reader.bounds
        crcs = np.zeros(len(bounds) - 1, np.int64)
        for at, ids in reader.steps():
            view = memoryview(ids.astype("<u4", copy=False)).cast("B")
            low = int(np.searchsorted(bounds, at, side="right")) - 1
            high = int(np.searchsorted(bounds, at + len(ids), side="left"))
            for number in range(low, high):
                a, b = max(int(bounds[number]) - at, 0), min(int(bounds[number + 1]) - at, len(ids))
                crcs[number] = zlib.crc32(view[4 * a : 4 * b], int(crcs[number]))
        for at in range(0, len(crcs), 10_000):
            to = min(at + 10_000, len(crcs))
            columns = {
                "doc_id": reader.documents.column("doc_id").combine_chunks()[at:to],
                "start": pa.array(bounds[at:to] + first),
                "n_tokens": pa.array(np.diff(bounds[at : to + 1])),
                "ids_crc32": pa.array(crcs[at:to]),
            }
            if not with_ids:
                yield pa.RecordBatch.from_pydict(columns)
                continue
            whole = pa.RecordBatch.from_pydict(columns)
            for row in range(to - at):
                ids = reader.ids(int(bounds[at + row]), int(bounds[at + row + 1])).astype("<u4")
                yield whole.slice(row, 1).append_column("ids", pa.array([ids.tobytes()], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for file in batch.to_pylist():
                yield from rows_of(FileReader(store, f"{root}/{file['file']}"), file["first"])

    return dealt.mapInArrow(run, schema)


def token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the ids of ``docs`` and read them back; without ``folder``, in the session's shared folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    write_tokens(docs, tokenizer, folder, doc_id, text)
    return read_tokens(spark, folder, kind)
