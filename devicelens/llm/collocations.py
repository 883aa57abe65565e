"""Operator 11: phrase collocations, counted by multikey three-way quicksort of suffix pointers.

A suffix is a word and what follows it in its piece, ``MOST_WORDS`` words at most.  Suffixes are routed by language and
their two leading words; a task sorts pointers to its suffixes word by word into less, equal and more.  The size of an
equal partition is the count of the words that lead to it; a partition below the least count is
abandoned, as all within it is rarer.

What is routed: passes over the texts add up how often phrases occur by hash bucket, in arrays of fixed size:
words and pairs first, then the triples whose pairs may be frequent, then longer phrases whose triples may.
A bucket below the least count holds nothing frequent, so suffixes end there; a bucket only ever says too much, and what is
left is counted exactly.  Equal suffixes of a task travel once, with their number; a core has few tasks, whatever the input.
A pair whose bucket reaches ``HOT`` may be too frequent for one task: its suffixes are routed by three words, or by all
if the triple is hot as well, and what tasks find for shorter prefixes is added up.  So what is routed together has
fewer than ``HOT`` suffixes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicelens.llm.common import cut, slices

LEAST = 100
MOST_WORDS = 5
TOP = 2000
#: Buckets of a filter (4 bytes each in a task, 2 bits each at the end).
FILTER_BITS = 24
HOT = 65_535
#: Distinct suffixes a task holds before it passes them on.
HELD_ROWS = 1_000_000
#: Suffixes sorted together; a task holds these and one routed pair.
SORT_ROWS = 400_000
#: Tasks for each core that read the texts, however many parts the input has.
TASKS_A_CORE = 3
_BLOCK_BITS = 16

# What ends a piece, and what parts words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_ENDS = b"\x20\x09"
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_ENDS + WORD_ENDS,
    b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(PIECE_ENDS) + b" " * len(WORD_ENDS),
)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Words:
    """The words of a batch of texts: codes, languages, and which one follows in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        nothing, line = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
        joined = pc.binary_join_element_wise(texts.fill_null("").cast(pa.large_string()), nothing, line)
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        raw = joined.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()
        data = np.frombuffer(raw.translate(_TABLE), np.uint8)
        end = data == 10
        word = ~end & (data != 32)
        edge = np.flatnonzero(np.diff(word, prepend=False))  # the last byte ends a piece
        starts, ends = edge[::2], edge[1::2]
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        spelled = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[word].tobytes())]
        ).dictionary_encode()
        self.words = spelled.dictionary
        self.codes = spelled.indices.to_numpy().astype(np.int64)
        named = langs.fill_null("und").dictionary_encode()
        self.names = named.dictionary
        text = np.searchsorted(offsets - offsets[0], starts, side="right") - 1
        self.langs = named.indices.to_numpy()[text].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        piece = np.cumsum(end, dtype=np.int32)[starts]
        self.joined = np.append(piece[:-1] == piece[1:], False)[: len(starts)]
        hashes = [xxhash.xxh64_intdigest(w) for w in self.words.to_numpy(zero_copy_only=False)]
        self.hashes = np.array(hashes, np.uint64)
        self.lang_hashes = np.array([xxhash.xxh64_intdigest(x) for x in self.names.to_pylist()], np.uint64)

    def extended(self, hashes: np.ndarray | None, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the phrases of ``size`` words that begin at ``at``, from those of one word less."""
        word = self.hashes[self.codes[at + size - 1]]
        if hashes is None:
            return (word ^ self.lang_hashes[self.langs[at]]) * _ODD[0]
        mixed = (hashes ^ (hashes >> np.uint64(29))) * _ODD[1] + word * _ODD[2]
        return (mixed ^ (mixed >> np.uint64(32))) * _ODD[0]

    def candidates(self, filters: list[Filter], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(size, where phrases of this size begin that may be frequent, their hashes, whether a filter has
        judged them), as far as the filters and one group of sizes beyond them."""
        at, hashes = np.arange(len(self.codes)), None
        for size in range(1, most + 1):
            if size > 1:
                # What is frequent has frequent parts: one word less from here and from the next word.
                follows = np.zeros(len(self.codes) + 1, bool)
                follows[at] = True
                good = self.joined[at + size - 2] & follows[at + 1]
                at, hashes = at[good], hashes[good]
            hashes = self.extended(hashes, at, size)
            group = group_of(size)
            judged = group < len(filters)
            if judged:
                good = filters[group].often(hashes)
                at, hashes = at[good], hashes[good]
            elif group > len(filters):
                return
            yield size, at, hashes, judged


def group_of(size: int) -> int:
    """Phrases of 1 and 2, of 3, and of more words have a filter each."""
    return min(max(size - 2, 0), 2)


class Filter:
    """Two bits for every bucket: whether it may hold something frequent, and something hot."""

    def __init__(self, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.marks = [np.zeros(max(1, (1 << bits) >> 3), np.uint8) for _ in range(2)]

    def _marked(self, which: int, hashes: np.ndarray) -> np.ndarray:
        bucket = (hashes >> self.shift).astype(np.int64)
        return (self.marks[which][bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8) & 1).astype(bool)

    def often(self, hashes: np.ndarray) -> np.ndarray:
        return self._marked(0, hashes)

    def hot(self, hashes: np.ndarray) -> np.ndarray:
        return self._marked(1, hashes)


def _read(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Texts and languages; a missing language is ``und``."""
    return docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in a few tasks for each core: a task sends its bucket counts and every frequent phrase that it meets
    once, so what is sent follows the cores and the phrases and not the parts of the input."""
    return rows.coalesce(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def _survey(rows: DataFrame, filters: list[Filter], bits: int, most: int) -> DataFrame:
    """Per task: (lang, n) numbers of words, and (block, counts) of the buckets of the next group of sizes."""
    block = min(bits, _BLOCK_BITS)
    known = rows.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        totals: dict[str, int] = {}
        for batch in slices(batches, "text", 8 << 20):
            found = Words(batch.column("text"), batch.column("lang"))
            for _, _, hashes, judged in found.candidates(known.value, most):
                if not judged:
                    np.add.at(counts, (hashes >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
            np.minimum(counts, HOT, out=counts)
            for name, n in zip(found.names.to_pylist(), np.bincount(found.langs, minlength=len(found.names))):
                totals[name] = totals.get(name, 0) + int(n)
        blocks = counts.reshape(-1, 1 << block)
        seen = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*totals, *[None] * len(seen)], pa.string()),
                pa.array([*totals.values(), *[None] * len(seen)], pa.int64()),
                pa.array([*[None] * len(totals), *seen.tolist()], pa.int64()),
                pa.array([*[None] * len(totals), *[_squeezed(blocks[b]) for b in seen]], pa.binary()),
            ],
            names=["lang", "n", "block", "counts"],
        )

    return _dealt(rows).mapInArrow(run, "lang string, n bigint, block bigint, counts binary")


def _squeezed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u2").tobytes(), 1)


def _filter(survey: DataFrame, bits: int, least: int) -> Filter:
    """The filter of a survey's buckets."""
    block = min(bits, _BLOCK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = None, np.zeros(1 << block, np.int64)

        def row() -> pa.RecordBatch:
            marks = [np.packbits(total >= least).tobytes(), np.packbits(total >= HOT).tobytes()]
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([number], pa.int64()), **{n: pa.array([m]) for n, m in zip(("often", "hot"), marks)}}
            )

        for batch in batches:
            for at, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                if at != number:
                    if number is not None:
                        yield row()
                    number = at
                    total[:] = 0
                total += np.frombuffer(zlib.decompress(counts), "<u2")
        if number is not None:
            yield row()

    parts = survey.where("block is not null").select("block", "counts")
    summed = parts.repartition("block").sortWithinPartitions("block").mapInArrow(
        run, "block bigint, often binary, hot binary"
    )
    found = Filter(bits)
    size = max(1, (1 << block) >> 3)
    for row in summed.collect():  # 2^bits / 4 bytes at most, whatever the input
        for marks, some in zip(found.marks, (row.often, row.hot)):
            marks[row.block * size : (row.block + 1) * size] = np.frombuffer(bytes(some), np.uint8)
    return found


def suffixes(found: Words, filters: list[Filter], most: int) -> Iterator[tuple]:
    """(lang numbers, word codes (rows, most) with -1 behind the end, counts, words to route by), made distinct.

    A suffix ends where nothing longer can be frequent.  Single words come as suffixes of one word, with all
    their occurrences.
    """
    length = np.zeros(len(found.codes), np.int64)
    leads = np.full(len(found.codes), 2, np.int64)
    for size, at, hashes, _ in found.candidates(filters, most):
        length[at] = size
        if size == 1:
            key, number = np.unique(found.langs[at] << 32 | found.codes[at], return_counts=True)
            alone = np.full((len(key), most), -1, np.int64)
            alone[:, 0] = key & 0xFFFFFFFF
            yield key >> 32, alone, number, np.ones(len(key), np.int64)
        if size == 2:
            leads[at] = np.where(filters[0].hot(hashes), 3, 2)
        if size == 3:
            leads[at] = np.where((leads[at] == 3) & filters[1].hot(hashes), most, leads[at])

    at = np.flatnonzero(length > 1)
    rows = np.full((len(at), most), -1, np.int64)
    for place in range(most):
        has = length[at] > place
        rows[has, place] = found.codes[at[has] + place]
    langs = found.langs[at]
    keys = [langs, *rows.T]
    packed = [keys[i] << 32 | (keys[i + 1] + 1 if i + 1 < len(keys) else 0) for i in range(0, len(keys), 2)]
    order = np.lexsort(packed[::-1])
    if len(order):
        change = np.zeros(len(order) - 1, bool)
        for values in packed:
            change |= np.diff(values[order]) != 0
        first = np.concatenate([[0], np.flatnonzero(change) + 1])
        chosen = order[first]
        number = np.diff(np.append(first, len(order)))
        yield langs[chosen], rows[chosen], number, leads[at[chosen]]


def _suffix_rows(rows: DataFrame, filters: list[Filter], most: int) -> DataFrame:
    """(lang, words, n, leads): suffixes as words joined by a space, their numbers, and how many words route them."""
    known = rows.sparkSession.sparkContext.broadcast(filters)
    names, space = ["lang", "words", "n", "leads"], pa.scalar(" ", pa.large_string())

    def found_in(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = Words(batch.column("text"), batch.column("lang"))
        spelled = found.words.cast(pa.large_string())
        for langs, codes, number, leads in suffixes(found, known.value, most):
            for at in range(0, len(langs), 1 << 17):
                some = slice(at, at + (1 << 17))
                parts = [spelled.take(pa.array(c, mask=c < 0)) for c in codes[some].T]
                words = pc.binary_join_element_wise(*parts, space, null_handling="skip")
                yield pa.RecordBatch.from_arrays(
                    [
                        found.names.take(pa.array(langs[some])).cast(pa.string()),
                        words.cast(pa.string()),
                        pa.array(number[some], pa.int64()),
                        pa.array(leads[some], pa.int32()),
                    ],
                    names=names,
                )

    def summed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held).group_by(["lang", "words", "leads"]).aggregate([("n", "sum")])
        return table.rename_columns({"n_sum": "n"}).select(names).to_batches(max_chunksize=1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        least = 0
        for batch in slices(batches, "text", 8 << 20):
            held.extend(found_in(batch))
            # What has been summed is summed again only with as many new rows.
            if sum(x.num_rows for x in held) > max(HELD_ROWS, 2 * least):
                held = summed(held)
                least = sum(x.num_rows for x in held)
                if least > HELD_ROWS:
                    yield from held
                    held, least = [], 0
        if held:
            yield from summed(held)

    return _dealt(rows).mapInArrow(run, "lang string, words string, n bigint, leads int")


def multikey_counts(
    words: np.ndarray, weights: np.ndarray, least: int, whole: int = 0
) -> Iterator[tuple[int, int, int]]:
    """(depth, row, count) of every prefix of ``depth`` columns that weighs ``least`` or more.

    Three-way radix quicksort of row pointers: one column at a time, parted into less, equal and more than a
    pivot.  Less and more are sorted on by the same column, equal by the next one; a partition that weighs less
    than ``least`` is abandoned.  ``row`` shows the prefix; a negative value ends a row.  Only prefixes of ``whole``
    columns or more are here with all their rows; shorter ones are given whatever they weigh.
    """
    waiting = [(np.arange(len(words)), 0)]
    while waiting:
        rows, depth = waiting.pop()
        if depth + 1 >= whole and weights[rows].sum() < least:
            continue
        column = words[rows, depth]
        some = np.sort(column[:: max(1, len(column) // 9)])
        pivot = some[len(some) // 2] if len(some) else -1
        less, equal, more = rows[column < pivot], rows[column == pivot], rows[column > pivot]
        waiting.extend((part, depth) for part in (less, more) if len(part))
        if pivot >= 0:
            count = int(weights[equal].sum())
            if count >= least or depth + 1 < whole:
                yield depth + 1, int(equal[0]), count
                if depth + 1 < words.shape[1]:
                    waiting.append((equal, depth + 1))


def _sorted_counts(routed: DataFrame, least: int, most: int) -> DataFrame:
    """(lang, words, n) of prefixes: the whole number of those as long as what routes them, a task's share of shorter ones.

    ``routed`` has all suffixes of one language and one ``lead`` in one task, together.
    """

    def count(table: pa.Table) -> Iterator[pa.RecordBatch]:
        spelled, names = table.column("words").combine_chunks(), table.column("lang").combine_chunks()
        lists = pc.split_pattern(spelled, " ")
        size = pc.list_value_length(lists).to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        words = np.full((len(size), most + 1), -1, np.int64)
        words[row, place + 1] = lists.flatten().dictionary_encode().indices.to_numpy()
        words[:, 0] = names.dictionary_encode().indices.to_numpy()
        weights, leads = table.column("n").to_numpy(), table.column("leads").to_numpy()
        found = []
        for lead in np.unique(leads):
            rows = np.flatnonzero(leads == lead)
            # One column more for the language; suffixes of one word count that word, others none.
            whole = 0 if lead <= 2 else lead + 1 if lead < most else most + 2
            counts = multikey_counts(words[rows], weights[rows], least, whole)
            found += [(d, rows[r], n) for d, r, n in counts if (d == 2 if lead == 1 else d > 2)]
        depth, row, n = (np.array(x, np.int64) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        phrases = [
            whole if d > s else " ".join(whole.split(" ")[: d - 1])
            for whole, d, s in zip(spelled.take(pa.array(row)).to_pylist(), depth.tolist(), size[row].tolist())
        ]
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(row)), pa.array(phrases, pa.string()), pa.array(n)], names=["lang", "words", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            lead = batch.column("lead").to_numpy()
            change = np.flatnonzero(np.diff(lead)) + 1
            if held and held[-1].column("lead")[-1].as_py() != lead[0]:
                change = np.concatenate([[0], change])
            if size + batch.num_rows >= SORT_ROWS and len(change):
                at = int(change[-1])
                table = pa.Table.from_batches([*held, batch.slice(0, at)])
                if table.num_rows:
                    yield from count(table)
                held, size, batch = [], 0, batch.slice(at)
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield from count(pa.Table.from_batches(held))

    return routed.mapInArrow(run, "lang string, words string, n bigint")


def phrase_counts(
    docs: DataFrame,
    least: int = LEAST,
    most: int = MOST_WORDS,
    text: str = "text",
    lang: str = "lang",
    bits: int = FILTER_BITS,
) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases, (lang, words, n_words, n) of 1 to ``most`` words, and (lang, n) of all words.

    Texts are lower-cased (A-Z) and split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words at spaces and tabs;
    a phrase lies in one piece, overlapping occurrences count.  Null texts are empty, a null language is
    ``und``.  Rows that repeat count each time; other columns are not read.
    """
    rows = _read(docs, text, lang)
    filters: list[Filter] = []
    for _ in range(group_of(most) + 1):
        survey = cut(_survey(rows, filters, bits, most))
        if not filters:
            totals = survey.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
        filters.append(_filter(survey, bits, least))

    lead = F.array_join(F.slice(F.split("words", " "), F.lit(1), F.col("leads")), " ")
    routed = _suffix_rows(rows, filters, most).withColumn("lead", F.xxhash64("lang", lead))
    counts = (
        _sorted_counts(routed.repartition("lead").sortWithinPartitions("lead"), least, most)
        .groupBy("lang", "words")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least)
    )
    return counts.select("lang", "words", F.size(F.split("words", " ")).alias("n_words"), "n"), totals


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    most: int = MOST_WORDS,
    top: int = TOP,
    text: str = "text",
    lang: str = "lang",
    bits: int = FILTER_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language.

    A phrase of 2 to ``most`` words that occurs a >= ``least`` times scores floor(1000 a n / (l r)) at its lowest-scoring
    cut (of equal ones the first): l and r count the parts, n all words of the language.  Phrases within
    a longer frequent phrase that occurs as often are dropped.  Order: score and a descending, phrase ascending by
    its UTF-8 bytes.  Products are decimals of 38 digits.  Texts without words, null texts and empty tables
    give no rows; see :func:`phrase_counts` for what counts.
    """
    counts, totals = phrase_counts(docs, least, most, text, lang, bits)
    return ranked(cut(counts), totals, top)


def ranked(counts: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Scores and ranks of the phrases of two words or more among ``counts``; see :func:`collocations`."""
    phrases = counts.where("n_words > 1")
    parts = F.split("words", " ")

    def part(first, size) -> Column:
        return F.array_join(F.slice(parts, first, size), " ")

    cuts = F.transform(
        F.sequence(F.lit(1), F.col("n_words") - 1),
        lambda k: F.struct(
            k.alias("k"),
            part(F.lit(1), k).alias("first"),
            part(k + 1, F.col("n_words") - k).alias("rest"),
        ),
    )
    each = phrases.select("lang", "words", F.col("n").alias("a"), F.explode(cuts).alias("cut")).select(
        "lang", "words", "a", "cut.k", "cut.first", "cut.rest"
    )
    left = counts.select("lang", F.col("words").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("words").alias("rest"), F.col("n").alias("r"))
    score = F.expr(
        "cast(cast(1000 * cast(a as decimal(38, 0)) * n as decimal(38, 0)) div "
        "cast(cast(l as decimal(38, 0)) * r as decimal(38, 0)) as bigint)"
    )
    scored = (
        each.join(left, ["lang", "first"])
        .join(right, ["lang", "rest"])
        .join(totals, "lang")
        .withColumn("score", score)
        .groupBy("lang", "words")
        .agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best"))
    )

    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("n_words") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.col("n_words") - size + 1), lambda first: part(first, size)
            ),
        )
    )
    within = (
        phrases.where("n_words > 2")
        .select("lang", F.explode(inner).alias("words"), "n")
        .groupBy("lang", "words")
        .agg(F.max("n").alias("longer"))
    )
    place = F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    )
    return (
        scored.join(within, ["lang", "words"], "left")
        .where(F.coalesce(F.col("longer") < F.col("best.a"), F.lit(True)))
        .select("lang", F.col("words").alias("phrase"), "best.a", "best.l", "best.r", "best.n", "best.score")
        .withColumn("rank", place.cast("bigint"))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
