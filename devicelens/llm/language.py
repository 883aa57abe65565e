"""Operator 3: language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.  A word's probability
is the sum over all its segmentations into pieces, which a forward pass gives; a text's score
is the product over its words.  Probabilities are fitted by expectation maximisation.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from devicelens.llm.common import cut, held_out, slices

#: Labelled rows the probabilities are fitted on: those with the smallest hash of their id.
MAX_LABELLED = 4000
ROUNDS = 3
SMOOTHING = 0.1
UNKNOWN = 1e-7  # probability of a sign that is no piece, in every language
UNDETERMINED = "und"
#: Words whose scores a Python worker remembers.
MAX_REMEMBERED = 500_000
BATCH = 4096  # words whose lattices are held at a time

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; numbers that are no decimal digits (``½``, ``²``) make no word alone."""
    found = _WORD.findall((text or "").lower())
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def read_pieces(model_file: str) -> list[str]:
    """The pieces of a sentencepiece file that stand for text; a word begins with its mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not skip(i)]


MARK = "▁"  # fixed value: how the vocabulary marks the beginning of a word


class Lattice:
    """Pieces between all positions of words of one length.

    ``ids[n, i, k]`` is the piece of word n from position i over k + 1 signs; ``none`` if there is none.
    """

    def __init__(self, ids: dict[str, int], longest: int, some: list[str]) -> None:
        self.none, unknown = len(ids), len(ids) + 1
        self.length = len(some[0]) + 1
        self.longest = min(longest, self.length)
        flat = []
        for word in some:
            marked = MARK + word
            for i in range(self.length):
                one = ids.get(marked[i])
                flat.append(unknown if one is None else one)
                for k in range(2, self.longest + 1):
                    flat.append(ids.get(marked[i : i + k], self.none) if i + k <= self.length else self.none)
        self.ids = np.array(flat, np.int32).reshape(len(some), self.length, self.longest)

    def forward(self, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled sums over the segmentations of every prefix, and the logarithms of the scales.

        ``chances`` is (pieces, languages); results are (words, positions, languages).
        """
        n, width = len(self.ids), chances.shape[1]
        sums = np.zeros((n, self.length + 1, width))
        logs = np.zeros((n, self.length + 1, width))
        sums[:, 0] = 1.0
        for j in range(1, self.length + 1):
            least = max(0, j - self.longest)
            base = logs[:, least:j].max(axis=1)
            total = np.zeros((n, width))
            for i in range(least, j):
                total += sums[:, i] * np.exp(logs[:, i] - base) * chances[self.ids[:, i, j - i - 1]]
            sums[:, j] = 1.0
            with np.errstate(divide="ignore"):
                logs[:, j] = np.log(total) + base
        return sums, logs

    def score(self, chances: np.ndarray) -> np.ndarray:
        """Logarithms of the words' probabilities: (words, languages)."""
        n, width = len(self.ids), chances.shape[1]
        if self.length > 24:
            return self.forward(chances)[1][:, -1]
        sums = np.zeros((n, self.length + 1, width))
        sums[:, 0] = 1.0
        for j in range(1, self.length + 1):
            for i in range(max(0, j - self.longest), j):
                sums[:, j] += sums[:, i] * chances[self.ids[:, i, j - i - 1]]
        return np.log(sums[:, -1])

    def expected(self, chances: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected uses of every piece under one language's ``chances`` for words of these weights."""
        _, before = self.forward(chances[:, None])
        before = before[:, :, 0]
        after = np.full((len(self.ids), self.length + 1), -np.inf)
        after[:, -1] = 0.0
        with np.errstate(divide="ignore"):
            logs = np.log(chances)
        for i in range(self.length - 1, -1, -1):
            for k in range(min(self.longest, self.length - i)):
                after[:, i] = np.logaddexp(after[:, i], logs[self.ids[:, i, k]] + after[:, i + k + 1])
        out = np.zeros(len(chances))
        whole = before[:, -1]
        for i in range(self.length):
            for k in range(min(self.longest, self.length - i)):
                use = np.exp(before[:, i] + logs[self.ids[:, i, k]] + after[:, i + k + 1] - whole)
                out += np.bincount(self.ids[:, i, k], weights=use * weights, minlength=len(chances))
        return out


def by_length(some: list[str]) -> Iterator[np.ndarray]:
    """Positions of words of equal length, at most ``BATCH`` signs' worth together."""
    groups = defaultdict(list)
    for i, word in enumerate(some):
        groups[len(word)].append(i)
    for length, who in groups.items():
        step = max(1, BATCH * 8 // (length + 8))
        for at in range(0, len(who), step):
            yield np.array(who[at : at + step])


@dataclass
class Model:
    """Languages, their logarithmic priors and the (pieces + 2, languages) probabilities."""

    languages: list[str]
    priors: np.ndarray
    pieces: list[str]
    chances: np.ndarray
    known: dict[str, int] = field(default_factory=dict)

    def prepare(self) -> None:
        """Derived tables, made where the model is used."""
        if not hasattr(self, "ids"):
            self.ids = {p: i for i, p in enumerate(self.pieces)}
            self.longest = max(map(len, self.pieces), default=1)
            self.table = np.zeros((0, len(self.languages)))

    def word_scores(self, some: list[str]) -> np.ndarray:
        self.prepare()
        out = np.zeros((len(some), len(self.languages)))
        for who in by_length(some):
            out[who] = Lattice(self.ids, self.longest, [some[i] for i in who]).score(self.chances)
        return out

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of every text and its share of the probability."""
        self.prepare()
        found = [words(t) for t in texts]
        if len(self.known) > MAX_REMEMBERED:
            self.known.clear()
            self.table = self.table[:0]
        new = [w for w in set().union(*found) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, self.word_scores(new)])
        labels, share = [], np.zeros(len(texts))
        for n, own in enumerate(found):
            if not own or not self.languages:
                labels.append(UNDETERMINED)
                continue
            at = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
            total = self.priors + self.table[at].sum(axis=0)
            best = int(total.argmax())
            labels.append(self.languages[best])
            share[n] = 1.0 / np.exp(total - total[best]).sum()
        return labels, share


def _word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n) of the sample's whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found.update((lang, w) for w in words(text))
            if found:
                lang, word = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang), pa.array(word), pa.array(list(found.values()), pa.int64())],
                    names=["lang", "word", "n"],
                )

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: str, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model:
    """Fit on at most ``max_labelled`` documents with a language and a text that are not held out.

    The bound is shared among the languages: each gives those of its doc_ids with the smallest hashes, in turn.  A
    doc_id that repeats counts once (its least language and text).  Languages weigh by their documents in the whole
    table.  The words are counted whole in Spark; every
    round sends one sum per piece and language to the driver, which the vocabulary bounds.
    """
    pieces = read_pieces(vocabulary)
    usable = docs.where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()
    )
    ids = usable.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    chosen = (
        ids.withColumn("place", place)
        .where(F.col("place") <= max_labelled)
        .orderBy("place", *order)
        .limit(max_labelled)
        .select("doc_id")
    )
    sample = (
        usable.select("doc_id", "lang", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id")
        .agg(F.min(F.struct("lang", "text")).alias("row"))
        .select("row.*")
    )
    counts = cut(_word_counts(sample))
    languages = [r.lang for r in counts.select("lang").distinct().orderBy("lang").collect()]
    totals = {r.lang: r.n for r in ids.groupBy("lang").agg(F.count("*").alias("n")).join(
        F.broadcast(counts.select("lang").distinct()), "lang"
    ).collect()}
    size, width = len(pieces) + 2, len(languages)
    chances = np.full((size, width), 1.0 / max(1, len(pieces)))
    chances[-2:] = [[0.0], [UNKNOWN]]
    index = {lang: i for i, lang in enumerate(languages)}
    longest = max(map(len, pieces), default=1)
    for _ in range(rounds if width else 0):
        shared = docs.sparkSession.sparkContext.broadcast((pieces, chances))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces_, chances_ = shared.value
            ids = {p: i for i, p in enumerate(pieces_)}
            sums = np.zeros_like(chances_)
            for batch in batches:
                langs = np.array([index[x] for x in batch.column("lang").to_pylist()])
                some, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for i in range(sums.shape[1]):
                    mine = np.flatnonzero(langs == i)
                    own = [some[j] for j in mine]
                    for who in by_length(own):
                        lattice = Lattice(ids, longest, [own[j] for j in who])
                        sums[:, i] += lattice.expected(chances_[:, i], n[mine[who]])
            piece, lang = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(sums[piece, lang])],
                names=["piece", "lang", "uses"],
            )

        uses = (
            counts.mapInArrow(expect, "piece int, lang int, uses double")
            .groupBy("piece", "lang")
            .agg(F.sum("uses").alias("uses"))
            .toPandas()
        )
        sums = np.zeros((size, width))
        sums[uses["piece"], uses["lang"]] = uses["uses"]
        sums = sums[:-2] + SMOOTHING
        chances = np.vstack([sums / sums.sum(axis=0), np.zeros((1, width)), np.full((1, width), UNKNOWN)])
    number = np.array([totals[x] for x in languages], np.float64)
    return Model(languages, np.log(number / max(1.0, number.sum())) if width else number, pieces, chances)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (its probability among the learned languages).

    Only the whole text is read.  A text that is null or has no letter is ``und`` with score 0, and so is every
    text if no language was learned.  Existing columns of these names are replaced.
    """
    base = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = base.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            labels, share = shared.value.scores(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels, pa.string()), pa.array(share)],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return base.mapInArrow(run, T.StructType([*base.schema.fields, *added]))
