import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from devicelens.llm import collocations as C
from devicelens.llm.queries import ORACLES, QUERIES
from tools.check import TABLES, canonical

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, most + 1):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    often = {key: n for key, n in counts.items() if n >= least}
    hidden = set()
    for (lang, words), n in often.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                if n >= often[lang, words[i : i + size]]:
                    hidden.add((lang, words[i : i + size]))
    found = []
    for (lang, words), a in often.items():
        if len(words) > 1 and (lang, words) not in hidden:
            cuts = []
            for k in range(1, len(words)):
                left, right = often[lang, words[:k]], often[lang, words[k:]]
                cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((lang, " ".join(words), a, left, right, totals[lang], score))
    ranked = []
    for lang in totals:
        best = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[6], -f[2], f[1].encode()))
        ranked += [(lang, i + 1, *f[1:]) for i, f in enumerate(best[:top])]
    return sorted(ranked)


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=4), st.integers(1, 5)), max_size=60), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_sorted_partitions_are_counts(rows, least):
    words = np.full((len(rows), 4), -1, np.int64)
    want = Counter()
    for i, (some, weight) in enumerate(rows):
        words[i, : len(some)] = some
        for size in range(1, len(some) + 1):
            want[tuple(some[:size])] += weight
    weights = np.array([w for _, w in rows], np.int64)
    found = {tuple(words[row, :depth].tolist()): n for depth, row, n in C.multikey_counts(words, weights, least)}
    assert found == {key: n for key, n in want.items() if n >= least}


TEXTS = [
    ("a b c d e f. A B\tc", "x"), ("a b c, a b c; a  b", None), ("the the the the the the", "x"), (None, "x"), ("", None),
    (" \t\n!? ", "y"), ("É b é b c a\x0bb a\x1cb", "x"), ("und b a b", "und"), ("long " * 30_000 + "end", "x"), ("a b c d e f", "x"),
]


@pytest.mark.parametrize(("bits", "hot", "rows"), [(23, 65_535, 400_000), (4, 65_535, 3), (12, 4, 5)])
def test_collocations_equal_brute_force(spark, make_docs, monkeypatch, bits, hot, rows):
    """With a filter that passes too much, with pairs too frequent for one task, with small sorts."""
    monkeypatch.setattr(C, "HOT", hot)
    monkeypatch.setattr(C, "SORT_ROWS", rows)
    monkeypatch.setattr(C, "HELD_ROWS", rows)
    some = TEXTS * 3
    docs = make_docs([(i % 7, t, lang) for i, (t, lang) in enumerate(some)]).repartition(4)
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("words", "n", "phrase", "lead", "rank")])
    for least, most, top in ((3, 5, 2000), (2, 3, 4)):
        got = sorted(tuple(r) for r in C.collocations(docs, least, most, top, bits=bits).collect())
        assert got == brute(some, least, most, top)


def test_suffixes_sent_follow_cores_and_phrases(spark, make_docs):
    """Not the parts of the input: 200 of them, the same ten phrases in each."""
    docs = make_docs([(i, "a b c d", "x") for i in range(1000)]).repartition(200)
    passing = [C.Filter(8) for _ in range(3)]
    for some in passing:
        some.marks[0][:] = 255
    sent = C._suffix_rows(C._read(docs, "text", "lang"), passing, 5).groupBy("words").agg(F.sum("n"), F.count("n")).collect()
    # Single words and the suffixes of two words or more.
    assert {w: n for w, n, _ in sent} == {w: 1000 for w in ("a", "b", "c", "d", "a b c d", "b c d", "c d")}
    assert max(times for *_, times in sent) <= C.TASKS_A_CORE * spark.sparkContext.defaultParallelism


def test_exact_beyond_64_bits(spark):
    """1000 a n and l r of some 10^25 and more."""
    counts = spark.createDataFrame(
        [("x", w, len(w.split()), n) for w, n in (("a", 4 * 10**15), ("b", 3 * 10**15), ("a b", 10**15))],
        "lang string, words string, n_words int, n bigint",
    )
    totals = spark.createDataFrame([("x", 9 * 10**15)], "lang string, n bigint")
    (row,) = C.ranked(counts, totals, 10).collect()
    assert row.score == 1000 * 10**15 * 9 * 10**15 // (12 * 10**30)


def test_collocations_of_nothing(spark, make_docs):
    assert C.collocations(make_docs([]), bits=10).collect() == []
    assert C.collocations(make_docs([(1, None), (2, " . ")]), bits=10).collect() == []


def test_op11_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = QUERIES["op11_phrase_collocations"](spark, sf_dir)
    cursor = con.execute(ORACLES["op11_phrase_collocations"])
    mine = canonical(df.columns, [tuple(x) for x in df.collect()])
    assert mine and mine == canonical([c[0] for c in cursor.description], cursor.fetchall())
