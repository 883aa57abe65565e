import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from devicelens.llm import language as L
from devicelens.llm import quality as Q
from devicelens.llm.common import held_out
from devicelens.llm.queries import QUERIES, tokenizer_path


def test_held_out_follows_crc32(spark):
    df = spark.range(-3, 200).select(F.col("id").alias("doc_id"), held_out("id").alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())


def good(i):
    return " ".join(f"word{chr(97 + (i * 7 + j * 3) % 26)}ing thing{chr(97 + (i + j) % 26)}" for j in range(30)) + "."


def junk(i):
    return f"BUY!! NOW!! {i} $$$ ### " * 20


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    docs = make_docs([(i, good(i) if i % 3 else junk(i)) for i in range(120)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_learns_and_keeps_columns(spark, make_docs, labelled):
    model = Q.fit(*labelled)
    odd = make_docs([(900, None), (901, ""), (902, " \n"), (903, good(5) * 2000), (None, junk(2)), (904, "x"), (904, "x")])
    docs = odd.withColumn("score", F.lit("old")).withColumn("row", F.lit(7))
    found = Q.quality_scores(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "score", "predicted"]
    rows = {r.doc_id: r for r in found.collect()}
    assert len(found.collect()) == 7
    assert [rows[i].score for i in (900, 901, 902)] == [0.0] * 3
    assert rows[903].predicted == 1 and rows[None].predicted == 0
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert Q.drop_low_quality(docs, model).columns == docs.columns


def test_quality_never_learns_from_held_out_or_unlabelled_rows(spark, labelled):
    docs, labels = labelled
    ids = {r.doc_id for r in docs.where(~held_out()).collect()}
    assert len(Q.fit(docs, labels).labels) == len(ids)
    assert len(Q.fit(docs, labels, max_labelled=10).labels) == 10
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (Q.fit(docs, flipped).labels == Q.fit(docs, labels).labels).all()
    null = labels.withColumn("quality", F.lit(None).cast("int"))
    empty = Q.fit(docs, null)
    assert [r.score for r in Q.quality_scores(docs.limit(3), empty).collect()] == [1.0] * 3
    assert Q.quality_scores(docs.limit(0), Q.fit(docs.limit(0), labels)).collect() == []


def test_quality_votes_equal_brute_force(labelled):
    model = Q.fit(*labelled)
    texts = [good(3), junk(4), "some other text", good(1) + junk(1)]
    for text, score in zip(texts, model.score(texts)):
        v = model.project(Q.terms(text)[None])[0]
        near = sorted(((float(v @ u), float(y)) for u, y in zip(model.vectors, model.labels)), reverse=True)[: Q.NEIGHBOURS]
        weights = [max(c, 1e-3) ** Q.SHARPNESS for c, _ in near]
        assert score == pytest.approx(sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights))


def test_op1_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op1_quality_classifier"](spark, sf)
    assert found.count() == 1000
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


PIECES = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca"]


def segmentations(marked, ids):
    """All ways to cut a word into pieces; a sign that is no piece stands alone."""
    if not marked:
        yield []
    for k in range(1, len(marked) + 1):
        piece = marked[:k]
        if piece in ids or k == 1:
            for rest in segmentations(marked[k:], ids):
                yield [ids.get(piece, len(PIECES) + 1), *rest]


@pytest.mark.parametrize("length", [1, 2, 3, 5, 6])
def test_forward_sums_all_segmentations(length):
    ids = {p: i for i, p in enumerate(PIECES)}
    rng = np.random.default_rng(length)
    chances = np.vstack([rng.dirichlet(np.ones(len(PIECES)), 2).T, [[0, 0]], [[L.UNKNOWN] * 2]])
    some = ["".join(w) for w in itertools.islice(itertools.product("abcx", repeat=length), 60)]
    lattice = L.Lattice(ids, max(map(len, PIECES)), some)
    want = [[sum(np.prod(chances[s, k]) for s in segmentations(L.MARK + w, ids)) for k in (0, 1)] for w in some]
    assert np.allclose(lattice.score(chances), np.log(want))
    assert np.allclose(lattice.forward(chances)[1][:, -1], np.log(want))
    uses = np.zeros(len(PIECES) + 2)
    for w in some:
        cuts = list(segmentations(L.MARK + w, ids))
        mass = [np.prod(chances[s, 0]) for s in cuts]
        for s, m in zip(cuts, mass):
            np.add.at(uses, s, m / sum(mass))
    assert np.allclose(lattice.expected(chances[:, 0], np.ones(len(some))), uses)


def test_very_long_words_do_not_vanish():
    ids = {p: i for i, p in enumerate(PIECES)}
    chances = np.full((len(PIECES) + 2, 1), 0.01)
    assert np.isfinite(L.Lattice(ids, 4, ["abcx" * 2000]).score(chances)).all()


def test_language_of_odd_rows(spark, make_docs):
    rows = [(i, "the thing and the other with this", "en") for i in range(40)]
    rows += [(100 + i, "der die das und nicht ein mit", "de") for i in range(40)]
    docs = make_docs(rows)
    model = L.fit(docs, tokenizer_path("piece_bpe_32k.model"))
    assert model.languages == ["de", "en"]
    odd = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the thing"), (5, "UND NICHT"), (6, "the other " * 20000), (7, "漢字"),
           (8, "x" * 3000), (None, "der das"), (4, "the thing")]
    found = L.identify(make_docs(odd).withColumn("score", F.lit(1)), model)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in found.collect()}
    assert found.count() == len(odd)
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert [got[i][0] for i in (4, 5, 6, None)] == ["en", "de", "en", "de"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[7][0] in ("de", "en")
    nothing = L.fit(docs.withColumn("lang", F.lit(None).cast("string")), tokenizer_path("piece_bpe_32k.model"), rounds=1)
    assert [r.lang_pred for r in L.identify(docs.limit(2), nothing).collect()] == ["und"] * 2
    assert L.identify(docs.limit(0), model).collect() == []


def test_op3_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op3_language_id"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert len(rows) == 1000
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) >= 0.97


def test_language_sample_counts_ids_once_and_is_shared(spark, make_docs):
    one = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(one, "the house and the water", "en")] * 60
    rows += [(i, "der hund und das haus", "de") for i in range(100, 160)] + [(i, "le chat et la maison", "fr") for i in range(300, 306)]
    model = L.fit(make_docs(rows), tokenizer_path("piece_bpe_32k.model"), max_labelled=6)
    assert model.languages == ["de", "en", "fr"]
    docs = make_docs([(1, "das haus und der hund"), (2, "la maison et le chat"), (3, "the water"), (5, "\u00bd \u00b2 \u2460 \u2167"), (6, "x")])
    found = {r.doc_id: r.lang_pred for r in L.identify(docs.select("doc_id", "text"), model).collect()}
    assert [found[i] for i in (1, 2, 3, 5)] == ["de", "fr", "en", "und"] and found[6] != "und"
