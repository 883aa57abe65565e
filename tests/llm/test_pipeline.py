from tokenizers import Tokenizer

import corpus_pipeline
from devicelens.llm import mixing, quality
from devicelens.llm.common import table
from tests.llm.test_dedup import brute_simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    order = sorted(rows)
    scores = dict(zip(order, model.score([rows[d].text for d in order])))
    good = [d for d in order if scores[d] >= 0.7]
    last = {rows[d].text: d for d in good}
    single = sorted(last.values())
    alone = sorted(d for d, _, c in brute_simhash([(d, rows[d].text) for d in single]) if d == c)

    want = [good, single, alone]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, want):
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == COLUMNS, name
        assert sorted(r.doc_id for r in docs.collect()) == expected, name
    mixed = sorted((r.doc_id, r.copy) for r in mixing.mix(docs).collect())
    name, stage = corpus_pipeline.STAGES[3]
    docs = stage(spark, docs, sf_dir)
    assert docs.columns == COLUMNS and sorted(r.doc_id for r in docs.collect()) == [d for d, _ in mixed]
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted({r.doc_id for r in found}) == sorted({d for d, _ in mixed})
    plain = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    texts = [rows[d].text for d, _ in mixed]
    total = sum(len(x.ids) + 1 for x in plain.encode_batch(texts, add_special_tokens=False))
    assert sum(r.length for r in found) == total


def test_stages_take_no_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []
        docs = docs if "text" in docs.columns else table(spark, sf_dir, "documents").limit(0)


def test_stages_keep_odd_rows_and_columns_whole(spark, sf_dir):
    from pyspark.sql import functions as F

    text = " ".join(f"the word{chr(97 + i % 26)} and thing{chr(97 + i * 7 % 26)}" for i in range(60)) + "."
    rows = [
        (1, text, "en", "a"), (1, text, "en", "a"), (2, text, None, None), (3, None, "en", "a"), (4, "", None, "b"),
        (None, text + " more", "en", "a"), (5, text.replace("and", "or") * 400, "en", None), (6, " \n", "en", "b"),
    ]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["key", "row", "score", "predicted", "copy", "rate", "component_id", "place"]
    docs = docs.select("*", *[F.lit(n).alias(n) for n in names])
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == COLUMNS + names, name
        found = docs.collect()
        assert all(r[n] == n for r in found for n in names), name
        kept.append(sorted({str(r.doc_id) for r in found}))
    # Blank texts are rejected; of the two equal texts 2 stays.
    assert kept[0] == ["1", "2", "5", "None"] and kept[1] == ["2", "5", "None"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {str(r.doc_id) for r in pieces} == set(kept[3])
