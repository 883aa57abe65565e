import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from devicelens.llm import token_files as T
from devicelens.llm.queries import QUERIES, tokenizer_path

PLAIN = Tokenizer.from_file(tokenizer_path())
IDS = st.one_of(st.integers(0, 40), st.integers(0, 60_000), st.integers(0, 2**32 - 1))


def plain_ids(text):
    return np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@given(st.lists(IDS, min_size=1, max_size=1200), st.sampled_from([0.01, 0.5, 0.9, 1.0]))
@settings(max_examples=120, deadline=None)
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    blocks = T.encode_blocks(ids, percentile)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert len(blocks) == -(-len(ids) // T.BLOCK)
    assert (T.decode_blocks(b"".join(blocks), starts)[: len(ids)] == ids).all()


def test_outliers_are_patched():
    ids = np.arange(T.BLOCK, dtype=np.uint32) % 16 + 1000
    small = len(T.encode_blocks(ids)[0])
    ids[[3, 77]] = 2**31
    (block,) = T.encode_blocks(ids)
    assert len(block) == small + 2 * 6 and small == T._HEAD.size + T.BLOCK * 4 // 8
    assert (T.decode_blocks(block, np.array([0])) == ids).all()


def test_files_are_read_at_any_place(tmp_path, monkeypatch):
    monkeypatch.setattr(T, "STEP_IDS", 2048)
    store, rng = fs.LocalFileSystem(), np.random.default_rng(1)
    writer = T.FileWriter(store, f"{tmp_path}/x.ids")
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (1, 5000, 512, 3, 7000, 1)]
    for i, ids in enumerate(docs):
        writer.add(i if i else None, ids)
    writer.close(T.pa.int64())
    reader, whole = T.FileReader(store, f"{tmp_path}/x.ids"), np.concatenate(docs)
    assert reader.documents.column("doc_id").to_pylist() == [None, 1, 2, 3, 4, 5]
    for a, b in [(0, 1), (0, len(whole)), (5001, 5513), (511, 513), (12_000, 12_517), (7, 7)]:
        assert (reader.ids(a, b) == whole[a:b]).all()
    assert (np.concatenate([ids for _, ids in reader.steps(777)]) == whole).all()
    with open(f"{tmp_path}/x.ids", "rb") as whole_file, open(f"{tmp_path}/cut.ids", "wb") as cut_file:
        cut_file.write(whole_file.read()[:-3])
    with pytest.raises(ValueError):
        T.FileReader(store, f"{tmp_path}/cut.ids")


@pytest.mark.parametrize("file_ids", [T.FILE_IDS, 100])
def test_token_files_of_odd_rows(spark, make_docs, tmp_path, file_ids):
    text = "Some words, and more. "
    rows = [(5, "five"), (2, None), (2, text), (2, text), (-7, ""), (None, "lost"), (9, text * 3000), (2, "other"), (8, "<|endoftext|>")]
    rows += [(4, "same")] * 40
    docs = make_docs(rows).repartition(5).withColumn("start", F.lit("x")).withColumn("_hash", F.lit(1))
    manifest = T.write_tokens(docs, tokenizer_path(), str(tmp_path), file_ids=file_ids)
    total = sum(len(plain_ids(t)) for _, t in rows)
    assert manifest.agg(F.sum("n_ids"), F.sum("n_docs")).first()[:] == (total, len(rows))
    found = T.read_tokens(spark, str(tmp_path), with_ids=True).orderBy("start").collect()
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        at += r.n_tokens
    keys = [r.doc_id for r in found]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    want = sorted((str(d), plain_ids(t).tobytes()) for d, t in rows)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in found) == want


def test_token_files_of_nothing_and_of_text_ids(spark, make_docs):
    assert T.token_files(make_docs([]), tokenizer_path()).collect() == []
    docs = make_docs([(10, "b"), (9, "a")]).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert [r.doc_id for r in T.token_files(docs, tokenizer_path()).orderBy("start").collect()] == ["10", "9"]


def test_files_no_manifest_names_do_not_count(spark, make_docs, tmp_path):
    """What a lost attempt left behind."""
    T.write_tokens(make_docs([(1, "one"), (2, "two")]), tokenizer_path(), str(tmp_path))
    (tmp_path / "part-000000-0000-lost.ids").write_bytes(b"half")
    assert T.read_tokens(spark, str(tmp_path)).count() == 2


def test_op13_equals_the_tokenizer(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want, at = [], 0
    for doc, text in docs:
        ids = plain_ids(text)
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op13_token_files"](spark, sf_dir).collect()) == want
