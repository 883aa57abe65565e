import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from devicelens.llm import embedding_dedup as E
from devicelens.llm import exact_dedup as X
from devicelens.llm import simhash as S
from devicelens.llm.components import components


def brute_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(400, 450)]
    links = [*chain, *star, (7, 7), (3, 9), (9, 3), (-5, 3)]
    nodes = {n for pair in links for n in pair} - {7}
    df = spark.createDataFrame(links, "a bigint, b bigint")
    assert {r.node: r.component for r in components(df).collect()} == brute_components(nodes, links[:-4] + links[-3:])


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def long_text(n):
    return "".join(f"Sentence number {i} of a long text. " for i in range(n))


def test_chunks_cover_the_text_and_follow_its_content(spark, make_docs):
    texts = ["", " ", "x" * 9000, long_text(500), "a.\n" * 900, "é\U0001f600 b. " * 300]
    rows = make_docs(list(enumerate(texts))).select("text", X.chunks(F.col("text")).alias("c")).collect()
    assert all("".join(r.c) == r.text and all(0 < len(x) <= X.MOST for x in r.c) for r in rows)
    shifted = make_docs([(0, long_text(500)), (1, "One more. " + long_text(500))])
    one, two = (set(r.c) for r in shifted.select(X.chunks(F.col("text")).alias("c")).collect())
    assert len(one & two) > len(one) // 2


def expected_groups(rows):
    """Brute force: (doc_id, text) -> (keep, size, kept)."""
    once = {(d, t or "") for d, t in rows}
    out = {}
    for d, t in once:
        same = [e for e, u in once if u == t]
        named = [e for e in same if e is not None]
        keep = max(named) if named else None
        out[d, t] = (keep, len(same), d == keep)
    return out


EXACT_ROWS = [
    (1, "same text. here"), (9, "same text. here"), (4, "same text. here"), (4, "same text. here"),
    (5, None), (6, ""), (7, " "), (8, long_text(400)), (11, long_text(400)), (12, long_text(400) + "x"),
    (None, "no id"), (None, "no id"), (None, "same text. here"), (2, "other"), (2, "one more"),
]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_equal_brute_force(spark, make_docs, weak):
    # With a hash of two values nearly all chunks collide, and the verified numbers decide.
    extra = {"chunk_hash": lambda c: F.length(c).cast("bigint") % 2} if weak else {}
    found = X.exact_groups(make_docs(EXACT_ROWS), **extra).collect()
    import hashlib

    text = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in EXACT_ROWS}
    got = {(r.doc_id, text[r.text_sha256]): (r.keep_id, r.group_size, r.kept) for r in found}
    assert len(found) == len(got)
    assert got == expected_groups(EXACT_ROWS)


def test_drop_exact_copies_keeps_whole_rows(spark, make_docs):
    docs = make_docs(EXACT_ROWS).withColumn("key", F.lit("x")).withColumn("row", F.lit(1))
    kept = X.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    want = sorted((d, t) for (d, t), v in expected_groups(EXACT_ROWS).items() if v[2] and d is not None)
    assert sorted((r.doc_id, r.text or "") for r in kept.collect() if r.doc_id is not None) == want
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["no id"]
    assert X.drop_exact_copies(make_docs([])).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40, unique=True), st.integers(0, 5), st.data())
@settings(max_examples=60, deadline=None)
def test_trie_walk_equals_all_pairs(seeds, distance, data):
    near = [s ^ (1 << data.draw(st.integers(0, 63))) for s in seeds[: len(seeds) // 2]]
    values = np.unique(np.array([*seeds, *near], np.uint64))
    brute = [
        (int(a), int(b)) for i, a in enumerate(values) for b in values[i + 1 :] if (int(a) ^ int(b)).bit_count() <= distance
    ]
    nodes = [int(v) for v in values]
    u, v = S.link_forest(values, None, 0, distance)
    assert brute_components(nodes, zip(u.tolist(), v.tolist())) == brute_components(nodes, brute)
    assert all((a, b) != (b, a) for a, b in zip(u, v)) and len(u) < len(values)
    half = np.uint64(1 << 63)
    low, high = values[values < half], values[values >= half]
    if len(low) and len(high):
        u, v = S.link_forest(low, high, 1, distance)
        across = [(a, b) for a, b in brute if a < 2**63 <= b]
        assert brute_components(nodes, zip(u.tolist(), v.tolist())) == brute_components(nodes, across)


def test_dense_group_is_linked_by_a_forest():
    values = np.unique(np.arange(4096, dtype=np.uint64) << np.uint64(17))
    u, _ = S.link_forest(values, None, 0, 3)
    assert len(u) == len(values) - 1


def brute_fingerprint(text, shingle=3):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_the_definition():
    texts = [None, "", " \t\n", "One", "one two", "A b C d", "É à b c d", "x " * 700, long_text(300), "a b c " * 3]
    for text in texts:
        assert S.fingerprint(text and text.encode()) == brute_fingerprint(text)


def brute_simhash(rows, distance=3):
    prints = [brute_fingerprint(t) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance
    ]
    group = brute_components(range(len(rows)), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        known = [x for x in (least.get(group[i]), d) if x is not None]
        least[group[i]] = min(known) if known else None
    return sorted(((d, f"{prints[i]:016x}", least[group[i]]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("cell_rows", [2, 16384])
def test_simhash_groups_equal_brute_force(spark, make_docs, cell_rows):
    base = long_text(60)
    rows = [
        (5, base), (3, base), (8, base.replace("number 7 ", "number seven ")), (2, None), (1, ""), (4, " \n"),
        (6, "one"), (7, "one two"), (9, long_text(3000)), (None, "quite another text of words"), (5, base), (10, base.upper()),
    ]
    rows += [(100 + i, " ".join(f"w{i * 31 + j * 7}" for j in range(30))) for i in range(40)]
    found = S.simhash_groups(make_docs(rows), cell_rows=cell_rows).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=str) == brute_simhash(rows)
    if cell_rows > 2:
        docs = make_docs(rows).withColumn("component_id", F.lit(1))
        kept = S.drop_near_copies(docs)
        assert kept.columns == docs.columns
        want = {(d, c) for d, _, c in brute_simhash(rows) if d == c}
        assert {(r.doc_id, r.doc_id) for r in kept.collect()} == want


def test_simhash_of_no_documents(spark, make_docs):
    assert S.simhash_groups(make_docs([])).collect() == []


def near_vectors(rng, n, dim=16):
    base = rng.standard_normal((n, dim))
    near = np.repeat(base[:10], 12, axis=0) + 0.08 * rng.standard_normal((120, dim))
    return np.vstack([base, near, base[:5], base[:5] * 2]).astype(np.float32)


def test_embedding_groups_equal_brute_force(spark, monkeypatch):
    rows = near_vectors(np.random.default_rng(3), 400)
    vectors = [(i, r.tolist(), i % 3) for i, r in enumerate(rows)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    vectors += [(1000 + i, v, 0) for i, v in enumerate(bad)]
    vectors += [(2000, [1.0, 0.0], 0), (2001, [1.0, 0.1], 0), (2001, [1.0, 0.1], 0), (None, [0.0, -1.0], 0)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int")
    monkeypatch.setattr(E, "BLOCK", 128)
    found = {r.vec_id: r for r in E.embedding_groups(df.withColumn("kept", F.lit(0)), window=64).collect()}
    unit = E.unit_rows(rows)
    close = unit @ unit.T >= 0.9
    links = [(i, j) for i, j in zip(*np.nonzero(close)) if i < j]
    group = brute_components(range(len(rows)), links)
    for i in range(len(rows)):
        assert found[i].n_links == close[i].sum() - 1
        assert found[i].component_id == group[i]
        assert found[i].kept == (group[i] == i)
    for i in range(len(bad)):
        assert (found[1000 + i].n_links, found[1000 + i].component_id) == (0, 1000 + i)
    assert (found[2001].n_links, found[2001].component_id, found[2000].kept) == (1, 2000, True)
    assert (found[None].n_links, found[None].component_id, found[None].kept) == (0, None, True)
    assert len(found) == len(rows) + len(bad) + 3


def test_dense_groups_lose_no_link(spark, monkeypatch):
    # 300 near but unequal vectors among others, windows of 16 in blocks of 32: runs go on over many blocks.
    rng = np.random.default_rng(5)
    rows = np.vstack([rng.standard_normal((200, 16)), rng.standard_normal(16) + 0.05 * rng.standard_normal((300, 16))])
    rows = rng.permutation(rows).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(E, "BLOCK", 32)
    found = {r.vec_id: r.n_links for r in E.embedding_groups(df, window=16).collect()}
    unit = E.unit_rows(rows)
    assert found == dict(enumerate((unit @ unit.T >= 0.9).sum(1) - 1))


def test_passes_follow_the_number_of_vectors():
    same = 1 - np.arccos(0.9) / np.pi
    for n in (10**5, 10**6, 10**7, 10**9):
        assert (1 - same ** np.log2(n / E.WINDOW)) ** E.passes_needed(n) <= 0.001
    assert [E.passes_needed(n) for n in (0, 1, 256, 2000)] == [E.PASSES] * 4


def test_embedding_groups_of_no_vectors(spark):
    assert E.embedding_groups(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


def test_copies_of_one_vector_are_counted(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500)], "vec_id bigint, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in E.embedding_groups(df).collect()} == {(499, 0)}


def test_op9_equals_sql(spark, sf_dir):
    from devicelens.llm.queries import ORACLES, QUERIES
    from tools.check import canonical

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = QUERIES["op9_exact_dedup"](spark, sf_dir)
    cursor = con.execute(ORACLES["op9_exact_dedup"])
    mine = canonical(df.columns, [tuple(x) for x in df.collect()])
    assert mine == canonical([c[0] for c in cursor.description], cursor.fetchall())


def test_op10_equals_brute_force(spark, sf_dir):
    from devicelens.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op10_simhash_near_dedup"](spark, sf_dir).collect()
    want = brute_simhash([(r.doc_id, r.text) for r in docs])
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=str) == want


def test_op2_equals_brute_force(spark, sf_dir):
    from devicelens.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    unit = E.unit_rows(np.array([r.embedding for r in rows]))
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    found = {r.vec_id: r.n_links for r in QUERIES["op2_embedding_near_dedup"](spark, sf_dir).collect()}
    assert found == {r.vec_id: n for r, n in zip(rows, links)}
