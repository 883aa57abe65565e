import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from devicelens.llm import chat_format as C
from devicelens.llm import encoding as E
from devicelens.llm import mixing as M
from devicelens.llm import packing as P
from devicelens.llm import url_filter as U
from devicelens.llm.queries import ORACLES, QUERIES, URL_RULES, tokenizer_path
from tools.check import TABLES, canonical


@pytest.mark.parametrize("name", ["op5_chat_formatting", "op7_url_filters", "op8_mixing"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(ORACLES[name])
    mine = canonical(df.columns, [tuple(x) for x in df.collect()])
    assert mine == canonical([c[0] for c in cursor.description], cursor.fetchall())


# Packing


def check_pieces(rows, sizes, window):
    """Every id in one piece, sequences gapless; padded ones are at powers of two. Rows as Packer yields them."""
    fill, cover = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, sequence, offset in rows:
        fill[sequence].append((offset, length))
        cover[doc].append((start, length))
    for parts, total in [*((cover[d], n) for d, n in sizes.items()), *((p, None) for p in fill.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at <= window
    return [sum(n for _, n in p) for p in fill.values()]


@given(st.lists(st.integers(1, 300), max_size=120), st.sampled_from([1, 5, 4096]))
@settings(max_examples=80, deadline=None)
def test_packer_round_trip(sizes, max_open):
    window = 64
    packer, rows = P.Packer(window, max_open), []
    docs = {i: np.arange(n, dtype="<u4") for i, n in enumerate(sizes)}
    for i, ids in docs.items():
        rows += packer.add(i, ids)
        assert packer.counts.sum() <= max_open
    rows += packer.close()
    fills = check_pieces(rows, {i: len(d) for i, d in docs.items()}, window)
    assert all(f & (f - 1) == 0 for f in fills)
    assert sum(f < window for f in fills) <= math.log2(window)
    assert all(zlib.crc32(docs[r[0]][r[1] : r[1] + r[2]].tobytes()) == r[3] for r in rows)


def test_packer_takes_the_level_that_grows_least():
    packer = P.Packer(64)
    for i, n in enumerate([40, 40, 40, 30]):
        list(packer.add(i, np.zeros(n, "<u4")))
    # Three windows at 40, one at 30: 24 into a 40 fills it (9 to 4); 20 into a 40 makes one at 60.
    assert len(list(packer.add(9, np.zeros(24, "<u4")))) == 2
    list(packer.add(10, np.zeros(20, "<u4")))
    assert {i: int(n) for i, n in enumerate(packer.counts) if n} == {30: 1, 40: 1, 60: 1}


ODD_TEXTS = [
    None, "", " ", "a", "two words", "  lead", "trail  ", "a  b", "a\n b", "a \nb", "a\tb c\n", "it's they'll 'x 's 12 3",
    "é \x1c b \xa0 c", "x  y", "<|endoftext|> a <|endoftext|>", "漢字 かな", "\U0001f600 \U0001f600", "word " * 5000, "z" * 20000,
    "a'll b's c' 'd e'll, f--- g!? h.i j_k l2 m. É, ñandú... straße; \u0130x ǅ ªb º\u0301 n\u0301, x\u200by 3rd, #tag @me, o'", "we're. I'm, '' ' a' b",
]


def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def encoded(encoder, texts):
    found = encoder.encode(pa.array(texts, pa.string()))
    return [found.ids[a:b].tolist() for a, b in zip(found.starts, found.starts[1:])]


def test_encoder_equals_the_tokenizer():
    encoder = E.Encoder(tokenizer_path())
    whole = plain_tokenizer().encode_batch([t or "" for t in ODD_TEXTS], add_special_tokens=False)
    for _ in range(2):
        for text, got, want in zip(ODD_TEXTS, encoded(encoder, ODD_TEXTS), whole):
            assert got == want.ids, text
    assert encoded(encoder, []) == [] and encoded(encoder, [None, ""]) == [[], []]


@given(
    st.lists(
        st.text(st.sampled_from(list("aZ9é×÷ç\u00a0\u0085\u2003\u3000…«日 \t\n\r\x0b\x1c\x00'’.,-_<|>$½²ªß\u0301s")), max_size=14),
        max_size=5,
    )
)
@settings(max_examples=400, deadline=None)
def test_units_never_change_the_ids(texts):
    want = [x.ids for x in PLAIN.encode_batch(texts, add_special_tokens=False)]
    assert encoded(ENCODER, texts) == want


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(E, "MAX_REMEMBERED", 3)
    monkeypatch.setattr(E, "MAX_UNIT", 5)
    encoder = E.Encoder(tokenizer_path())
    for text in ODD_TEXTS:
        assert encoded(encoder, [text]) == [plain_tokenizer().encode(text or "", add_special_tokens=False).ids]
        assert all(len(u) <= 5 for u in encoder.known)


ENCODER, PLAIN = E.Encoder(tokenizer_path()), plain_tokenizer()


def test_pack_covers_odd_documents(spark, make_docs):
    rows = [*enumerate(ODD_TEXTS), (3, "a"), (None, "no id")]
    docs = make_docs(rows).withColumn("offset", F.lit(-1))
    found = P.pack(docs.repartition(3), tokenizer_path()).collect()
    tokens = plain_tokenizer()
    want = sorted(((d, len(tokens.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in rows), key=str)
    whole = defaultdict(int)
    for r in found:
        whole[r.doc_id] += r.length
        assert r.start + r.length <= r.doc_tokens
    total = defaultdict(int)
    for d, n in want:
        total[d] += n
    assert whole == total
    fill = defaultdict(int)
    for r in found:
        fill[r.sequence_id] += r.length
    assert all(n <= 1024 and n & (n - 1) == 0 for n in fill.values())
    assert P.pack(docs.limit(0), tokenizer_path()).collect() == []
    with pytest.raises(ValueError):
        P.pack(docs, tokenizer_path(), window=1000)


def test_op6_equals_the_tokenizer(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tokens = plain_tokenizer()
    ids = {
        d: np.array([*tokens.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for d, t in docs.items()
    }
    found = QUERIES["op6_packing"](spark, sf_dir).collect()
    rows = [(r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in found]
    fills = check_pieces(rows, {d: len(x) for d, x in ids.items()}, 1024)
    assert all(f & (f - 1) == 0 for f in fills) and sum(f < 1024 for f in fills) <= 10
    assert all(zlib.crc32(ids[d][s : s + n].tobytes()) == crc for d, s, n, crc, _, _ in rows)
    assert all(r.doc_tokens == len(ids[r.doc_id]) for r in found)


# Mixing


def test_mix_reaches_the_target_weights(spark, make_docs):
    rows = [(i, "x" * 99, "en", "hot" if i % 3 else "rare") for i in range(3000)]
    mixed = M.mix(make_docs(rows), {"hot": 1.0, "rare": 3.0}).collect()
    share = sum(r.source == "rare" for r in mixed) / len(mixed)
    assert abs(share - 0.75) < 0.03 and abs(len(mixed) - 3000) < 250
    rate = {r.source: r.rate for r in mixed}
    assert rate["hot"] == pytest.approx(0.375) and rate["rare"] == pytest.approx(2.25)
    per = defaultdict(int)
    for r in mixed:
        per[r.doc_id] += 1
        assert 1 <= r.copy <= r.copies
    counts = np.bincount([per[i] for i in range(0, 3000, 3)], minlength=8) / 1000
    want = [math.exp(-2.25) * 2.25**k / math.factorial(k) for k in range(6)]
    assert np.abs(counts[:6] - want).max() < 0.05


def test_mix_of_odd_rows(spark, make_docs):
    rows = [(1, None, None, None), (1, None, None, None), (2, "", None, "a"), (None, "x", None, "a"), (3, "y" * 100000, None, "b")]
    docs = make_docs(rows).withColumn("rate", F.lit("old")).withColumn("key", F.lit(1)).withColumn("row", F.lit(2))
    mixed = M.mix(docs, epochs=40.0)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "row", "copy", "copies", "rate", "shuffle_key"]
    got = mixed.collect()
    assert {r.source for r in got} == {None, "a", "b"}
    one = [r for r in got if r.doc_id == 1]
    assert len(one) == 2 * one[0].copies
    assert M.mix(docs.limit(0)).collect() == []
    assert {r.source for r in M.mix(docs, {"a": 1.0}, epochs=5.0).collect()} == {"a"}
    with pytest.raises(ValueError):
        M.mix(docs, {"a": -1.0})


def test_poisson_table_is_the_distribution(spark):
    rates = spark.createDataFrame([("a", 0.0), ("b", 0.3), ("c", 5.0), ("d", 4000.0)], "source string, rate double")
    for r in M.poisson_table(rates).collect():
        assert r.cdf[-1] == pytest.approx(1.0)
        if 0 < r.rate < 100:
            want = np.cumsum([math.exp(-r.rate) * r.rate**k / math.factorial(k) for k in range(len(r.cdf))])
            assert np.allclose(r.cdf, want, atol=1e-9) and r.least == 0
        mean = r.least + sum(1 - c for c in r.cdf)
        assert mean == pytest.approx(r.rate, abs=1e-6 * max(1, r.rate))


# URL filters


URLS = [
    None, "", "no scheme", "http://ORG/x", "https://example.org/es/1", "http://a.b.Example.ORG/en/12?x=/fr/", "http://example.org/en/2",
    "http://badexample.org/es/", "https://x.com/fr/a#b", "https://x.com/de/", "http://x.com?/de/", "http://x.net/de/", "ftp://com/de/x",
    "http://example.org", "http://u@h.org:80/x", "http://a..org/", "://org/", "http://x.com/de/\n/y", "HTTP://X.COM/de/1", "http://É.org/",
]


def brute_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    name = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [r for r in URL_RULES if (name == r[0] or name.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return name, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("most", [0, 1000])
def test_url_rules_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(U, "MAX_BROADCAST_BLOCKS", most)
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    rows = [(i, u, "z", 1) for i, u in enumerate([*URLS, *URLS[:6]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, place string, row int")
    found = U.judge_urls(pages, rules)
    assert found.columns == ["page_id", "url", "place", "row", "host", "path", "rule", "verdict"]
    assert found.count() == len(rows)
    for r in found.collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(r.url), r.url
    assert {r.verdict for r in U.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert U.judge_urls(pages.limit(0), rules).collect() == []


def test_bloom_filter_misses_nothing_and_passes_little(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    blocks = 2048
    bloom = U.bloom_filter(keys, blocks)
    assert U.may_contain(keys, bloom, blocks).count() == 20_000
    others = spark.range(20_000, 60_000).select(F.col("id").cast("string").alias("key"))
    assert U.may_contain(others, bloom, blocks).count() < 400


def test_many_rules(spark):
    listed = [(f"h{i}.net", f"/{i % 7}/", "block" if i % 2 else "allow") for i in range(3000)] + [("h1.net", "/1/", "allow")]
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://www.h{i}.net/{i % 7}/x") for i in range(0, 6000, 3)], "page_id long, url string")
    for r in U.judge_urls(pages, rules).collect():
        want = f"h{r.page_id}.net/{r.page_id % 7}/" if r.page_id < 3000 else None
        assert r.rule == want and r.verdict == ("block" if want and r.page_id % 2 else "allow")


# Chat formatting


def test_rotation_of_three_parties(spark, monkeypatch):
    monkeypatch.setattr(C, "TURNS", 2)
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi é"), (1, 2, "bob", None), (1, 3, "cid", "Yo"), (1, 3, "ann", "Again"),
        (2, 0, "system", "alone"), (None, None, None, "x"), (None, 5, "bob", "y"), (1, 4, "bob", "dup"), (1, 4, "bob", "dup"),
        (3, 0, "ann", "z" * 50_000),
    ]
    turns = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, key string")
    found = C.rotate(turns).collect()
    talks = defaultdict(list)
    for r in found:
        talks[r.conv_id, r.perspective].append(r)
    assert set(talks) == {(1, "ann"), (1, "bob"), (1, "cid"), (None, "unknown"), (None, "bob"), (3, "ann")}
    for (_, who), parts in talks.items():
        parts.sort(key=lambda r: r.start)
        whole = "".join(r.segment for r in parts)
        at = 0
        for r in parts:
            assert (r.start, r.length) == (at, len(r.segment))
            at += r.length
            own = r.speaker == who
            assert r.chat_role == ("assistant" if own else "system" if r.speaker == "system" else "user")
            assert r.name == (None if own or r.speaker == "system" else r.speaker)
            said = whole[r.mask_start : r.mask_start + r.mask_length]
            assert said == (r.segment.split("\n", 1)[1] if own else "")
    first = "".join(r.segment for r in talks[1, "bob"])
    assert first.startswith("<|system|>\nBe kind.<|end|>\n<|user name=ann|>\nHi é<|end|>\n<|assistant|>\n<|end|>\n<|user name=ann|>")
    assert C.rotate(turns.limit(0)).collect() == []


def test_added_tokens_have_the_ids_of_the_tokenizer_file():
    plain = plain_tokenizer()
    texts = ["<|endoftext|>", "one <|endoftext|> two", "a<|endoftext|>b c", " x\n<|endoftext|>  y <|endoftext|>", "<|endoftext| >", "none here", None, ""]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 50256 in want[1]
    assert encoded(E.Encoder(tokenizer_path()), texts) == want
