import random
import re
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from devicelens.catalog import knowledge_base
from devicelens.functions.chunks import chunk_text
from devicelens.functions.vectors import cosine_distance
from devicelens.operators import diagnosis as dg
from devicelens.operators import knowledge as kb


def texts():
    rng = random.Random(1)
    
    def prose(n, seps):
        return "".join(f"w{rng.randrange(10**6)}" + rng.choice(seps) for _ in range(n))

    def letters(n):
        return "".join(rng.choice("abcdefghijklmnop") for _ in range(n))

    return [
        "short",
        letters(2047),
        letters(2048),
        letters(2049),
        letters(9000),
        "\n" * 5000 + "tail",
        prose(2000, [" "]),
        prose(2000, [" ", ", ", ". "]),
        prose(3000, [" ", "\n", "\n\n"]),
        "\n\n".join(f"para {i}" for i in range(900)),
        prose(30, [" "]) + letters(5000) + prose(300, [" "]),
    ]


@pytest.mark.parametrize("text", texts(), ids=range(len(texts())))
@pytest.mark.parametrize("size,overlap", [(2048, 200), (300, 50), (64, 0)])
def test_chunk_invariants(text, size, overlap):
    chunks = chunk_text(text, size, overlap)
    for chunk in chunks:
        assert 0 < len(chunk) <= size and chunk == chunk.strip()
    if len(text) <= size:
        assert chunks == [text.strip()]
    # Nothing but white space is lost: walk the text, each chunk may reach back at most ``overlap``.
    covered = np.zeros(len(text), dtype=bool)
    start = 0
    for chunk in chunks:
        i = text.find(chunk, start)
        assert i != -1
        covered[i : i + len(chunk)] = True
        start = max(i + 1, i + len(chunk) - overlap)
    assert not "".join(c for c, ok in zip(text, covered) if not ok).strip()


def test_known_chunks():
    # A piece carries its separator in front, and that counts.
    assert chunk_text("aa bb cc dd", 5, 0) == ["aa bb", "cc", "dd"]
    assert chunk_text("aa bb cc dd ee", 8, 3) == ["aa bb cc", "cc dd", "dd ee"]
    assert chunk_text("abcdefgh", 3, 1) == ["abc", "cde", "efg", "gh"]
    assert chunk_text("one\n\ntwo two\n\nthree", 9, 0) == ["one", "two two", "three"]


def test_chunk_documents_and_ids(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "incident_id INT, text STRING")
    got = kb.chunk_rows(kb.chunk_documents(df)).collect()
    for i, text in rows:
        mine = sorted((x for x in got if x["incident_id"] == i), key=lambda x: x["chunk_index"])
        assert [x["document"] for x in mine] == chunk_text(text)
        assert [x["chunk_id"] for x in mine] == [f"{i}_chunk_{n}" for n in range(len(mine))]


@pytest.mark.parametrize("blocks", [(2048, 32768), (7, 11), (1, 5)])
def test_topk_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(20, 8)), rng.normal(size=(60, 8))
    c[10] = 0.0
    c[30:34] = c[29]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id BIGINT, embedding ARRAY<DOUBLE>")
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "chunk_id BIGINT, embedding ARRAY<DOUBLE>")
    got = kb.cosine_topk(queries, chunks, 5, query_block=blocks[0], chunk_block=blocks[1]).collect()
    norm = np.linalg.norm(c, axis=1)
    for i, v in enumerate(q):
        d = 1 - np.divide(c @ v, norm * np.linalg.norm(v), out=np.zeros(60), where=norm > 0)
        mine = sorted((x for x in got if x["query_id"] == i), key=lambda x: x["rank"])
        assert [x["distance"] for x in mine] == pytest.approx(np.sort(d)[:5])
        assert len(mine) == 5 and len({x["chunk_id"] for x in mine}) == 5


def test_cells_rank_equal_vectors_by_id_and_near_ones_by_distance(monkeypatch):
    """Copies, vectors nearer to each other than single precision tells, zero ones, ones that are no numbers."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    base[0] = 0.0
    base[1, 3] = np.inf
    vectors = np.concatenate([base[rng.integers(0, 12, 300)], base[2] + rng.normal(size=(300, 16)) * 1e-9])
    ids = rng.permutation(len(vectors))
    cell = pd.DataFrame({"id": ids, "v": list(vectors)})
    with np.errstate(invalid="ignore"):
        unit = kb._unit(cell["v"])
        far = 1 - np.stack([np.einsum("ij,ij->i", np.broadcast_to(u, unit.shape), unit) for u in unit])
    want = {i: [int(ids[x]) for x in np.lexsort((ids, far[row]))[:5]] for row, i in enumerate(ids)}
    for tile in (7, 64, 4096):
        got = kb._nearest(5, tile)(cell, cell).sort_values(["query_id", "distance", "chunk_id"])
        assert got.groupby("query_id")["chunk_id"].apply(list).to_dict() == want


def test_vectors_travel_once_per_large_block(spark):
    """A vector is copied for every block of the other side, so the number of copies must stay small."""
    few = spark.createDataFrame([(1, [1.0])], "id bigint, embedding array<double>")
    queries, chunks = few.withColumnRenamed("id", "query_id"), few.withColumnRenamed("id", "chunk_id")
    found = kb.cosine_topk(queries, chunks, counts=(600_000, 600_000))
    plan = found._jdf.queryExecution().analyzed().toString()
    blocks = [int(x) + 1 for x in re.findall(r"explode\(sequence\(0, (\d+)", plan)]
    assert blocks == [19, 19] and found.count() == 1


def test_only_registered_devices_ask(spark, monkeypatch):
    """Their hits among all vectors are those of a search for every vector; null and repeated ids too."""
    rng = np.random.default_rng(4)
    ids = [*range(40), 3, None]
    vectors = [(i, rng.normal(size=4).tolist(), n % 3) for n, i in enumerate(ids)]
    incidents = [(i, f"doc {i}", "low", "src") for i in range(3)]
    d = SimpleNamespace(
        vectors=spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>, incident_id bigint"),
        incidents=spark.createDataFrame(incidents, "incident_id bigint, title string, severity string, failure_category string"),
        devices=spark.createDataFrame([(3,), (3,), (7,), (99,), (None,)], "device_id bigint"),
    )
    asked = []
    search = kb.cosine_topk
    monkeypatch.setattr(kb, "cosine_topk", lambda q, c, k: asked.append((q.count(), c.count())) or search(q, c, k))
    got = knowledge_base._device_hits(d)
    every = knowledge_base._nearest(d)
    assert asked == [(3, 42), (42, 42)]
    meta = d.vectors.select(F.col("vec_id").alias("chunk_id"), "incident_id").join(d.incidents, "incident_id")
    want = every.where("query_id in (3, 7)").join(meta, "chunk_id")
    columns = ["query_id", "rank", "distance", "chunk_id", "incident_id", "title"]
    assert sorted(tuple(r) for r in got.select(columns).collect()) == sorted(tuple(r) for r in want.select(columns).collect())
    assert {r.query_id for r in got.collect()} == {3, 7}


def test_cosine_expression(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    assert df.select(cosine_distance(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1 - 0.5**0.5)


def test_upserts_and_default_vectors(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id STRING, v INT")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "chunk_id STRING, v INT")
    assert {tuple(x) for x in kb.upsert_chunks(old, new).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    docs = spark.createDataFrame([("x", "Fan fan heat"), ("y", "...")], "chunk_id STRING, document STRING")
    got = {x["chunk_id"]: x["embedding"] for x in kb.attach_embeddings(docs, None, 16).collect()}
    assert len(got["x"]) == 16 and np.linalg.norm(got["x"]) == pytest.approx(1.0)
    assert np.linalg.norm(got["y"]) == 0.0


FALLBACK = "Unable to parse structured diagnosis. Raw response: "
ANSWERS = {
    '{"root_cause_summary": "r", "confidence_score": 0.8, "supporting_evidence": ["e"], '
    '"recommended_actions": ["a"], "retrieved_incident_ids": ["1"]}': ("r", 0.8, ["e"], ["a"], ["1"]),
    '```json\n{"root_cause_summary": "r", "confidence_score": 1}\n```': ("r", 1.0, [], [], []),
    "  \n```\n{\"confidence_score\": 2.5}\n```\n": ("", 1.0, [], [], []),
    '{"confidence_score": -3}': ("", 0.0, [], [], []),
    '{"confidence_score": "0.9"}': ("", 0.1, [], [], []),
    "{}": ("", 0.1, [], [], []),
    "not json at all": (
        FALLBACK + "not json at all",
        0.1,
        ["LLM response parsing failed"],
        ["Review raw LLM response manually", "Check prompt template formatting"],
        [],
    ),
    "```\nbroken": (
        FALLBACK,
        0.1,
        ["LLM response parsing failed"],
        ["Review raw LLM response manually", "Check prompt template formatting"],
        [],
    ),
}


def test_answer_normalisation(spark):
    df = spark.createDataFrame([(t,) for t in ANSWERS], "raw_response STRING")
    for x in dg.normalise_diagnoses(df).collect():
        got = (
            x["root_cause_summary"], x["confidence_score"], x["supporting_evidence"],
            x["recommended_actions"], x["retrieved_incident_ids"],
        )
        assert got == ANSWERS[x["raw_response"]], x["raw_response"]
    long = spark.createDataFrame([("x" * 500,)], "raw_response STRING")
    assert len(dg.normalise_diagnoses(long).first()["root_cause_summary"]) == len(FALLBACK) + 200


def test_history_and_incident_texts(spark):
    anomalies = spark.sql(
        "SELECT 'a1' anomaly_id, 'd' device_id, TIMESTAMP '2024-01-01 01:00:00' detected_at "
        "UNION ALL SELECT 'a2', 'none', TIMESTAMP '2024-01-01 01:00:00'"
    )
    readings = spark.range(100).select(
        F.lit("d").alias("device_id"),
        F.col("id").alias("event_id"),
        F.lit("t").alias("metric_type"),
        (F.col("id") / 4).alias("value"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("timestamp"),
    )
    # 30 minutes before detection up to the end of the data: minutes 30 .. 99.
    recent = dg.recent_readings(anomalies, readings)
    assert {x["in_range"] for x in recent.filter("anomaly_id = 'a1'").collect()} == {70}
    assert dg.recent_readings(anomalies, readings, upper=True).filter("r IS NOT NULL").first()["in_range"] == 31
    assert dg.context_join(anomalies, readings).count() == 31
    text = {x["anomaly_id"]: x["recent_telemetry"] for x in dg.format_history(recent).collect()}
    lines = text["a1"].split("\n")
    assert lines[0] == "Showing 20 most recent readings:" and len(lines) == 21
    assert lines[-1] == "  2024-01-01T01:39:00+00:00 | t: 24.75"
    assert text["a2"] == dg.NO_HISTORY
    hits = spark.createDataFrame(
        [("a1", 1, "i1", "T", "high", "c", "one"), ("a1", 2, "i1", "T", "high", "c", "two"),
         ("a1", 3, "i2", None, None, None, "three")],
        "anomaly_id STRING, rank INT, incident_id STRING, title STRING, severity STRING, "
        "failure_category STRING, document STRING",
    )
    out = dg.format_incidents(hits).first()
    assert out["retrieved_ids"] == ["i1", "i2"]
    assert "### Incident 3 (ID: i2)\n**Title:** Unknown incident" in out["retrieved_incidents"]
    assert "two" not in out["retrieved_incidents"]


def test_incident_files(spark, tmp_path):
    import json

    from devicelens.sources.tables import read_incidents

    record = {
        "title": "Fan failure", "description": "Fan stopped in rack", "affected_device_types": ["gw"],
        "root_cause": "Bearing worn out", "resolution_steps": ["replace", "verify"], "severity": "high",
        "failure_category": "thermal", "tags": ["fan"],
    }
    for name in ("002.json", "001.json"):
        (tmp_path / name).write_text(json.dumps(record, indent=1))
    df = read_incidents(spark, str(tmp_path))
    assert [x["source_file"] for x in df.orderBy("source_file").collect()] == ["001.json", "002.json"]
    assert kb.incident_text(df).first()["text"] == (
        "Incident: Fan failure\n\nDescription: Fan stopped in rack\n\nRoot Cause: Bearing worn out\n\n"
        "Resolution Steps:\n- replace\n- verify\n\nAffected Device Types: gw\nSeverity: high\nCategory: thermal"
    )


def test_a_batch_of_long_texts_is_cut_in_parts():
    import pyarrow as pa

    from devicelens.operators.knowledge import _chunker

    texts = ["one two. " * 30, "three, four " * 20, " " * 300, "five six. " * 25]
    given = pa.RecordBatch.from_arrays([pa.array([7, 8, None, 9]), pa.array(texts)], ["id", "text"])
    parts = list(_chunker("text", ["id"], 100, 10, rows=1)(iter([given])))
    assert len(parts) == 4
    got = [tuple(row.values()) for part in parts for row in part.to_pylist()]
    want = [(key, n, c) for key, t in zip([7, 8, None, 9], texts) for n, c in enumerate(chunk_text(t, 100, 10))]
    assert got == want and {key for key, _, _ in got} == {7, 8, 9}
