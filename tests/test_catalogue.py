import duckdb
import pytest

import __spark_entry__ as entry
from devicelens.catalog import registry
from tools.check import TABLES, canonical

QUERIES, ORACLES = registry.catalogue().queries, registry.catalogue().oracles

# One query per area; tools/check.py compares all of them.
SAMPLE = [
    "a1_rolling_stats", "a2_rolling_stats_dedupe", "a7_detect_anomalies", "e1_enrich", "v1_validate_raw",
    "m2_rate", "rr5_http_5xx_ratio", "rr6_http_latency_p95", "ar1_service_down", "l5_alert_episodes",
    "l7_inhibit", "t4_diagnosis_triage", "r6_cosine_topk", "r8_recent_readings", "r12_normalise_answers",
    "k2_retry_after", "q1_query_telemetry", "g3_firing_gauges", "s8_webhook_alerts",
]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert sorted(set(QUERIES) - set(ORACLES)) == []


def test_entry_registers_the_catalogue():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_inventory_is_covered():
    have = {name.split("_")[0] for name in QUERIES}
    want = (
        [f"v{i}" for i in range(1, 11)] + [f"e{i}" for i in range(1, 11)] + [f"a{i}" for i in range(1, 10)]
        + [f"g{i}" for i in range(1, 12)] + [f"m{i}" for i in range(1, 15)] + [f"rr{i}" for i in range(1, 30)]
        + [f"db{i}" for i in range(1, 28)] + [f"l{i}" for i in range(1, 14)] + [f"ar{i}" for i in range(1, 23)]
        + [f"in{i}" for i in range(1, 8)] + [f"t{i}" for i in range(1, 6)] + [f"r{i}" for i in range(1, 14)]
        + [f"q{i}" for i in range(1, 14)] + ["k1", "k2"]
    )
    assert [x for x in want if x not in have] == []


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    mine = canonical(df.columns, [tuple(x) for x in df.collect()])
    cursor = con.execute(ORACLES[name])
    assert mine == canonical([c[0] for c in cursor.description], cursor.fetchall())
