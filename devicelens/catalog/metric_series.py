"""Series algebra, recording rules and dashboards (M*, RR*, DB*, E8, E9, G6-G8, ST3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from devicelens.catalog.domain import END_S, Domain
from devicelens.catalog.registry import Registry, r, us
from devicelens.catalog.sql import (
    INF,
    PARTS,
    build,
    bucket_counter,
    counter,
    quantile,
    rate,
    rate_by,
    rd,
)
from devicelens.operators import series as s
from devicelens.operators import summaries as su
from devicelens.operators.histograms import (
    DELIVERY_BUCKETS,
    DIAGNOSIS_BUCKETS,
    HTTP_BUCKETS,
    TRIAGE_BUCKETS,
    histogram_quantile,
    to_buckets,
)
from devicelens.plans import dashboards as db
from devicelens.plans import recording as rr

VALUE_BUCKETS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0)

# --- counters in SQL ----------------------------------------------------------------------------

HTTP_L = ("job", "endpoint", "method", "status_code")
HTTP_BL = ("job", "endpoint", "method", "le")
counter("http", "instrumented", HTTP_L, "ts_us")
counter("ingested", "accepted", (), "ts_us")
counter("dlq", "dead_letters", ("reason",), "failed_us")
counter("analyzed", "scored", (), "ts_us")
counter("anom", "anomalies", ("severity",), "detected_us")

PARTS["publish_errors"] = (
    "SELECT *, CASE WHEN method = 'POST' THEN 'timeout' ELSE 'connection' END AS error_type "
    "FROM requests WHERE status_code = '500'"
)
PARTS["diagnosed"] = "SELECT * FROM answers WHERE failed_phase IS NULL"
PARTS["undiagnosed"] = (
    "SELECT *, failed_phase AS phase FROM answers WHERE failed_phase IS NOT NULL"
)
PARTS["webhook_log"] = (
    "SELECT *, CASE WHEN notification_id % 17 = 0 THEN '500' ELSE '202' END AS status_code "
    "FROM alert_log"
)
PARTS["alert_errors"] = (
    "SELECT *, CASE WHEN priority = '5-LOW' THEN 'ValueError' ELSE 'KeyError' END AS error_type "
    "FROM alert_log WHERE notification_id % 17 = 0"
)
counter("puberr", "publish_errors", ("error_type",), "ts_us")
counter("diag", "diagnosed", ("severity",), "detected_us")
counter("diagfail", "undiagnosed", ("phase",), "detected_us")
counter("alerts_in", "alert_log", ("status", "severity"), "received_us")
counter("webhooks", "webhook_log", ("status_code",), "received_us")
counter("alerr", "alert_errors", ("error_type",), "received_us")
counter("triaged", "triage_runs", ("result",), "received_us")
bucket_counter("httpb", "instrumented", "duration", HTTP_BUCKETS, HTTP_BL[:3], "ts_us")
bucket_counter("diagb", "answers", "generation_s", DIAGNOSIS_BUCKETS, (), "detected_us")
bucket_counter("triageb", "triage_runs", "triage_s", TRIAGE_BUCKETS, (), "received_us")
bucket_counter("deliverb", "deliveries", "delivery_s", DELIVERY_BUCKETS, (), "received_us")

TOTAL = {
    "ingested": rate("ingested_c"),
    "dlq": rate_by("dlq_c", ("reason",)),
    "analyzed": rate("analyzed_c"),
    "anom": rate_by("anom_c", ("severity",)),
    "puberr": rate_by("puberr_c", ("error_type",)),
    "diag": rate_by("diag_c", ("severity",)),
    "diagfail": rate_by("diagfail_c", ("phase",)),
}


def _ratio(a: str, b: str, floor: float, on: str = "t") -> str:
    return f"""SELECT {on}, a.v / greatest(b.v, {floor}) AS v FROM ({a}) a JOIN ({b}) b USING ({on})"""


def _sum(a: str, b: str) -> str:
    return f"SELECT t, a.v + b.v AS v FROM ({a}) a JOIN ({b}) b USING (t)"


def _shifted(a: str, by: int) -> str:
    return f"SELECT t + {by} AS t, v FROM ({a})"


# SQL of the recording rules: ``labels, t, v``.
RULE_SQL: dict[str, str] = {
    "rr1": rate_by("http_c", HTTP_L, ("job",)),
    "rr2": rate_by("http_c", HTTP_L, ("job", "endpoint", "method")),
    "rr3": rate_by("http_c", HTTP_L, ("job",), where="status_code LIKE '5__'"),
    "rr4": rate_by("http_c", HTTP_L, ("job",), where="status_code LIKE '4__'"),
    "rr6": quantile("httpb_c", HTTP_BL, 0.95, ("job", "endpoint")),
    "rr7": quantile("httpb_c", HTTP_BL, 0.99, ("job",)),
    "rr8": TOTAL["ingested"],
    "rr9": rate("ingested_c", (), 60),
    "rr10": rate_by("dlq_c", ("reason",), ("reason",)),
    "rr11": TOTAL["dlq"],
    "rr12": _ratio(TOTAL["dlq"], _sum(TOTAL["ingested"], TOTAL["dlq"]), 1.0),
    "rr13": rate_by("puberr_c", ("error_type",), ("error_type",)),
    "rr14": TOTAL["puberr"],
    "rr15": rate_by("anom_c", ("severity",), ("severity",)),
    "rr16": TOTAL["anom"],
    "rr17": rate_by("anom_c", ("severity",), where="severity IN ('critical', 'high')"),
    "rr18": TOTAL["analyzed"],
    "rr19": _ratio(TOTAL["anom"], TOTAL["analyzed"], 0.001),
    "rr20": rate_by("diag_c", ("severity",), ("severity",)),
    "rr21": TOTAL["diag"],
    "rr22": rate_by("diagfail_c", ("phase",), ("phase",)),
    "rr23": TOTAL["diagfail"],
    "rr24": _ratio(TOTAL["diagfail"], _sum(TOTAL["diag"], TOTAL["diagfail"]), 0.001),
    "rr25": quantile("diagb_c", ("le",), 0.95),
    "rr26": quantile("diagb_c", ("le",), 0.99),
    "rr27": _ratio(TOTAL["ingested"], _shifted(TOTAL["ingested"], 900), 0.001),
    "rr28": _ratio(TOTAL["anom"], _shifted(TOTAL["anom"], 900), 0.001),
    "rr29": _ratio(TOTAL["analyzed"], TOTAL["ingested"], 0.001),
}
RULE_SQL["rr5"] = _ratio(RULE_SQL["rr3"], RULE_SQL["rr1"], 1.0, "job, t")


def _quantiles_sql(source: str, labels, qs: dict[str, float], by=(), where: str = "true") -> str:
    on = ", ".join([*by, "t"])
    cols = ", ".join(f"{n}.v AS {n}" for n in qs)
    joined = ""
    for n, q in qs.items():
        part = f"({quantile(source, labels, q, by, where)}) {n}"
        joined = part if not joined else f"{joined} JOIN {part} USING ({on})"
    return f"SELECT {on}, {cols} FROM {joined}"


def _total_sql(source: str, by: str = "") -> str:
    lab = f"{by}, " if by else ""
    return f"SELECT {lab}sum(v) AS v FROM {source} WHERE t = {END_S} GROUP BY ALL"


PANEL_SQL: dict[str, str] = {
    "db1": rate_by("http_c", HTTP_L, ("endpoint",), 60),
    "db2": quantile("httpb_c", HTTP_BL, 0.95, ("endpoint",)),
    "db3": rate_by(
        "http_c", HTTP_L, ("status_code",), 60, "status_code LIKE '4__' OR status_code LIKE '5__'"
    ),
    "db4": "SELECT job, instance, t, v FROM up_ticks",
    "db5": "SELECT job, instance, t, v FROM memory_ticks",
    "db6": RULE_SQL["rr9"],
    "db7": rate_by("dlq_c", ("reason",), ("reason",), 60),
    "db8": _total_sql("ingested_c"),
    "db9": _total_sql("dlq_c"),
    "db10": _total_sql("puberr_c"),
    "db11": _quantiles_sql(
        "httpb_c",
        HTTP_BL,
        db.P50_95_99,
        where="method = 'POST' AND endpoint = '/api/v1/telemetry'",
    ),
    "db12": _total_sql("anom_c"),
    "db13": _total_sql("analyzed_c"),
    "db14": rate_by("anom_c", ("severity",), ("severity",), 60),
    "db15": _total_sql("anom_c", "severity"),
    "db16": f"""SELECT t, a.v AS analyzed, b.v AS detected FROM ({rate("analyzed_c", (), 60)}) a
                JOIN ({rate_by("anom_c", ("severity",), (), 60)}) b USING (t)""",
    "db17": f"""SELECT 'generated' AS outcome, v FROM ({_total_sql("diag_c")}) UNION ALL
                SELECT 'failed', v FROM ({_total_sql("diagfail_c")})""",
    "db18": _quantiles_sql("diagb_c", ("le",), db.P50_95_99),
    "db20": rate_by("alerts_in_c", ("status", "severity"), ("status",)),
    "db21": rate_by("alerts_in_c", ("status", "severity"), ("severity",), where="status = 'firing'"),
    "db22": _quantiles_sql("deliverb_c", ("le",), db.P50_95_99),
    "db23": rate_by("triaged_c", ("result",), ("result",)),
    "db24": _quantiles_sql("triageb_c", ("le",), db.P50_95),
    "db25": rate_by("alerr_c", ("error_type",), ("error_type",)),
    "db26": rate_by("webhooks_c", ("status_code",), ("status_code",)),
    "db27": _total_sql("alerts_in_c"),
}


def series_out(frame, labels=(), values=("value",), timed: bool = True, digits: int = 6):
    return frame.select(*labels, *([us("ts")] if timed else []), *[r(v, digits) for v in values])


def series_sql(body: str, labels=(), values=("value",), timed: bool = True, digits: int = 6) -> str:
    lab = "".join(f"{c}, " for c in labels)
    ts = "t * 1000000 AS ts_us, " if timed else ""
    cols = ", ".join(
        f"{rd('v' if v == 'value' else v, digits)} AS {v}" for v in values
    )
    return build(f"SELECT {lab}{ts}{cols} FROM ({body})")


def _sawtooth(d: Domain):
    """Reading values as a counter that restarts at every drop, at irregular times."""
    return d.readings.select("metric_type", F.col("timestamp").alias("ts"), "value")


SAWTOOTH_SQL = """
    SELECT metric_type, ts_us, {result} AS v FROM (
      SELECT metric_type, ts_us, count(*) OVER w AS n, value - first_value(value) OVER w +
             sum(reset) OVER w - first_value(reset) OVER w AS inc, first_value(value) OVER w AS v0,
             (ts_us - first_value(ts_us) OVER w) / 1e6 AS sampled,
             (first_value(ts_us) OVER w - (ts_us - 300000000)) / 1e6 AS start
      FROM (SELECT metric_type, ts_us, value, CASE WHEN value < prev THEN prev ELSE 0.0 END AS reset
            FROM (SELECT *, lag(value) OVER (PARTITION BY metric_type ORDER BY ts_us) AS prev FROM readings))
      WINDOW w AS (PARTITION BY metric_type ORDER BY ts_us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW))
    WHERE n >= 2"""
EXTRAPOLATED = """inc * ((sampled + least(
    CASE WHEN start >= 1.1 * sampled / (n - 1) THEN sampled / (n - 1) / 2 ELSE start END,
    coalesce(CASE WHEN inc > 0 THEN sampled * v0 / inc END, 1e18))) / sampled) / 300"""


def _bucketed(d: Domain):
    return to_buckets(d.readings, ["metric_type"], "value", VALUE_BUCKETS)


def _buckets_sql(source: str, value: str, bounds, labels: str = "") -> str:
    lab = f"{labels}, " if labels else ""
    every = ", ".join([*(f"CAST({b} AS DOUBLE)" for b in bounds), INF])
    return f"""SELECT {lab}le, count(*) FILTER ({value} <= le) AS cumulative, sum({value}) AS total, count(*) AS n
               FROM {source}, (SELECT unnest([{every}]) AS le) b GROUP BY ALL"""


def _bucket_out(frame, *labels):
    return frame.select(*labels, F.col("le").cast("string").alias("le"), "cumulative", r("total", 4), "n")


def _bucket_sql(body: str, *labels) -> str:
    lab = "".join(f"{c}, " for c in labels)
    return build(
        f"""SELECT {lab}CASE WHEN isinf(le) THEN 'Infinity' ELSE CAST(le AS VARCHAR) END AS le, cumulative,
            {rd('total', 4)} AS total, n FROM ({body})"""
    )


def register(reg: Registry) -> None:
    # --- algebra -----------------------------------------------------------------------------
    reg.add(
        "m1_to_counter",
        lambda d: series_out(d.metrics[rr.HTTP].samples, HTTP_L),
        series_sql("SELECT * FROM http_c", HTTP_L),
    )
    reg.add(
        "m2_rate",
        lambda d: series_out(s.rate(_sawtooth(d), ["metric_type"]), ["metric_type"], digits=9),
        build(
            f"SELECT metric_type, ts_us, {rd('v', 9)} AS value FROM "
            f"({SAWTOOTH_SQL.format(result=EXTRAPOLATED)})"
        ),
    )
    reg.add(
        "m2_increase_per_second",
        lambda d: series_out(
            s.rate(_sawtooth(d), ["metric_type"], extrapolate=False), ["metric_type"], digits=9
        ),
        build(
            f"SELECT metric_type, ts_us, {rd('v', 9)} AS value FROM "
            f"({SAWTOOTH_SQL.format(result='inc / 300')})"
        ),
    )
    reg.add(
        "m3_sum_by",
        lambda d: series_out(s.sum_by(d.metrics[rr.HTTP].samples, ["endpoint"]), ["endpoint"]),
        series_sql("SELECT endpoint, t, sum(v) AS v FROM http_c GROUP BY ALL", ["endpoint"]),
    )
    reg.add(
        "m4_match",
        lambda d: series_out(
            s.match(d.metrics[rr.HTTP].samples, status_code="4..|5..", method="POST"), HTTP_L
        ),
        series_sql(
            "SELECT * FROM http_c WHERE regexp_full_match(status_code, '4..|5..') AND method = 'POST'",
            HTTP_L,
        ),
    )
    reg.add(
        "m5_ratio",
        lambda d: series_out(
            s.ratio(
                d.metrics.rate_by(rr.HTTP, ("endpoint",), method="POST"),
                d.metrics.rate_by(rr.HTTP, ("endpoint",)),
                0.001,
                ["endpoint"],
            ),
            ["endpoint"],
        ),
        series_sql(
            _ratio(
                rate_by("http_c", HTTP_L, ("endpoint",), where="method = 'POST'"),
                rate_by("http_c", HTTP_L, ("endpoint",)),
                0.001,
                "endpoint, t",
            ),
            ["endpoint"],
        ),
    )
    reg.add(
        "m6_clamp_min",
        lambda d: series_out(
            s.clamp_min(s.add(d.metrics.rate(rr.INGESTED), d.metrics.rate_by(rr.DLQ)), 1.0)
        ),
        series_sql(f"SELECT t, greatest(v, 1.0) AS v FROM ({_sum(TOTAL['ingested'], TOTAL['dlq'])})"),
    )
    reg.add(
        "m7_histogram_quantile",
        lambda d: series_out(
            histogram_quantile(
                _bucketed(d).select(
                    "metric_type",
                    "le",
                    F.timestamp_seconds(F.lit(END_S)).alias("ts"),
                    F.col("cumulative").cast("double").alias("value"),
                ),
                0.9,
                ["metric_type"],
            ),
            ["metric_type"],
        ),
        series_sql(
            f"""SELECT metric_type, CAST({END_S} AS BIGINT) AS t, CASE WHEN le = {INF} THEN low
                ELSE low + (le - low) * ((0.9 * total - below) / (v - below)) END AS v
                FROM (SELECT *, row_number() OVER (PARTITION BY metric_type ORDER BY le) AS i FROM (
                  SELECT *, coalesce(lag(le) OVER o, 0) AS low, coalesce(lag(v) OVER o, 0) AS below,
                         max(v) OVER (PARTITION BY metric_type) AS total
                  FROM (SELECT metric_type, le, cumulative AS v
                        FROM ({_buckets_sql("readings", "value", VALUE_BUCKETS, "metric_type")}))
                  WINDOW o AS (PARTITION BY metric_type ORDER BY le)) WHERE v >= 0.9 * total) WHERE i = 1""",
            ["metric_type"],
        ),
    )
    reg.add(
        "m8_offset",
        lambda d: series_out(s.offset(d.metrics.rate(rr.INGESTED), 900)),
        series_sql(_shifted(TOTAL["ingested"], 900)),
    )
    reg.add(
        "m9_binary_op",
        lambda d: series_out(
            s.binary_op(
                s.sum_by(d.metrics[rr.HTTP].samples, ["job", "endpoint"]),
                s.sum_by(d.metrics[rr.HTTP].samples, ["job"]),
                lambda a, b: a - b,
                ["job"],
            ),
            ["job", "endpoint"],
        ),
        series_sql(
            """SELECT job, endpoint, t, a.v - b.v AS v
               FROM (SELECT job, endpoint, t, sum(v) AS v FROM http_c GROUP BY ALL) a
               JOIN (SELECT job, t, sum(v) AS v FROM http_c GROUP BY ALL) b USING (job, t)""",
            ["job", "endpoint"],
        ),
    )
    reg.add(
        "m10_compare",
        lambda d: series_out(s.compare(d.metrics.rate_by(rr.DLQ), ">", 0.3)),
        series_sql(f"SELECT * FROM ({TOTAL['dlq']}) WHERE v > 0.3"),
    )
    above = f"SELECT * FROM ({TOTAL['ingested']}) WHERE v > 0.6"
    reg.add(
        "m11_and",
        lambda d: series_out(
            s.v_and(
                d.metrics.rate_by(rr.DLQ, ("reason",)),
                s.compare(d.metrics.rate(rr.INGESTED), ">", 0.6),
            ),
            ["reason"],
        ),
        series_sql(
            f"SELECT * FROM ({RULE_SQL['rr10']}) WHERE t IN (SELECT t FROM ({above}))", ["reason"]
        ),
    )
    reg.add(
        "m11_or",
        lambda d: series_out(
            s.v_or(
                s.compare(d.metrics.rate_by(rr.HTTP, ("job",)), ">", 0.121),
                d.metrics.rate_by(rr.HTTP, ("job",), status_code="5.."),
                ["job"],
            ),
            ["job"],
        ),
        series_sql(
            f"""WITH a AS (SELECT * FROM ({RULE_SQL["rr1"]}) WHERE v > 0.121)
                SELECT * FROM a UNION ALL SELECT * FROM ({RULE_SQL["rr3"]})
                WHERE (job, t) NOT IN (SELECT (job, t) FROM a)""",
            ["job"],
        ),
    )
    reg.add(
        "m12_instant",
        lambda d: series_out(d.metrics.gauge(rr.UP), ["job", "instance"]),
        series_sql("SELECT * FROM up_ticks", ["job", "instance"]),
    )
    reg.add(
        "m13_total",
        lambda d: series_out(d.metrics.total(rr.HTTP, ("job",)), ["job"], timed=False),
        series_sql(_total_sql("http_c", "job"), ["job"], timed=False),
    )
    reg.add(
        "m14_grid",
        # Every tick of the grid with the number of readings counted at it.
        lambda d: s.grid(
            d.spark, "2024-01-01 00:00:00", "2024-01-01 03:00:00", 15
        )
        .join(
            d.readings.groupBy(F.timestamp_seconds(s.tick_of("timestamp", 15)).alias("ts")).agg(
                F.count(F.lit(1)).alias("n")
            ),
            "ts",
            "left",
        )
        .select(us("ts"), F.coalesce("n", F.lit(0)).alias("n")),
        build(
            """SELECT t * 1000000 AS ts_us, count(event_id) AS n FROM grid
               LEFT JOIN readings ON t = ((ts_us + 14999999) // 15000000) * 15 GROUP BY ALL"""
        ),
    )

    # --- joins of series -----------------------------------------------------------------------
    reg.add(
        "e8_vector_matching",
        lambda d: series_out(
            s.ratio(
                d.metrics.rate_by(rr.HTTP, ("job",), status_code="5.."),
                d.metrics.rate_by(rr.HTTP, ("job",)),
                1.0,
                ["job"],
            ),
            ["job"],
        ),
        series_sql(RULE_SQL["rr5"], ["job"]),
    )
    reg.add(
        "e9_offset_join",
        lambda d: s.binary_op(
            d.metrics.rate(rr.INGESTED).withColumnRenamed("value", "now").withColumn(
                "value", F.col("now")
            ),
            s.offset(d.metrics.rate(rr.INGESTED), 900),
            lambda a, b: b,
        ).select(us("ts"), r("now"), r("value", alias="before")),
        build(
            f"""SELECT t * 1000000 AS ts_us, {rd("a.v")} AS now, {rd("b.v")} AS before
                FROM ({TOTAL["ingested"]}) a JOIN ({_shifted(TOTAL["ingested"], 900)}) b USING (t)"""
        ),
    )

    # --- recording rules and dashboards ----------------------------------------------------------
    for rule in rr.RECORDING_RULES:
        reg.add(
            f"{rule.id}_{rule.key}",
            lambda d, rule=rule: series_out(rule.compute(d.metrics), rule.labels),
            series_sql(RULE_SQL[rule.id], rule.labels),
        )
    for panel in db.PANELS:
        digits = 2 if panel.id == "db5" else 6  # bytes
        reg.add(
            f"{panel.id}_{panel.key}",
            lambda d, p=panel, n=digits: series_out(
                p.compute(d.metrics), p.labels, p.values, p.over_time, n
            ),
            series_sql(PANEL_SQL[panel.id], panel.labels, panel.values, panel.over_time, digits),
        )
    reg.add(
        "st3_sliding_rate",
        # Batch result of the streaming sliding-window rate.
        lambda d: _sliding(d),
        build(
            """SELECT metric_type, w * 1000000 AS start_us, count(*) AS n FROM (
                 SELECT metric_type, unnest(range((ts_us // 15000000 - 19) * 15, ts_us // 15000000 * 15 + 1, 15)) AS w
                 FROM readings) GROUP BY ALL"""
        ),
    )

    # --- histograms ------------------------------------------------------------------------------
    reg.add(
        "g6_histogram_buckets",
        lambda d: _bucket_out(_bucketed(d), "metric_type"),
        _bucket_sql(_buckets_sql("readings", "value", VALUE_BUCKETS, "metric_type"), "metric_type"),
    )
    reg.add(
        "g7_http_requests",
        lambda d: su.http_requests(d.requests),
        build(
            """SELECT method, endpoint, status_code, count(*) AS n FROM requests
               WHERE endpoint <> '/metrics' GROUP BY ALL"""
        ),
    )
    reg.add(
        "g7_http_latency",
        lambda d: _bucket_out(su.http_latency(d.requests), "method", "endpoint"),
        _bucket_sql(
            _buckets_sql("instrumented", "duration", HTTP_BUCKETS, "method, endpoint"),
            "method",
            "endpoint",
        ),
    )
    reg.add(
        "g8_delivery_latency",
        lambda d: _bucket_out(su.delivery_latency(d.alert_log)),
        _bucket_sql(_buckets_sql("deliveries", "delivery_s", DELIVERY_BUCKETS)),
    )


def _sliding(d: Domain):
    from devicelens.streaming.rates import sliding_counts

    return sliding_counts(d.readings, ["metric_type"], "timestamp", 300, 15).select(
        "metric_type", us("window_start", "start_us"), "n"
    )
