"""The driver tables seen as device telemetry.

``events`` spans 30 days with few readings per minute; it is replayed 240 times faster (30 days in
3 hours), so that the real settings -- 5-minute windows, a 15-second grid, 1 to 10 minute holding
times -- apply to it as they are.  ``orders`` (6.6 years) is replayed into the same 3 hours as the
alert notification log.  Detection runs per metric, since one user has about 13 events per metric.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelens.config import DetectorConfig
from devicelens.functions.times import MICROS, micros
from devicelens.operators import alerts as al
from devicelens.operators import anomalies as an
from devicelens.operators import dead_letters as dl
from devicelens.operators import diagnosis as dg
from devicelens.operators import enrichment as en
from devicelens.operators.histograms import (
    DELIVERY_BUCKETS,
    DIAGNOSIS_BUCKETS,
    HTTP_BUCKETS,
    TRIAGE_BUCKETS,
    bucket_counter,
)
from devicelens.operators.series import to_counter
from devicelens.plans import dashboards as db
from devicelens.plans import recording as rr
from devicelens.plans.alert_rules import FROM_JOB, rule_catalogue
from devicelens.plans.metrics import Metrics, Series
from devicelens.plans.rule_engine import Feed

START_S = 1_704_067_200  # 2024-01-01
END_S = START_S + 10_800
EVENT_SPEED = 240
ORDERS_START_S = 788_918_400  # 1995-01-01
ORDER_SPEED = 19_232
SHIPMENTS_START_S = ORDERS_START_S
SHIPMENT_SPEED = 20_480

JOBS = ("api-gateway", "ingestion-consumer", "anomaly-detection", "diagnosis-service", "alert-receiver")
ENDPOINTS = {
    "purchase": "/api/v1/telemetry",
    "click": "/api/v1/anomalies",
    "signup": "/api/v1/devices",
    "error": "/api/v1/knowledge",
    "view": "/metrics",
}
MAX_VALUE = 300.0
DETECTOR = DetectorConfig(keys=("metric_type",))


def replay(ts: Column, origin_s: int, speed: int) -> Column:
    """Move a time into the replay window (whole microseconds, rounded down)."""
    passed = F.unix_micros(ts) - origin_s * MICROS
    return F.timestamp_micros(
        F.lit(START_S * MICROS) + F.floor((passed - F.pmod(passed, F.lit(speed))) / speed)
    )


def one_of(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def switch(col: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default)
    for key, value in mapping.items():
        out = F.when(col == key, value).otherwise(out)
    return out


def failed_phase() -> Column:
    phases = {"0": "context", "1": "retrieval", "2": "generation", "3": "persistence"}
    return switch((F.col("event_id") % 13).cast("string"), phases)


def generation_seconds() -> Column:
    return F.col("k") * 1.5


class Domain:
    """Lazy domain frames over one directory of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # The tables hold zone-less UTC times.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    # --- readings and devices -----------------------------------------------------------------

    @cached_property
    def readings(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("user_id").alias("device_id"),
            F.col("event_type").alias("metric_type"),
            "value",
            replay(F.col("ts").cast("timestamp"), START_S, EVENT_SPEED).alias("timestamp"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )

    @cached_property
    def history(self) -> DataFrame:
        """Readings at their original, zone-less time (plain columns, so filters are pushed)."""
        return self.table("events").select(
            "event_id",
            F.col("user_id").alias("device_id"),
            F.col("event_type").alias("metric_type"),
            "value",
            F.col("ts").alias("timestamp"),
        )

    def _registry(self, table: str, key: str, name: str, nation: str) -> DataFrame:
        nations = self.table("nation").select(F.col("n_nationkey").alias(nation), "n_name")
        return self.table(table).join(nations, nation).select(
            F.col(key).alias("device_id"),
            F.col(name).alias("device_name"),
            F.concat(F.lit("type_"), (F.col(nation) % 4).cast("string")).alias("device_type"),
            F.col("n_name").alias("location"),
            F.when(F.col(key) % 10 == 0, F.lit(""))
            .otherwise(F.concat(F.lit("v1."), (F.col(key) % 3).cast("string")))
            .alias("firmware_version"),
            F.timestamp_seconds(F.lit(START_S) + F.col(key) * 60).alias("registered_at"),
        )

    @cached_property
    def devices(self) -> DataFrame:
        return self._registry("supplier", "s_suppkey", "s_name", "s_nationkey")

    @cached_property
    def devices_all(self) -> DataFrame:
        return self._registry("customer", "c_custkey", "c_name", "c_nationkey")

    @cached_property
    def payloads(self) -> DataFrame:
        """Raw JSON payloads of the readings, one in ten damaged in one of ten ways."""
        good = F.format_string(
            '{"device_id": "%s", "metric_type": "%s", "value": %s, "timestamp": "%s"}',
            F.col("device_id"),
            F.col("metric_type"),
            F.col("value").cast("string"),
            F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        )
        broken = {
            0: F.regexp_replace(good, '"device_id"', '"bad"'),
            1: F.regexp_replace(good, '"device_id": "', '"device_id": "x'),
            2: F.lit("completely invalid json {{{{"),
            3: F.lit("42"),
            4: F.lit(""),
            5: F.regexp_replace(good, '"value": ', '"value": "high", "was": '),
            6: F.regexp_replace(good, '"value": ([0-9.]+)', '"value": "$1"'),
            7: F.regexp_replace(good, '"timestamp": "', '"timestamp": "not a time '),
            8: F.regexp_replace(good, '"metric_type"', '"metric"'),
            9: F.regexp_replace(good, "}$", ', "metadata": 5}'),
        }
        payload = good
        for digit, text in broken.items():
            payload = F.when(
                (F.col("event_id") % 10 == 7) & (F.col("k") % 10 == digit), text
            ).otherwise(payload)
        return self.readings.select("event_id", payload.alias("payload"))

    @cached_property
    def enriched(self) -> DataFrame:
        return en.enrich(self.readings, self.devices)

    @cached_property
    def dead_letters(self) -> DataFrame:
        """Rejects of the readings: values out of range, then unknown devices."""
        as_payload = self.readings.withColumn(
            "payload", F.to_json(F.struct("device_id", "metric_type", "value"))
        )
        marked = en.enrich_or_mark(as_payload, self.devices)
        failed_at = F.col("timestamp")

        def envelope(rows: DataFrame, reason: str) -> DataFrame:
            # Keep the event id next to the envelope: it makes result orders total.
            text = dl._texts(F.col("device_id").cast("string"), F.lit("value out of range"))[reason]
            return rows.select(
                "event_id",
                F.lit(dl.RAW_TOPIC).alias("original_topic"),
                F.col("payload").alias("original_payload"),
                text.alias("error_reason"),
                F.lit(reason).alias("reason"),
                failed_at.alias("failed_at"),
            )

        out_of_range = F.col("value") > MAX_VALUE
        return envelope(marked.filter(out_of_range), "validation_failed").unionByName(
            envelope(marked.filter(~out_of_range & ~F.col("known")), "device_not_found")
        )

    @cached_property
    def accepted(self) -> DataFrame:
        return self.enriched.filter(F.col("value") <= MAX_VALUE)

    # --- detection and diagnosis --------------------------------------------------------------

    @cached_property
    def scored(self) -> DataFrame:
        return an.scored_readings(self.enriched, DETECTOR)

    @cached_property
    def anomalies(self) -> DataFrame:
        return an.to_anomalies(self.scored, DETECTOR)

    @cached_property
    def anomaly_table(self) -> DataFrame:
        """The anomalies later stages read; a deployment passes its stored table here."""
        return self.anomalies

    @cached_property
    def answers(self) -> DataFrame:
        """Model answers per anomaly: plain, fenced, blank, incomplete, oddly typed."""
        k = F.get_json_object("props", "$.k").cast("bigint")
        events = self.table("events").select("event_id", k.alias("k"))
        e = F.col("event_id")
        body = F.format_string(
            '{"root_cause_summary": "cause %d", "confidence_score": %s, '
            '"supporting_evidence": ["e%d"], "recommended_actions": ["act %d", "act %d"], '
            '"retrieved_incident_ids": ["%d"]}',
            F.col("k") % 7,
            F.when(e % 11 == 2, F.lit('"high"')).otherwise((F.col("k") / 50).cast("string")),
            F.col("k"),
            F.col("k") % 3,
            F.col("k") % 4,
            F.col("k"),
        )
        text = (
            F.when(e % 5 == 0, F.lit(""))
            .when(e % 7 == 1, F.lit('{"root_cause_summary": "only"}'))
            .when(e % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .otherwise(body)
        )
        return self.anomaly_table.join(events, "event_id").select(
            "event_id",
            "anomaly_id",
            "device_id",
            "severity",
            "detected_at",
            text.alias("raw_response"),
            failed_phase().alias("failed_phase"),
            generation_seconds().alias("generation_time_seconds"),
            F.timestamp_micros(micros("detected_at") + 20 * MICROS).alias("generated_at"),
        )

    @cached_property
    def diagnosed(self) -> DataFrame:
        """Diagnoses with the device, severity and time of their anomaly."""
        made = dg.normalise_diagnoses(self.answers.filter(F.col("failed_phase").isNull()))
        return made.withColumn("diagnosis_id", F.col("event_id")).drop("raw_response", "failed_phase")

    @cached_property
    def diagnoses(self) -> DataFrame:
        return self.diagnosed.drop("device_id", "severity", "detected_at")

    # --- requests and metrics -------------------------------------------------------------------

    @cached_property
    def requests(self) -> DataFrame:
        kind = F.col("metric_type")
        return self.readings.select(
            "event_id",
            "device_id",
            one_of(JOBS, F.col("device_id") % 5).alias("job"),
            F.concat(F.lit("node-"), (F.col("device_id") % 16).cast("string")).alias("instance"),
            F.when(F.col("k") % 2 == 0, "POST").otherwise("GET").alias("method"),
            switch(kind, ENDPOINTS).alias("endpoint"),
            F.when(kind == "error", "500")
            .when(kind == "signup", "404")
            .otherwise("200")
            .alias("status_code"),
            (F.col("value") / 100).alias("duration"),
            "value",
            "k",
            "timestamp",
        )

    @cached_property
    def instrumented(self) -> DataFrame:
        return self.requests.filter(F.col("endpoint") != "/metrics")

    @cached_property
    def up_samples(self) -> DataFrame:
        """Scrape results: an instance answers (1) or not (0) at the time of its requests."""
        return self.requests.select(
            "job",
            "instance",
            F.col("timestamp").alias("ts"),
            F.when(F.col("k") < 50, 0.0).otherwise(1.0).alias("value"),
        )

    @cached_property
    def memory_samples(self) -> DataFrame:
        return self.requests.select(
            "job",
            "instance",
            F.col("timestamp").alias("ts"),
            (F.col("value") * 10 * 1024 * 1024).alias("value"),
        )

    def _counter(self, events: DataFrame, *labels: str, ts: str = "timestamp") -> Series:
        return Series(
            to_counter(events, list(labels), ts, 15, START_S, END_S), tuple(labels)
        )

    def _buckets(self, rows: DataFrame, value: str, bounds, *labels: str, ts: str = "timestamp"):
        return Series(
            bucket_counter(rows, list(labels), value, bounds, ts, 15, START_S, END_S),
            (*labels, "le"),
        )

    @cached_property
    def metrics(self) -> Metrics:
        generated = F.col("failed_phase").isNull()
        return Metrics(
            {
                rr.HTTP: lambda: self._counter(
                    self.instrumented, "job", "endpoint", "method", "status_code"
                ),
                rr.HTTP_BUCKETS: lambda: self._buckets(
                    self.instrumented, "duration", HTTP_BUCKETS, "job", "endpoint", "method"
                ),
                rr.INGESTED: lambda: self._counter(self.accepted),
                rr.DLQ: lambda: self._counter(self.dead_letters, "reason", ts="failed_at"),
                rr.PUBLISH_ERRORS: lambda: self._counter(
                    self.requests.filter(F.col("status_code") == "500").withColumn(
                        "error_type",
                        F.when(F.col("method") == "POST", "timeout").otherwise("connection"),
                    ),
                    "error_type",
                ),
                rr.ANALYZED: lambda: self._counter(self.scored),
                rr.ANOMALIES: lambda: self._counter(
                    self.anomaly_table, "severity", ts="detected_at"
                ),
                rr.DIAGNOSES: lambda: self._counter(
                    self.answers.filter(generated), "severity", ts="detected_at"
                ),
                rr.DIAGNOSES_FAILED: lambda: self._counter(
                    self.answers.filter(~generated).withColumnRenamed("failed_phase", "phase"),
                    "phase",
                    ts="detected_at",
                ),
                rr.DIAGNOSIS_BUCKETS: lambda: self._buckets(
                    self.answers, "generation_time_seconds", DIAGNOSIS_BUCKETS, ts="detected_at"
                ),
                rr.UP: lambda: Series(self.up_samples, ("job", "instance")),
                rr.MEMORY: lambda: Series(self.memory_samples, ("job", "instance")),
                db.ALERT_EVENTS: lambda: self._counter(
                    self.alert_log, "status", "severity", ts="received_at"
                ),
                db.WEBHOOKS: lambda: self._counter(
                    self.alert_log.withColumn(
                        "status_code",
                        F.when(F.col("notification_id") % 17 == 0, "500").otherwise("202"),
                    ),
                    "status_code",
                    ts="received_at",
                ),
                db.ALERT_ERRORS: lambda: self._counter(
                    self.alert_log.filter(F.col("notification_id") % 17 == 0).withColumn(
                        "error_type",
                        F.when(F.col("priority") == "5-LOW", "ValueError").otherwise("KeyError"),
                    ),
                    "error_type",
                    ts="received_at",
                ),
                db.TRIAGE: lambda: self._counter(
                    self.triage_runs, "result", ts="received_at"
                ),
                db.TRIAGE_BUCKETS: lambda: self._buckets(
                    self.triage_runs, "triage_s", TRIAGE_BUCKETS, ts="received_at"
                ),
                db.DELIVERY_BUCKETS: lambda: self._buckets(
                    self.deliveries, "delivery_s", DELIVERY_BUCKETS, ts="received_at"
                ),
            },
            last_tick_s=END_S,
        )

    # --- the same metrics as long rows, for the rule engine ----------------------------------------

    def _events_of(self, rows: DataFrame, metrics: dict[str, tuple[Column, dict[str, Column]]]) -> DataFrame:
        """A row per event and metric; ``metrics`` has when a row counts, and its labels and observation."""
        kinds = {"job": "string", "endpoint": "string", "method": "string", "code": "string", "observed": "double"}
        entries = [
            F.when(
                test,
                F.struct(
                    F.lit(name).alias("metric"),
                    *[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()],
                ),
            )
            for name, (test, given) in metrics.items()
        ]
        found = F.filter(F.array(*entries), lambda x: x.isNotNull())
        return rows.select(F.col("timestamp").alias("ts"), F.inline(found))

    def metric_events(self, names: set[str]) -> DataFrame:
        c = F.col
        place = {"job": c("job"), "endpoint": c("endpoint"), "method": c("method")}
        shown = c("endpoint") != "/metrics"
        of_requests = {
            rr.HTTP: (shown, {**place, "code": c("status_code")}),
            rr.HTTP_BUCKETS: (shown, {**place, "observed": c("duration")}),
            rr.PUBLISH_ERRORS: (
                c("status_code") == "500",
                {"code": F.when(c("method") == "POST", "timeout").otherwise("connection")},
            ),
        }
        high = c("value") > MAX_VALUE
        of_ingest = {
            rr.INGESTED: (~high & c("known"), {}),
            rr.DLQ: (
                high | ~c("known"),
                {"code": F.when(high, "validation_failed").otherwise("device_not_found")},
            ),
        }
        severe, phase = c("severity").isNotNull(), failed_phase()
        of_detection = {
            rr.ANALYZED: (F.lit(True), {}),
            rr.ANOMALIES: (severe, {"code": c("severity")}),
            rr.DIAGNOSES: (severe & phase.isNull(), {"code": c("severity")}),
            rr.DIAGNOSES_FAILED: (severe & phase.isNotNull(), {"code": phase}),
            rr.DIAGNOSIS_BUCKETS: (severe, {"observed": generation_seconds()}),
        }
        parts = []
        chosen = {k: v for k, v in (of_requests | of_ingest).items() if k in names}
        if chosen:
            known = names & set(of_ingest)
            rows = en.enrich_or_mark(self.requests, self.devices) if known else self.requests
            parts.append(self._events_of(rows, chosen))
        chosen = {k: v for k, v in of_detection.items() if k in names}
        if chosen:
            parts.append(self._events_of(self.scored, chosen))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def gauge_samples(self, names: set[str]) -> DataFrame:
        values = {
            rr.UP: F.when(F.col("k") < 50, 0.0).otherwise(1.0),
            rr.MEMORY: F.col("value") * 10 * 1024 * 1024,
        }
        entries = [F.struct(F.lit(n).alias("metric"), values[n].alias("value")) for n in sorted(names)]
        rows = self.requests.withColumn("_e", F.explode(F.array(*entries)))
        return rows.select("_e.metric", "job", "instance", F.col("timestamp").alias("ts"), "_e.value")

    @cached_property
    def feed(self) -> Feed:
        bounds = {rr.HTTP_BUCKETS: HTTP_BUCKETS, rr.DIAGNOSIS_BUCKETS: DIAGNOSIS_BUCKETS}
        return Feed(self.metric_events, self.gauge_samples, bounds, START_S, END_S)

    # --- line items as a busier service: half of every year it ingests nothing ----------------------

    @cached_property
    def shipments(self) -> DataFrame:
        number = F.col("l_linenumber").cast("string")
        jobs = {"4": JOBS[1], "5": JOBS[2], "6": JOBS[3], "7": JOBS[4]}
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("notification_id"),
            "l_partkey",
            "l_suppkey",
            replay(F.col("l_shipdate").cast("timestamp"), SHIPMENTS_START_S, SHIPMENT_SPEED).alias("timestamp"),
            F.month("l_shipdate").alias("month"),
            F.coalesce(switch(number, jobs), F.lit(JOBS[0])).alias("job"),
            F.concat(F.lit("node-"), (F.col("l_suppkey") % 4).cast("string")).alias("instance"),
            switch(F.col("l_returnflag"), {"R": "500", "N": "404", "A": "404"}, "200").alias("status_code"),
            F.when(F.col("l_linenumber") == 1, "critical").otherwise("low").alias("severity"),
        )

    def shipment_events(self, names: set[str]) -> DataFrame:
        busy = F.col("month") <= 6
        metrics = {
            rr.HTTP: (F.lit(True), {"job": F.col("job"), "code": F.col("status_code")}),
            rr.INGESTED: (busy, {}),
            rr.ANALYZED: (busy, {}),
            rr.ANOMALIES: (busy, {"code": F.col("severity")}),
            rr.PUBLISH_ERRORS: (F.col("l_suppkey") % 5 == 0, {"code": F.lit("timeout")}),
        }
        return self._events_of(self.shipments, {k: v for k, v in metrics.items() if k in names})

    def shipment_gauges(self, names: set[str]) -> DataFrame:
        down = F.col("month").isin(3, 4) & F.col("job").isin(JOBS[1], JOBS[2])
        return self.shipments.select(
            F.lit(rr.UP).alias("metric"), "job", "instance", F.col("timestamp").alias("ts"),
            F.when(down, 0.0).otherwise(1.0).alias("value"),
        )

    @cached_property
    def shipment_feed(self) -> Feed:
        return Feed(self.shipment_events, self.shipment_gauges, {}, START_S, END_S)

    @cached_property
    def shipment_alerts(self) -> DataFrame:
        """Line items as firing alerts, pipelines independent of their rules."""
        t = micros("timestamp")
        rules = rule_catalogue(self.spark).drop("pipeline")
        return (
            self.shipments.drop("severity")
            .withColumn("rule", (F.col("l_partkey") % rules_count()).cast("int"))
            # The catalogue is a constant of 22 rows.
            .join(F.broadcast(rules), "rule")
            .select(
                "notification_id",
                F.timestamp_micros(t - F.pmod(t, F.lit(15 * MICROS))).alias("ts"),
                "alert_name",
                "severity",
                one_of(("ingestion", "detection", "diagnosis", "api"), F.col("l_suppkey") % 4).alias("pipeline"),
            )
        )

    # --- alerts -----------------------------------------------------------------------------------

    @cached_property
    def notifications(self) -> DataFrame:
        """All orders as alert notifications, valid or not."""
        orders = self.table("orders")
        rules = rule_catalogue(self.spark)
        job = one_of(JOBS, F.col("o_custkey") % 5)
        return (
            orders.withColumn("rule", (F.col("o_custkey") % rules_count()).cast("int"))
            # The catalogue is a constant of 22 rows.
            .join(F.broadcast(rules), "rule")
            .select(
                F.col("o_orderkey").alias("notification_id"),
                F.col("o_custkey").alias("fingerprint"),
                F.when(F.col("o_orderstatus") == "O", "firing")
                .when(F.col("o_orderstatus") == "F", "resolved")
                .otherwise("pending")
                .alias("status"),
                "alert_name",
                "severity",
                "tier",
                F.when(F.col("pipeline") == FROM_JOB, job)
                .otherwise(F.col("pipeline"))
                .alias("pipeline"),
                "compound",
                F.col("o_orderpriority").alias("priority"),
                F.col("o_totalprice").alias("price"),
                replay(
                    F.col("o_orderdate").cast("timestamp"), ORDERS_START_S, ORDER_SPEED
                ).alias("received_at"),
            )
            .withColumn(
                "started_at",
                F.timestamp_micros(
                    micros("received_at") - F.col("notification_id") % 5000 * MICROS
                ),
            )
            .withColumn(
                "resolved_at",
                F.when(
                    (F.col("status") == "resolved") & (F.col("notification_id") % 6 != 0),
                    F.col("received_at"),
                ),
            )
        )

    @cached_property
    def alert_log(self) -> DataFrame:
        return self.notifications.filter(F.col("status").isin("firing", "resolved"))

    @cached_property
    def episodes(self) -> DataFrame:
        return al.alert_episodes(
            self.alert_log,
            ["received_at", "notification_id"],
            first=["started_at", "priority", "alert_name", "severity", "pipeline", "tier"],
            latest_firing=["price"],
            segment_us=600 * MICROS,
        )

    @cached_property
    def firing_alerts(self) -> DataFrame:
        """Firing notifications at the evaluation tick of their receipt."""
        t = micros("received_at")
        return self.alert_log.filter(F.col("status") == "firing").withColumn(
            "ts", F.timestamp_micros(t - F.pmod(t, F.lit(15 * MICROS)))
        )

    @cached_property
    def triage_runs(self) -> DataFrame:
        return self.alert_log.filter(
            (F.col("status") == "firing") & (F.col("severity") == "critical")
        ).select(
            "received_at",
            one_of(("success", "failure", "skipped"), F.col("notification_id") % 3).alias("result"),
            (F.col("price") / 8000).alias("triage_s"),
        )

    @cached_property
    def deliveries(self) -> DataFrame:
        from devicelens.operators.summaries import with_delivery_latency

        return with_delivery_latency(self.alert_log)

    @cached_property
    def monitors(self) -> DataFrame:
        """Parts as user-defined monitors (some fields left out)."""
        p = F.col("p_partkey")
        return self.table("part").select(
            F.lpad(p.cast("string"), 8, "0").alias("id"),
            F.concat(F.lit("Monitor "), "p_name", F.lit(" "), p.cast("string")).alias("name"),
            F.concat(F.lit("value > "), F.col("p_size").cast("string")).alias("expr"),
            F.when(p % 3 != 0, F.concat((F.col("p_size") % 9 + 1).cast("string"), F.lit("m"))).alias(
                "duration"
            ),
            F.when(p % 4 == 0, "critical").when(p % 4 == 1, "info").alias("severity"),
            F.when(p % 2 == 0, "ingestion").alias("pipeline"),
            F.when(p % 5 == 0, F.concat(F.lit("Summary of "), "p_name")).otherwise("").alias(
                "summary"
            ),
            F.lit("").alias("description"),
            F.when(p % 7 == 0, F.lit(False)).alias("enabled"),
            F.timestamp_seconds(F.lit(START_S) + F.pmod(p * 7919, F.lit(10_000))).alias("created_at"),
        )

    @cached_property
    def rate_monitors(self) -> DataFrame:
        """The monitors with predicates over the request rate per job; four of eleven cannot be read."""
        p = F.col("id").cast("bigint")
        reads = F.concat(F.lit("round(value * 300, 6) > "), F.regexp_extract("expr", r"\d+", 0))
        bad = {0: "value >", 1: "missing > 1", 2: "value + 1", 3: "sum(value) > 1"}
        expr = F.when(p % 3 == 0, F.concat(reads, F.lit(" AND job LIKE 'a%'"))).otherwise(reads)
        for rest, text in bad.items():
            expr = F.when(p % 11 == rest, text).otherwise(expr)
        return self.monitors.withColumn("expr", expr)

    @cached_property
    def monitor_updates(self) -> DataFrame:
        """Line items as partial updates of monitors."""
        li = self.table("lineitem")
        return li.select(
            F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("id"),
            F.lit(None).cast("string").alias("name"),
            F.when(F.col("l_returnflag") == "R", F.concat(F.lit("value > "), F.col("l_linenumber").cast("string"))).alias("expr"),
            F.when(F.col("l_linestatus") == "O", F.concat(F.col("l_linenumber").cast("string"), F.lit("h"))).alias("duration"),
            F.when(F.col("l_returnflag") == "A", "warning").alias("severity"),
            F.lit(None).cast("string").alias("pipeline"),
            F.lit(None).cast("string").alias("summary"),
            F.lit(None).cast("string").alias("description"),
            F.when(F.col("l_returnflag") == "N", F.col("l_linenumber") % 2 == 0).alias("enabled"),
            F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").alias("seq"),
        )

    # --- knowledge ------------------------------------------------------------------------------

    @cached_property
    def incidents(self) -> DataFrame:
        labels = self.table("labels")
        return self.table("documents").join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("incident_id"),
            F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
            F.col("text").alias("description"),
            F.array("lang").alias("affected_device_types"),
            F.concat(F.lit("root cause in "), "source").alias("root_cause"),
            F.array(
                F.concat(F.lit("check "), "lang"), F.concat(F.lit("review "), "source")
            ).alias("resolution_steps"),
            F.when(F.col("toxic") == 1, "critical")
            .when(F.col("quality") == 1, "high")
            .when(F.col("quality") == 0, "medium")
            .otherwise("low")
            .alias("severity"),
            F.col("source").alias("failure_category"),
            F.array("lang", "source").alias("tags"),
            F.timestamp_seconds(F.lit(START_S) + F.col("doc_id")).alias("ingested_at"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            F.col("label").cast("bigint").alias("incident_id"),
        )


def rules_count() -> int:
    from devicelens.plans.alert_rules import ALERT_RULES

    return len(ALERT_RULES)
