"""All alert rules in one pass over one long frame.

Every metric is a row kind of one frame of increments; counters and rates are taken once for all of them.
What rules compare (their operands) are conditional aggregates of those rates at three grains: the tick, the
job and the endpoint.  Gauges join them as rows.  The rows of a tick meet in one shuffle, where windows give
each row the operands of its tick and job; each row then names the rules that hold for it, and all holding
times run in one state machine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicelens.config import GridConfig
from devicelens.operators import series as s
from devicelens.operators.alerts import alert_states, render
from devicelens.operators.histograms import INF, quantile_of
from devicelens.plans import recording as r
from devicelens.plans.alert_rules import ALERT_RULES, FROM_JOB, AlertRule

#: Labels of increments; ``code`` is the status, reason, severity, phase or error type.
SERIES = ("metric", "job", "endpoint", "method", "code")
IDENTITY = ("rule", "job", "instance", "endpoint")


@dataclass(frozen=True)
class Feed:
    """Raw rows of many metrics.

    ``increments(names)`` gives ``(metric, job, endpoint, method, code, ts, observed)``, a row per event of
    the named counters and histograms; ``gauges(names)`` gives ``(metric, job, instance, ts, value)``.
    """

    increments: Callable[[set[str]], DataFrame]
    gauges: Callable[[set[str]], DataFrame]
    bounds: dict[str, tuple[float, ...]]
    start_s: int
    end_s: int
    cfg: GridConfig = field(default_factory=GridConfig)


@dataclass(frozen=True)
class Operand:
    """Sum of the rates of a metric's series whose code matches, at a grain; quantiles instead of sums for ``q``."""

    metric: str
    code: str | None = None
    grain: str = "tick"
    q: float | None = None
    before: bool = False


# Operands by the names that conditions use; "before" is the value one baseline offset earlier.
OPERANDS = {
    "ingested": Operand(r.INGESTED),
    "ingested_before": Operand(r.INGESTED, before=True),
    "dlq": Operand(r.DLQ),
    "analyzed": Operand(r.ANALYZED),
    "anomalies": Operand(r.ANOMALIES),
    "anomalies_before": Operand(r.ANOMALIES, before=True),
    "anomalies_critical": Operand(r.ANOMALIES, "critical"),
    "anomalies_severe": Operand(r.ANOMALIES, "critical|high"),
    "publish_errors": Operand(r.PUBLISH_ERRORS),
    "diagnoses": Operand(r.DIAGNOSES),
    "failures": Operand(r.DIAGNOSES_FAILED),
    "diagnosis_p95": Operand(r.DIAGNOSIS_BUCKETS, q=0.95),
    "http": Operand(r.HTTP, grain="job"),
    "http_5xx": Operand(r.HTTP, "5..", "job"),
    "http_4xx": Operand(r.HTTP, "4..", "job"),
    "http_p95": Operand(r.HTTP_BUCKETS, grain="endpoint", q=0.95),
}
_GAUGES = {"up": r.UP, "memory": r.MEMORY}


def c(name: str) -> Column:
    return F.col(f"o_{name}")


def _ratio(a: Column, b: Column, floor: float) -> Column:
    """a / clamp_min(b, floor); NULL unless both sides are there."""
    return F.when(b.isNotNull(), a / F.greatest(b, F.lit(floor)))


def _failure_ratio() -> Column:
    return _ratio(c("failures"), c("diagnoses") + c("failures"), 0.001)


def _error_ratio() -> Column:
    return _ratio(c("http_5xx"), c("http"), 1.0)


def _dlq_ratio() -> Column:
    return _ratio(c("dlq"), c("ingested") + c("dlq"), 1.0)


def _against_baseline(name: str) -> Column:
    return _ratio(c(name), c(f"{name}_before"), 0.001)


def _api() -> Column:
    return F.col("job") == "api-gateway"


@dataclass(frozen=True)
class Condition:
    """When a rule holds, on the rows of a grain: tick, job, endpoint, up or memory."""

    grain: str
    needs: tuple[str, ...]
    value: Callable[[], Column]
    holds: Callable[[Column], Column]


def _cond(grain: str, needs: str, value, holds) -> Condition:
    return Condition(grain, tuple(needs.split()), value, holds)


def _gauge() -> Column:
    return F.col("value")


# The bounds of the rules.  A value meets its bound in nine digits, so that the order of a sum
# does not decide a tie.
CONDITIONS: dict[str, Condition] = {
    "ar1": _cond("up", "up", _gauge, lambda v: v == 0.0),
    "ar2": _cond("tick", "ingested", lambda: c("ingested"), lambda v: v == 0.0),
    "ar3": _cond("tick", "anomalies_critical", lambda: c("anomalies_critical"), lambda v: v > 0.1),
    "ar4": _cond(
        "tick", "failures diagnoses", _failure_ratio,
        lambda v: (v > 0.9) & (c("failures") + c("diagnoses") > 0.0),
    ),
    "ar5": _cond("up", "up", _gauge, lambda v: (v == 0.0) & (F.col("job") == "alert-receiver")),
    "ar6": _cond("job", "http http_5xx", _error_ratio, lambda v: (v > 0.05) & _api()),
    "ar7": _cond("endpoint", "http_p95", lambda: c("http_p95"), lambda v: (v > 2.0) & _api()),
    "ar8": _cond("tick", "dlq", lambda: c("dlq"), lambda v: v > 0.05),
    "ar9": _cond("tick", "diagnosis_p95", lambda: c("diagnosis_p95"), lambda v: v > 60.0),
    "ar10": _cond("tick", "anomalies", lambda: c("anomalies"), lambda v: v > 0.033),
    "ar11": _cond("tick", "publish_errors", lambda: c("publish_errors"), lambda v: v > 0.0),
    "ar12": _cond("memory", "memory", _gauge, lambda v: v > 512.0 * 1024 * 1024),
    "ar13": _cond("tick", "failures diagnoses", _failure_ratio, lambda v: v > 0.25),
    "ar14": _cond("tick", "anomalies", lambda: c("anomalies"), lambda v: v > 0.0),
    "ar15": _cond("tick", "dlq", lambda: c("dlq"), lambda v: v > 0.0),
    "ar16": _cond("job", "http_4xx", lambda: c("http_4xx"), lambda v: (v > 1.0) & _api()),
    "ar17": _cond(
        "tick", "ingested ingested_before anomalies anomalies_before", lambda: _against_baseline("ingested"),
        lambda v: (v < 0.5) & (F.round(_against_baseline("anomalies"), 9) < 0.2),
    ),
    "ar18": _cond(
        "up", "up http http_5xx", _gauge,
        lambda v: (v == 0.0) & F.col("job").isin("ingestion-consumer", "anomaly-detection") & F.col("api_errors"),
    ),
    "ar19": _cond(
        "tick", "publish_errors ingested ingested_before", lambda: c("publish_errors"),
        lambda v: (v > 0.01) & (F.round(_against_baseline("ingested"), 9) < 0.5),
    ),
    "ar20": _cond(
        "tick", "anomalies_severe failures diagnoses", lambda: c("anomalies_severe"),
        lambda v: (v > 0.01) & (F.round(_failure_ratio(), 9) > 0.5),
    ),
    "ar21": _cond(
        "tick", "ingested analyzed up", lambda: c("ingested"),
        lambda v: (v == 0.0) & (c("analyzed") == 0.0) & F.col("api_up"),
    ),
    "ar22": _cond("tick", "dlq ingested", _dlq_ratio, lambda v: v > 0.1),
}


def _rates(feed: Feed, metrics: set[str]) -> DataFrame:
    """Rates of all series of the metrics: ``(labels, le, ts, value)``."""
    buckets = {m: (*feed.bounds[m], INF) for m in sorted(metrics & set(feed.bounds))}
    lanes = F.array(F.struct(F.lit(None).cast("double").alias("le"), F.count("*").alias("n")))
    for metric, bounds in buckets.items():
        counts = [
            F.struct(F.lit(le).alias("le"), F.count_if(F.col("observed") <= F.lit(le)).alias("n")) for le in bounds
        ]
        lanes = F.when(F.first("metric") == metric, F.array(*counts)).otherwise(lanes)
    per_tick = (
        feed.increments(metrics)
        .withColumn("_tick", s.tick_of("ts", feed.cfg.step_s))
        .groupBy(*SERIES, "_tick")
        .agg(lanes.alias("_lanes"))
        .select(*SERIES, "_tick", F.inline("_lanes"))
        .withColumn("_n", F.col("n").cast("double"))
    )
    labels = [*SERIES, "le"]
    samples = s.fill_counter(per_tick, labels, feed.cfg.step_s, feed.start_s, feed.end_s)
    return s.rate(samples, labels, feed.cfg.range_s)


def _sum_if(test: Column) -> Column:
    return F.sum(F.when(test, F.col("value")))


def _operands(feed: Feed, names: list[str]) -> DataFrame:
    """A row per (ts, job, endpoint) with its operands ``o_...``; metrics without these labels have one per tick."""
    rates = _rates(feed, {OPERANDS[n].metric for n in names})
    sums, made = [], {}
    for name in names:
        op = OPERANDS[name]
        of = F.col("metric") == op.metric
        if op.q is None:
            test = of if op.code is None else of & F.col("code").rlike(f"^(?:{op.code})$")
            sums.append(_sum_if(test).alias(f"o_{name}"))
            continue
        cells = []
        for number, le in enumerate((*feed.bounds[op.metric], INF)):
            lane = f"_{name}_{number}"
            sums.append(_sum_if(of & (F.col("le") == le)).alias(lane))
            cells.append(F.struct(F.lit(le).alias("le"), F.col(lane).alias("cum")))
        made[f"o_{name}"] = F.when(F.col(f"_{name}_0").isNotNull(), quantile_of(F.array(*cells), op.q))
    rows = rates.groupBy("ts", "job", "endpoint").agg(*sums)
    plain = [f"o_{n}" for n in names if f"o_{n}" not in made]
    return rows.select("ts", "job", "endpoint", *plain, *[v.alias(k) for k, v in made.items()])


def _with_baseline(rows: DataFrame, names: list[str], offset_s: int) -> DataFrame:
    """Rows that also reach the tick ``offset_s`` later, with the "before" operands only."""
    late = [f"o_{n}" for n in names if OPERANDS[n].before]
    if not late:
        return rows
    now = [f"o_{n}" for n in names if not OPERANDS[n].before]
    rows = rows.withColumn("_later", F.explode(F.array(F.lit(False), F.lit(True))))
    has = F.coalesce(*late).isNotNull()
    shifted = F.col("ts") + F.make_dt_interval(secs=F.lit(offset_s))
    return rows.filter(~F.col("_later") | has).select(
        F.when(F.col("_later"), shifted).otherwise(F.col("ts")).alias("ts"),
        *[F.when(~F.col("_later"), F.col(x)).alias(x) for x in ("job", "endpoint", *now)],
        *[F.when(F.col("_later"), F.col(x)).alias(x) for x in late],
    )


def _gauge_rows(feed: Feed, names: list[str]) -> DataFrame:
    labels = ["metric", "job", "instance"]
    samples = feed.gauges({_GAUGES[n] for n in names})
    return s.instant(samples, labels, feed.cfg.step_s, feed.cfg.lookback_s)


def conditions(feed: Feed, rules: list[AlertRule]) -> DataFrame:
    """``(rule, job, instance, endpoint, ts, value)`` where rules hold; ``rule`` numbers ALERT_RULES."""
    wanted = {rule.id: CONDITIONS[rule.id] for rule in rules}
    needs = list(dict.fromkeys(n for x in wanted.values() for n in x.needs))
    operands, gauges = [n for n in needs if n in OPERANDS], [n for n in needs if n in _GAUGES]
    parts = []
    if operands:
        found = _with_baseline(_operands(feed, operands), operands, feed.cfg.offset_s)
        parts.append(found.withColumn("kind", F.lit("series")))
    if gauges:
        name = F.when(F.col("metric") == r.UP, "up").otherwise("memory")
        parts.append(_gauge_rows(feed, gauges).select("job", "instance", "ts", "value", name.alias("kind")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    for column, kind in (("instance", "string"), ("endpoint", "string"), ("value", "double")):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast(kind))

    if operands:
        tick, job = Window.partitionBy("ts"), Window.partitionBy("ts", "kind", "job")
        rows = rows.repartition("ts")
        for name in operands:
            if OPERANDS[name].grain == "job":
                rows = rows.withColumn(f"o_{name}", F.sum(f"o_{name}").over(job))
        if "http_5xx" in operands and "http" in operands:
            bad = F.when((F.col("kind") == "series") & _api(), F.round(_error_ratio(), 9) > 0.1)
            rows = rows.withColumn("api_errors", F.coalesce(F.max(bad).over(tick), F.lit(False)))
        if "up" in gauges:
            up = F.when((F.col("kind") == "up") & _api(), F.col("value") == 1.0)
            rows = rows.withColumn("api_up", F.coalesce(F.max(up).over(tick), F.lit(False)))
        for name in operands:
            if OPERANDS[name].grain == "tick":
                rows = rows.withColumn(f"o_{name}", F.sum(f"o_{name}").over(tick))
        order = [F.col(x) for x in ("kind", "job", "endpoint", "instance")]
        rows = rows.withColumn("_in_tick", F.row_number().over(tick.orderBy(*order)))
        rows = rows.withColumn("_in_job", F.row_number().over(job.orderBy("endpoint")))

    series = F.col("kind") == "series"
    on = {
        "tick": F.col("_in_tick") == 1 if operands else None,
        "job": series & F.col("job").isNotNull() & (F.col("_in_job") == 1) if operands else None,
        "endpoint": series,
        "up": F.col("kind") == "up",
        "memory": F.col("kind") == "memory",
    }
    keeps = {"tick": (), "job": ("job",), "endpoint": ("job", "endpoint"), "up": ("job", "instance")}
    numbers = {rule.id: i for i, rule in enumerate(ALERT_RULES)}
    held = []
    for rule_id, cond in wanted.items():
        labels = keeps.get(cond.grain, ("job", "instance"))
        value = cond.value()
        row = F.struct(
            F.lit(numbers[rule_id]).alias("rule"),
            *[
                (F.col(x) if x in labels else F.lit(None).cast("string")).alias(x)
                for x in ("job", "instance", "endpoint")
            ],
            value.alias("value"),
        )
        held.append(F.when(on[cond.grain] & cond.holds(F.round(value, 9)), row))
    return rows.select("ts", F.inline(F.filter(F.array(*held), lambda x: x.isNotNull())))


def _by_rule(values: list, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("rule") + 1)


def rule_states(feed: Feed, rules: list[AlertRule] | None = None) -> DataFrame:
    """Pending / firing / resolved ticks: ``(rule, job, instance, endpoint, ts, active_at, state, value)``."""
    hold = _by_rule([rule.for_s for rule in ALERT_RULES], "int")
    return alert_states(conditions(feed, rules or ALERT_RULES), IDENTITY, hold, feed.cfg.step_s, feed.end_s)


def labelled_states(feed: Feed, rules: list[AlertRule] | None = None) -> DataFrame:
    """Rule states with the alerts' names, labels, ``compound``, rendered summaries and descriptions."""
    rules = rules or ALERT_RULES
    named = _by_rule([rule.pipeline for rule in ALERT_RULES], "string")
    labels = {x: F.col(x) for x in ("job", "instance", "endpoint")}
    texts = {"summary": F.lit(None).cast("string"), "description": F.lit(None).cast("string")}
    for number, rule in enumerate(ALERT_RULES):
        if rule in rules:
            for kind, text in texts.items():
                filled = render(getattr(rule, kind), labels, F.col("value"))
                texts[kind] = F.when(F.col("rule") == number, filled).otherwise(text)
    return rule_states(feed, rules).select(
        _by_rule([rule.name for rule in ALERT_RULES], "string").alias("alert_name"),
        _by_rule([rule.severity for rule in ALERT_RULES], "string").alias("severity"),
        _by_rule([rule.tier for rule in ALERT_RULES], "string").alias("tier"),
        F.when(named == FROM_JOB, F.coalesce("job", F.lit("unknown"))).otherwise(named).alias("pipeline"),
        _by_rule([str(rule.compound).lower() for rule in ALERT_RULES], "string").alias("compound"),
        *labels,
        "ts",
        "active_at",
        "state",
        "value",
        *[text.alias(kind) for kind, text in texts.items()],
    )
