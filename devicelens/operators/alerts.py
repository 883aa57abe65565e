"""Alert evaluation and lifecycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicelens.functions.scans import with_previous, with_run_sums
from devicelens.functions.text import fixed
from devicelens.functions.times import micros, parse_alert_ts, parse_resolved_ts, slot_of
from devicelens.operators.series import SEGMENT_TICKS

DAY_US = 86_400_000_000


# --- evaluation -----------------------------------------------------------------------------


def alert_states(
    condition: DataFrame,
    labels: list[str] | tuple[str, ...],
    for_s: int | Column,
    step_s: int = 15,
    last_tick_s: int | Column | None = None,
    segment_ticks: int = SEGMENT_TICKS,
) -> DataFrame:
    """``for`` state machine over the ticks at which a condition holds.

    ``condition`` has a row ``(labels, ts, value)`` per tick where it is true; ``for_s`` may be a column
    over the labels.  A run of adjacent ticks is *pending* until it has lasted ``for_s``, then *firing*; the
    first false tick after a firing run is *resolved*, and a run that never fired ends without a trace.

    Ticks are ordered inside (labels, time segment).  Along the labels only segment summaries are: first and
    last tick, and where the run open at the end began.  A run that crosses segments takes its
    beginning from them.
    """
    keys = list(labels)
    step, span = F.lit(step_s), step_s * segment_ticks
    hold = (F.lit(for_s) if isinstance(for_s, int) else for_s).cast("bigint")
    inside = Window.partitionBy("_key", "_seg").orderBy("_t")
    prev = F.lag("_t").over(inside)
    breaks = F.when(F.col("_t") - prev > step, F.col("_t"))
    runs = (
        condition.select(
            F.struct(*keys, hold.alias("_hold")).alias("_key"), F.unix_seconds("ts").alias("_t"), "value"
        )
        .withColumn("_seg", F.floor(F.col("_t") / span))
        .repartition("_key", "_seg")
        .withColumn("_break", breaks)
        .withColumn(
            "_from", F.last("_break", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        )
        .withColumn("_next", F.lead("_t").over(inside))
    )
    summaries = runs.groupBy("_key", "_seg").agg(
        F.min("_t").alias("_first"),
        F.max("_t").alias("_last"),
        F.max("_break").alias("_open"),
        F.collect_list(F.struct("_t", "_from", "_next", "value")).alias("_rows"),
    )
    along = Window.partitionBy("_key").orderBy("_seg")
    apart = F.coalesce(F.col("_first") - F.lag("_last").over(along) > step, F.lit(True))
    # Where the run that holds a segment's first tick began: there, at the last break before, or earlier.
    known = F.when(apart, F.col("_first")).otherwise(F.lag("_open").over(along))
    states = (
        summaries.withColumn("_known", known)
        .withColumn(
            "_begin", F.last("_known", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
        )
        .withColumn("_after", F.lead("_first").over(along))
        .select("_key", "_begin", "_after", F.inline("_rows"))
        .withColumn("active_at", F.coalesce("_from", "_begin"))
        .withColumn("_next", F.coalesce("_next", "_after"))
        .withColumn(
            "state",
            F.when(F.col("_t") - F.col("active_at") >= F.col("_key._hold"), "firing").otherwise("pending"),
        )
    )
    ends = F.col("_next").isNull() | (F.col("_next") - F.col("_t") > step)
    closed = (F.col("state") == "firing") & ends
    if last_tick_s is not None:
        closed = closed & (F.col("_t") + step <= last_tick_s)
    here = F.struct(F.col("_t").alias("t"), "state", "value")
    after = F.struct(
        (F.col("_t") + step).alias("t"),
        F.lit("resolved").alias("state"),
        F.lit(None).cast("double").alias("value"),
    )
    return states.withColumn(
        "_e", F.explode(F.when(closed, F.array(here, after)).otherwise(F.array(here)))
    ).select(
        *[f"_key.{c}" for c in keys],
        F.timestamp_seconds("_e.t").alias("ts"),
        F.timestamp_seconds("active_at").alias("active_at"),
        "_e.state",
        "_e.value",
    )


def firing(states: DataFrame) -> DataFrame:
    return states.filter(F.col("state") == "firing")


# --- webhook rows and lifecycle -----------------------------------------------------------------


def label(labels: Column, name: str) -> Column:
    """Label value with the default 'unknown'."""
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit("unknown"))


def project_alerts(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Pull alert name, severity, pipeline and tier out of the label map."""
    col = F.col(labels)
    return (
        df.withColumn("alert_name", label(col, "alertname"))
        .withColumn("severity", label(col, "severity"))
        .withColumn("pipeline", label(col, "pipeline"))
        .withColumn("tier", label(col, "tier"))
    )


def with_alert_times(df: DataFrame, now: str = "received_at") -> DataFrame:
    """startsAt / endsAt text -> started_at / resolved_at."""
    received = F.col(now)
    return df.withColumn("started_at", parse_alert_ts(F.col("startsAt"), received)).withColumn(
        "resolved_at",
        F.when(F.col("status") == "resolved", parse_resolved_ts(F.col("endsAt"), received)),
    )


def number_episodes(
    log: DataFrame,
    order: list[str],
    key: str = "fingerprint",
    received: str = "received_at",
    segment_us: int = DAY_US,
) -> DataFrame:
    """Add ``episode`` (1, 2, ... per fingerprint) to every notification.

    A firing notification opens an episode unless one is open, a resolved one closes it; a resolved
    one with nothing open is an episode of its own.  The order within a fingerprint is found with
    segmented scans, so a busy fingerprint does not have to fit in one task.
    """
    segment = slot_of(micros(received), segment_us)
    with_prev = with_previous(log, [key], order, F.col("status"), segment, "_before")
    opens = F.coalesce(F.col("_before"), F.lit("resolved")) == "resolved"
    return with_run_sums(with_prev, [key], order, opens, segment, "episode").drop("_before")


def fold_episodes(
    numbered: DataFrame,
    order: list[str],
    key: str = "fingerprint",
    first: list[str] | tuple[str, ...] = ("started_at", "severity"),
    latest_firing: list[str] | tuple[str, ...] = ("labels", "annotations"),
    received: str = "received_at",
    resolved: str = "resolved_at",
) -> DataFrame:
    """One row per episode.

    ``first`` keeps the values of the opening notification, ``latest_firing`` those of the last
    firing one, ``received`` the last time; the resolve time of a notification that gives none is
    its receive time.  All are partial aggregates, so an episode may have any number of rows.
    """
    position = F.struct(*order)
    is_firing = F.col("status") == "firing"
    return numbered.groupBy(key, "episode").agg(
        *[F.min_by(c, position).alias(c) for c in first],
        *[
            F.coalesce(F.max_by(c, F.when(is_firing, position)), F.max_by(c, position)).alias(c)
            for c in latest_firing
        ],
        F.max_by("status", position).alias("status"),
        F.max(received).alias(received),
        F.max(F.when(~is_firing, F.coalesce(F.col(resolved), F.col(received)))).alias(resolved),
        F.count(F.lit(1)).alias("notifications"),
        (F.min_by("status", position) == "resolved").alias("unmatched"),
    )


def alert_episodes(
    log: DataFrame,
    order: list[str],
    key: str = "fingerprint",
    first: list[str] | tuple[str, ...] = ("started_at", "severity"),
    latest_firing: list[str] | tuple[str, ...] = ("labels", "annotations"),
    received: str = "received_at",
    resolved: str = "resolved_at",
    segment_us: int = DAY_US,
) -> DataFrame:
    """Fold the notification log into one row per episode of a fingerprint."""
    numbered = number_episodes(log, order, key, received, segment_us)
    return fold_episodes(numbered, order, key, first, latest_firing, received, resolved)


def mark_new(
    log: DataFrame,
    order: list[str],
    key: str = "fingerprint",
    received: str = "received_at",
    segment_us: int = DAY_US,
) -> DataFrame:
    """Add ``is_new``: this notification creates a row (it does not update an open one)."""
    segment = slot_of(micros(received), segment_us)
    prev = with_previous(log, [key], order, F.col("status"), segment, "_before")
    return prev.withColumn(
        "is_new", F.coalesce(F.col("_before"), F.lit("resolved")) == "resolved"
    ).drop("_before")


def active_firing(episodes: DataFrame) -> DataFrame:
    return episodes.filter(F.col("status") == "firing")


def fingerprint(labels: Column) -> Column:
    """Id of a label set, independent of the order of its entries."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(labels))), 256)


# --- inhibition -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Inhibition:
    """Targets are muted while a source fires (and the ``equal`` labels agree)."""

    id: str
    source: dict[str, str]
    target: dict[str, str]
    equal: tuple[str, ...] = ()


def _matches(matchers: dict[str, str]) -> Column:
    out = F.lit(True)
    for name, value in matchers.items():
        out = out & (F.col(name) == value)
    return out


def _pair_key(rule: Inhibition, tick: list[str]) -> Column:
    """Join key of one rule: rule id, tick and the values of the equal labels."""
    equal = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rule.equal]
    return F.struct(
        F.lit(rule.id).alias("rule"),
        *[F.col(c) for c in tick],
        F.concat_ws("\u0001", *equal).alias("equal"),
    )


def inhibited_by(
    alerts: DataFrame, rules: list[Inhibition], tick: list[str] | tuple[str, ...] = ("ts",)
) -> DataFrame:
    """Muted alerts with the rules that mute them: ``(alerts.*, rule)``.

    All rules are one equi-join on (rule, tick, equal labels).  Sources are reduced to distinct
    keys first, so an alert meets each rule at most once however many sources fire.
    """
    ticks = list(tick)

    def keys(side: str) -> Column:
        found = [
            F.when(_matches(getattr(rule, side)), _pair_key(rule, ticks)) for rule in rules
        ]
        return F.explode(F.filter(F.array(*found), lambda k: k.isNotNull()))

    sources = alerts.select(keys("source").alias("_k")).distinct()
    return (
        alerts.withColumn("_k", keys("target"))
        .join(sources, "_k", "left_semi")
        .withColumn("rule", F.col("_k.rule"))
        .drop("_k")
    )


def inhibit(
    alerts: DataFrame,
    rules: list[Inhibition],
    tick: list[str] | tuple[str, ...] = ("ts",),
    identity: list[str] | tuple[str, ...] = ("fingerprint",),
) -> DataFrame:
    """Alerts that are not muted; a missing part of the identity is equal to a missing one."""
    key = F.struct(*tick, *identity).alias("_id")
    muted = inhibited_by(alerts, rules, tick).select(key).distinct()
    return alerts.withColumn("_id", key).join(muted, "_id", "left_anti").drop("_id")


def mark_inhibited(
    alerts: DataFrame, rules: list[Inhibition], tick: list[str] | tuple[str, ...] = ("ts",)
) -> DataFrame:
    """Add ``muted``: whether a source of some rule fires at the alert's tick.

    Reads the alerts once: sources are looked up with windows over (tick, equal labels), which share one
    shuffle by tick.  :func:`inhibited_by` names the rules instead, with a join.
    """
    muted = F.lit(False)
    for rule in rules:
        equal = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rule.equal]
        beside = Window.partitionBy(*tick, *equal)
        source = F.coalesce(F.max(_matches(rule.source)).over(beside), F.lit(False))
        muted = muted | (F.coalesce(_matches(rule.target), F.lit(False)) & source)
    return alerts.repartition(*tick).withColumn("muted", muted)


def firing_runs(
    states: DataFrame, identity: list[str] | tuple[str, ...], last_tick_s: int, step_s: int = 15
) -> DataFrame:
    """One row per firing run of rule states: ``started_at`` and ``ended_at`` (NULL: still firing).

    Of states with a column ``muted`` (:func:`mark_inhibited`), runs that are never heard are left out.
    """
    heard = ~F.col("muted") if "muted" in states.columns else F.lit(True)
    runs = (
        states.filter(F.col("state") == "firing")
        .groupBy(*identity, "active_at")
        .agg(
            F.min("ts").alias("started_at"),
            F.max(F.unix_seconds("ts")).alias("_last"),
            F.max(heard).alias("_heard"),
        )
        .filter("_heard")
    )
    ended = F.when(
        F.col("_last") + step_s <= last_tick_s, F.timestamp_seconds(F.col("_last") + step_s)
    )
    return runs.withColumn("ended_at", ended).drop("_last", "_heard")


# --- grouping, routing, notification ---------------------------------------------------------

GROUP_BY = ("alert_name", "pipeline", "severity")


def group_alerts(alerts: DataFrame, by: list[str] | tuple[str, ...] = GROUP_BY) -> DataFrame:
    """One row per notification group: size, first start and number of distinct fingerprints.

    Members stay rows keyed by the group columns; a group is never collected into one array.
    """
    return alerts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count_if(F.col("status") == "firing").alias("firing"),
        F.countDistinct("fingerprint").alias("fingerprints"),
        F.min("started_at").alias("first_started_at"),
    )


@dataclass(frozen=True)
class Route:
    receiver: str
    match: dict[str, str]
    group_wait_s: int
    group_interval_s: int
    repeat_interval_s: int
    go_on: bool = False


def route(alerts: DataFrame, routes: list[Route], default: Route) -> DataFrame:
    """Receivers of each alert: first matching route wins, a ``go_on`` route keeps looking."""
    entry = "struct<receiver:string,group_wait_s:int,group_interval_s:int,repeat_interval_s:int>"

    def as_struct(r: Route) -> Column:
        return F.struct(
            F.lit(r.receiver).alias("receiver"),
            F.lit(r.group_wait_s).alias("group_wait_s"),
            F.lit(r.group_interval_s).alias("group_interval_s"),
            F.lit(r.repeat_interval_s).alias("repeat_interval_s"),
        ).cast(entry)

    stopped = F.lit(False)
    chosen = []
    for r in routes:
        hit = _matches(r.match)
        chosen.append(F.when(hit & ~stopped, as_struct(r)))
        if not r.go_on:
            stopped = stopped | hit
    picked = F.filter(F.array(*chosen), lambda x: x.isNotNull())
    picked = F.when(F.size(picked) > 0, picked).otherwise(F.array(as_struct(default)))
    return alerts.withColumn("_r", F.explode(picked)).select(
        *alerts.columns, "_r.receiver", "_r.group_wait_s", "_r.group_interval_s", "_r.repeat_interval_s"
    )


def notification_schedule(groups: DataFrame, until: str = "ended_at") -> DataFrame:
    """When a firing group notifies: first after group_wait, then every repeat_interval, and once
    more on resolve if it has ended.

    ``groups`` has ``started_at``, ``until`` (NULL = still firing), ``horizon_at`` (end of the
    replay) and the timing columns of :func:`route`.
    """
    first = F.unix_seconds("started_at") + F.col("group_wait_s")
    end = F.unix_seconds(F.coalesce(F.col(until), F.col("horizon_at")))
    repeats = F.when(
        first <= end, F.sequence(first, end, F.col("repeat_interval_s").cast("bigint"))
    ).otherwise(F.array().cast("array<bigint>"))
    sends = F.transform(
        repeats, lambda t: F.struct(t.alias("t"), F.lit("firing").alias("status"))
    )
    # The change "resolved" goes out at the next group_interval after it happened.
    interval = F.col("group_interval_s").cast("bigint")
    resolved_at = first + F.ceil((end - first) / interval).cast("bigint") * interval
    closing = F.when(
        F.col(until).isNotNull() & (first <= end),
        F.array(F.struct(resolved_at.alias("t"), F.lit("resolved").alias("status"))),
    ).otherwise(F.array().cast("array<struct<t: bigint, status: string>>"))
    return (
        groups.withColumn("_n", F.explode(F.concat(sends, closing)))
        .withColumn("notify_at", F.timestamp_seconds("_n.t"))
        .withColumn("notify_status", F.col("_n.status"))
        .drop("_n")
    )


def group_notifications(
    alerts: DataFrame,
    horizon_s: int,
    by: list[str] | tuple[str, ...] = (*GROUP_BY, "receiver"),
) -> DataFrame:
    """When groups notify: ``(by, notify_at, notify_status, firing)``.

    ``alerts`` has the group columns, ``started_at``, ``ended_at`` (NULL: still firing) and the timing
    columns of :func:`route`.  A group is looked at ``group_wait`` after its first alert and then
    every ``group_interval``.  It notifies if an alert has begun or ended since, and again after
    ``repeat_interval`` without a change while any alert fires, up to ``horizon_s``.  Changes are
    reduced to one row per group and time before they are ordered, so a group's window grows with
    time and not with its alerts.
    """
    timing = ["group_wait_s", "group_interval_s", "repeat_interval_s"]
    key = F.struct(*by).alias("_g")
    change = F.array(
        F.struct(F.unix_seconds("started_at").alias("t"), F.lit(1).alias("d")),
        F.struct(F.unix_seconds("ended_at").alias("t"), F.lit(-1).alias("d")),
    )
    changes = (
        alerts.select(key, *timing, F.inline(change))
        .filter(F.col("t").isNotNull())
        .groupBy("_g", *timing, "t")
        .agg(F.sum("d").alias("d"), F.max(F.col("d") > 0).alias("begins"))
    )
    group = Window.partitionBy("_g")
    interval = F.col("group_interval_s").cast("bigint")
    first = F.col("_t0") + F.col("group_wait_s")
    late = F.greatest(F.lit(0), F.col("t") - first)
    looks = (
        changes.withColumn("_t0", F.min(F.when(F.col("begins"), F.col("t"))).over(group))
        .withColumn("_look", (first + F.ceil(late / interval) * interval).cast("bigint"))
        .groupBy("_g", "_look", *timing)
        .agg(F.sum("d").alias("d"))
    )
    along = group.orderBy("_look")
    # Repeats fall on looks, too.
    every = (F.ceil(F.col("repeat_interval_s") / interval) * interval).cast("bigint")
    until = F.least(F.coalesce(F.lead("_look").over(along), F.lit(horizon_s + 1)), F.lit(horizon_s + 1))
    sends = F.when(
        (F.col("firing") > 0) & (F.col("_until") > F.col("_look")),
        F.sequence(F.col("_look"), F.col("_until") - 1, F.col("_every")),
    ).otherwise(F.array("_look"))
    return (
        looks.withColumn("firing", F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_until", until)
        .withColumn("_every", every)
        .filter(F.col("_look") <= horizon_s)
        .withColumn("_at", F.explode(sends))
        .select(
            "_g.*",
            F.timestamp_seconds("_at").alias("notify_at"),
            F.when(F.col("firing") > 0, "firing").otherwise("resolved").alias("notify_status"),
            "firing",
        )
    )


# --- annotation templates -----------------------------------------------------------------------


def render(template: str, labels: dict[str, Column], value: Column) -> Column:
    """Fill ``{{ $labels.x }}``, ``{{ $value }}`` and ``{{ $value | printf "%.2f" }}``.

    ``humanize1024`` is supported as the second formatter the rules use.
    """
    import re

    out: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{\{\s*(.*?)\s*\}\}", template):
        if m.start() > pos:
            out.append(F.lit(template[pos : m.start()]))
        body = m.group(1)
        printf = re.fullmatch(r"\$value\s*\|\s*printf\s+\"(%\.\df)\"", body)
        name = re.fullmatch(r"\$labels\.(\w+)", body)
        if name:
            out.append(F.coalesce(labels.get(name.group(1), F.lit("")).cast("string"), F.lit("")))
        elif printf:
            out.append(fixed(value.cast("double"), int(printf.group(1)[2])))
        elif re.fullmatch(r"\$value\s*\|\s*humanize1024", body):
            out.append(humanize1024(value))
        elif body == "$value":
            out.append(value.cast("string"))
        else:
            out.append(F.lit(m.group(0)))
        pos = m.end()
    if pos < len(template):
        out.append(F.lit(template[pos:]))
    return F.concat(*out)


def humanize1024(value: Column) -> Column:
    """512*1024*1024 -> '512Mi' (four significant digits)."""
    out = F.format_string("%s", value.cast("string"))
    for power, unit in enumerate(("ki", "Mi", "Gi", "Ti"), start=1):
        scaled = value / float(1024**power)
        digits = (
            F.when(scaled >= 1000, fixed(scaled, 0))
            .when(scaled >= 100, fixed(scaled, 1))
            .when(scaled >= 10, fixed(scaled, 2))
            .otherwise(fixed(scaled, 3))
        )
        short = F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        out = F.when(F.abs(value) >= float(1024**power), F.concat(short, F.lit(unit))).otherwise(out)
    return out
