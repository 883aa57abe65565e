"""User-defined monitors: defaults, partial updates, conversion to rules, evaluation."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devicelens.functions.times import duration_col
from devicelens.operators.alerts import alert_states

#: Different predicates that are compiled together; a table with more is refused.
MOST_EXPRESSIONS = 1000

FIELDS = (
    "name",
    "expr",
    "duration",
    "severity",
    "pipeline",
    "summary",
    "description",
    "enabled",
)


def with_defaults(monitors: DataFrame) -> DataFrame:
    """Fill what the creator left out."""

    def given(name: str):
        return F.nullif(F.col(name), F.lit(""))

    return (
        monitors.withColumn("duration", F.coalesce("duration", F.lit("5m")))
        .withColumn("severity", F.coalesce("severity", F.lit("warning")))
        .withColumn("pipeline", F.coalesce("pipeline", F.lit("custom")))
        .withColumn(
            "summary", F.coalesce(given("summary"), F.concat(F.col("name"), F.lit(" is firing")))
        )
        .withColumn(
            "description",
            F.coalesce(
                given("description"), F.concat(F.lit("Custom monitor: "), F.col("name"))
            ),
        )
        .withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    )


def apply_monitor_updates(base: DataFrame, updates: DataFrame, order: str) -> DataFrame:
    """Apply partial updates: per monitor and field the last value given wins.

    ``max_by`` over the updates that set a field keeps this a partial aggregate, whatever number
    of updates one monitor has.
    """
    latest = updates.groupBy("id").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}")
            for c in FIELDS
        ]
    )
    joined = base.join(latest, "id", "left")
    for c in FIELDS:
        joined = joined.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    return joined.select(*base.columns)


def monitor_rejects(monitors: DataFrame) -> DataFrame:
    """Enabled monitors whose duration cannot be read: they make no rule."""
    return monitors.filter(F.col("enabled") & duration_col(F.col("duration")).isNull())


def monitors_to_rules(monitors: DataFrame) -> DataFrame:
    """Rules of the enabled monitors, oldest first; see :func:`monitor_rejects` for the others."""
    return (
        monitors.filter(F.col("enabled") & duration_col(F.col("duration")).isNotNull())
        .select(
            F.col("name").alias("alert_name"),
            "expr",
            F.col("duration").alias("for"),
            duration_col(F.col("duration")).alias("for_s"),
            "severity",
            F.lit("custom").alias("tier"),
            "pipeline",
            F.lit("monitor-api").alias("managed_by"),
            "summary",
            "description",
            "created_at",
        )
        .orderBy("created_at", "alert_name")
    )


def delete_monitors(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("id"), "id", "left_anti")


def monitor_condition(series: DataFrame, expr: str) -> DataFrame:
    """Ticks at which a monitor's Spark SQL predicate over a series holds."""
    return series.filter(F.expr(expr))


# --- a table of monitors as one set ---------------------------------------------------------------


def expressions(series: DataFrame, monitors: DataFrame, most: int = MOST_EXPRESSIONS) -> tuple[list[str], list[str]]:
    """The different predicates of the enabled monitors: those that ``series`` can evaluate, and the others.

    A predicate is a boolean Spark SQL expression over the columns of ``series``; one that does not parse, names
    another column, aggregates or is not boolean is of the others.  Each is tried on an empty frame of the
    same columns.  Monitors that share a predicate count once; more than ``most`` different ones raise ValueError.
    """
    texts = monitors.filter("enabled").select("expr").dropna().distinct().limit(most + 1).collect()
    if len(texts) > most:
        raise ValueError(f"more than {most} different expressions")
    empty = series.sparkSession.createDataFrame([], series.schema)
    good, bad = [], []
    for text in sorted(row.expr for row in texts):
        try:
            empty.filter(F.expr(text)).schema
        except (AnalysisException, ParseException):
            bad.append(text)
        else:
            good.append(text)
    return good, bad


def set_rejects(series: DataFrame, monitors: DataFrame, most: int = MOST_EXPRESSIONS) -> DataFrame:
    """``(id, name, reason)`` of enabled monitors that a set leaves out: ``duration`` or ``expression``."""
    _, bad = expressions(series, monitors, most)
    unread = F.col("expr").isNull() | F.col("expr").isin(bad)
    reason = F.when(duration_col(F.col("duration")).isNull(), "duration").when(unread, "expression")
    return monitors.filter("enabled").select("id", "name", reason.alias("reason")).dropna(subset="reason")


def _numbers_held(texts: list[str]) -> Column:
    """The numbers of the predicates that hold on a row."""
    tried = [F.when(F.expr(text), F.lit(number)) for number, text in enumerate(texts)]
    return F.array_compact(F.array(*tried)) if tried else F.array().cast("array<int>")


def monitor_states(
    series: DataFrame,
    monitors: DataFrame,
    labels: list[str] | tuple[str, ...],
    step_s: int = 15,
    last_tick_s: int | None = None,
    most: int = MOST_EXPRESSIONS,
    counted: list[str] | tuple[str, ...] | None = None,
) -> DataFrame:
    """Pending, firing and resolved ticks of all enabled monitors over a series ``(labels, ts, value)``.

    All predicates are one array in one projection, so the series is read once whatever the number of monitors.
    The state machine runs once per predicate and holding time; monitors meet its result by both.  Columns: the
    monitor's ``alert_name``, ``severity``, ``pipeline`` and ``summary``, the labels, ``ts``, ``active_at``,
    ``state``, ``value``.  A NULL predicate does not hold; monitors that :func:`set_rejects` names give no rows;
    monitors of the same name each give theirs.

    With ``counted``, columns of the monitors, these rows are counted by them, the labels and the state: ``ticks``, ``runs``
    (different ``active_at``) and ``first`` (the earliest ``ts``).  Ticks are then counted before monitors meet them, so
    that they are not copied for every monitor.
    """
    texts, _ = expressions(series, monitors, most)
    numbers = series.sparkSession.createDataFrame(list(enumerate(texts)), "_no int, expr string")
    rules = (
        monitors_to_rules(monitors)
        .select("alert_name", "severity", "pipeline", "summary", "expr", "for_s")
        .join(numbers, "expr")
        .drop("expr")
    )
    holds = series.select(*labels, "ts", "value", F.explode(_numbers_held(texts)).alias("_no"))
    condition = holds.join(rules.select("_no", "for_s").distinct(), "_no")
    states = alert_states(condition, [*labels, "_no", "for_s"], F.col("for_s"), step_s, last_tick_s)
    if counted is not None:
        return _counted(states, rules, list(labels), list(counted))
    return states.join(rules, ["_no", "for_s"]).select(
        "alert_name", "severity", "pipeline", "summary", *labels, "ts", "active_at", "state", "value"
    )


def _counted(states: DataFrame, rules: DataFrame, labels: list[str], by: list[str]) -> DataFrame:
    """``(by, labels, state, ticks, runs, first)`` of the states of all rules.

    Rules of one ``by`` are a set of (predicate, holding time, their number).  Different sets are few where names differ;
    each is counted once, over runs, and its rules meet the counts.
    """
    alike = rules.groupBy(*by, "_no", "for_s").agg(F.count(F.lit(1)).alias("_rules"))
    sets = alike.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_no", "for_s", "_rules"))).alias("_set"))
    runs = states.groupBy("_no", "for_s", *labels, "state", "active_at").agg(
        F.count(F.lit(1)).alias("_ticks"), F.min("ts").alias("_first")
    )
    counts = (
        sets.select("_set")
        .distinct()
        .select("_set", F.inline("_set"))
        .join(runs, ["_no", "for_s"])
        .groupBy("_set", *labels, "state")
        .agg(
            F.sum(F.col("_rules") * F.col("_ticks")).alias("ticks"),
            F.countDistinct("active_at").alias("runs"),
            F.min("_first").alias("first"),
        )
    )
    return sets.join(counts, "_set").select(*by, *labels, "state", "ticks", "runs", "first")
