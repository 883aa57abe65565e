"""The one-pass rule engine against rule-by-rule evaluation, and segmented scans against brute force."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from devicelens.catalog.domain import END_S
from devicelens.functions.times import duration_seconds
from devicelens.operators import alerts as al
from devicelens.operators import monitors as mo
from devicelens.operators import series as s
from devicelens.operators.histograms import INF, histogram_quantile, quantile_of
from devicelens.plans import alert_rules as ar
from devicelens.plans import rule_engine as engine
from devicelens.plans.recording import recorded

FEW = dict(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df, *cols):
    return sorted(tuple(str(x) for x in row) for row in df.select(*cols).collect())


@pytest.mark.parametrize("rule", [x for x in ar.ALERT_RULES if x.id in ("ar2", "ar5", "ar7", "ar17", "ar19")], ids=lambda x: x.id)
def test_engine_equals_the_rule_alone(domain, rule):
    value = F.round("value", 6).alias("value")
    cols = [*rule.labels, "ts", "active_at", "state", value]
    want = rows(ar.states(domain.metrics, rule), *cols)
    assert want and rows(engine.rule_states(domain.feed, [rule]), *cols) == want


def test_all_rules_at_once(domain):
    """Rules do not see each other: all at once gives what a pair gives."""
    states = engine.rule_states(domain.feed).select(*engine.IDENTITY, "ts", "state")
    some = [x for x in ar.ALERT_RULES if x.id in ("ar9", "ar12")]
    numbers = [ar.ALERT_RULES.index(x) for x in some]
    cols = [*engine.IDENTITY, "ts", "state"]
    assert rows(states.filter(F.col("rule").isin(numbers)), *cols) == rows(engine.rule_states(domain.feed, some), *cols)


def test_one_pass_reads_detection_once(spark, domain):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = al.mark_inhibited(al.firing(engine.labelled_states(domain.feed)), ar.INHIBITIONS)
        plan = marked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange ") <= 35 and "SinglePartition" not in plan and "CartesianProduct" not in plan


def test_compound_comes_from_the_rule(domain):
    found = {(r.alert_name, r.compound) for r in engine.labelled_states(domain.feed).select("alert_name", "compound").distinct().collect()}
    want = {x.name: str(x.compound).lower() for x in ar.ALERT_RULES}
    assert found and all(want[name] == compound for name, compound in found) and ("PipelineDegradation", "true") in found


TICKS = st.sets(st.integers(0, 60), max_size=40)


@given(TICKS, TICKS, st.sampled_from([0, 30, 60]), st.sampled_from([1, 3, 240]))
@settings(**FEW)
def test_segmented_states_equal_brute_force(spark, one, two, hold, segment):
    """With and without labels, whatever the segment."""
    cond = spark.createDataFrame(
        [(name, t * 15, float(t)) for name, some in (("a", one), (None, two)) for t in some], "l string, t long, value double"
    ).select("l", F.timestamp_seconds("t").alias("ts"), "value")
    want = []
    for name, some in (("a", one), (None, two)):
        for t in sorted(some):
            start = t
            while start - 1 in some:
                start -= 1
            fires = (t - start) * 15 >= hold
            want.append((str(name), str(t * 15), str(start * 15), "firing" if fires else "pending"))
            if fires and t + 1 not in some and (t + 1) * 15 <= 800:
                want.append((str(name), str((t + 1) * 15), str(start * 15), "resolved"))
    found = al.alert_states(cond, ["l"], hold, 15, 800, segment)
    assert rows(found, "l", F.unix_seconds("ts"), F.unix_seconds("active_at"), "state") == sorted(want)
    alone = al.alert_states(cond.filter("l = 'a'").drop("l"), [], hold, 15, 800, segment)
    mine = sorted(w[1:] for w in want if w[0] == "a")
    assert rows(alone, F.unix_seconds("ts"), F.unix_seconds("active_at"), "state") == mine


@given(st.lists(st.tuples(st.integers(0, 900), st.sampled_from(["a", "b", None])), max_size=25), st.sampled_from([1, 4, 240]))
@settings(**FEW)
def test_filled_counters_equal_brute_force(spark, events, segment):
    df = spark.createDataFrame(events, "t long, l string").select(F.timestamp_seconds("t").alias("ts"), "l")
    per_tick = df.withColumn("_tick", s.tick_of("ts", 15)).groupBy("l", "_tick").agg(F.count("*").cast("double").alias("_n"))
    found = s.fill_counter(per_tick, ["l"], 15, 0, 960, segment)
    want = sorted(
        (str(name), str(t), str(float(sum(1 for at, of in events if of == name and at <= t))))
        for name in {of for _, of in events}
        for t in range(0, 961, 15)
    )
    assert rows(found, "l", F.unix_seconds("ts"), "value") == want
    total = s.fill_counter(per_tick.groupBy("_tick").agg(F.sum("_n").alias("_n")), [], 15, 0, 960, segment)
    alone = [(str(t), str(float(sum(1 for at, _ in events if at <= t)))) for t in range(0, 961, 15)] if events else []
    assert rows(total, F.unix_seconds("ts"), "value") == sorted(alone)


def test_label_less_series_are_ordered_by_segment(spark):
    """Ticks are dealt by segment; what meets in one task is a row per segment."""
    events = spark.range(50).select(F.timestamp_seconds(F.col("id") * 100).alias("timestamp"))
    for df in (
        s.to_counter(events, [], start_s=0, end_s=6000),
        al.alert_states(events.select(F.col("timestamp").alias("ts"), F.lit(1.0).alias("value")), [], 60),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange" in line]
        assert any("_seg" in line for line in dealt)
        single = plan.index("SinglePartition")
        assert "ObjectHashAggregate" in plan[single:].splitlines()[1] and "_seg" in plan[single:].splitlines()[1]


@given(st.lists(st.floats(0, 9), min_size=4, max_size=4), st.sampled_from([0.1, 0.5, 0.95, 1.0]))
@settings(**FEW)
def test_quantile_expression_equals_the_series_form(spark, cums, q):
    bounds = [0.5, 1.0, 4.0, INF]
    series = spark.createDataFrame([(0, le, cum) for le, cum in zip(bounds, cums)], "t long, le double, value double")
    want = histogram_quantile(series.withColumn("ts", F.timestamp_seconds("t")), q).first().value
    cells = F.array(*[F.struct(F.lit(le).alias("le"), F.lit(cum).alias("cum")) for le, cum in zip(bounds, cums)])
    got = spark.range(1).select(quantile_of(cells, q).alias("v")).first().v
    assert got == want or abs(got - want) < 1e-9


def test_marked_inhibition_equals_the_join(domain):
    alerts = domain.firing_alerts
    loud = al.inhibit(alerts, ar.INHIBITIONS, ("ts",), ("notification_id",))
    marked = al.mark_inhibited(alerts, ar.INHIBITIONS).filter("not muted")
    assert rows(marked, "notification_id", "ts") == rows(loud, "notification_id", "ts")


MONITORS = "id STRING, name STRING, expr STRING, duration STRING, severity STRING, pipeline STRING, summary STRING, description STRING, enabled BOOLEAN, created_at TIMESTAMP"


def monitor_table(spark, rows):
    given = [(str(i), f"m{i}", expr, hold, None, None, "", "", on, None) for i, (expr, hold, on) in enumerate(rows)]
    return mo.with_defaults(spark.createDataFrame(given, MONITORS))


def test_monitor_set_equals_one_monitor_at_a_time(spark, domain):
    """Many predicates in one projection; shared predicates, shared and different holding times, label tests."""
    series = recorded(domain.metrics, "rr1")
    given = [(f"value > {n / 2000}", f"{n % 4}m", None) for n in range(20)]
    given += [("value > 0.002", "1m", None), ("value > 0.002", "30s", None), ("job LIKE 'a%' AND value > 0.001", "1m", None)]
    found = mo.monitor_states(series, monitor_table(spark, given), ["job"], last_tick_s=END_S)
    cols = ["job", "ts", "active_at", "state", F.round("value", 6).alias("value")]
    for number in (5, 20, 21, 22):
        expr, hold, _ = given[number]
        want = rows(
            al.alert_states(mo.monitor_condition(series, expr), ["job"], duration_seconds(hold), last_tick_s=END_S), *cols
        )
        assert rows(found.filter(F.col("alert_name") == f"m{number}"), *cols) == want and want


def test_counted_monitor_states_equal_counting_all_of_them(spark, domain):
    """Names shared by monitors of the same and of different predicates and holding times, and none at all."""
    series = recorded(domain.metrics, "rr1")
    given = [(str(i), name, f"value > {bound}", hold, None, None, "", "", True, None) for i, (name, bound, hold) in enumerate(
        [("a", 0.001, "1m"), ("a", 0.001, "1m"), ("a", 0.002, "1m"), ("a", 0.002, "0s"), ("b", 0.001, "1m"), (None, 0.003, "2m"), (None, 0.001, "30s"), ("c", 9e9, "1m")]
    )]
    monitors = mo.with_defaults(spark.createDataFrame(given, MONITORS))
    by = ["alert_name", "severity"]
    every = mo.monitor_states(series, monitors, ["job"], last_tick_s=END_S)
    want = every.groupBy(*by, "job", "state").agg(
        F.count("*").alias("ticks"), F.countDistinct("active_at").alias("runs"), F.min("ts").alias("first")
    )
    found = mo.monitor_states(series, monitors, ["job"], last_tick_s=END_S, counted=by)
    assert found.columns == want.columns and rows(found, *want.columns) == rows(want, *want.columns) and want.count() > 6
    assert mo.monitor_states(series, monitors.limit(0), ["job"], counted=by).count() == 0


def test_monitor_set_reads_its_series_once(spark, domain):
    series = spark.range(100).selectExpr("'a' AS job", "timestamp_seconds(id * 15) AS ts", "id / 10D AS value")
    plan = mo.monitor_states(series, monitor_table(spark, [(f"value > {n}", "1m", None) for n in range(25)]), ["job"])
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_monitor_set_leaves_out_what_it_cannot_read(spark):
    series = spark.createDataFrame([("a", None, 2.0)], "job string, ts timestamp, value double").withColumn(
        "ts", F.timestamp_seconds(F.lit(900))
    )
    bad = ["value >", "missing > 1", "value + 1", "sum(value) > 1", "row_number() over (order by ts) > 1", None, ""]
    table = monitor_table(
        spark,
        [(x, "0s", None) for x in bad]
        + [("value > 1", "soon", None), ("value >", "0s", False), ("value > 1", "0s", False), ("value > 1", "0s", None)]
        + [("nullif(value, 2) > 1", "0s", None), ("value > 1", "0s", None)],
    )
    rejects = {r.name: r.reason for r in mo.set_rejects(series, table).collect()}
    assert rejects == {**{f"m{i}": "expression" for i in range(len(bad))}, "m7": "duration"}
    found = mo.monitor_states(series, table, ["job"])
    both = [(name, state) for name in ("m10", "m12") for state in ("firing", "resolved")]
    assert sorted((r.alert_name, r.state) for r in found.collect()) == both
    assert mo.monitor_states(series, table.limit(0), ["job"]).count() == 0
    assert mo.monitor_states(series.limit(0), table, ["job"]).count() == 0
    with pytest.raises(ValueError):
        mo.expressions(series, table, most=2)


def test_alerts_carry_rendered_descriptions(domain):
    """Every rule has one; what a template names is filled in, and nothing else is in braces."""
    found = engine.labelled_states(domain.feed).select("alert_name", "job", "instance", "description")
    by_name = {}
    for row in found.distinct().collect():
        by_name.setdefault(row.alert_name, []).append(row)
    assert len({x.description for x in ar.ALERT_RULES}) == len(ar.ALERT_RULES)
    down = by_name["ServiceDown"]
    assert all(x.description.startswith(f"The service {x.job} ({x.instance}) has been\n") for x in down)
    assert not any("{{" in x.description for rows_ in by_name.values() for x in rows_)
