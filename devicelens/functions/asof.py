"""Last rows of a time range, per probe.

A join on a pure range would emit every pair.  Three ways avoid it:

- ``newest_before``: ranges of one width up to the probe's time.  Time is cut into segments; the
  newest ``n`` rows of a segment are all that later segments can need of it, so these few are carried
  on and every probe finds its rows inside its own segment.  Rows and probes are read once.
- ``newest_since``: ranges without an end.  The newest ``n`` rows of the key are all that matter.
- ``count_since``: the size of a range without an end, from counts per key and segment.
- ``last_in_range``: any closed range, with the number of its rows.  Rows are numbered along time per key (a
  segmented running count, see ``scans``), each probe reads off the numbers at both ends, and the
  wanted rows are fetched by an equi-join on (key, number): at most ``n`` per probe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devicelens.functions.scans import with_running_sum
from devicelens.functions.times import slot_of


def last_in_range(
    rows: DataFrame,
    probes: DataFrame,
    keys: list[str],
    row_t: Column,
    row_id: str,
    probe_id: str,
    low: Column,
    high: Column,
    n: int,
    segment_us: int,
) -> DataFrame:
    """``(probe_id, in_range, position, r)``: the last ``n`` rows with low <= t <= high per probe.

    Times are epoch microseconds.  ``in_range`` counts all rows of the range, ``position`` is 1 for
    the oldest of the returned rows, ``r`` is the row.  Probes without rows appear once with ``r`` NULL.
    """
    payload = F.struct(*rows.columns)
    # The keys as one struct, so that NULL keys find each other.
    key = F.struct(*keys)
    base = rows.select(
        key.alias("_k"),
        row_t.alias("_t"),
        F.lit(1).alias("_kind"),
        F.col(row_id).alias("_u"),
        payload.alias("r"),
    )
    bounds = [
        F.struct(low.alias("t"), F.lit(0).alias("kind")),
        F.struct(high.alias("t"), F.lit(2).alias("kind")),
    ]
    # A row at the lower bound is inside, so that probe sorts in front of it (kind 0 < 1 < 2).
    ends = probes.select(
        key.alias("_k"), F.col(probe_id).alias("_probe"), F.explode(F.array(*bounds)).alias("_e")
    ).select("_k", F.col("_e.t").alias("_t"), F.col("_e.kind").alias("_kind"), "_probe")
    numbered = with_running_sum(
        base.unionByName(ends, allowMissingColumns=True),
        ["_k"],
        ["_t", "_kind", "_u", "_probe"],
        F.when(F.col("_kind") == 1, F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
        slot_of(F.col("_t"), segment_us),
        "_n",
    )
    rows_at = numbered.filter(F.col("_kind") == 1).select("_k", F.col("_n").alias("_at"), "r")
    found = (
        numbered.filter(F.col("_kind") != 1)
        .groupBy("_k", "_probe")
        .agg(
            F.max(F.when(F.col("_kind") == 0, F.col("_n"))).alias("_lo"),
            F.max(F.when(F.col("_kind") == 2, F.col("_n"))).alias("_hi"),
        )
    )
    found = (
        found.withColumn("in_range", F.col("_hi") - F.col("_lo"))
        .withColumn("_from", F.greatest(F.col("_lo"), F.col("_hi") - n) + 1)
        .withColumn(
            "_at",
            F.explode_outer(
                F.when(F.col("in_range") > 0, F.sequence(F.col("_from"), F.col("_hi")))
            ),
        )
    )
    return found.join(rows_at, ["_k", "_at"], "left").select(
        F.col("_probe").alias(probe_id),
        "in_range",
        (F.col("_at") - F.col("_from") + 1).alias("position"),
        "r",
    )


def newest_before(
    rows: DataFrame,
    probes: DataFrame,
    keys: list[str],
    row_t: Column,
    row_id: str,
    probe_t: Column,
    width_us: int,
    n: int,
    out: str = "newest",
    parts: int = 6,
) -> DataFrame:
    """``probes`` with the newest ``n`` rows with probe_t - width_us < t <= probe_t, newest first.

    Times are epoch microseconds.  Without ``keys`` all rows are one key, which is still spread over
    its segments of width_us / parts.  A segment hands at most ``n`` rows to each of the next ``parts``,
    so a segment holds its own rows, its probes and at most n * parts rows of others.  Rows of equal
    time are ordered by ``row_id``, the larger being newer.  A NULL key meets a NULL key; rows without
    a time are in no range; a probe without a time or without rows gets an empty array.
    """
    length = -(-width_us // parts)
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("none"))
    timed = rows.select(
        key.alias("_k"), row_t.alias("_t"), F.col(row_id).alias("_u"), F.struct(*rows.columns).alias("_r")
    ).filter(F.col("_t").isNotNull())
    newest_first = Window.partitionBy("_k", "_seg").orderBy(F.desc("_t"), F.desc("_u"))
    carried = (
        timed.withColumn("_seg", slot_of(F.col("_t"), length))
        .withColumn("_back", F.row_number().over(newest_first))
        .withColumn(
            "_seg",
            F.explode(
                F.sequence("_seg", F.col("_seg") + F.when(F.col("_back") <= n, parts).otherwise(0))
            ),
        )
        .drop("_back")
    )
    asked = probes.select(
        key.alias("_k"),
        probe_t.alias("_t"),
        F.struct(*probes.columns).alias("_p"),
        # Probes without a time are spread by their content; they sort in front of all rows.
        F.coalesce(
            slot_of(probe_t, length), F.xxhash64(F.to_json(F.struct(*probes.columns)))
        ).alias("_seg"),
    )
    inside = Window.partitionBy("_k", "_seg")
    # A row at the probe's time is inside, so it sorts in front of the probe.
    along = inside.orderBy("_t", F.col("_p").isNotNull(), "_u").rowsBetween(
        Window.unboundedPreceding, 0
    )
    last_n = inside.orderBy("_n").rangeBetween(-(n - 1), 0)
    return (
        carried.unionByName(asked, allowMissingColumns=True)
        .withColumn("_n", F.count("_r").over(along))
        .withColumn(
            "_last", F.collect_list(F.when(F.col("_r").isNotNull(), F.struct("_t", "_r"))).over(last_n)
        )
        .filter(F.col("_p").isNotNull())
        .select(
            "_p.*",
            F.transform(
                F.reverse(F.filter("_last", lambda x: x["_t"] > F.col("_t") - width_us)),
                lambda x: x["_r"],
            ).alias(out),
        )
    )


def newest_since(
    rows: DataFrame,
    probes: DataFrame,
    keys: list[str],
    row_t: Column,
    row_id: str,
    low: Column,
    n: int,
    out: str = "newest",
) -> DataFrame:
    """``probes`` with the newest ``n`` rows with t >= low, newest first.

    A key's newest rows are chosen before the shuffle already (a limit per key and task) and become one
    array per key; probes of a hot key can be split by adaptive execution.  Ties, NULL keys and missing
    times are as in :func:`newest_before`.
    """
    newest_first = Window.partitionBy("_k").orderBy(F.desc("_t"), F.desc("_u"))
    best = (
        rows.select(
            F.struct(*keys).alias("_k"),
            row_t.alias("_t"),
            F.col(row_id).alias("_u"),
            F.struct(*rows.columns).alias("_r"),
        )
        .filter(F.col("_t").isNotNull())
        .withColumn("_rn", F.row_number().over(newest_first))
        .filter(F.col("_rn") <= n)
        .groupBy("_k")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "_t", "_r"))).alias("_best"))
    )
    asked = probes.select(
        F.struct(*keys).alias("_k"), low.alias("_low"), F.struct(*probes.columns).alias("_p")
    )
    kept = F.filter("_best", lambda x: x["_t"] >= F.col("_low"))
    found = F.transform(kept, lambda x: x["_r"])
    return asked.join(best, "_k", "left").select("_p.*", F.coalesce(found, F.array()).alias(out))


def count_since(
    rows: DataFrame,
    probes: DataFrame,
    keys: list[str],
    row_t: Column,
    low: Column,
    segment_us: int,
    out: str = "in_range",
) -> DataFrame:
    """``probes`` with the number of rows with t >= low.

    Rows are counted per (key, segment); a key's counts are an array as long as the key has segments
    with rows, whatever their number of rows, and give the later segments at once.  Only inside the
    probe's own segment are rows ordered.  NULL keys and missing times are as in :func:`newest_before`;
    a probe without a time or without rows counts 0.
    """
    timed = rows.select(F.struct(*keys).alias("_k"), row_t.alias("_t")).filter(
        F.col("_t").isNotNull()
    ).withColumn("_seg", slot_of(F.col("_t"), segment_us))
    sizes = (
        timed.groupBy("_k", "_seg")
        .agg(F.count(F.lit(1)).alias("_size"))
        .groupBy("_k")
        .agg(F.collect_list(F.struct("_seg", "_size")).alias("_sizes"))
    )
    asked = probes.select(
        F.struct(*keys).alias("_k"),
        low.alias("_t"),
        F.struct(*probes.columns).alias("_p"),
        F.coalesce(
            slot_of(low, segment_us), F.xxhash64(F.to_json(F.struct(*probes.columns)))
        ).alias("_seg"),
    )
    later = F.aggregate(
        F.filter("_sizes", lambda x: x["_seg"] > F.col("_seg")),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x["_size"],
    )
    carried = asked.join(sizes, "_k", "left").withColumn("_later", F.coalesce(later, F.lit(0)))
    # A row at the bound is inside, so it sorts in front of the probe.
    down = (
        Window.partitionBy("_k", "_seg")
        .orderBy(F.desc("_t"), F.col("_p").isNotNull())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    here = F.count(F.when(F.col("_p").isNull(), 1)).over(down)
    return (
        timed.unionByName(carried.drop("_sizes"), allowMissingColumns=True)
        .withColumn("_here", here)
        .filter(F.col("_p").isNotNull())
        .select(
            "_p.*",
            F.when(F.col("_t").isNull(), F.lit(0))
            .otherwise(F.col("_here") + F.col("_later"))
            .cast("bigint")
            .alias(out),
        )
    )
