"""Streaming alert lifecycle: the episode of each notification as it arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Of each fingerprint of a bucket: its last episode, whether that is open, and when it was last met.
STATE = "keys ARRAY<STRING>, episodes ARRAY<BIGINT>, opens ARRAY<BOOLEAN>, seen ARRAY<BIGINT>"


def _numberer(order: list[str], idle_s: int, columns: list[str]):
    """State function: one bucket's new notifications, all its fingerprints at once."""
    import numpy as np

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        names, episodes, opens, seen = state.get if state.exists else ([], [], [], [])
        known = pd.DataFrame(
            {
                "episode": np.asarray(episodes, "int64"),
                "is_open": np.asarray(opens, "bool"),
                "seen": np.asarray(seen, "int64"),
            },
            index=pd.Index(list(names), dtype=object),
        )
        known = known[known["seen"] > now - idle_s * 1000]
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["_key", *order], kind="stable", ignore_index=True)
        name, firing = rows["_key"].to_numpy(object), (rows["status"] == "firing").to_numpy(bool)
        changes = name[1:] != name[:-1]
        first, last = np.append(True, changes), np.append(changes, True)
        before = known.reindex(name[first])
        was_open = np.append(False, firing[:-1])
        was_open[first] = before["is_open"].eq(True).to_numpy(bool)
        fresh = ~was_open
        count, group = np.cumsum(fresh), np.cumsum(first) - 1
        numbers = count + (before["episode"].fillna(0).to_numpy("int64") - (count - fresh)[first])[group]
        rest = known.drop(index=name[first], errors="ignore")
        state.update(
            (
                [*rest.index, *name[last]],
                [*rest["episode"].tolist(), *numbers[last].tolist()],
                [*rest["is_open"].tolist(), *firing[last].tolist()],
                [*rest["seen"].tolist(), *[now] * int(last.sum())],
            )
        )
        state.setTimeoutDuration(idle_s * 1000)
        yield rows[columns].assign(episode=numbers, is_new=fresh)

    return run


def number_episodes_stream(
    log: DataFrame, order: list[str], key: str = "fingerprint", idle_s: int = 30 * 86400, buckets: int = 256
) -> DataFrame:
    """Streaming form of ``operators.alerts.number_episodes``.

    State per fingerprint is the number of its last episode and whether that is open; it is kept in ``buckets`` by a
    hash of the fingerprint, so a batch calls Python once per bucket and not once per fingerprint (a checkpoint
    holds for one number of buckets).  Fold the result with ``fold_episodes``: its aggregates are the same on the
    numbered rows of a stream.  The state of a fingerprint without notifications for ``idle_s`` expires; its next
    notification then begins at episode 1.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)
    # A text that tells a missing fingerprint from an empty one.
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    return (
        log.withColumn("_key", name)
        .withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)))
        .groupBy("_bucket")
        .applyInPandasWithState(
            _numberer(order, idle_s, log.columns),
            f"{fields}, episode BIGINT, is_new BOOLEAN",
            STATE,
            "append",
            GroupStateTimeout.ProcessingTimeTimeout,
        )
    )
