"""Alerts of a stream: throttled with state, then handed on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.stats import severity_rank
from ..operators.alerts import Group
from ..sources.hooks import Hook, dispatch

OUT = "group_key string, seq long, at double, severity string, emitted boolean, count long, suppressed long, first_seen double"
STATE = "seen long, held long, rank long, first_at double, last_at double, seen_at double"
PARTS = [p.split()[0] for p in STATE.split(",")]


def throttle_stream(alerts: DataFrame, window_s: float = 300.0) -> DataFrame:
    """The batch rule, micro-batch by micro-batch. A batch's alerts of a group are put in order; an alert
    that comes in a later batch counts as later. State of a group without alerts for twice the
    window, by the clock, goes."""
    keep_ms = int(max(2 * window_s, 60.0) * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        group = Group()
        if state.exists:
            for name, value in zip(PARTS, state.get, strict=True):
                setattr(group, name, value)
        for rows in [pd.concat(list(batches))]:
            rows = rows.sort_values(["at", "seq"])
            got = [group.submit(at, rank, window_s) for at, rank in zip(rows["at"], rows["rank"], strict=True)]
            out = pd.DataFrame(got, columns=["emitted", "count", "suppressed", "first_seen"])
            yield pd.concat([rows[["group_key", "seq", "at", "severity"]].reset_index(drop=True), out], axis=1)
        state.update(tuple(getattr(group, name) for name in PARTS))
        state.setTimeoutDuration(keep_ms)

    ranked = alerts.select("group_key", "seq", "at", "severity", severity_rank(F.col("severity")).alias("rank"))
    return ranked.groupBy("group_key").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def deliver(payloads: DataFrame, hooks: list[Hook], checkpoint: str) -> StreamingQuery:
    """Each payload that goes out to each hook, at least once."""
    return payloads.writeStream.foreachBatch(dispatch(hooks)).option("checkpointLocation", checkpoint).start()
