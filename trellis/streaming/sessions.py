"""Rules over running sessions: the streaming twins of ``trellis.operators.sessions``.

Input: a stream of ``session, terms, ts, event_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP_MS = 2 * 24 * 3600 * 1000


def _timed(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def _keep(state: GroupState, last_ms: int, keep_ms: int) -> None:
    """State goes when the watermark, not the clock, has passed the time it is needed for: a replay gives what a live run gave."""
    state.setTimeoutTimestamp(max(last_ms + keep_ms, state.getCurrentWatermarkMs()) + 1)


def skip_repeats(events: DataFrame, seconds: int = 180, delay: str = "10 minutes") -> DataFrame:
    """Events with ``skipped``: the session asked for these terms less than ``seconds`` before, in event time.

    Events later than ``delay`` behind the newest are dropped.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        skipped = []
        for ts in rows["ts"]:
            now = int(ts.timestamp() * 1_000_000)
            skipped.append(last is not None and now - last < seconds * 1_000_000)
            last = now
        state.update((last,))
        _keep(state, last // 1000, seconds * 1000)
        yield pd.DataFrame({"event_id": rows["event_id"], "session": key[0], "terms": key[1], "skipped": skipped})

    out = "event_id long, session long, terms string, skipped boolean"
    return _timed(events, delay).groupBy("session", "terms").applyInPandasWithState(run, out, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def every_nth(events: DataFrame, every: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Every n-th event of a session.  The count of a session that is idle for two days, in event time, is dropped."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        turn = range(n + 1, n + 1 + len(rows))
        state.update((n + len(rows),))
        _keep(state, int(rows["ts"].iloc[-1].timestamp() * 1000), KEEP_MS)
        out = pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "session": key[0], "turn": turn})
        yield out[out["turn"] % every == 0]

    return _timed(events, delay).groupBy("session").applyInPandasWithState(run, "event_id long, session long, turn long", "n long", "append", GroupStateTimeout.EventTimeTimeout)


def first_per_session(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """The first event of each session within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session"])
