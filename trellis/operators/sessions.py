"""Rules over the events of sessions (``session, terms, ts, event_id``), as batch operators.

The same rules as running queries are in ``trellis.streaming``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def repeated_searches(events: DataFrame, seconds: int = 180) -> DataFrame:
    """Adds ``skipped``: the same session asked for the same terms less than ``seconds`` before."""
    w = W.partitionBy("session", "terms").orderBy("ts", "event_id")
    return events.withColumn("skipped", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) < seconds * 1_000_000, F.lit(False)))


def checkpoints(events: DataFrame, every: int = 10) -> DataFrame:
    """Every n-th event of a session."""
    w = W.partitionBy("session").orderBy("ts", "event_id")
    return events.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") % every == 0)


def first_of_session(events: DataFrame) -> DataFrame:
    return events.withColumn("_n", F.row_number().over(W.partitionBy("session").orderBy("ts", "event_id"))).filter("_n = 1").drop("_n")


def daily_runs(events: DataFrame, seconds: int = 86_400) -> DataFrame:
    """``at``: the seconds at which an upkeep starts: at the first event, then at the first one ``seconds`` or more after the last run.

    Each run depends on the one before, so one task reads the different seconds in their order, keeping only the last run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            out = []
            for at in batch["at"]:
                if last is None or at - last >= seconds:
                    out.append(at)
                    last = at
            yield pd.DataFrame({"at": out}, dtype="int64")

    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at")
    return events.filter("ts is not null").select(at).distinct().repartition(1).sortWithinPartitions("at").mapInPandas(run, "at long")


def idle_sessions(events: DataFrame, now: str, days: int = 2) -> DataFrame:
    """Sessions without an event for so many days."""
    last = events.groupBy("session").agg(F.max("ts").alias("last"))
    return last.filter(F.col("last") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def history(events: DataFrame, session: int | None = None, limit: int = 20) -> DataFrame:
    rows = events if session is None else events.filter(F.col("session") == session)
    return rows.orderBy(F.desc(F.to_date("ts")), F.desc("ts"), F.desc("event_id")).limit(limit)
