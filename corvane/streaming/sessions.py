"""Sessions of a stream of events: closed ones by event time, and the live state with its time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def closed_sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, started, ended, n): sessions that ended more than ``gap`` before the watermark, which is ``late`` behind the newest event."""
    marked = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    found = marked.groupBy(key, F.session_window("_at", gap)).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def live_sessions(events: DataFrame, key: str, ttl_ms: int, ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """(key, n, last_ms, expired): after each batch the state of the sessions it touched; ``expired`` ones are told once and forgotten.

    A session lives ``ttl_ms`` of event time after its last event. key: a long.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [key, "n", "last_ms", "expired"]
        n, last = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], n, last, True)], columns=columns)
            return
        for batch in batches:
            n, last = n + len(batch), max(last, int(batch["_ms"].max()))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(k[0], n, last, False)], columns=columns)

    marked = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late).withColumn("_ms", F.unix_millis("_at"))
    return marked.groupBy(key).applyInPandasWithState(step, f"{key} long, n long, last_ms long, expired boolean", "n long, last long", "update", GroupStateTimeout.EventTimeTimeout)
