"""Activity from event streams: sessions, online users, rate limits, log appends.

Every function takes a batch or a streaming DataFrame with ``ts`` and ``user_id``; with a streaming one a watermark bounds the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE, SWEEP, RATE_WINDOW, RATE, LATE = "35 seconds", "10 seconds", "15 minutes", 200, "1 minute"


def _bounded(events: DataFrame, late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def sessions(events: DataFrame, gap: str = IDLE) -> DataFrame:
    """A row per user and stay: begin, end (of the last event) and events; a user idle for longer than ``gap`` begins anew."""
    grouped = _bounded(events).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("events"), F.min("ts").alias("begin"), F.max("ts").alias("end")).drop("w")


def online_users(events: DataFrame, every: str = SWEEP, idle: str = IDLE) -> DataFrame:
    """Per sweep, how many users were seen within the idle time before it (approximate on streams, whose state must stay small)."""
    slid = _bounded(events).groupBy(F.window("ts", idle, every).alias("w"))
    distinct = F.approx_count_distinct("user_id") if events.isStreaming else F.count_distinct("user_id")
    return slid.agg(distinct.alias("users")).select(F.col("w.end").alias("at"), "users")


def heartbeats(events: DataFrame) -> DataFrame:
    """The last time that each user was seen, of a batch; ``presence`` is for streams."""
    return events.groupBy("user_id").agg(F.max("ts").alias("seen"))


def presence(events: DataFrame, idle: str = IDLE, late: str = LATE) -> DataFrame:
    """user_id, seen, online of a stream: a row whenever a user is seen, and one more when the watermark is past ``idle`` after the last time, by when the user is forgotten.

    So the state holds the users of the last ``idle`` and ``late``, and not all that there ever were. Events that come later than the watermark are left out.
    """
    span = int(pd.Timedelta(idle).total_seconds() * 1000)

    def beat(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seen, online = state.get[0], False
            state.remove()
        else:
            seen, online = max([int(b["ts"].max().value // 1000) for b in batches] + ([state.get[0]] if state.exists else [])), True
            if seen // 1000 + span <= state.getCurrentWatermarkMs():
                online = False
                if state.exists:
                    state.remove()
            else:
                state.update((seen,))
                state.setTimeoutTimestamp(seen // 1000 + span)
        yield pd.DataFrame({"user_id": [key[0]], "seen": [pd.Timestamp(seen, unit="us")], "online": [online]})

    kept = events.select("user_id", "ts").withWatermark("ts", late).groupBy("user_id")
    kind = dict(events.dtypes)["user_id"]
    return kept.applyInPandasWithState(beat, f"user_id {kind}, seen timestamp, online boolean", "seen long", "update", GroupStateTimeout.EventTimeTimeout)


def rate_limited(events: DataFrame, key: str = "user_id", window: str = RATE_WINDOW, most: int = RATE) -> DataFrame:
    """Windows in which a key makes more requests than allowed."""
    counted = _bounded(events).groupBy(F.window("ts", window).alias("w"), F.col(key)).agg(F.count("*").alias("requests"))
    return counted.filter(F.col("requests") > most).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "requests")


def append_log(events: DataFrame, path: str, checkpoint: str, every: str | None = "15 seconds") -> StreamingQuery:
    """Appends a stream to a log table: at intervals, or once over what there is."""
    writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
