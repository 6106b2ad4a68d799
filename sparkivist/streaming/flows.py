"""Stateful flows over message streams: windows, repeats, cool-down and the character counter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COOL_DOWN_SECONDS = 12 * 3600
RECALL_CHARS = 30000


def windowed_counts(messages: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(start, role, n, chars) per window of event time; messages later than ``late`` are left out."""
    w = messages.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "role")
    return w.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).select(F.col("w.start").alias("start"), "role", "n", "chars")


def without_repeats(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of the messages with a key; keys are forgotten once the watermark has passed them."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def inactivity_sessions(messages: DataFrame, late: str = "1 hour", gap: str = "1800 seconds") -> DataFrame:
    """(source_id, start, end, n) of sessions that a longer gap ends."""
    w = messages.withWatermark("ts", late).groupBy("source_id", F.session_window("ts", gap).alias("s"))
    return w.agg(F.count("*").alias("n")).select("source_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def cooled_deliveries(requests: DataFrame, seconds: float = COOL_DOWN_SECONDS) -> DataFrame:
    """(record_id, at, delivered): a record is delivered again only ``seconds`` after its last delivery.

    requests: record_id, at in epoch seconds. The state of a record is one number, dropped when it
    has cooled down.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for at in rows["at"]:
            go = last is None or at - last >= seconds
            last = at if go else last
            out.append((key[0], at, go))
        state.update((float(last),))
        state.setTimeoutDuration(int(seconds * 1000))
        yield pd.DataFrame(out, columns=["record_id", "at", "delivered"])

    return requests.groupBy("record_id").applyInPandasWithState(step, "record_id string, at double, delivered boolean", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def recall_triggers(turns: DataFrame, limit: int = RECALL_CHARS) -> DataFrame:
    """(session, at, chars): a turn that brings a session's characters since the last trigger to ``limit`` triggers recall."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for at, n in zip(rows["at"], rows["chars"]):
            total += int(n)
            if total >= limit:
                out.append((key[0], at, total))
                total = 0
        state.update((total,))
        yield pd.DataFrame(out, columns=["session", "at", "chars"])

    return turns.groupBy("session").applyInPandasWithState(step, "session string, at double, chars long", "total long", "append", GroupStateTimeout.NoTimeout)


def idempotent_sink(path: str):
    """A foreachBatch writer: each batch has its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
