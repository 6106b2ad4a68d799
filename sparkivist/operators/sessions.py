"""Messages, sessions and intervals: normalisation, gap sessions, day batches and coverage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP_SECONDS, BLOCK_CHARS = 1800, 800


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, the latter read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz"))


def epoch_seconds(value: Column) -> Column:
    """Seconds from seconds or, above 1e11, milliseconds; null where unusable."""
    usable = value.isNotNull() & ~F.isnan(value) & (value > 0)
    return F.when(usable, F.when(value > 1e11, value / 1000).otherwise(value))


def distinct_messages(rows: DataFrame) -> DataFrame:
    """(conv_key, key, epoch, copies): one row per message key with its earliest usable time."""
    return rows.groupBy("conv_key", "key").agg(F.round(F.min(epoch_seconds(F.col("epoch"))), 3).alias("epoch"), F.count("*").alias("copies"))


def gap_sessions(rows: DataFrame, gap: float = GAP_SECONDS, by: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Adds ``session_no`` from 0 per ``by``: a new one begins where more than ``gap`` seconds pass.

    Null times neither break nor move the clock.
    """
    w = W.partitionBy(by).orderBy(ts, tie)
    seconds = micros(ts) / 1e6
    before = F.last(seconds, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    flagged = rows.withColumn("_new", F.coalesce((seconds - before > gap).cast("int"), F.lit(0)))
    return flagged.withColumn("session_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_new")


def sized_blocks(rows: DataFrame, by: str, order: str, size: str, ts: str, gap: float = GAP_SECONDS, limit: int = BLOCK_CHARS) -> DataFrame:
    """(by, order, block_no): greedy blocks, flushed when the gap is exceeded or the size would be.

    rows: by, order, size, ts in seconds. A row over the limit is a block of its own; null times
    never break. The fold runs over each partition's sorted rows as a stream, so its memory does
    not grow with a group.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, block, filled, held, last = object(), 0, 0, False, None
        for f in frames:
            out = []
            for g, n, t in zip(f[by], f[size], f[ts]):
                if g != group:
                    group, block, filled, held, last = g, 0, 0, False, None
                known = t is not None and t == t
                if held and ((known and last is not None and t - last > gap) or filled + n > limit):
                    block, filled = block + 1, 0
                filled, held = filled + n, True
                last = t if known else last
                out.append(block)
            yield pd.DataFrame({by: f[by], order: f[order], "block_no": out})

    kinds = {x.name: x.dataType.simpleString() for x in rows.schema}
    sorted_ = rows.select(by, order, size, ts).where(F.col(by).isNotNull()).repartition(by).sortWithinPartitions(by, ts, order)
    return sorted_.mapInPandas(fold, f"{by} {kinds[by]}, {order} {kinds[order]}, block_no long")


def day_batches(rows: DataFrame, by: str, day: Column, size: Column, order: list[str], limit: int) -> DataFrame:
    """(by, day, in_batch, left_over, chars): the first batch of each day, filled in order up to ``limit``; the first row always fits."""
    w = W.partitionBy(by, "day").orderBy(*order)
    r = rows.select(by, day.alias("day"), size.cast("long").alias("_n"), *order).where("day IS NOT NULL")
    r = r.withColumn("_sum", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_first", F.row_number().over(w) == 1)
    inside = (F.col("_sum") <= limit) | F.col("_first")
    return r.groupBy(by, "day").agg(F.count_if(inside).alias("in_batch"), F.count_if(~inside).alias("left_over"), F.sum(F.when(inside, F.col("_n")).otherwise(0)).alias("chars"))


def interval_coverage(rows: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """(by, covered, pieces): length and number of the intervals after union, by gaps and islands; empty ones are dropped."""
    r = rows.where(F.col(start) < F.col(end)).select(by, F.col(start).alias("s"), F.col(end).alias("e"))
    w = W.partitionBy(by).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    r = r.withColumn("_new", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1)))
    r = r.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    islands = r.groupBy(by, "_island").agg((F.max("e") - F.min("s")).alias("len"))
    return islands.groupBy(by).agg(F.sum("len").cast("long").alias("covered"), F.count("*").alias("pieces"))
