"""Recall without a query: recency, daily caps, recall log and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 7.0
WEIGHT_CAP = 2.0


def recency(ts: Column, now: float, source: Column | None = None, half_life: float = HALF_LIFE_DAYS) -> Column:
    """0.5 ^ (age in days / half life); 0 for null times, file-copy times and times over a day ahead."""
    unknown = ts.isNull() | (ts > now + 86400)
    if source is not None:
        unknown = unknown | (F.coalesce(source, F.lit("")) == "mtime")
    return F.when(unknown, 0.0).otherwise(F.pow(F.lit(0.5), F.greatest(F.lit(now) - ts, F.lit(0.0)) / 86400.0 / half_life))


def recall_recent(rows: DataFrame, now: float, k: int, id_col: str = "id") -> DataFrame:
    """(id, score, rank): rows (id, ts, weight, source) by recency times weight capped at two.

    Ties go to the larger raw weight, then the smaller id. Null weights count as one.
    """
    weight = F.coalesce("weight", F.lit(1.0))
    scored = rows.select(id_col, weight.alias("weight"), F.round(recency(F.col("ts"), now, F.col("source")) * F.least(weight, F.lit(WEIGHT_CAP)), 9).alias("score"))
    order = (F.desc("score"), F.desc("weight"), F.asc(id_col))
    return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long")).select(id_col, "score", "rank")


def recall_per_day_cap(rows: DataFrame, now: float, k: int, cap: int, id_col: str = "id") -> DataFrame:
    """(id, day, score): as recall_recent, one row per source key and at most ``cap`` per day.

    rows: id, ts, weight, source, source_key, day. A source already seen is skipped before the
    day is counted. Both steps keep the first rows of a group, which Spark prunes before its
    shuffle, so neither a hot source nor a hot day is gathered.
    """
    weight = F.coalesce("weight", F.lit(1.0))
    scored = rows.select(id_col, "source_key", F.coalesce("day", F.lit("unknown")).alias("day"), weight.alias("weight"), F.round(recency(F.col("ts"), now, F.col("source")) * F.least(weight, F.lit(WEIGHT_CAP)), 9).alias("score"))
    order = (F.desc("score"), F.desc("weight"), F.asc(id_col))
    best = scored.withColumn("_n", F.row_number().over(W.partitionBy("source_key").orderBy(*order))).where("_n = 1").drop("_n")
    capped = best.withColumn("_n", F.row_number().over(W.partitionBy("day").orderBy(*order))).where(F.col("_n") <= cap).drop("_n")
    return capped.orderBy(*order).limit(k).select(id_col, "day", "score")


def explode_recalls(log: DataFrame) -> DataFrame:
    """(recall_id, recalled_at, trigger_kind, pos, record_id, score, local_date); null and empty lists give no rows."""
    return log.select("recall_id", "recalled_at", "trigger_kind", F.posexplode("recall").alias("pos", "r")).select("recall_id", "recalled_at", "trigger_kind", "pos", "r.record_id", "r.score", "r.local_date")


def last_days(log: DataFrame, days: int) -> DataFrame:
    """Rows no older than ``days`` before the newest row of the log."""
    newest = log.agg(F.max("recalled_at")).scalar()
    return log.where(F.col("recalled_at") >= newest - days * 86400.0)


def recalled_snippets(log: DataFrame, records: DataFrame, days: int = 7, width: int = 160) -> DataFrame:
    """Recalls of the last days with the first characters of their record; records: record_id, text.

    Unknown records keep a null snippet. Copies of a record count once.
    """
    one = records.groupBy(F.col("record_id").alias("_rid")).agg(F.min(F.substring("text", 1, width)).alias("snippet"))
    r = explode_recalls(last_days(log, days))
    return r.join(one, r["record_id"] == one["_rid"], "left").select("recall_id", "pos", "record_id", "local_date", F.round("score", 6).alias("score"), "snippet")


def recall_weights(log: DataFrame, boost: float = 0.05) -> DataFrame:
    """(record_id, recalls, weight): 1 + boost per recall; the log is the append-only weights ledger."""
    n = explode_recalls(log).where("record_id IS NOT NULL").groupBy("record_id").agg(F.count("*").alias("recalls"))
    return n.withColumn("weight", F.round(1 + boost * F.col("recalls"), 6))


def most_recalled(log: DataFrame, k: int) -> DataFrame:
    return recall_weights(log).orderBy(F.desc("recalls"), "record_id").limit(k)


def days_overview(rows: DataFrame, span: int = 35) -> DataFrame:
    """(day, n, first_id, last_id) of the last ``span`` days, which end at the newest record; rows: id, day (yyyy-mm-dd)."""
    dated = rows.where("day IS NOT NULL").withColumn("d", F.to_date("day"))
    newest = dated.agg(F.max("d")).scalar()
    return dated.where(F.col("d") > F.date_sub(newest, span)).groupBy("day").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
