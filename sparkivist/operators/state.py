"""Logs and their state: cursors, firing of batches, folds of operations, idempotent requests and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def after_cursor(messages: DataFrame, cursor: DataFrame) -> DataFrame:
    """Messages (source_id, key, at, …) behind their log's cursor (source_id, c_at, c_keys): later, or at its instant with a key not among its keys.

    A log without a cursor is pending as a whole; messages without a time are not.
    """
    c = cursor.select(F.col("source_id").alias("_s"), "c_at", "c_keys")
    j = messages.where("at IS NOT NULL").join(c, F.col("source_id") == F.col("_s"), "left")
    fresh = F.col("c_at").isNull() | (F.col("at") > F.col("c_at")) | ((F.col("at") == F.col("c_at")) & ~F.array_contains("c_keys", F.col("key")))
    return j.where(fresh).drop("_s", "c_at", "c_keys")


def advanced_cursor(messages: DataFrame) -> DataFrame:
    """(source_id, c_at, c_keys): the cursor after all given messages; the keys are those of the last instant."""
    last = messages.where("at IS NOT NULL").groupBy("source_id").agg(F.max("at").alias("c_at"))
    j = messages.join(last, "source_id").where("at = c_at")
    return j.groupBy("source_id", "c_at").agg(F.array_sort(F.collect_set("key")).alias("c_keys"))


def fire(messages: DataFrame, day: Column, today: str, now: float, max_chars: int, min_messages: int, stale_minutes: float) -> DataFrame:
    """(source_id, day, in_batch, left_over, closed, fires): the batch of each log's oldest pending day and whether it is written now.

    messages: source_id, key, at, role, chars. The batch fills in order up to ``max_chars``, its
    first message always fits. It fires if the day is over, something was left over, the day has
    ``min_messages``, or its oldest message is ``stale_minutes`` old; before the day is over only with both roles.
    """
    m = messages.where("at IS NOT NULL").withColumn("day", day)
    first = m.groupBy("source_id").agg(F.min("day").alias("day"))
    m = m.join(first, ["source_id", "day"])
    w = W.partitionBy("source_id").orderBy("at", "key").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("chars").over(w)
    # Once a message does not fit, none after it does: the running sum only grows.
    r = m.withColumn("_in", (total <= max_chars) | (total == F.col("chars")) & (F.count("*").over(w) == 1))
    g = r.groupBy("source_id", "day").agg(
        F.count_if("_in").alias("in_batch"), F.count_if(~F.col("_in")).alias("left_over"), F.min("at").alias("oldest"), F.max(F.col("_in") & (F.col("role") == "user")).alias("u"), F.max(F.col("_in") & (F.col("role") == "assistant")).alias("a")
    )
    closed = F.col("day") < today
    due = closed | (F.col("left_over") > 0) | (F.col("in_batch") + F.col("left_over") >= min_messages) | (now - F.col("oldest") >= stale_minutes * 60)
    return g.select("source_id", "day", "in_batch", "left_over", closed.alias("closed"), (due & (closed | (F.coalesce("u", F.lit(False)) & F.coalesce("a", F.lit(False))))).alias("fires"))


def idempotent(requests: DataFrame, keys: list[str], content: list[str], order: list[str]) -> DataFrame:
    """(*keys, requests, verdict): one row per request key; ``repeat`` and ``single`` agree in content, ``conflict`` does not."""
    print_ = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in content]))
    g = requests.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count("*").alias("requests"), F.min(print_).alias("_lo"), F.max(print_).alias("_hi"))
    verdict = F.when(F.col("_lo") != F.col("_hi"), "conflict").when(F.col("requests") > 1, "repeat").otherwise("single")
    return g.select(*keys, "requests", verdict.alias("verdict"))


def open_items(ops: DataFrame) -> DataFrame:
    """(item, opened_at, updated_at, updates): items that are open after all operations (item, at, seq, action).

    open begins an item, update changes an open one, close ends it; operations on an item that is
    not open have no effect. Only what follows the last close counts.
    """
    order = F.struct("at", "seq")
    ended = ops.where("action = 'close'").groupBy("item").agg(F.max(order).alias("_end"))
    live = ops.where("action <> 'close' AND item IS NOT NULL").join(ended, "item", "left").where(F.col("_end").isNull() | (order > F.col("_end")))
    begun = live.where("action = 'open'").groupBy("item").agg(F.min(order).alias("_begin"))
    return live.join(begun, "item").where(order >= F.col("_begin")).groupBy("item").agg(F.min("at").alias("opened_at"), F.max(F.when(F.col("action") == "update", F.col("at"))).alias("updated_at"), F.count_if(F.col("action") == "update").alias("updates"))


def delivery_states(recalls: DataFrame, live: DataFrame) -> DataFrame:
    """(recall_id, covered, invalidated, state): a delivery's records (recall_id, record_id) still live, or gone since; live: record_id.

    state is covered if all are live, invalidated if none is, else partly.
    """
    known = live.where("record_id IS NOT NULL").select(F.col("record_id").alias("_r")).distinct().withColumn("_live", F.lit(True))
    j = recalls.where("record_id IS NOT NULL").select("recall_id", "record_id").distinct().join(known, F.col("record_id") == F.col("_r"), "left")
    g = j.groupBy("recall_id").agg(F.count("_live").alias("covered"), F.count_if(F.col("_live").isNull()).alias("invalidated"))
    return g.withColumn("state", F.when(F.col("invalidated") == 0, "covered").when(F.col("covered") == 0, "invalidated").otherwise("partly"))


def same_day_excluded(recalls: DataFrame, day: Column) -> DataFrame:
    """(recall_id, record_id, pos): recalled rows without those of the recall's own day; a recall whose first row is of that day has none.

    recalls: recall_id, pos, record_id, local_date. A row of unknown date is never of the same day.
    """
    same = F.coalesce(F.col("local_date") == day, F.lit(False))
    first = recalls.groupBy("recall_id").agg(F.min_by(same, "pos").alias("_first"))
    return recalls.withColumn("_same", same).join(first, "recall_id").where("NOT _same AND NOT _first").select("recall_id", "record_id", "pos")


def eligibility(recalls: DataFrame, live: DataFrame, docs_day: Column, floor: float) -> DataFrame:
    """(recall_id, reason, record_id): the first eligible row of each recall, or why there is none.

    Rows in order of pos: dead records are passed over, rows under the floor are not reliable, rows of
    the recall's day end the turn. reason is eligible, same_day_record, no_reliable_candidate or
    nothing_live. recalls: recall_id, pos, record_id, score, local_date; live: record_id.
    """
    known = live.where("record_id IS NOT NULL").select(F.col("record_id").alias("_r")).distinct().withColumn("_live", F.lit(True))
    j = recalls.join(known, F.col("record_id") == F.col("_r"), "left")
    verdict = F.when(F.col("_live").isNull(), "dead").when(F.coalesce(F.col("score") < floor, F.lit(True)), "weak").when(F.coalesce(F.col("local_date") == docs_day, F.lit(False)), "same_day").otherwise("eligible")
    v = j.withColumn("_v", verdict)
    deciding = F.struct("pos", F.col("_v").alias("v"), "record_id")
    g = v.groupBy("recall_id").agg(F.min(F.when(F.col("_v").isin("eligible", "same_day"), deciding)).alias("d"), F.count_if(F.col("_v") == "weak").alias("weak"))
    reason = F.when(F.col("d.v") == "eligible", "eligible").when(F.col("d.v") == "same_day", "same_day_record").when(F.col("weak") > 0, "no_reliable_candidate").otherwise("nothing_live")
    return g.select("recall_id", reason.alias("reason"), F.when(F.col("d.v") == "eligible", F.col("d.record_id")).alias("record_id"))


def last_lines(events: DataFrame, by: str, order: list[str], line: str, take: int = 3, width: int = 40) -> DataFrame:
    """(by, topics): the last ``take`` rows of each group that have a line, their first characters joined in order."""
    w = W.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    r = events.where(F.trim(F.coalesce(line, F.lit(""))) != "").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= take)
    cut = F.substring(F.regexp_replace(line, r"\s+", " "), 1, width)
    return r.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("k"), cut.alias("x")))), lambda s: s["x"]), " / ").alias("topics"))


def age_label(seconds: Column) -> Column:
    """today, yesterday or "N days ago" by whole days; null for null, today for what lies ahead."""
    days = F.floor(F.greatest(seconds, F.lit(0.0)) / 86400)
    return F.when(seconds.isNull(), None).when(days == 0, "today").when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
