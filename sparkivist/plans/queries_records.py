"""Queries of the recall, ledger, session and fact operators over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkivist.operators import facts, gates, ledger, passive, recall, sessions, timestamps
from sparkivist.plans.session import table

NOW = 1704672000.0  # 2024-01-08 00:00 UTC, inside the span of the events


def _event_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events as dated records: the value as weight, the user as source, errors as file copies."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), (sessions.micros("ts") / 1e6).alias("ts"), (1 + F.col("value") / 100).alias("weight"), F.when(F.col("event_type") == "error", "mtime").otherwise("record_iso").alias("source"),
        F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH")).alias("source_key"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


def recall_recent(spark, d):
    return recall.recall_recent(_event_rows(spark, d), NOW, 20)


def recall_per_day_cap(spark, d):
    return recall.recall_per_day_cap(_event_rows(spark, d), NOW, 20, 3)


def recall_weights(spark, d):
    return recall.recall_weights(table(spark, d, "recall_log"))


def most_recalled(spark, d):
    return recall.most_recalled(table(spark, d, "recall_log"), 25)


def recalled_snippets(spark, d):
    return recall.recalled_snippets(table(spark, d, "recall_log"), table(spark, d, "memory_entries").select("record_id", "text"), days=90)


def recall_triggers(spark, d):
    r = table(spark, d, "recall_log")
    return r.groupBy(F.coalesce("trigger_kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.when(F.size("recall") >= 0, F.size("recall")), F.lit(0))).alias("recalled"), F.round(F.max("recalled_at"), 3).alias("last"))


def days_overview(spark, d):
    return recall.days_overview(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("local_date").alias("day")))


def retracted_visibility(spark, d):
    e = table(spark, d, "memory_entries").select("entry_id", "record_id").distinct()
    return ledger.visible(e, table(spark, d, "retraction_ledger")).select("entry_id")


def retraction_reasons(spark, d):
    r = table(spark, d, "retraction_ledger")
    return r.groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"), F.count("replaced_by").alias("replaced"), F.round(F.max("retracted_at"), 3).alias("last"))


def supersession_chain(spark, d):
    return ledger.supersession_chains(table(spark, d, "retraction_ledger"))


def chain_violations(spark, d):
    return ledger.chain_violations(table(spark, d, "retraction_ledger"), table(spark, d, "memory_entries").select("record_id"))


def file_difference(spark, d):
    """Records by source in the imports before 2025 and since: what was retired, added or moved between the two."""
    e = table(spark, d, "memory_entries").where("source_id IS NOT NULL AND record_id IS NOT NULL").select(F.col("source_id").alias("place"), F.col("record_id").alias("hash"), "ingested_at")
    late = F.year("ingested_at") >= 2025
    return ledger.file_difference(e.where(~late), e.where(late))


def session_gap(spark, d):
    s = sessions.gap_sessions(table(spark, d, "events").select("event_id", "user_id", "ts"))
    return s.select("event_id", "user_id", "session_no")


def session_summary(spark, d):
    s = sessions.gap_sessions(table(spark, d, "events").select("event_id", "user_id", "ts"))
    return s.groupBy("user_id", "session_no").agg(F.count("*").alias("events"), F.round((F.max(sessions.micros("ts")) - F.min(sessions.micros("ts"))) / 1e6, 3).alias("seconds"))


def session_size_cap(spark, d):
    m = table(spark, d, "archive_msgs").select("conv_key", "row_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), sessions.epoch_seconds(F.col("epoch")).alias("t"))
    return sessions.sized_blocks(m, "conv_key", "row_id", "n", "t")


def message_epochs(spark, d):
    m = table(spark, d, "archive_msgs")
    return m.select("row_id", F.round(sessions.epoch_seconds(F.col("epoch")), 3).alias("seconds"))


def message_dedup(spark, d):
    return sessions.distinct_messages(table(spark, d, "archive_msgs"))


def archive_batches(spark, d):
    m = table(spark, d, "archive_msgs").withColumn("t", sessions.epoch_seconds(F.col("epoch"))).where("text IS NOT NULL")
    day = F.date_format(F.timestamp_micros((F.col("t") * 1e6).cast("long")), "yyyy-MM-dd")
    return sessions.day_batches(m, "source_id", day, F.length("text"), ["t", "row_id"], 30000)


def import_statistics(spark, d):
    e = table(spark, d, "memory_entries")
    return e.groupBy("source_id").agg(
        F.count("*").alias("rows"), F.count_distinct("entry_id").alias("entries"), F.count_distinct("speaker").alias("speakers"), F.count_if(F.lower(F.trim("timestamp_source")) == "mtime").alias("mtime_rows"), F.count("timestamp").alias("timed")
    )


def entry_turns(spark, d):
    """Entries of a known speaker by kind of source."""
    e = table(spark, d, "memory_entries").where("trim(coalesce(speaker, '')) <> '' AND text IS NOT NULL").select("entry_id", "speaker", F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("none")).alias("kind")).distinct()
    return e.groupBy("kind", "speaker").agg(F.count("*").alias("n"))


def input_gate(spark, d):
    m = table(spark, d, "archive_msgs").where("lower(trim(role)) IN ('user', 'human')")
    return m.select("row_id", gates.input_gate("text", ("嗯",)).alias("g")).select("row_id", "g.admit", "g.reason")


def message_intent(spark, d):
    m = table(spark, d, "archive_msgs")
    return m.groupBy(gates.intent("text").alias("intent")).agg(F.count("*").alias("n"))


def near_dup_facts(spark, d):
    return facts.near_dup_fact_pairs(facts.clean_facts(table(spark, d, "passive_facts")), 0.3)


def near_dup_survivors(spark, d):
    return facts.collapse_near_dups(facts.clean_facts(table(spark, d, "passive_facts")), 0.3)


def clean_facts(spark, d):
    return facts.clean_facts(table(spark, d, "passive_facts")).select("fact_id", "written", "tag")


def fact_search(spark, d):
    f = table(spark, d, "passive_facts").groupBy("fact_id").agg(F.max("fact").alias("fact"), F.max("tag").alias("tag"))
    return facts.search_facts(f, "两只白鹭的故事 winter trip")


def facts_per_day(spark, d):
    return facts.facts_per_day(table(spark, d, "passive_facts"))


def older_states(spark, d):
    return facts.older_states(table(spark, d, "passive_facts"))


def uncovered_records(spark, d):
    return facts.uncovered_records(table(spark, d, "memory_entries"), table(spark, d, "passive_facts"))


def facts_live(spark, d):
    """Facts whose block is a live, known record and that were written before a day."""
    f = table(spark, d, "passive_facts").where("block IS NOT NULL AND written < '2026-01-01'").select("fact_id", "block").distinct()
    known = ledger.visible(table(spark, d, "memory_entries").select("record_id").where("record_id IS NOT NULL").distinct(), table(spark, d, "retraction_ledger"))
    return f.join(known, f["block"] == known["record_id"], "left_semi")


def window_siblings(spark, d):
    """Dates of documents, undated ones borrowing that of the first dated document of their window."""
    t = table(spark, d, "documents").select("doc_id", "window_no", "local_date")
    first = t.where("local_date IS NOT NULL AND window_no IS NOT NULL").groupBy(F.col("window_no").alias("_w")).agg(F.min_by("local_date", "doc_id").alias("borrowed"))
    j = t.join(first, t["window_no"] == first["_w"], "left")
    how = F.when(F.col("local_date").isNotNull(), "own").when(F.col("borrowed").isNotNull(), "window_sibling").otherwise("none")
    return j.select("doc_id", F.coalesce("local_date", "borrowed").alias("local_date"), how.alias("date_source"))


def index_bridge(spark, d):
    """Index documents with the timeline documents of the same window and day."""
    t = table(spark, d, "documents").where("window_no IS NOT NULL AND local_date IS NOT NULL").select("doc_id", "layer", "window_no", "local_date")
    i = t.where("layer = 'index'").select(F.col("doc_id").alias("index_id"), "window_no", "local_date")
    return i.join(t.where("layer = 'timeline'"), ["window_no", "local_date"]).groupBy("index_id").agg(F.count("*").alias("timeline_docs"), F.min("doc_id").alias("first_doc"))


def json_props(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"), "value")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("sum_k"), F.max("p.k").alias("max_k"), F.round(F.sum("value"), 2).alias("sum_value"))


def interval_coverage(spark, d):
    """Days that a supplier's lines cover, each from its ship date for one day and one more per line number, overlaps counted once."""
    line = table(spark, d, "lineitem").select("l_suppkey", F.datediff("l_shipdate", F.lit("1970-01-01")).alias("s"), (F.datediff("l_shipdate", F.lit("1970-01-01")) + 1 + F.col("l_linenumber")).alias("e"))
    return sessions.interval_coverage(line, "l_suppkey", "s", "e")


def event_windows(spark, d):
    """Counts by fixed hour windows, the batch form of the streaming aggregate."""
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select((sessions.micros("w.start") / 1000000).cast("long").alias("start"), "event_type", "n", "total")


def latest_by_user(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


def pricing_summary(spark, d):
    line = table(spark, d, "lineitem")
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice").cast("double")), 2).alias("sum_price"), F.count("*").alias("n"))


def transcript(spark, d):
    """The lines of each conversation and day, [HH:MM] role: text, in order, each as a digest."""
    m = table(spark, d, "archive_msgs").withColumn("t", sessions.epoch_seconds(F.col("epoch"))).where("t IS NOT NULL AND text IS NOT NULL")
    ts = F.timestamp_micros((F.col("t") * 1e6).cast("long"))
    line = F.concat(F.lit("["), F.date_format(ts, "HH:mm"), F.lit("] "), F.coalesce("role", F.lit("")), F.lit("："), F.col("text"))
    g = m.select("conv_key", F.date_format(ts, "yyyy-MM-dd").alias("day"), F.round("t", 3).alias("t"), "row_id", F.md5(line).alias("hash"))
    return g.withColumn("line_no", F.row_number().over(W.partitionBy("conv_key", "day").orderBy("t", "row_id")).cast("long")).select("conv_key", "day", "line_no", "hash")


def topic_coverage(spark, d):
    return passive.topic_coverage(table(spark, d, "documents"), ["winter trip", "cat", "garden wall"], least=0.6)


def delivery_budget(spark, d):
    """Recalled records in order of score while a recall's text stays within 2,400 bytes."""
    one = table(spark, d, "memory_entries").where("text IS NOT NULL").groupBy(F.col("record_id").alias("_rid")).agg(F.max(F.octet_length("text")).alias("bytes"))
    r = recall.explode_recalls(table(spark, d, "recall_log"))
    sized = r.join(one, r["record_id"] == one["_rid"]).select("recall_id", "pos", "score", "record_id", F.col("bytes").cast("long").alias("bytes"))
    return passive.within_budget(sized.withColumn("down", -F.col("score")), "recall_id", ["down", "pos"], "bytes", 2400).select("recall_id", "record_id", "used")


def _spoken(spark, d):
    m = table(spark, d, "archive_msgs")
    name = F.lower(F.trim("role"))
    role = F.when(name.isin("user", "human"), "user").when(name.isin("assistant", "ai", "model"), "assistant")
    return m.select("conv_key", "key", "row_id", role.alias("role"), F.round(sessions.epoch_seconds(F.col("epoch")), 3).alias("at"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))


def first_exchange(spark, d):
    return passive.first_exchange(_spoken(spark, d))


def boundary_cut(spark, d):
    return passive.boundary_cut(_spoken(spark, d), 2000)


def source_drift(spark, d):
    e = table(spark, d, "memory_entries").where("source_id IS NOT NULL AND ingested_at IS NOT NULL")
    late = F.year("ingested_at") >= 2025
    return passive.drift(e.where(~late).select("source_id"), e.where(late).select("source_id"), "source_id")


def conflict_components(spark, d):
    """Components of records linked by replacement or by a shared window."""
    r = table(spark, d, "retraction_ledger").select(F.col("hash").alias("a"), F.col("replaced_by").alias("b"))
    s = table(spark, d, "retraction_ledger").select(F.col("hash").alias("a"), F.col("source_id").alias("b"))
    return passive.conflict_components(r.unionByName(s))


def frequent_strings(spark, d):
    return passive.frequent_strings(table(spark, d, "passive_facts").select(F.col("fact").alias("text")), 4)


_FUNCTIONS = (
    topic_coverage, delivery_budget, first_exchange, boundary_cut, source_drift, conflict_components, frequent_strings, recall_recent, recall_per_day_cap, recall_weights, most_recalled, recalled_snippets, recall_triggers, days_overview, retracted_visibility, retraction_reasons, supersession_chain, chain_violations, file_difference, session_gap,
    session_summary, session_size_cap, message_epochs, message_dedup, archive_batches, import_statistics, entry_turns, input_gate, message_intent, near_dup_facts, near_dup_survivors, clean_facts, fact_search, facts_per_day, older_states,
    uncovered_records, facts_live, window_siblings, index_bridge, json_props, interval_coverage, event_windows, latest_by_user, pricing_summary, transcript,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS} | {"p2_found": timestamps.timestamps_query, "p2_status": timestamps.status_query}
