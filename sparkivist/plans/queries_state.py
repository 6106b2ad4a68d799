"""Queries of the span, chain, evidence and state operators over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkivist.functions import text as T
from sparkivist.operators import chains, evidence, facts, index, ledger, ranking, recall, sessions, spans, state, vectors
from sparkivist.plans.queries_evaluation import _neighbours
from sparkivist.plans.queries_retrieval import PROBES, QUERY, VARIANT
from sparkivist.plans.session import cut_lineage, table

QUOTES = ["the budget for the winter trip", "two herons", "两只白鹭的故事", "带烟味的茶", "nowhere to be found"]
NEEDLES = ["the winter trip", "trip to", "两只白鹭", "白鹭的故事"]
MARKERS = ["so far", "by mistake", "after all", "本来没人要求", "日历写错了"]
PHRASE = "the budget for the winter trip 两只白鹭的故事"
FLOORS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]
GRID = [round(0.02 * i, 2) for i in range(40)]
TODAY, FACT_FLOOR = "2026-06-01", 0.2


def quote_location(spark: SparkSession, d: str) -> DataFrame:
    return spans.locate_quotes(table(spark, d, "documents"), QUOTES)


def term_occurrences(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.explode(spans.occurrences_of("text", "the w")).alias("at"))


def anchor_table(spark, d):
    return spans.anchors(table(spark, d, "documents"))


def span_coverage(spark, d):
    return spans.covered_share(table(spark, d, "documents"), NEEDLES)


def text_blocks(spark, d):
    """Blocks of each document: how many, how many of them fenced, and the characters in them."""
    b = spans.blocks(table(spark, d, "documents"))
    return b.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if("fenced").alias("fenced"), F.sum(F.col("end") - F.col("start")).alias("chars"))


def anchored_excerpts(spark, d):
    return spans.excerpt(table(spark, d, "documents"), "winter trip", 400).select("doc_id", F.md5("excerpt").alias("hash"), (F.octet_length("excerpt") <= 400).alias("within"))


def common_substrings(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", spans.common_substring("text", PHRASE).alias("longest"))


def substring_profile(spark, d):
    return evidence.substring_profile(table(spark, d, "documents"), spans.common_substring("text", PHRASE))


def demoted_documents(spark, d):
    t = table(spark, d, "documents")
    return t.where(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("trip"))).select("doc_id", evidence.demoted("text", "trip", MARKERS).alias("demoted"))


def word_profile(spark, d):
    return evidence.word_profile(table(spark, d, "documents"), MARKERS)


def reduplicated_words(spark, d):
    return evidence.reduplicated(table(spark, d, "documents"))


def gate_variants(spark, d):
    return evidence.gate_variants(table(spark, d, "documents"), QUERY, ["Haldenmere", "garden wall"])


def gate_kill_rate(spark, d):
    """(query, admitted, killed): how many documents the lexical gate lets in for each probe, and the share it keeps out."""
    docs, out = table(spark, d, "documents"), None
    for q in PROBES:
        s = ranking.bm25_scores(docs, q).agg(F.count_if("admitted").alias("admitted")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))
        s = s.select(F.lit(q).alias("query"), "admitted", F.round(1 - F.try_divide("admitted", "n"), 6).alias("killed"))
        out = s if out is None else out.unionByName(s)
    return out


def gate_misses(spark, d):
    """Documents that hold the words of the query and are not admitted for its rewording."""
    docs = table(spark, d, "documents")
    expected = docs.where(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("winter trip"))).select("doc_id")
    return expected.join(ranking.bm25_scores(docs, VARIANT).where("admitted").select("doc_id"), "doc_id", "left_anti")


def correct_empty(spark, d):
    """(query, empty): whether the gate finds nothing for a probe, as is right for what is absent."""
    docs, out = table(spark, d, "documents"), None
    for q in (*PROBES, "qzxv", "ħŧ"):
        s = ranking.bm25_scores(docs, q).agg(F.count_if("admitted").alias("n")).select(F.lit(q).alias("query"), (F.col("n") == 0).alias("empty"))
        out = s if out is None else out.unionByName(s)
    return out


def vector_gate(spark, d):
    return evidence.vector_gate(_neighbours(spark, d).select("query_id", F.col("vec_id").alias("id"), F.col("cosine").alias("score")), 0.3)


def floor_table(spark, d):
    """Best neighbours as scores, present where the label agrees."""
    n = _neighbours(spark, d, 1)
    return evidence.floor_table(n.select(F.col("relevant").alias("present"), F.col("cosine").alias("score")), FLOORS)


def margin_sweep(spark, d):
    return evidence.margin_sweep(_neighbours(spark, d).select("query_id", "rank", F.col("cosine").alias("score"), "relevant"), 0.2, [0.0, 0.01, 0.02, 0.05, 0.1])


def surfacing_alignment(spark, d):
    """Floors for the second and later neighbours aligned with 0.3 for the first."""
    n = _neighbours(spark, d).select("query_id", "rank", F.col("cosine").alias("score"))
    return evidence.aligned_floor(n.where("rank > 1").withColumn("rank", F.col("rank") - 1), n, 0.3, GRID)


def best_hint_line(spark, d):
    """The least line whose rate of hints, at a lead of 0.02, is no more than a third; none if all are over."""
    n = _neighbours(spark, d)
    g = n.groupBy("query_id").agg(*[F.coalesce(F.max(F.when(F.col("rank") == i, F.col("cosine"))), F.lit(0.0)).alias(f"s{i}") for i in (1, 2, 3)])
    hit = lambda t: ((F.col("s1") >= t) & (F.round(F.col("s1") - F.col("s2"), 4) >= 0.02)) | ((F.col("s2") >= t) & (F.round(F.col("s2") - F.col("s3"), 4) >= 0.02))
    rates = g.agg(F.array(*[F.struct(F.lit(t).alias("line"), F.round(F.avg(hit(t).cast("int")), 6).alias("rate")) for t in GRID]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return rates.where("rate <= 0.333334").orderBy("line").limit(1)


def present_pair_scores(spark, d):
    """Each query vector's neighbours without itself, cut to three after it is dropped."""
    e = table(spark, d, "embeddings")
    n = vectors.nearest(e, e.where("vec_id % 100 = 0"), 4, exclude_self=False).where("vec_id <> query_id")
    w = W.partitionBy("query_id").orderBy("rank")
    return n.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("query_id", "vec_id", "place")


def fact_problems(spark, d):
    return evidence.fact_problems(table(spark, d, "passive_facts"), table(spark, d, "memory_entries"))


def pronoun_vote(spark, d):
    e = table(spark, d, "memory_entries").where("trim(coalesce(speaker, '')) <> ''").select("entry_id", "speaker", "text").distinct()
    return evidence.pronoun_vote(e, "speaker", ["他", "她", " he ", " she "])


def source_specificity(spark, d):
    return evidence.specificity_state(table(spark, d, "memory_entries"), "source_id", 12)


def date_coverage(spark, d):
    t = table(spark, d, "documents")
    return t.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.min("local_date").alias("first_day"), F.max("local_date").alias("last_day"), F.count("local_date").alias("dated"), F.count("*").alias("docs"))


def _records(spark, d) -> DataFrame:
    return table(spark, d, "memory_entries").where("record_id IS NOT NULL").select("record_id", "text")


def retraction_plan(spark, d):
    return chains.retraction_plan(_records(spark, d), table(spark, d, "retraction_ledger"), [("the budget for the winter trip", None), ("  gave up on the trowel ", None), ("no such thing at all", None), ("我", "f9445274d7710a7e")])


def retraction_followers(spark, d):
    docs = table(spark, d, "documents")
    return chains.followers(docs, docs.where("layer = 'timeline' AND n_chars % 5 = 0"))


def _wanted_links(spark, d) -> DataFrame:
    """Every replacement of the ledger as a wish, its reverse, and a few that cannot be."""
    r = table(spark, d, "retraction_ledger").where("hash IS NOT NULL")
    known = _records(spark, d).select("record_id").distinct().join(r.select(F.col("hash").alias("record_id")), "record_id", "left_anti")
    fresh = known.where("substring(record_id, 1, 1) = 'a'").select(F.col("record_id").alias("old"), F.lit("0" * 16).alias("new"))
    links = r.where("replaced_by IS NOT NULL")
    return links.select(F.col("hash").alias("old"), F.col("replaced_by").alias("new")).unionByName(links.select(F.col("replaced_by").alias("old"), F.col("hash").alias("new"))).unionByName(fresh).unionByName(r.select(F.col("hash").alias("old"), F.col("hash").alias("new"))).unionByName(r.select(F.upper("hash").alias("old"), F.col("hash").alias("new")))


def supersession_plan(spark, d):
    return chains.supersession_plan(_records(spark, d), table(spark, d, "retraction_ledger"), _wanted_links(spark, d))


def integrity_codes(spark, d):
    """The ledger read as a two-way one in which every third back link is missing, two wrong states, and a loop of three."""
    r = table(spark, d, "retraction_ledger").where("hash IS NOT NULL").select("hash", "replaced_by")
    back = r.where("replaced_by IS NOT NULL").groupBy(F.col("replaced_by").alias("rid")).agg(F.min("hash").alias("supersedes"))
    rows = r.select(F.col("hash").alias("rid"), F.when(F.col("replaced_by").isNotNull() | (F.substring("hash", 1, 1) == "0"), "superseded").otherwise("current").alias("status"), F.col("replaced_by").alias("superseded_by"))
    rows = rows.join(back, "rid", "left").select("rid", "status", F.when(F.substring("rid", 2, 1) < "b", F.col("supersedes")).alias("supersedes"), "superseded_by")
    loop = spark.createDataFrame([("x1", "superseded", "x3", "x2"), ("x2", "superseded", "x1", "x3"), ("x3", "superseded", "x2", "x1"), ("y", "current", None, "z")], "rid string, status string, supersedes string, superseded_by string")
    return chains.integrity_codes(rows.unionByName(loop))


def chain_members(spark, d):
    return chains.chain_members(table(spark, d, "retraction_ledger"))


def _recalled(spark, d) -> DataFrame:
    return recall.explode_recalls(table(spark, d, "recall_log"))


def hit_chains(spark, d):
    """Chains two of whose records appear in the ledger's first half or in the recall log."""
    hits = table(spark, d, "retraction_ledger").where("substring(hash, 1, 1) < 'b'").select(F.col("hash").alias("record_id")).unionByName(_recalled(spark, d).select("record_id"))
    return chains.hit_chains(table(spark, d, "retraction_ledger"), hits)


def expanded_hits(spark, d):
    """The ledger's records as hits, ranked by hash, with chains put in whole."""
    h = table(spark, d, "retraction_ledger").where("hash IS NOT NULL").select(F.col("hash").alias("record_id"))
    return chains.expanded_hits(ranking.global_rank(h, F.asc("record_id")).select("record_id", F.length("record_id").cast("double").alias("score"), (F.col("rank0") + 1).alias("rank")), table(spark, d, "retraction_ledger"))


def supersede_pool(spark, d):
    day = F.date_format(F.timestamp_micros((F.col("retracted_at") * 1e6).cast("long")), "yyyy-MM-dd")
    return chains.supersede_pool(table(spark, d, "passive_facts"), table(spark, d, "retraction_ledger").select(F.col("hash").alias("block"), day.alias("day")))


def index_gold(spark, d):
    """Index documents with sentences and the timeline documents of their window, the gold of each sentence."""
    t = table(spark, d, "documents").where("window_no IS NOT NULL")
    gold = t.where("layer = 'timeline'").groupBy("window_no").agg(F.count("*").alias("gold"), F.min("doc_id").alias("first_gold"))
    s = t.where("layer = 'index'").select("doc_id", "window_no", F.size(T.sentences("text")).alias("sentences")).where("sentences > 0")
    return s.join(gold, "window_no").select("doc_id", "sentences", "gold", "first_gold")


def bridge_keys(spark, d):
    """Index documents with timeline documents by window, else by day, else by source: the first key that both have."""
    t = table(spark, d, "documents").select("doc_id", "layer", F.coalesce(F.concat(F.lit("w"), F.col("window_no").cast("string")), F.concat(F.lit("d"), F.col("local_date")), F.concat(F.lit("s"), F.col("source"))).alias("key")).where("key IS NOT NULL")
    timeline = t.where("layer = 'timeline'").groupBy("key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
    return t.where("layer = 'index'").join(timeline, "key").select(F.col("doc_id").alias("index_id"), F.substring("key", 1, 1).alias("by"), "docs", "first_doc")


def entity_edges(spark, d):
    """Neighbours of facts by shared bigrams and by their event day as an entity."""
    f = table(spark, d, "passive_facts").where("fact IS NOT NULL").groupBy("fact_id").agg(F.max("fact").alias("text"), F.max("event_date").alias("entity"))
    return ranking.graph_edges(f, "fact_id", entities=f.select("fact_id", "entity"))


def hybrid_visible(spark, d):
    """Retrieval over the live records: retracted ones count in the statistics and are never shown."""
    e = table(spark, d, "memory_entries").where("record_id IS NOT NULL").groupBy("entry_id").agg(F.max("text").alias("text"), F.max("record_id").alias("record_id"), F.max(F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("none"))).alias("layer"))
    gone = table(spark, d, "retraction_ledger").where("hash IS NOT NULL").select(F.col("hash").alias("record_id"), F.lit(True).alias("gone")).distinct()
    docs = e.join(gone, "record_id", "left").select(F.col("entry_id").alias("doc_id"), "text", "layer", F.col("gone").isNull().alias("live"))
    return ranking.hybrid_retrieve(docs, QUERY, visible=F.col("live"))


def index_replace(spark, d):
    """Statistics of an index of which a tenth of the documents was replaced by their upper half and another tenth removed."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    old = cut_lineage(index.build(docs))
    changed = docs.where("doc_id % 10 = 3").select("doc_id", F.substring("text", 1, 100).alias("text"))
    new = index.replace(old, changed, docs.where("doc_id % 10 = 7"))
    return cut_lineage(new).agg(F.count("*").alias("docs"), F.sum("dl").alias("bigrams"), F.sum(F.octet_length("grams") / 8).cast("long").alias("postings"))


def random_facts(spark, d):
    """Twelve facts in an order that only their ids and a seed decide."""
    f = table(spark, d, "passive_facts").select("fact_id").distinct()
    return f.select("fact_id", F.md5(F.concat(F.lit("seed-7|"), "fact_id")).alias("draw")).orderBy("draw").limit(12)


def record_by_id(spark, d):
    """Records by id: text digest and number of entries, not found where there is none."""
    wanted = spark.createDataFrame([("f9445274d7710a7e",), ("43a126c06bc15cef",), ("0000000000000000",)], "record_id string")
    r = table(spark, d, "memory_entries").join(F.broadcast(wanted), "record_id", "left_semi").groupBy("record_id").agg(F.count_distinct("entry_id").alias("entries"), F.md5(F.max("text")).alias("hash"))
    return wanted.join(r, "record_id", "left").select("record_id", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("hash", F.lit("not found")).alias("hash"))


def facts_by_span(spark, d):
    f = table(spark, d, "passive_facts").where("written BETWEEN '2024-01-01' AND '2024-06-30' AND tag IN ('life', 'work')")
    return f.select("fact_id", "written", "tag").distinct()


def checklist_items(spark, d):
    """Lines of the form "- [x] name: text": well-formed and malformed ones, and names that come again in their document."""
    line = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^- \["))
    name = F.regexp_extract("line", r"^- \[[ x]\] ([^:：\n]+)[:：] \S", 1)
    items = line.select("doc_id", name.alias("name"))
    per = items.groupBy("doc_id", "name").agg(F.count("*").alias("n"))
    return per.groupBy("doc_id").agg(F.sum(F.when(F.col("name") != "", 1).otherwise(0)).alias("items"), F.coalesce(F.sum(F.when(F.col("name") == "", F.col("n"))), F.lit(0)).alias("malformed"), F.sum(F.when(F.col("name") != "", F.col("n") - 1).otherwise(0)).alias("repeated"))


def bold_items(spark, d):
    """Names of the bold items of each document, in order, as a digest."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\*\*([^*:：\n]+)[:：]"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", found.alias("x")).where("size(x) > 0").select("doc_id", F.size("x").alias("items"), F.md5(F.array_join("x", "|")).alias("hash"))


def overwrite_conflicts(spark, d):
    """Windows and sources with more than one text: what writing one file per window would lose."""
    t = table(spark, d, "documents").where("window_no IS NOT NULL AND text IS NOT NULL")
    return t.groupBy("window_no", "source").agg(F.count_distinct(F.md5("text")).alias("texts")).where("texts > 1")


def fact_vector_pairs(spark, d):
    """Facts with the vector of their number, and whether the vector is of unit length to two places."""
    f = table(spark, d, "passive_facts").select("fact_id", F.substring("fact_id", 2, 20).cast("long").alias("no")).distinct()
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("no"), F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 2).alias("norm"))
    return f.join(v, "no").select("fact_id", "norm")


def _messages(spark, d) -> DataFrame:
    m = table(spark, d, "archive_msgs")
    name = F.lower(F.trim("role"))
    role = F.when(name.isin("user", "human"), "user").when(name.isin("assistant", "ai", "model"), "assistant")
    at = F.round(sessions.epoch_seconds(F.col("epoch")), 3)
    return m.where("key IS NOT NULL").groupBy("source_id", "key").agg(F.min(at).alias("at"), F.min(role).alias("role"), F.max(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


def pending_messages(spark, d):
    """Messages behind each log's cursor, which stands at the last message before 2024."""
    m = cut_lineage(_messages(spark, d))
    return state.after_cursor(m, state.advanced_cursor(m.where("at < 1704067200"))).select("source_id", "key")


def archive_cursor(spark, d):
    c = state.advanced_cursor(_messages(spark, d))
    return c.select("source_id", "c_at", F.array_join("c_keys", ",").alias("keys"))


def archive_fire(spark, d):
    day = F.date_format(F.timestamp_micros((F.col("at") * 1e6).cast("long")), "yyyy-MM-dd")
    m = _messages(spark, d).where("at >= 1704067200")
    return state.fire(m, day, "2024-01-12", 1705017600.0, 3000, 12, 240.0)


def idempotent_requests(spark, d):
    return state.idempotent(table(spark, d, "archive_msgs"), ["conv_key", "key"], ["role", "text"], ["row_id"])


def open_items(spark, d):
    """Events read as operations on an item per user: purchases open, clicks and views update, errors close."""
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "error", "close").when(F.col("event_type") == "purchase", "open").otherwise("update")
    return state.open_items(e.select(F.col("user_id").alias("item"), sessions.micros("ts").alias("at"), F.col("event_id").alias("seq"), action.alias("action")))


def _live(spark, d) -> DataFrame:
    return ledger.visible(_records(spark, d).select("record_id").distinct(), table(spark, d, "retraction_ledger"))


def delivery_states(spark, d):
    return state.delivery_states(_recalled(spark, d), _live(spark, d))


def _recall_day():
    return F.date_format(F.timestamp_micros((F.col("recalled_at") * 1e6).cast("long")), "yyyy-MM")


def same_month_recalls(spark, d):
    """As the rule of the same day, over months, since the log rarely recalls the day it is written."""
    r = _recalled(spark, d).withColumn("local_date", F.substring("local_date", 1, 7))
    return state.same_day_excluded(r, _recall_day())


def recall_eligibility(spark, d):
    r = _recalled(spark, d).withColumn("local_date", F.substring("local_date", 1, 7))
    return state.eligibility(r, _live(spark, d), _recall_day(), 0.3)


def conversation_topics(spark, d):
    m = table(spark, d, "archive_msgs").where("conv_key IS NOT NULL").withColumn("t", F.round(sessions.epoch_seconds(F.col("epoch")), 3)).where("t IS NOT NULL")
    return state.last_lines(m, "conv_key", ["t", "row_id"], "text").select("conv_key", F.md5("topics").alias("hash"))


def source_ages(spark, d):
    s = table(spark, d, "import_sources")
    return s.select("source_id", state.age_label(F.lit(1767225600.0) - sessions.micros("exported_at") / 1e6).alias("age"))


def backfill_next(spark, d):
    """The next records without a fact, in order, within 40 records and 12,000 characters; the first always fits."""
    r = table(spark, d, "memory_entries").where("record_id IS NOT NULL AND text IS NOT NULL").groupBy("record_id").agg(F.max(F.length("text")).cast("long").alias("chars"))
    todo = r.join(facts.uncovered_records(r, table(spark, d, "passive_facts")), "record_id", "left_semi").orderBy("record_id").limit(40)
    w = W.orderBy("record_id").rowsBetween(W.unboundedPreceding, 0)  # forty rows
    return todo.withColumn("used", F.sum("chars").over(w)).withColumn("no", F.count("*").over(w)).where("used <= 12000 OR no = 1").select("record_id", "used")


def rare_word_path(spark, d):
    """Timeline documents with the query's rarest word, by number of its other words, then id."""
    docs = table(spark, d, "documents")
    words = sorted({w for w in QUERY.lower().split() if len(w) > 2})
    held = docs.select("doc_id", "layer", T.words("text").alias("w"))
    counts = held.agg(*[F.count_if(F.array_contains("w", x)).alias(x) for x in words]).first().asDict()
    rare = min((n, w) for w, n in counts.items() if n) if any(counts.values()) else None
    if rare is None or rare[0] > 18:
        return docs.select("doc_id", F.lit("").alias("term"), F.lit(0).alias("others")).limit(0)
    others = F.size(F.array_intersect("w", F.array(*map(F.lit, words)))) - 1
    return held.where((F.col("layer") == "timeline") & F.array_contains("w", rare[1])).select("doc_id", F.lit(rare[1]).alias("term"), others.alias("others"))


def fact_mode(spark, d):
    """The whole of fact mode for the stated query vectors over the facts whose number a vector has.

    Facts must not be meta, be written before the day, and belong to a live record. Ranked by cosine,
    cut at the floor and to two, then without cooling ones; siblings of their blocks follow within
    the budget. older marks a state that a later one of its block, delivered with it, has replaced.
    """
    f = table(spark, d, "passive_facts").where(f"coalesce(tag, '') <> 'meta' AND written < '{TODAY}' AND block IS NOT NULL AND fact IS NOT NULL")
    f = f.withColumn("_n", F.row_number().over(W.partitionBy("fact_id").orderBy("written", "fact"))).where("_n = 1").drop("_n")
    live = f.join(_live(spark, d).withColumnRenamed("record_id", "block"), "block", "left_semi").withColumn("vec_id", F.substring("fact_id", 2, 20).cast("long"))
    e = table(spark, d, "embeddings")
    mine = e.join(live.select("vec_id"), "vec_id", "left_semi")
    near = vectors.nearest(mine, e.where("vec_id % 100 = 0"), 11).withColumn("cosine", F.round("cosine", 4))
    ranked = near.join(live, "vec_id").select("query_id", "fact_id", "block", "rank", F.octet_length("fact").alias("bytes"), (F.col("cosine") >= FACT_FLOOR).alias("above"), (F.col("vec_id") % 7 == 0).alias("cooling"))
    out = cut_lineage(facts.attach_siblings(ranked))
    told = out.join(live.select("fact_id", "block", "kind", "event_date"), "fact_id")
    newest = F.max(F.when(F.col("kind") == "state", F.col("event_date"))).over(W.partitionBy("query_id", "block"))
    return told.select("query_id", "fact_id", "role", "at", F.coalesce((F.col("kind") == "state") & (F.col("event_date") < newest), F.lit(False)).alias("older"))


_FUNCTIONS = (
    quote_location, term_occurrences, anchor_table, span_coverage, text_blocks, anchored_excerpts, common_substrings, substring_profile, demoted_documents, word_profile, reduplicated_words, gate_variants, gate_kill_rate, gate_misses, correct_empty,
    vector_gate, floor_table, margin_sweep, surfacing_alignment, best_hint_line, present_pair_scores, fact_problems, pronoun_vote, source_specificity, date_coverage, retraction_plan, retraction_followers, supersession_plan, integrity_codes,
    chain_members, hit_chains, expanded_hits, supersede_pool, index_gold, bridge_keys, entity_edges, hybrid_visible, index_replace, random_facts, record_by_id, facts_by_span, checklist_items, bold_items, overwrite_conflicts, fact_vector_pairs,
    pending_messages, archive_cursor, archive_fire, idempotent_requests, open_items, delivery_states, same_month_recalls, recall_eligibility, conversation_topics, source_ages, backfill_next, rare_word_path, fact_mode,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
