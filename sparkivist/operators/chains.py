"""Operations on the ledgers: retraction, supersession plans, their integrity, chain members and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkivist.operators.ledger import supersession_chains
from sparkivist.plans.session import cut_lineage


def retraction_plan(records: DataFrame, ledger: DataFrame, quotes: list[tuple[str, str | None]]) -> DataFrame:
    """(quote, matches, verdict, record_id): what retracting by a quote, with an optional record id, would do.

    records: record_id, text. Matches are records not yet retracted that contain the trimmed quote,
    copies of a text being one. No match is ``none``, several are ``ambiguous``, one is
    ``retract`` and names the record.
    """
    live = records.where("record_id IS NOT NULL AND text IS NOT NULL").select("record_id", "text").join(ledger.where("hash IS NOT NULL").select(F.col("hash").alias("record_id")), "record_id", "left_anti")
    aggs = []
    for q, rid in quotes:
        hit = F.contains("text", F.lit(q.strip())) & (F.col("record_id") == rid if rid else F.lit(True))
        # The least and the greatest match tell none, one and several apart without gathering them.
        aggs.append(F.struct(F.lit(q).alias("quote"), F.min(F.when(hit, F.col("record_id"))).alias("lo"), F.max(F.when(hit, F.col("record_id"))).alias("hi"), F.count_if(hit).alias("matches")))
    x = live.groupBy("record_id").agg(F.max("text").alias("text")).agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    verdict = F.when(F.col("matches") == 0, "none").when(F.col("lo") != F.col("hi"), "ambiguous").otherwise("retract")
    return x.select("quote", "matches", verdict.alias("verdict"), F.when(verdict == "retract", F.col("lo")).alias("record_id"))


def followers(docs: DataFrame, retracted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, via): index documents that follow a retracted timeline document of their window, and the least such; retracted: id."""
    t = docs.where("window_no IS NOT NULL").select(id_col, "layer", "window_no")
    gone = t.where("layer = 'timeline'").join(retracted.select(id_col).distinct(), id_col, "left_semi").groupBy("window_no").agg(F.min(id_col).alias("via"))
    return t.where("layer = 'index'").join(gone, "window_no").select(id_col, "via")


def supersession_plan(records: DataFrame, ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """(old, new, verdict) of wanted links (old, new): the first rule that refuses a link, else ``ok``.

    records: record_id; ledger: hash, replaced_by. Rules in order: malformed (no 16 hex digits),
    self_link, unknown_old, unknown_new, retracted_new (in the ledger without a replacement),
    already_superseded, taken (new replaces another record), cycle (new lies before old).
    """
    known = records.where("record_id IS NOT NULL").select(F.col("record_id").alias("_k")).distinct()
    links = ledger.where("replaced_by IS NOT NULL").select("hash", "replaced_by")
    w = cut_lineage(wanted.select("old", "new").distinct())

    def has(df: DataFrame, col: str, key: str, flag: str) -> DataFrame:
        keys = df.select(F.col(key).alias("_x")).distinct().withColumn(flag, F.lit(True))
        return w.select("old", "new").join(keys, F.col(col) == F.col("_x")).select("old", "new", flag)

    ends = supersession_chains(ledger).select(F.col("rid").alias("_rid"), F.col("current").alias("_end"))
    up = w.join(ends, F.col("new") == F.col("_rid")).where("_end = old").select("old", "new", F.lit(True).alias("cycle"))
    out = w
    for f in (
        has(known, "old", "_k", "old_known"), has(known, "new", "_k", "new_known"), has(ledger.where("replaced_by IS NULL"), "new", "hash", "new_gone"), has(links, "old", "hash", "superseded"), has(links, "new", "replaced_by", "taken"), up,
    ):
        out = out.join(f, ["old", "new"], "left")
    shape = F.col("old").rlike("^[0-9a-f]{16}$") & F.col("new").rlike("^[0-9a-f]{16}$")
    verdict = (
        F.when(~F.coalesce(shape, F.lit(False)), "malformed").when(F.col("old") == F.col("new"), "self_link").when(F.col("old_known").isNull(), "unknown_old").when(F.col("new_known").isNull(), "unknown_new")
        .when(F.col("new_gone"), "retracted_new").when(F.col("superseded"), "already_superseded").when(F.col("taken"), "taken").when(F.col("cycle"), "cycle").otherwise("ok")
    )
    return out.select("old", "new", verdict.alias("verdict"))


def integrity_codes(ledger: DataFrame) -> DataFrame:
    """(rid, code) of a two-way ledger: rid, status, supersedes, superseded_by.

    dangling: a link to a record without a row. one_way: the other side does not link back.
    status_mismatch: superseded without a successor, or current with one. cycle: following
    superseded_by never ends. A record may have several codes.
    """
    rows = cut_lineage(ledger.where("rid IS NOT NULL").select("rid", "status", "supersedes", "superseded_by"))
    links = rows.where("supersedes IS NOT NULL").select("rid", F.col("supersedes").alias("to"), F.lit("superseded_by").alias("back")).unionByName(rows.where("superseded_by IS NOT NULL").select("rid", F.col("superseded_by").alias("to"), F.lit("supersedes").alias("back")))
    other = rows.select(F.col("rid").alias("_rid"), F.col("supersedes").alias("_s"), F.col("superseded_by").alias("_b"))
    j = links.join(other, F.col("to") == F.col("_rid"), "left")
    answer = F.when(F.col("back") == "supersedes", F.col("_s")).otherwise(F.col("_b"))
    code = F.when(F.col("_rid").isNull(), "dangling").when(~F.coalesce(answer == F.col("rid"), F.lit(False)), "one_way")
    broken = j.select("rid", code.alias("code")).where("code IS NOT NULL")
    status = rows.where((F.col("status") == "superseded") & F.col("superseded_by").isNull() | (F.col("status") == "current") & F.col("superseded_by").isNotNull()).select("rid", F.lit("status_mismatch").alias("code"))
    chain = rows.where("superseded_by IS NOT NULL").select(F.col("rid").alias("hash"), F.col("superseded_by").alias("replaced_by"))
    ended = supersession_chains(chain).select("rid")
    looped = chain.select(F.col("hash").alias("rid")).join(ended, "rid", "left_anti").select("rid", F.lit("cycle").alias("code"))
    return broken.unionByName(status).unionByName(looped).distinct()


def chain_members(ledger: DataFrame) -> DataFrame:
    """(current, rid, steps): every record of a chain with its distance to the end, the end included with 0."""
    c = cut_lineage(supersession_chains(ledger))
    return c.select("current", "rid", "steps").unionByName(c.select("current", F.col("current").alias("rid"), F.lit(0).cast("long").alias("steps")).distinct())


def hit_chains(ledger: DataFrame, hits: DataFrame, least: int = 2) -> DataFrame:
    """(current, hits): chains of which at least ``least`` different records are hit; hits: record_id."""
    m = chain_members(ledger)
    return m.join(hits.select(F.col("record_id").alias("rid")).distinct(), "rid", "left_semi").groupBy("current").agg(F.count_distinct("rid").alias("hits")).where(F.col("hits") >= least)


def expanded_hits(ranked: DataFrame, ledger: DataFrame) -> DataFrame:
    """(record_id, score, rank, steps): ranked hits (record_id, score, rank) with the first hit of a chain replaced by its members.

    All members carry that hit's score and rank, oldest first by falling steps; later hits of the
    same chain are dropped. Hits outside chains stay as they are with null steps.
    """
    m = cut_lineage(chain_members(ledger))
    of = ranked.join(m.select(F.col("rid").alias("record_id"), "current"), "record_id", "left")
    first = of.where("current IS NOT NULL").groupBy("current").agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("rank"))
    grown = first.join(m, "current").select(F.col("rid").alias("record_id"), "score", "rank", "steps")
    return grown.unionByName(of.where("current IS NULL").select("record_id", "score", "rank", F.lit(None).cast("long").alias("steps")))


def supersede_pool(facts: DataFrame, retracted: DataFrame, k: int = 3) -> DataFrame:
    """(fact_id, older_id, rank): for each dated fact the k latest older facts of its block that were still valid when it was written.

    facts: fact_id, block, event_date, written; retracted: block, day (when the block's record was
    retracted). Older means written before, on another event day; as of the writing the block must
    not have been retracted. Ties by id.
    """
    f = facts.where("block IS NOT NULL AND written IS NOT NULL AND event_date IS NOT NULL").select("fact_id", "block", "event_date", "written").distinct()
    o = f.select(F.col("fact_id").alias("older_id"), "block", F.col("event_date").alias("_e"), F.col("written").alias("_w"))
    gone = retracted.groupBy(F.col("block").alias("_b")).agg(F.min("day").alias("_gone"))
    j = f.join(o, "block").where("_w < written AND _e <> event_date").join(gone, F.col("block") == F.col("_b"), "left").where("_gone IS NULL OR _gone > written")
    from pyspark.sql import Window as W

    w = W.partitionBy("fact_id").orderBy(F.desc("_w"), "older_id")
    return j.select("fact_id", "older_id", "_w").distinct().withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("fact_id", "older_id", "rank")
