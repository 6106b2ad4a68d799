"""Retraction and supersession ledgers: visibility, chains and their integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkivist.plans.session import cut_lineage


def visible(rows: DataFrame, ledger: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows whose record is not retracted; rows with a null record stay."""
    gone = ledger.where("hash IS NOT NULL").select(F.col("hash").alias("_hash"))
    return rows.join(gone, rows[key] == gone["_hash"], "left_anti")


def successors(ledger: DataFrame) -> DataFrame:
    """(rid, next): replacement links without nulls and self-links; the least replacement if there are several."""
    return ledger.where("hash IS NOT NULL AND replaced_by IS NOT NULL AND hash <> replaced_by").groupBy(F.col("hash").alias("rid")).agg(F.min("replaced_by").alias("next"))


def supersession_chains(ledger: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(rid, current, steps): where each replaced record's chain ends, by pointer doubling.

    A round joins every open pointer with its target's, so a chain of n links takes log2(n) of
    them. Records on or behind a cycle have no current record and are left out.
    """
    state = cut_lineage(successors(ledger).select("rid", F.col("next").alias("ptr"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done")))
    total = state.count()
    for i in range(max_rounds):
        if 2**i > 2 * max(total, 1):
            break
        hop = state.select(F.col("rid").alias("_rid"), F.col("ptr").alias("_ptr"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        open_ = state.where("NOT done")
        state = cut_lineage(
            state.where("done").unionByName(
                open_.join(hop, open_["ptr"] == hop["_rid"], "left").select(
                    "rid", F.coalesce("_ptr", "ptr").alias("ptr"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), (F.col("_rid").isNull() | F.col("_done")).alias("done")
                )
            )
        )
        if not state.where("NOT done").limit(1).count():
            break
    return state.where("done").select("rid", F.col("ptr").alias("current"), "steps")


def chain_violations(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """(rid, code): dangling (replaced by an unknown record), retracted_target, shared_target, self_link.

    records: record_id. A rid may have several codes.
    """
    links = ledger.where("replaced_by IS NOT NULL").select(F.col("hash").alias("rid"), "replaced_by")
    known = records.where("record_id IS NOT NULL").select(F.col("record_id").alias("_k")).distinct()
    gone = ledger.select(F.col("hash").alias("_h"))
    dangling = links.join(known, links["replaced_by"] == known["_k"], "left_anti").select("rid", F.lit("dangling").alias("code"))
    retracted = links.join(gone, links["replaced_by"] == gone["_h"], "left_semi").select("rid", F.lit("retracted_target").alias("code"))
    several = links.groupBy("replaced_by").agg(F.count("*").alias("n")).where("n > 1").select(F.col("replaced_by").alias("_r"))
    shared = links.join(several, links["replaced_by"] == several["_r"], "left_semi").select("rid", F.lit("shared_target").alias("code"))
    own = links.where("rid = replaced_by").select("rid", F.lit("self_link").alias("code"))
    return dangling.unionByName(retracted).unionByName(shared).unionByName(own)


def file_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(place, hash, change, n): multi-set difference of two versions; rows: place, hash.

    Of the copies of a text that left places and entered others, as many as both sides have are
    moves, dealt out in order of the places; the rest is retired or added. A row may have both.
    """
    o = old.groupBy("place", "hash").agg(F.count("*").alias("o"))
    n = new.groupBy("place", "hash").agg(F.count("*").alias("n"))
    d = o.join(n, ["place", "hash"], "full").select("place", "hash", (F.coalesce("n", F.lit(0)) - F.coalesce("o", F.lit(0))).alias("delta")).where("delta <> 0")
    both = d.groupBy("hash").agg(F.least(F.sum(F.when(F.col("delta") > 0, F.col("delta")).otherwise(0)), F.sum(F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0))).alias("moves"))
    size = F.abs("delta")
    before = F.sum(size).over(W.partitionBy("hash", F.col("delta") > 0).orderBy("place").rowsBetween(W.unboundedPreceding, 0)) - size
    dealt = d.join(both, "hash").withColumn("moved", F.greatest(F.least(F.col("moves") - before, size), F.lit(0)))
    gained = F.col("delta") > 0
    parts = F.array(F.struct(F.when(gained, "moved_in").otherwise("moved_out").alias("change"), F.col("moved").alias("n")), F.struct(F.when(gained, "added").otherwise("retired").alias("change"), (size - F.col("moved")).alias("n")))
    return dealt.select("place", "hash", F.explode(parts).alias("x")).select("place", "hash", "x.change", "x.n").where("n > 0")
