"""Facts: near-duplicates of a day, ranking with siblings, states and search."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkivist.functions import text as T

OVERLAP_FLOOR = 0.6


def clean_facts(facts: DataFrame) -> DataFrame:
    """Facts without meta rows and blanks, one row per text: the earliest written, then the least id."""
    live = facts.where("fact IS NOT NULL AND trim(fact) <> '' AND coalesce(tag, '') <> 'meta'")
    w = W.partitionBy("fact").orderBy(F.col("written").asc_nulls_last(), "fact_id")
    return live.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def near_dup_fact_pairs(facts: DataFrame, floor: float = OVERLAP_FLOOR) -> DataFrame:
    """(fact_a, fact_b, overlap), a < b: facts of one written or event day whose bigram sets overlap by at least ``floor``.

    The overlap is the intersection over the smaller set. A shared day and a shared token of a
    prefix make a candidate: of the sets in one global token order, rarest first, an overlap of floor x the
    smaller size must show in its first size - ceil(floor x size) + 1 tokens, so only prefixes of
    the one are joined with the tokens of the other.
    """
    sets = facts.select("fact_id", "written", "event_date", F.array_sort(T.ngram_set("fact")).alias("s")).where(F.size("s") > 0)
    days = sets.select("fact_id", "s", F.explode(F.array_distinct(F.filter(F.array("written", "event_date"), lambda d: d.isNotNull()))).alias("day"))
    size = F.size("s")
    # The smaller set's prefix meets any token of the larger; the rarest tokens of the table come first in it.
    tokens = sets.select("fact_id", F.explode("s").alias("t"))
    rare = tokens.join(tokens.groupBy("t").agg(F.count("*").alias("df")), "t").groupBy("fact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda x: x["t"]).alias("o"))
    days = days.join(rare, "fact_id")
    prefix = days.select("day", F.col("fact_id").alias("p"), size.alias("pn"), F.explode(F.slice("o", F.lit(1), (size - F.ceil(size * floor) + 1).cast("int"))).alias("t"))
    full = days.select("day", F.col("fact_id").alias("q"), size.alias("qn"), F.explode("s").alias("t"))
    pairs = prefix.join(full, ["day", "t"]).where((F.col("p") != F.col("q")) & ((F.col("pn") < F.col("qn")) | (F.col("pn") == F.col("qn")) & (F.col("p") < F.col("q"))))
    pairs = pairs.select(F.least("p", "q").alias("fact_a"), F.greatest("p", "q").alias("fact_b")).distinct()
    sa, sb = sets.select(F.col("fact_id").alias("fact_a"), F.col("s").alias("sa")), sets.select(F.col("fact_id").alias("fact_b"), F.col("s").alias("sb"))
    overlap = F.size(F.array_intersect("sa", "sb")) / F.least(F.size("sa"), F.size("sb"))
    return pairs.join(sa, "fact_a").join(sb, "fact_b").select("fact_a", "fact_b", F.round(overlap, 6).alias("overlap")).where(F.col("overlap") >= floor)


def collapse_near_dups(facts: DataFrame, floor: float = OVERLAP_FLOOR) -> DataFrame:
    """(fact_id) that survive the greedy collapse: inside a day, longest first, each absorbs later near-duplicates.

    A fact absorbed under one of its days is out everywhere; days go in ascending order. The fold
    runs per connected group of near-duplicates, which holds all facts that can affect one another.
    """
    from sparkivist.plans.session import cut_lineage

    pairs = cut_lineage(near_dup_fact_pairs(facts, floor))
    days = facts.select("fact_id", F.length("fact").alias("n"), F.explode(F.array_distinct(F.filter(F.array("written", "event_date"), lambda d: d.isNotNull()))).alias("day"))
    a = days.select(F.col("fact_id").alias("fact_a"), F.col("n").alias("na"), "day")
    b = days.select(F.col("fact_id").alias("fact_b"), F.col("n").alias("nb"), "day")
    by_day = pairs.join(a, "fact_a").join(b, ["fact_b", "day"])
    first = (F.col("na") > F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("fact_a") < F.col("fact_b"))
    keeper, loser = F.when(first, F.col("fact_a")).otherwise(F.col("fact_b")), F.when(first, F.col("fact_b")).otherwise(F.col("fact_a"))
    time = F.struct("day", (-F.greatest("na", "nb")).alias("k"), keeper.alias("by"))
    pending = cut_lineage(by_day.select(keeper.alias("keeper"), loser.alias("loser"), time.alias("time")))
    gone = pending.select(F.col("loser").alias("fact_id"), "time").limit(0)
    # An arc acts at its time unless its keeper is gone by then; it waits for earlier arcs that may remove the keeper.
    while True:  # every round fires the earliest open arc at least
        out = gone.groupBy(F.col("fact_id").alias("keeper")).agg(F.min("time").alias("out"))
        alive = pending.join(out, "keeper", "left").where(F.col("out").isNull() | (F.col("time") < F.col("out"))).drop("out")
        threat = alive.groupBy(F.col("loser").alias("keeper")).agg(F.min("time").alias("threat"))
        judged = cut_lineage(alive.join(threat, "keeper", "left").withColumn("ready", F.col("threat").isNull() | (F.col("time") < F.col("threat"))))
        fired = judged.where("ready").select(F.col("loser").alias("fact_id"), "time")
        gone = cut_lineage(gone.unionByName(fired).groupBy("fact_id").agg(F.min("time").alias("time")))
        pending = judged.where("NOT ready").select("keeper", "loser", "time")
        if not pending.limit(1).count():
            break
    return facts.select("fact_id").join(gone.select("fact_id"), "fact_id", "left_anti").distinct()


def search_facts(facts: DataFrame, query: str, k: int = 12) -> DataFrame:
    """(fact_id, coverage): share of the query's bigrams that a fact holds, best first, ties by id; meta facts are left out."""
    q = T.query_ngrams(query)
    share = F.size(F.array_intersect(T.ngrams("fact"), F.array(*map(F.lit, q)))) / len(q)
    return facts.where("coalesce(tag, '') <> 'meta'").select("fact_id", F.round(share, 6).alias("coverage")).where("coverage > 0").orderBy(F.desc("coverage"), "fact_id").limit(k)


def facts_per_day(facts: DataFrame) -> DataFrame:
    """(day, life, work, other, total) by the day they were written."""
    tag = F.coalesce("tag", F.lit(""))
    return facts.where("written IS NOT NULL").groupBy(F.col("written").alias("day")).agg(
        F.count_if(tag == "life").alias("life"), F.count_if(tag == "work").alias("work"), F.count_if(~tag.isin("life", "work")).alias("other"), F.count("*").alias("total")
    )


def older_states(facts: DataFrame) -> DataFrame:
    """(fact_id, newest): dated states of a block for which a later one exists."""
    states = facts.where("kind = 'state' AND event_date IS NOT NULL AND block IS NOT NULL").select("fact_id", "block", "event_date").distinct()
    newest = states.groupBy("block").agg(F.max("event_date").alias("newest"))
    return states.join(newest, "block").where("event_date < newest").select("fact_id", "newest").distinct()


def uncovered_records(records: DataFrame, facts: DataFrame) -> DataFrame:
    """record_id of the records without a fact."""
    done = facts.where("block IS NOT NULL").select(F.col("block").alias("_b")).distinct()
    return records.where("record_id IS NOT NULL").select("record_id").distinct().join(done, F.col("record_id") == F.col("_b"), "left_anti")


def attach_siblings(ranked: DataFrame, top: int = 2, siblings: int = 3, budget: int = 1000) -> DataFrame:
    """(query_id, fact_id, role, at): the first ``top`` facts of a query, each followed by siblings of its block.

    ranked: query_id, fact_id, block, rank from 1, bytes, above (over the floor), cooling. The cut
    comes before the cooling facts are dropped, and nothing moves up. Siblings are taken in rank
    order while the bytes stay within the budget; one that does not fit is passed over. The fold
    sees only facts over the floor of one query.
    """

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rank")
        kept = f[(f["rank"] <= top) & ~f["cooling"]]
        used, chosen = int(kept["bytes"].sum()), {i: [] for i in kept["fact_id"]}
        of = dict(zip(kept["block"], kept["fact_id"]))
        n = 0
        for r in f[(f["rank"] > top) & ~f["cooling"]].itertuples():
            if n >= siblings:
                break
            if r.block in of and used + r.bytes <= budget:
                chosen[of[r.block]].append(r.fact_id)
                used, n = used + r.bytes, n + 1
        rows, q = [], f["query_id"].iloc[0]
        for i in kept["fact_id"]:
            rows += [(q, i, "kept"), *((q, s, "sibling") for s in chosen[i])]
        out = pd.DataFrame(rows, columns=["query_id", "fact_id", "role"])
        out["at"] = range(1, len(out) + 1)
        return out

    kinds = {x.name: x.dataType.simpleString() for x in ranked.schema}
    return ranked.where("above").groupBy("query_id").applyInPandas(fold, f"query_id {kinds['query_id']}, fact_id {kinds['fact_id']}, role string, at long")


def margin_and_lead(ranked: DataFrame) -> DataFrame:
    """(query_id, margin, lead) from ranked scores: s1 - s2, and s1 less the mean of s2..s11."""
    s1, s2 = F.max(F.when(F.col("rank") == 1, F.col("score"))), F.max(F.when(F.col("rank") == 2, F.col("score")))
    rest = F.avg(F.when(F.col("rank").between(2, 11), F.col("score")))
    return ranked.groupBy("query_id").agg(F.round(s1 - s2, 6).alias("margin"), F.round(s1 - rest, 6).alias("lead"))
