"""Checks of candidates and records, gates by kind of evidence, and what the measuring of gates needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkivist.operators import evaluate, ranking
from sparkivist.operators.gates import contains_term


def fact_problems(facts: DataFrame, records: DataFrame) -> DataFrame:
    """(fact_id, code): what is wrong with facts, by one rule each; a fact may have several codes.

    no_block, unknown_block (no such record), blank, too_short (under 8 characters), bad_date (an
    event date that is none), event_after_writing, duplicate_id (rows of one id that differ).
    facts: fact_id, block, fact, event_date, written; records: record_id.
    """
    f = facts.select("fact_id", "block", "fact", "event_date", "written").distinct()
    known = records.where("record_id IS NOT NULL").select(F.col("record_id").alias("_k")).distinct()
    body = F.trim(F.coalesce("fact", F.lit("")))
    rules = F.array(
        F.when(F.col("block").isNull(), F.lit("no_block")), F.when(F.col("block").isNotNull() & F.col("_k").isNull(), F.lit("unknown_block")), F.when(body == "", F.lit("blank")), F.when((body != "") & (F.length(body) < 8), F.lit("too_short")),
        F.when(F.col("event_date").isNotNull() & F.try_to_date("event_date").isNull(), F.lit("bad_date")), F.when(F.col("event_date") > F.col("written"), F.lit("event_after_writing")),
    )
    coded = f.join(known, F.col("block") == F.col("_k"), "left").select("fact_id", F.explode(F.filter(rules, lambda c: c.isNotNull())).alias("code"))
    twice = f.groupBy("fact_id").agg(F.count("*").alias("n")).where("n > 1").select("fact_id", F.lit("duplicate_id").alias("code"))
    return coded.unionByName(twice).distinct()


def demoted(text: Column | str, term: str, markers: list[str], around: int = 30) -> Column:
    """Whether a text speaks about the term as a review does: two different markers in it, or one within ``around`` characters of an occurrence."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    several = reduce(lambda a, b: a + b, [F.contains(c, F.lit(m)).cast("int") for m in markers], F.lit(0)) >= 2
    case = "(?i)" if term.isascii() else ""
    any_ = "|".join(rf"\Q{m}\E" for m in markers)
    # A marker may begin or end inside the window only as a whole, hence the bound less its own length.
    near = [c.rlike(rf"(?s){case}\Q{term}\E.{{0,{around - len(m)}}}?\Q{m}\E|\Q{m}\E.{{0,{around - len(m)}}}?\Q{term}\E") for m in markers if len(m) <= around] if any_ else []
    return (several | reduce(lambda a, b: a | b, near, F.lit(False))) if markers else F.lit(False)


def vector_gate(scores: DataFrame, floor: float) -> DataFrame:
    """(state, admitted, ranked): what a vector route of (query_id, id, score) lets in by its state of calibration.

    calibrated: over the floor are admitted and ranked; uncalibrated: all are ranked, none admitted;
    absent: no vectors, nothing. Null scores count for nothing.
    """
    s = scores.where("score IS NOT NULL")
    over = F.count_if(F.col("score") > floor)
    rows = [("calibrated", over, over), ("uncalibrated", F.lit(0).cast("long"), F.count("*")), ("absent", F.lit(0).cast("long"), F.lit(0).cast("long"))]
    return s.agg(F.array(*[F.struct(F.lit(n).alias("state"), a.alias("admitted"), r.alias("ranked")) for n, a, r in rows]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def gate_variants(docs: DataFrame, query: str, entities: list[str], text: str = "text") -> DataFrame:
    """(gate, admitted): how many texts each kind of evidence lets in for a query.

    one: a distinctive bigram; two: two of them; rare: a bigram of at most three texts; entity: one
    of the entities; union: a distinctive bigram or an entity; either of these on an empty table is 0.
    """
    from sparkivist.operators import index
    from sparkivist.functions import text as T

    counted = index.scan(docs.select(text, F.lit(0).alias("_id")), query, "_id", text, (text,), cosine=False)
    from sparkivist.plans.session import cut_lineage

    entity = reduce(lambda a, b: a | b, [contains_term(text, e) for e in entities], F.lit(False))
    counted = cut_lineage(counted.select("_id", "dl", "tf", entity.alias("entity")))
    known = ranking.statistics_of(counted, len(T.query_ngrams(query))).select(F.struct("n", "dfs")).scalar()
    rows = counted.withColumn("known", known).select("entity", F.arrays_zip(F.coalesce("tf", F.array().cast("array<int>")).alias("tf"), F.col("known.dfs").alias("df")).alias("z"), F.col("known.n").alias("n"))
    n_dist = F.size(F.filter("z", lambda x: (x["tf"] > 0) & (x["df"] <= ranking.distinctive_cap(F.col("n")))))
    rare = F.exists("z", lambda x: (x["tf"] > 0) & (x["df"] <= 3))
    kinds = [("one", n_dist >= 1), ("two", n_dist >= 2), ("rare", F.coalesce(rare, F.lit(False))), ("entity", F.col("entity")), ("union", (n_dist >= 1) | F.col("entity"))]
    return rows.agg(F.array(*[F.struct(F.lit(k).alias("gate"), F.count_if(c).alias("admitted")) for k, c in kinds]).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def floor_table(scored: DataFrame, floors: list[float]) -> DataFrame:
    """(floor, blocked_present, admitted_absent): per floor the present probes whose gold it blocks and the absent ones it lets in.

    scored: present (boolean), score: the gold's score of a present probe, the best score of an absent one.
    """
    aggs = [F.struct(F.lit(f).alias("floor"), F.count_if(F.col("present") & (F.col("score") <= f)).alias("blocked_present"), F.count_if(~F.col("present") & (F.col("score") > f)).alias("admitted_absent")) for f in floors]
    return scored.where("score IS NOT NULL").agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def margin_sweep(ranked: DataFrame, floor: float, margins: list[float]) -> DataFrame:
    """(margin, kept, relevant, precision, retention, surfaced) of the first two rows of each query over the floor.

    ranked: query_id, rank, score, relevant. A query's margin is its first score less its second,
    infinite with one row; all of its rows are kept or none. surfaced counts queries with a kept row.
    Rows of unknown relevance are left out of the counts.
    """
    g = ranked.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"))
    rows = ranked.where("rank <= 2 AND relevant IS NOT NULL").join(g, "query_id").withColumn("gap", F.coalesce(F.round(F.col("s1") - F.col("s2"), 6), F.lit(float("inf"))))
    keep = lambda m: (F.col("score") >= floor) & (F.col("gap") >= m)
    aggs = [F.struct(F.lit(m).alias("margin"), F.count_if(keep(m)).alias("kept"), F.count_if(keep(m) & F.col("relevant")).alias("relevant"), F.count_if("relevant").alias("all_"), F.count_distinct(F.when(keep(m), F.col("query_id"))).alias("surfaced")) for m in margins]
    x = rows.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return x.select("margin", "kept", "relevant", F.round(F.when(F.col("kept") > 0, F.col("relevant") / F.col("kept")), 6).alias("precision"), F.round(F.when(F.col("all_") > 0, F.col("relevant") / F.col("all_")), 6).alias("retention"), "surfaced")


def aligned_floor(ranked: DataFrame, reference: DataFrame, reference_floor: float, floors: list[float]) -> DataFrame:
    """(wanted, floor, share): the floor whose share of surfacing queries is nearest to the reference's at its own; of two the larger.

    Both: query_id, rank, score; a query surfaces if one of its first two rows reaches the floor.
    """
    top = lambda df: df.where("rank <= 2").groupBy("query_id").agg(F.max("score").alias("best"))
    wanted = top(reference).agg(F.round(F.avg((F.col("best") >= reference_floor).cast("int")), 9).alias("wanted"))
    shares = top(ranked).agg(F.array(*[F.struct(F.lit(f).alias("floor"), F.round(F.avg((F.col("best") >= f).cast("int")), 9).alias("share")) for f in floors]).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return shares.crossJoin(F.broadcast(wanted)).orderBy(F.abs(F.col("share") - F.col("wanted")), F.desc("floor")).limit(1).select("wanted", "floor", "share")


def substring_profile(docs: DataFrame, length: Column) -> DataFrame:
    """(texts, upto_2, upto_3, upto_4, median): distribution of a common-substring length over all texts; the upper median."""
    counted = docs.select(length.cast("long").alias("v"), F.lit(0).alias("g"))
    shares = counted.agg(F.count("*").alias("texts"), *[F.round(F.avg((F.col("v") <= k).cast("int")), 6).alias(f"upto_{k}") for k in (2, 3, 4)])
    return shares.crossJoin(F.broadcast(evaluate.upper_median(counted, "g", "v").select("median")))


def pronoun_vote(entries: DataFrame, by: str, choices: list[str], least: int = 5, share: float = 0.75, text: str = "text") -> DataFrame:
    """(by, pronoun, hits): the pronoun of each side's texts if it has ``share`` of at least ``least`` hits, else null."""
    n = {c: F.sum(F.coalesce((F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))) / len(c), F.lit(0)).cast("long")) for c in choices}
    g = entries.where(F.col(by).isNotNull()).groupBy(by).agg(F.array(*[F.struct(v.alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, v) in enumerate(n.items())]).alias("x"))
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    best = F.array_max("x")
    return g.select(by, F.when((total >= least) & (best["n"] >= share * total), best["c"]).alias("pronoun"), total.alias("hits"))


def word_profile(docs: DataFrame, markers: list[str], id_col: str = "doc_id", source: str = "source", layer: str = "layer", text: str = "text") -> DataFrame:
    """(word, blocks, demoted_blocks, clean_sources, index_sources, timeline_sources, hot) of words in two texts at least.

    A text with two different markers is demoted. hot: one to twelve clean sources, at most 18
    blocks that are not demoted, less than four fifths demoted, three characters, no number.
    """
    from sparkivist.functions import text as T

    c = F.coalesce(F.col(text), F.lit(""))
    bad = reduce(lambda a, b: a + b, [F.contains(c, F.lit(m)).cast("int") for m in markers], F.lit(0)) >= 2
    w = docs.select(F.coalesce(source, F.lit("")).alias("source"), layer, bad.alias("bad"), F.explode(F.array_distinct(T.words(text))).alias("word"))
    per = w.groupBy("word", "source").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"), F.max(F.col(layer) == "index").alias("i"), F.max(F.col(layer) == "timeline").alias("t"))
    g = per.groupBy("word").agg(F.sum("n").alias("blocks"), F.sum("b").alias("demoted_blocks"), F.count_if(F.col("b") < F.col("n")).alias("clean_sources"), F.count_if("i").alias("index_sources"), F.count_if("t").alias("timeline_sources")).where("blocks >= 2")
    hot = F.col("clean_sources").between(1, 12) & (F.col("blocks") - F.col("demoted_blocks") <= 18) & (F.col("demoted_blocks") < 0.8 * F.col("blocks")) & (F.length("word") >= 3) & ~F.col("word").rlike(r"^\p{N}+$")
    return g.withColumn("hot", hot)


def reduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, docs): Han words of two equal characters and in how many texts they occur."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?=((\p{IsHan})\2))"), F.lit(1))
    return docs.select(F.explode(F.array_distinct(found)).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))


def specificity_state(rows: DataFrame, by: str, least: int, text: str = "text") -> DataFrame:
    """(by, state, best): ok, vague or missing by the greatest number of figures and names in a group's texts."""
    score = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\d+|[A-Z][a-z]{3,}"), F.lit(0)))
    g = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.max(F.when(F.trim(F.coalesce(text, F.lit(""))) != "", score)).cast("long").alias("best"))
    return g.select(by, F.when(F.col("best").isNull(), "missing").when(F.col("best") < least, "vague").otherwise("ok").alias("state"), "best")
