"""Queries of the evaluation and calibration operators over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkivist.operators import evaluate, facts, vectors
from sparkivist.plans.session import cut_lineage, table

THRESHOLDS = [0.2, 0.3, 0.4, 0.45, 0.5, 0.6, 0.7]


def _neighbours(spark, d: str, k: int = 11) -> DataFrame:
    """(query_id, vec_id, cosine, rank, relevant): the stated queries' nearest vectors; the same label is relevant."""
    e = table(spark, d, "embeddings")
    near = vectors.nearest(e, e.where("vec_id % 100 = 0"), k).withColumn("cosine", F.round("cosine", 4))
    a, b = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("_ql")), e.select("vec_id", F.col("label").alias("_l"))
    return near.join(a, "query_id").join(b, "vec_id").select("query_id", "vec_id", "cosine", "rank", (F.col("_ql") == F.col("_l")).alias("relevant"), F.col("_l").alias("block"))


def auc_rank_sum(spark, d):
    return evaluate.auc(_neighbours(spark, d), "cosine", "relevant")


def auc_event_values(spark, d):
    return evaluate.auc(table(spark, d, "events").select("value", (F.col("event_type") == "click").alias("is_click")), "value", "is_click")


def floor_sweep(spark, d):
    return evaluate.sweep(_neighbours(spark, d), "cosine", "relevant", THRESHOLDS)


def nearest_rank_percentiles(spark, d):
    return evaluate.nearest_rank(table(spark, d, "events").select("event_type", "value"), "event_type", "value", [5, 25, 50, 75, 90, 99])


def upper_medians(spark, d):
    return evaluate.upper_median(table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "n_chars"), "source", "n_chars")


def recall_mrr(spark, d):
    near = cut_lineage(_neighbours(spark, d, 5))
    e = table(spark, d, "embeddings")
    kinds = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("kind"))
    gold = kinds.join(near.where("relevant").select("query_id", F.col("vec_id").alias("item")), "query_id", "left")
    return evaluate.recall_and_mrr(near.select("query_id", F.col("vec_id").alias("item"), "rank"), gold, 5)


def fact_margin_lead(spark, d):
    return facts.margin_and_lead(_neighbours(spark, d).withColumnRenamed("cosine", "score"))


def fact_top2_siblings(spark, d):
    n = _neighbours(spark, d)
    ranked = n.select("query_id", F.col("vec_id").alias("fact_id"), "block", "rank", (F.lit(100) + F.col("vec_id") % 300).cast("int").alias("bytes"), (F.col("cosine") >= 0.2).alias("above"), (F.col("vec_id") % 7 == 0).alias("cooling"))
    return facts.attach_siblings(ranked)


def supersede_hint(spark, d):
    """Which of the first two neighbours the hint names, if any: s1 over the line with a lead, else s2 with one."""
    n = _neighbours(spark, d)
    g = n.groupBy("query_id").agg(*[F.coalesce(F.max(F.when(F.col("rank") == i, F.col("cosine"))), F.lit(0.0)).alias(f"s{i}") for i in (1, 2, 3)])
    t, lead = 0.4, 0.02
    hint = F.when((F.col("s1") >= t) & (F.round(F.col("s1") - F.col("s2"), 4) >= lead), "first").when((F.col("s2") >= t) & (F.round(F.col("s2") - F.col("s3"), 4) >= lead), "second").otherwise("none")
    return g.select("query_id", hint.alias("hint"))


def hint_rate_grid(spark, d):
    """Share of queries with a hint for each pair of line and lead."""
    n = _neighbours(spark, d)
    g = n.groupBy("query_id").agg(*[F.coalesce(F.max(F.when(F.col("rank") == i, F.col("cosine"))), F.lit(0.0)).alias(f"s{i}") for i in (1, 2, 3)])
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("line"), F.lit(m).alias("lead")) for t in (0.2, 0.3, 0.4, 0.5) for m in (0.0, 0.02, 0.05)]))
    x = g.select("s1", "s2", "s3", grid.alias("p"))
    hit = ((F.col("s1") >= F.col("p.line")) & (F.round(F.col("s1") - F.col("s2"), 4) >= F.col("p.lead"))) | ((F.col("s2") >= F.col("p.line")) & (F.round(F.col("s2") - F.col("s3"), 4) >= F.col("p.lead")))
    return x.groupBy("p.line", "p.lead").agg(F.round(F.avg(hit.cast("int")), 6).alias("rate"))


_FUNCTIONS = (auc_rank_sum, auc_event_values, floor_sweep, nearest_rank_percentiles, upper_medians, recall_mrr, fact_margin_lead, fact_top2_siblings, supersede_hint, hint_rate_grid)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
