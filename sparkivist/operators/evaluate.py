"""Quality measures: AUC, threshold sweeps, percentiles and retrieval scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkivist.operators.ranking import running_total


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row: auc (null if a class is empty), positives, negatives; ties count half.

    Rows are first counted by distinct score; the pairs below each score are then a running sum
    over ranges of scores. Null scores or labels are left out.
    """
    by = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    by = running_total(by, "n", F.asc("s"))
    below = F.col("running") - F.col("n")
    won = by.withColumn("won", F.col("p") * (below + F.col("n") / 2))
    return won.agg(F.sum("won").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n")).select(
        F.when((F.col("p") > 0) & (F.col("n") > 0), F.round(F.col("w") / (F.col("p") * F.col("n")), 6)).alias("auc"), F.coalesce("p", F.lit(0)).cast("long").alias("positives"), F.coalesce("n", F.lit(0)).cast("long").alias("negatives")
    )


def sweep(rows: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """(threshold, kept, relevant, precision, retention): what a floor keeps, for each threshold.

    One aggregation carries all thresholds; null labels are left out.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    aggs = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(score) >= t).alias("kept"), F.count_if((F.col(score) >= t) & F.col(label)).alias("relevant"), F.count_if(F.col(label)).alias("all_relevant")) for t in thresholds]
    x = known.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    return x.select("threshold", "kept", "relevant", F.round(F.when(F.col("kept") > 0, F.col("relevant") / F.col("kept")), 6).alias("precision"), F.round(F.when(F.col("all_relevant") > 0, F.col("relevant") / F.col("all_relevant")), 6).alias("retention"))


def _placed(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, v, c, upto, n): counted values of each group with the rows up to them and in all.

    The running count goes over ranges of (by, value), so that neither a hot group nor one with
    many different values comes into one task.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    run = running_total(counted, "c", F.asc_nulls_first(by), F.asc("v"))
    ends = run.groupBy(F.col(by).alias("_by")).agg(F.sum("c").alias("n"), F.max("running").alias("_to"))
    j = run.join(ends, F.col(by).eqNullSafe(F.col("_by")))
    return j.select(by, "v", "c", (F.col("running") - F.col("_to") + F.col("n")).alias("upto"), "n")


def nearest_rank(rows: DataFrame, by: str, value: str, percents: list[int]) -> DataFrame:
    """(by, percent, value): the value at place ceil(q n / 100), from 1."""
    hit = _placed(rows, by, value).withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    place = F.greatest(F.ceil(F.col("percent") * F.col("n") / 100.0), F.lit(1))
    return hit.where((F.col("upto") >= place) & (F.col("upto") - F.col("c") < place)).select(by, "percent", F.col("v").alias("value"))


def recall_and_mrr(ranked: DataFrame, gold: DataFrame, n: int) -> DataFrame:
    """(kind, queries, hit_at_1, recall, mrr) from ranked (query_id, item, rank) and gold (query_id, kind, item).

    A query counts with its best-placed gold item; queries without results count as misses.
    """
    found = gold.join(ranked.where(F.col("rank") <= n), ["query_id", "item"], "left")
    best = found.groupBy("query_id", "kind").agg(F.min("rank").alias("rank"))
    return best.groupBy("kind").agg(
        F.count("*").alias("queries"),
        F.round(F.avg((F.coalesce("rank", F.lit(0)) == 1).cast("int")), 6).alias("hit_at_1"),
        F.round(F.avg(F.col("rank").isNotNull().cast("int")), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): the value at place n // 2 + 1, without interpolation."""
    place = F.floor(F.col("n") / 2) + 1
    return _placed(rows, by, value).where((F.col("upto") >= place) & (F.col("upto") - F.col("c") < place)).select(by, F.col("v").alias("median"))
