"""Per-turn recall: topic coverage, delivery budgets, folds of event logs and boundary cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkivist.operators.gates import contains_term
from sparkivist.plans.session import cut_lineage


def topic_coverage(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text: str = "text", least: float = 1.0) -> DataFrame:
    """(id, hits, coverage) of documents that hold at least ``least`` of the terms, and one of them at least; no terms, no rows."""
    if not terms:
        return docs.select(id_col, F.lit(0).alias("hits"), F.lit(0.0).alias("coverage")).limit(0)
    hits = sum((contains_term(text, t).cast("int") for t in terms), F.lit(0))
    found = docs.select(id_col, F.inline(F.array(F.struct(hits.alias("hits")))))
    return found.withColumn("coverage", F.round(F.col("hits") / len(terms), 6)).where((F.col("hits") > 0) & (F.col("coverage") >= least))


def within_budget(rows: DataFrame, by: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows of each group, in order, while their running size stays within the budget; a group that begins over it has none."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def not_yet_delivered(rows: DataFrame, delivered: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(delivered.select(*keys).distinct(), keys, "left_anti")


def first_exchange(messages: DataFrame) -> DataFrame:
    """(conv_key, first_user, first_reply): keys of the first message of either side by (at, key); rows: conv_key, key, at, role."""
    order = F.struct("at", "key")
    return messages.where("at IS NOT NULL AND conv_key IS NOT NULL").groupBy("conv_key").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("key")), F.when(F.col("role") == "user", order)).alias("first_user"),
        F.min_by(F.when(F.col("role") == "assistant", F.col("key")), F.when(F.col("role") == "assistant", order)).alias("first_reply"),
    )


def boundary_cut(messages: DataFrame, keep: int) -> DataFrame:
    """(conv_key, cut_at): where a conversation is cut so that about ``keep`` characters follow.

    The tail grows from the end until it holds ``keep`` characters; the cut is the next turn of
    the user from there on. Conversations shorter than that, or without such a turn, have no row.
    """
    m = messages.where("at IS NOT NULL AND conv_key IS NOT NULL").select("conv_key", "row_id", "at", "role", F.col("chars").cast("long").alias("chars"))
    back = W.partitionBy("conv_key").orderBy(F.desc("at"), F.desc("row_id")).rowsBetween(W.unboundedPreceding, 0)
    tail = m.withColumn("tail", F.sum("chars").over(back))
    start = tail.where(F.col("tail") >= keep).groupBy("conv_key").agg(F.max(F.struct("at", "row_id")).alias("start"))
    users = m.where("role = 'user'").select("conv_key", F.struct("at", "row_id").alias("p"))
    return users.join(start, "conv_key").where(F.col("p") >= F.col("start")).groupBy("conv_key").agg(F.min("p").alias("p")).select("conv_key", F.col("p.row_id").alias("cut_at"))


def drift(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, before, after, change) of counts by key in two runs: collapsed, grown, new, gone or same; collapsed means under half."""
    b = before.groupBy(key).agg(F.count("*").alias("before"))
    a = after.groupBy(key).agg(F.count("*").alias("after"))
    j = b.join(a, key, "full").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    change = F.when(F.col("before") == 0, "new").when(F.col("after") == 0, "gone").when(F.col("after") * 2 < F.col("before"), "collapsed").when(F.col("after") > F.col("before"), "grown").otherwise("same")
    return j.withColumn("change", change)


def conflict_components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of edges (a, b), the least node being the root.

    Labels spread along the edges and then jump to their label's label, which shortens long
    chains; hubs are handled by the aggregation of minima. Null and self edges make no component.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    both = cut_lineage(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = label.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = cut_lineage(step.join(jump, "next").select("node", F.col("root").alias("old"), F.least("next", "far").alias("root")))
        label = new.select("node", "root")
        if not new.where("old <> root").limit(1).count():
            break
    return label


def frequent_strings(docs: DataFrame, n: int, least: int = 3, text: str = "text") -> DataFrame:
    """(gram, docs): Han strings of n characters in at least ``least`` documents, candidates for new words."""
    grams = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"(?=(\p{{IsHan}}{{{n}}}))"), F.lit(1))
    g = docs.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("docs"))
    return g.where(F.col("docs") >= least)
