"""Harmonic packing of documents into fixed-capacity windows.

Lengths are whole numbers up to the capacity, so a histogram of them has at most ``capacity`` rows
however large the corpus is. From it alone the driver draws up a plan: items of length L belong to
the reciprocal class k with C/(k+1) < L <= C/k, and a window opened for L holds k of them. The rest
of such windows is another, smaller harmonic problem: shorter lengths fill it, again with a fixed
count per window. Every (length, range of ranks) thus gets a count per window and a range of window
numbers, and each document finds its window from its rank among those of its length by arithmetic,
independently of all others.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkivist.llm.tokenizer import count_tokens
from sparkivist.plans.session import cut_lineage, parallelism, table

CAPACITY = 2048


def draw_plan(histogram: dict[int, int], capacity: int = CAPACITY, fill: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, items, items per window, first window), ranks and windows from 0.

    fill=False is plain harmonic packing, one class to a window. The plan's size depends on the
    number of distinct lengths only: each step splits at most one range of windows.
    """
    free: dict[int, list[list[int]]] = {}  # space left -> ranges [first window, windows]
    spaces: list[int] = []  # its keys, ascending
    plan, opened = [], 0

    def give(space: int, first: int, n: int) -> None:
        if n > 0 and space > 0:
            if space not in free:
                free[space] = []
                bisect.insort(spaces, space)
            free[space].append([first, n])

    for length in sorted((x for x, n in histogram.items() if x > 0 and n > 0), reverse=True):
        left, rank = histogram[length], 0
        while left and fill:
            at = bisect.bisect_left(spaces, length)  # the tightest space that takes the length
            if at == len(spaces):
                break
            space = spaces[at]
            first, n = free[space].pop()
            if not free[space]:
                del free[space], spaces[at]
            per = min(space // length, left)
            use = min(n, left // per)
            plan.append((length, rank, use * per, per, first))
            give(space - per * length, first, use)
            give(space, first + use, n - use)
            rank, left = rank + use * per, left - use * per
        while left:
            per = min(capacity // length, left)
            use = left // per
            plan.append((length, rank, use * per, per, opened))
            give(capacity - per * length, opened, use)
            opened, rank, left = opened + use, rank + use * per, left - use * per
    return plan


def _ranked(items: DataFrame, parts: int) -> DataFrame:
    """Adds ``rank``, from 0 among the items of equal length, without bringing them together.

    Items are ranked inside (length, part of the id's hash); the sizes of these groups, at most
    capacity times parts, give where each begins.
    """
    split = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)).cast("int"))
    sizes = split.groupBy(F.col("n_tokens").alias("b_tokens"), F.col("part").alias("b_part")).agg(F.count("*").alias("n"))
    begins = sizes.withColumn("begin", F.sum("n").over(W.partitionBy("b_tokens").orderBy("b_part")) - F.col("n"))
    local = split.withColumn("no", F.row_number().over(W.partitionBy("n_tokens", "part").orderBy("doc_id", "piece_no")) - 1)
    joined = local.join(begins, (F.col("n_tokens") == F.col("b_tokens")) & (F.col("part") == F.col("b_part")))
    return joined.select("doc_id", "piece_no", "n_tokens", (F.col("begin") + F.col("no")).alias("rank"))


def pack(sizes: DataFrame, capacity: int = CAPACITY, fill: bool = True) -> DataFrame:
    """(doc_id, piece_no, n_tokens, window_no), windows from 0, none over ``capacity``.

    sizes: doc_id (unique; repeated rows are items of their own), n_tokens. A document over the
    capacity is cut into pieces of the capacity and a rest, numbered from 0. Empty documents and
    null sizes take no space and lie in window 0. An empty table gives no rows; other columns are
    ignored.
    """
    spark = sizes.sparkSession
    n = F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0))
    items = (
        sizes.select("doc_id", n.alias("size"))
        .select("doc_id", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)).cast("int"))).alias("piece_no"))
        .select("doc_id", "piece_no", F.least(F.col("size") - F.col("piece_no").cast("long") * capacity, F.lit(capacity)).cast("int").alias("n_tokens"))
    )
    # At most ``capacity`` rows reach the driver.
    histogram = {r[0]: r[1] for r in items.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    plan = draw_plan(histogram, capacity, fill)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("length", "first_rank", "n_items", "per_window", "first_window")])
    ranges = spark.createDataFrame(plan, schema)
    ranked = _ranked(items.where("n_tokens > 0"), 4 * parallelism(spark))
    # The plan's size is bounded by the capacity, so it is broadcast.
    placed = ranked.join(F.broadcast(ranges), (F.col("n_tokens") == F.col("length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n_items")))
    window = F.col("first_window") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("per_window"))
    packed = placed.select("doc_id", "piece_no", "n_tokens", window.cast("long").alias("window_no"))
    return packed.unionByName(items.where("n_tokens <= 0").select("doc_id", "piece_no", "n_tokens", F.lit(0).cast("long").alias("window_no")))


def windows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_windows: the training window of each document, or of each piece of a longer one."""
    sizes = cut_lineage(count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))  # read by the histogram and the placing
    return pack(sizes)


def fill_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_fill: windows used, the fewest that the total would allow, and the share of space used."""
    packed = windows_query(spark, sf_dir)
    by = packed.groupBy("window_no").agg(F.sum("n_tokens").alias("used"))
    return by.agg(
        F.count("*").alias("windows"), F.ceil(F.sum("used") / CAPACITY).cast("long").alias("least_windows"), F.max("used").cast("long").alias("fullest"), F.round(F.sum("used") / (F.count("*") * CAPACITY), 6).alias("share_used")
    )
