"""Conversations rebuilt from message rows, through parent pointers and pointer jumping.

Rows are first merged into messages and judged; only small columns are shuffled. The log has no
parent column: a turn's parent is the turn before it in time. A range partitioning by
(conversation, time, key) cuts even a conversation that holds a third of all rows into blocks, and
each block into runs of at most ``RUN`` turns of one conversation, inside which parents are followed
by a running count. Every run is a node that points to the run before it; a run that begins with
a reply to nothing, or holds a turn that cannot be placed, points to a request that is not there.
``jump_pointers`` resolves all of them: every round joins each open pointer with its target's
pointer, so the distance covered doubles, and orphans and cycles show. The outcome decides which
conversations are whole and gives each run's place; their turns come out from root to leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkivist.plans.session import cut_lineage, parallelism, table

#: Turns of a run, the unit whose parent pointers are resolved by joins.
RUN = 64
ASSISTANT, OTHER, USER = 0, 1, 2  # codes of the roles; of copies that differ the least counts
# Role names by speaker, and the tags that a host puts into messages.
USER_ROLES = ("user", "human")
ASSISTANT_ROLES = ("assistant", "ai", "model", "bot")
_SPACE = r"[\s\p{Z}\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{1c}-\x{1f}\x{85}]"
_INSERTED = r"(?s)<(system-reminder|passive_recall_context)(?:\s[^>]*)?>.*?</\1\s*>"
_HOST = rf"^{_SPACE}*<(?:task-notification|(?:command|local-command|bash)-[\w-]+)"


def judge_messages(rows: DataFrame) -> DataFrame:
    """(conv_key, key, role, ms, bad): the messages that are speech or would be; role is a code.

    rows: conv_key, key, epoch, role, text. bad marks a message that
    would be speech but has no usable role or time. Epochs above 1e11 are milliseconds. Rows with
    equal conv_key and key are one message; where its copies differ, the usable value counts, the
    least of them. Rows with a null conv_key or key belong to no conversation.
    """
    name = F.lower(F.regexp_replace(F.coalesce("role", F.lit("")), rf"^{_SPACE}+|{_SPACE}+$", ""))
    role = F.when(name.isin(*USER_ROLES), USER).when(name.isin(*ASSISTANT_ROLES), ASSISTANT).when(name != "", OTHER)
    epoch = F.col("epoch")
    usable = epoch.isNotNull() & ~F.isnan(epoch) & (epoch > 0) & (epoch < 1e18)
    ms = F.when(usable, F.round(F.when(epoch > 1e11, epoch).otherwise(epoch * 1000)).cast("long"))
    said = F.regexp_replace(F.coalesce("text", F.lit("")), _INSERTED, "")
    judged = rows.where("conv_key IS NOT NULL AND key IS NOT NULL").select(
        "conv_key", "key", role.alias("role"), ms.alias("ms"), said.rlike(r"[\p{L}\p{N}]").alias("words"), said.rlike(_HOST).alias("host")
    )
    merged = judged.groupBy("conv_key", "key").agg(
        F.min("role").alias("role"), F.min("ms").alias("ms"), F.max("words").alias("words"), F.max("host").alias("host")
    )
    speech = F.col("words") & ((F.col("role") == ASSISTANT) | (F.coalesce("role", F.lit(USER)) == USER) & ~F.col("host"))
    return merged.where(speech).select("conv_key", "key", "role", "ms", (F.col("role").isNull() | F.col("ms").isNull()).alias("bad"))


def jump_pointers(nodes: DataFrame) -> DataFrame:
    """(id, root, distance, status) of nodes (id, parent, weight) by pointer jumping.

    distance is the summed weight of the ancestors; status is ok, orphan (the chain ends at a
    parent that is no node) or cycle. A node with a null parent is its own root. After r rounds a
    pointer spans 2^r nodes, so chains of n nodes take log2(n) rounds; those still open when as
    many rounds as the number of nodes needs are over lie on or behind a cycle. Ids must be
    unique and not null. Only open pointers are joined.
    """
    known = nodes.select(F.col("id").alias("_pid"))
    state = cut_lineage(
        nodes.join(known, nodes["parent"] == F.col("_pid"), "left").select(
            "id",
            F.when(F.col("_pid").isNotNull(), F.col("parent")).alias("ptr"),
            F.col("id").alias("root"),
            F.col("weight").cast("long").alias("weight"),
            (F.col("parent").isNotNull() & F.col("_pid").isNull()).alias("orphan"),
        )
    )
    # reach: summed weight from the node itself up to, but without, the node at ptr.
    state = state.withColumn("reach", F.col("weight"))
    total, rounds = state.count(), 0
    open_, closed = state.where("ptr IS NOT NULL"), [state.where("ptr IS NULL")]
    left = open_.count()
    while left and 2**rounds <= 2 * total:
        target = reduce(DataFrame.unionByName, [open_, *closed])
        target = target.select(F.col("id").alias("_id"), F.col("ptr").alias("_ptr"), F.col("root").alias("_root"), F.col("reach").alias("_reach"), F.col("orphan").alias("_orphan"))
        moved = cut_lineage(open_.join(target, open_["ptr"] == target["_id"]).select("id", F.col("_ptr").alias("ptr"), F.col("_root").alias("root"), "weight", F.col("_orphan").alias("orphan"), (F.col("reach") + F.col("_reach")).alias("reach")))
        open_ = moved.where("ptr IS NOT NULL")
        closed.append(moved.where("ptr IS NULL"))
        left, rounds = open_.count(), rounds + 1
    state = reduce(DataFrame.unionByName, [*closed, open_])
    status = F.when(F.col("ptr").isNotNull(), "cycle").when(F.col("orphan"), "orphan").otherwise("ok")
    return state.select("id", F.when(F.col("ptr").isNull(), F.col("root")).alias("root"), (F.col("reach") - F.col("weight")).alias("distance"), status.alias("status"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted turns their run and their place in it, from 0; keeps one row's state."""
    conv, n = None, 0
    for b in batches:
        out = []
        for c in b.column(0).to_pylist():
            if c != conv:
                conv, n = c, 0
            out.append(n)
            n += 1
        at = np.array(out, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array((at // RUN).astype(np.int32)), pa.array((at % RUN).astype(np.int32))], names=[*b.schema.names, "run", "no"])


def place_turns(messages: DataFrame) -> DataFrame:
    """(conv_key, key, role, bad, block, run, no), cut off: the messages of ``judge_messages`` in blocks and runs."""
    cols = messages.select("conv_key", "ms", "key", "role", "bad")
    ranged = cols.repartitionByRange(parallelism(messages.sparkSession), "conv_key", "ms", "key").sortWithinPartitions("conv_key", "ms", "key")
    blocks = ranged.select("conv_key", "key", "role", "bad", F.spark_partition_id().alias("block"))
    return cut_lineage(blocks.mapInArrow(_number, "conv_key string, key string, role int, bad boolean, block int, run int, no int"))


def resolve_runs(turns: DataFrame) -> DataFrame:
    """(conv_key, block, run, distance, status, last), cut off: every run with the turns before it, how its chain ends, and its last role.

    A conversation lies in as many blocks as there are partitions at most, so the window that finds
    the block before sees a bounded number of rows.
    """
    code = F.col("no") * 4 + F.coalesce("role", F.lit(OTHER))
    runs = turns.groupBy("conv_key", "block", "run").agg(F.count("*").alias("weight"), F.max("bad").alias("bad"), F.min(code).alias("first"), F.max(code).alias("last"))
    runs = cut_lineage(runs)
    w = W.partitionBy("conv_key").orderBy("block")
    ends = runs.groupBy("conv_key", "block").agg(F.max("run").alias("to")).select("conv_key", "block", F.lag("block").over(w).alias("before"), F.lag("to").over(w).alias("before_run"))
    r = runs.join(ends, ["conv_key", "block"])

    def node(block: Column, run: Column) -> Column:
        return F.struct(F.col("conv_key").alias("conv_key"), block.cast("int").alias("block"), run.cast("int").alias("run"))

    nowhere = node(F.lit(-1), F.lit(0))
    parent = F.when(F.col("bad"), nowhere).when(F.col("run") > 0, node(F.col("block"), F.col("run") - 1)).when(F.col("before").isNotNull(), node(F.col("before"), F.col("before_run"))).when(F.col("first") % 4 != USER, nowhere)
    nodes = r.select(node(F.col("block"), F.col("run")).alias("id"), parent.alias("parent"), "weight", (F.col("last") % 4).alias("last"))
    nodes = cut_lineage(nodes)
    found = jump_pointers(nodes.select("id", "parent", "weight"))
    return cut_lineage(found.join(nodes.select("id", "last"), "id").select("id.*", "distance", "status", "last"))


def conversation_status(resolved: DataFrame) -> DataFrame:
    """(conv_key, status) of conversations with a turn: ok, orphan (a turn without a request or a place), cycle, or unanswered."""
    leaf = F.max(F.col("distance") * 4 + F.col("last")) % 4  # a run of at least one turn lies between two distances
    g = resolved.groupBy("conv_key").agg(F.max(F.col("status") == "cycle").alias("cycle"), F.max(F.col("status") == "orphan").alias("orphan"), leaf.alias("leaf"))
    return g.select("conv_key", F.when(F.col("cycle"), "cycle").when(F.col("orphan"), "orphan").when(F.col("leaf") != ASSISTANT, "unanswered").otherwise("ok").alias("status"))


def rebuild_conversations(rows: DataFrame) -> DataFrame:
    """(conv_key, turn_no, key, role): the turns of all usable conversations in order of time.

    rows: conv_key, key, epoch, role, text; other columns are ignored. See ``judge_messages`` for
    what is speech and how copies are merged, ``conversation_status`` for what is dropped. Turns
    at the same instant come in order of their keys. Empty tables give no rows.
    """
    turns = place_turns(judge_messages(rows))
    resolved = resolve_runs(turns)
    usable = conversation_status(resolved).where("status = 'ok'").select("conv_key")
    placed = resolved.join(usable, "conv_key", "left_semi").select("conv_key", "block", "run", "distance")
    joined = turns.join(placed, ["conv_key", "block", "run"])
    return joined.select("conv_key", (F.col("distance") + F.col("no") + 1).alias("turn_no"), "key", F.when(F.col("role") == USER, "user").otherwise("assistant").alias("role"))


def found_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: conv_key, turn_no, key."""
    return rebuild_conversations(table(spark, sf_dir, "archive_msgs")).select("conv_key", "turn_no", "key")


def transcript_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_turns: the turns with their speaker and text, inserted elements removed."""
    rows = table(spark, sf_dir, "archive_msgs")
    turns = rebuild_conversations(rows)
    # Only rows of turns are shuffled with their texts; of copies the greatest text that says something counts.
    said = rows.where("conv_key IS NOT NULL AND key IS NOT NULL").select("conv_key", "key", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _INSERTED, "")).alias("text"))
    spoken = said.where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    joined = spoken.join(turns, ["conv_key", "key"])
    return joined.groupBy("conv_key", "turn_no", "key", "role").agg(F.max("text").alias("text"))


def status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_status: (conv_key, status) of every conversation with a turn."""
    return conversation_status(resolve_runs(place_turns(judge_messages(table(spark, sf_dir, "archive_msgs")))))
