"""Nearest neighbours by cosine: a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of query vectors that one pass over the rows may carry; more take further passes.
PASS_BYTES = 64 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision from the list's flat values; null and zero vectors become zero rows.

    Vectors of different widths in one column are an error.
    """
    size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    widths = np.unique(size[size > 0])
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {widths.tolist()}")
    m = np.zeros((len(column), int(widths[0]) if len(widths) else 1))
    if len(widths):
        m[size > 0] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, widths[0])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query_id, id, cosine, rank): the k rows most similar to each query, ties to the smaller id.

    Each task keeps the best k per query of its rows, so k times the number of tasks rows per
    query are shuffled. Query vectors travel with the task: as many as fit in ``PASS_BYTES`` at a
    time, the rest in further passes over the rows, found by the range of their ids.
    """
    spark = rows.sparkSession
    q = queries.select(F.col(id_col).cast("long").alias("q"), vec).where(F.col(vec).isNotNull())
    n, width = q.agg(F.count("*"), F.max(F.size(vec))).first()
    per_pass = max(1, PASS_BYTES // (8 * (width or 1)))
    cuts = [None] if n <= per_pass else q.approxQuantile("q", [i / -(-n // per_pass) for i in range(1, -(-n // per_pass))], 0.001)
    bounds = [(None, None)] if cuts == [None] else list(zip([None, *cuts], [*cuts, None]))
    passes = []
    for lo, hi in bounds:
        part = q if lo is None else q.where(F.col("q") > lo)
        part = part if hi is None else part.where(F.col("q") <= hi)
        block = part.orderBy("q").toArrow()  # bounded by PASS_BYTES
        ids = np.array(block.column("q").to_pylist(), dtype=np.int64)
        mat = _matrix(block.column(vec).combine_chunks()) if len(ids) else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast((ids, mat))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, qm = shared.value
            best_s = np.full((len(qid), k), -np.inf)
            best_i = np.full((len(qid), k), np.iinfo(np.int64).max)
            for b in batches:
                if not b.num_rows or not len(qid):
                    continue
                rid, m = b.column(0).to_numpy(), _matrix(b.column(1))
                s = np.round(qm @ m.T, 6)
                if exclude_self:
                    s[qid[:, None] == rid[None, :]] = -np.inf
                s = np.concatenate([best_s, s], axis=1)
                i = np.concatenate([best_i, np.broadcast_to(rid, (len(qid), len(rid)))], axis=1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            keep = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, keep.sum(axis=1))), pa.array(best_i[keep]), pa.array(best_s[keep])], names=["query_id", id_col, "cosine"])

        passes.append(rows.select(F.col(id_col).cast("long").alias(id_col), vec).where(F.col(vec).isNotNull()).mapInArrow(run, f"query_id long, {id_col} long, cosine double"))
    found = passes[0]
    for p in passes[1:]:
        found = found.unionByName(p)
    w = W.partitionBy("query_id").orderBy(F.desc("cosine"), id_col)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
