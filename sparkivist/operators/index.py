"""Lexical index: per document its distinct bigrams with counts, and its length.

Bigrams and counts are stored as packed little-endian integers (64 and 32 bits), which pass between
the JVM and numpy without a conversion value by value.

``build`` turns texts into index rows by one scan and one Arrow map, without a shuffle; ``write``
stores them as a table. Queries, graph and statistics read the index and never the texts again.
``hits`` counts a query's bigrams per document, from the index or, for a single query, straight
from the texts by ``scan``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkivist.functions import bigrams as B

_INDEX = [("dl", T.LongType()), ("grams", T.BinaryType()), ("counts", T.BinaryType()), ("cased", T.BinaryType()), ("cased_counts", T.BinaryType())]
_HITS = [("dl", T.LongType()), ("norm2", T.LongType()), ("tf", T.ArrayType(T.IntegerType(), False)), ("ctf", T.ArrayType(T.IntegerType(), False))]


def _schema(df: DataFrame, keep: list[str], new: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in new])


def _names(schema: T.StructType) -> list[str]:
    return schema.names


def _pack(offsets: np.ndarray, values: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Binary values of the documents' packed integers; null where not valid."""
    ends = pa.py_buffer((offsets.astype(np.int64) * values.itemsize).astype(np.int32).tobytes())
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [bits, ends, pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _unpack(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(document's place, value) of packed integers; nulls are empty."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.diff(ends) // np.dtype(kind).itemsize
    if column.null_count:
        size = np.where(column.is_valid().to_numpy(zero_copy_only=False), size, 0)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) else np.empty(0, dtype=np.uint8)
    return np.repeat(np.arange(len(column), dtype=np.int64), size), np.frombuffer(raw.tobytes(), dtype=kind)


def build(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, dl, grams, counts, cased, cased_counts), a row for each row of ``docs``.

    dl is the number of bigrams; grams are ascending. cased holds the bigrams before lower-casing
    and is null where they are the same. Null and empty texts have no bigrams.
    """
    kept = [id_col, *keep]
    schema = _schema(docs, kept, _INDEX)
    names = _names(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in B.slices(b.column(len(kept)).to_pylist()):
                n = len(texts)
                place, gram = B.stream(texts)
                offsets, grams, counts = B.counted(place, gram, n)
                dl = np.bincount(place, minlength=n)
                mixed = np.array([t != t.lower() for t in texts], dtype=bool)
                c_offsets, c_grams, c_counts = B.counted(*B.stream([t if m else "" for t, m in zip(texts, mixed)], lower=False), n)
                cols = [b.column(i).slice(at, n) for i in range(len(kept))]
                cols += [pa.array(dl, pa.int64()), _pack(offsets, grams), _pack(offsets, counts), _pack(c_offsets, c_grams, mixed), _pack(c_offsets, c_counts, mixed)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(*kept, text).mapInArrow(run, schema)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> None:
    """Stores the index of ``docs`` under ``path``."""
    build(docs, id_col, text, keep).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace(indexed: DataFrame, changed: DataFrame, removed: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The index after some documents were changed, added or removed; the others' rows are not computed again.

    changed: id, *keep, text; removed: id. Statistics follow from the rows, so nothing else has to be kept in step.
    """
    gone = changed.select(id_col) if removed is None else changed.select(id_col).unionByName(removed.select(id_col))
    return indexed.join(gone.distinct(), id_col, "left_anti").select(*indexed.columns).unionByName(build(changed, id_col, text, keep))


def _wanted(query: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted bigrams of the query, lower-cased and as they stand, and their places in its own order."""
    out: list[np.ndarray] = []
    for lower in (True, False):
        keys = np.array(list(B.query_bigrams(query, lower)), dtype=np.int64)
        order = np.argsort(keys)
        out += [keys[order], order]
    return out[0], out[1], out[2], out[3]


def _table(place: np.ndarray, which: np.ndarray, weights: np.ndarray | None, n: int, width: int) -> pa.Array:
    """Lists of ``width`` counts for each document, null for a document without any."""
    m = np.bincount(place * width + which, weights=weights, minlength=n * width).astype(np.int32).reshape(n, width) if width else np.zeros((n, 0), dtype=np.int32)
    some = m.any(axis=1)
    ends = np.concatenate(([0], np.cumsum(np.where(some, width, 0)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends[:-1].tolist() + [int(ends[-1])], pa.int32(), mask=np.append(~some, False)), pa.array(m[some].reshape(-1)))


def scan(docs: DataFrame, query: str, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), cosine: bool = True, grams: bool = False) -> DataFrame:
    """(id, *keep, dl, norm2, tf, ctf) of all rows, from their texts; with ``grams`` also their bigrams as ``build`` gives them.

    tf and ctf count the query's bigrams, lower-cased and as they stand, in the query's order;
    null where there is none. norm2 is the sum of the squared counts as they stand, null unless
    ``cosine`` asks for it and the document has one of the query's.
    """
    kept = [id_col, *keep]
    schema = _schema(docs, kept, _HITS + [c for c in _INDEX if grams and c[0] == "grams"])
    names = _names(schema)
    low, low_at, own, own_at = _wanted(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in B.slices(b.column(len(kept)).to_pylist()):
                n = len(texts)
                place, gram = B.stream(texts)
                where, which = B.find(gram, low)
                tf = _table(place[where], low_at[which], None, n, len(low))
                ctf, norm = pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.int64())
                if cosine:
                    c_place, c_gram = B.stream(texts, lower=False)
                    c_where, c_which = B.find(c_gram, own)
                    ctf = _table(c_place[c_where], own_at[c_which], None, n, len(own))
                    near = np.zeros(n, dtype=bool)
                    near[c_place[c_where]] = True
                    offsets, _, counts = B.counted(c_place[near[c_place]], c_gram[near[c_place]], n)
                    run_ = np.concatenate(([0], np.cumsum(counts.astype(np.int64) ** 2)))
                    norm = pa.array(run_[offsets[1:]] - run_[offsets[:-1]], mask=~near)
                cols = [b.column(i).slice(at, n) for i in range(len(kept))]
                cols += [pa.array(np.bincount(place, minlength=n), pa.int64()), norm, tf, ctf]
                yield pa.RecordBatch.from_arrays(cols + ([_pack(*B.counted(place, gram, n)[:2])] if grams else []), names=names)

    return docs.select(*kept, text).mapInArrow(run, schema)


def hits(indexed: DataFrame, query: str, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The result of ``scan``, from the index."""
    kept = [id_col, *keep]
    schema = _schema(indexed, kept, _HITS)
    names = _names(schema)
    low, low_at, own, own_at = _wanted(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, n = len(kept), b.num_rows
            (place, gram), (_, count) = _unpack(b.column(k + 1), np.int64), _unpack(b.column(k + 2), np.int32)
            (c_place, c_gram), (_, c_count) = _unpack(b.column(k + 3), np.int64), _unpack(b.column(k + 4), np.int32)
            where, which = B.find(gram, low)
            tf = _table(place[where], low_at[which], count[where], n, len(low))
            # A document without capitals has its bigrams in the first lists only.
            plain = b.column(k + 3).is_null().to_numpy(zero_copy_only=False)
            mine = plain[place]
            c_place, c_gram, c_count = np.concatenate((c_place, place[mine])), np.concatenate((c_gram, gram[mine])), np.concatenate((c_count, count[mine]))
            where, which = B.find(c_gram, own)
            ctf = _table(c_place[where], own_at[which], c_count[where], n, len(own))
            near = np.zeros(n, dtype=bool)
            near[c_place[where]] = True
            norm = pa.array(np.bincount(c_place, weights=c_count.astype(np.float64) ** 2, minlength=n).astype(np.int64), mask=~near)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(k)] + [b.column(k), norm, tf, ctf], names=names)

    return indexed.select(*kept, *[n for n, _ in _INDEX]).mapInArrow(run, schema)


def document_frequencies(indexed: DataFrame, least: int = 1) -> DataFrame:
    """(gram, df) of bigrams in at least ``least`` documents; batches are counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, n = np.unique(_unpack(b.column(0), np.int64)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])

    return indexed.select("grams").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("df")).where(F.col("df") >= least)


def postings(indexed: DataFrame, id_col: str = "doc_id", without: np.ndarray | None = None) -> DataFrame:
    """(id, gram): the documents' bigrams but for those in ``without`` (ascending)."""
    kind = indexed.schema[id_col].dataType.simpleString()
    without = np.empty(0, dtype=np.int64) if without is None else without

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, gram = _unpack(b.column(1), np.int64)
            keep = np.ones(len(gram), dtype=bool)
            keep[B.find(gram, without)[0]] = False
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place[keep])), pa.array(gram[keep])], names=[id_col, "gram"])

    return indexed.select(id_col, "grams").mapInArrow(run, f"{id_col} {kind}, gram long")


def unpacked(values: bytes | None) -> np.ndarray:
    """The bigrams of one document's ``grams``."""
    return np.frombuffer(values or b"", dtype=np.int64)


def frequencies_among(indexed: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(gram, df) of the given bigrams (ascending): every partition sends its sums, not its postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), dtype=np.int64)
        for b in batches:
            _, which = B.find(_unpack(b.column(0), np.int64)[1], wanted)
            total += np.bincount(which, minlength=len(wanted))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some], pa.int64()), pa.array(total[some])], names=["gram", "n"])

    return indexed.select("grams").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("df"))


def shared_strength(indexed: DataFrame, wanted: np.ndarray, weights: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """(id, column_no, strength): for each document and each column of ``weights`` the sum over the bigrams that it has.

    wanted: bigrams, ascending; weights: (bigrams, columns). Rows without a shared bigram are left out.
    """
    kind = indexed.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, gram = _unpack(b.column(1), np.int64)
            where, which = B.find(gram, wanted)
            for c in range(weights.shape[1]):
                s = np.bincount(place[where], weights=weights[which, c], minlength=b.num_rows)
                keep = np.flatnonzero(s > 0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(np.full(len(keep), c, dtype=np.int32)), pa.array(s[keep])], names=[id_col, "column_no", "strength"])

    return indexed.select(id_col, "grams").mapInArrow(run, f"{id_col} {kind}, column_no int, strength double")
