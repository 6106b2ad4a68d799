"""Content-defined splitting of oversized texts at natural boundaries.

A rolling hash over the characters marks landmarks that depend on nothing but the characters
around them. Between a piece's minimum and maximum size the first landmark decides, and snaps to
the nearest natural boundary: a paragraph end if one is close, else a sentence end, else a word
end; only a stretch without any is cut in between. An edit therefore moves the boundaries next
to it, and the sequence falls back into step at the next landmark that both versions share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkivist.plans.session import table

LIMIT, OVERLAP, LEAST = 800, 80, 240
_WINDOW, _MASK = 24, 127  # characters that a landmark depends on; one landmark in 128 characters
_NEAR = 160  # a paragraph end so near to the landmark wins over a nearer sentence end

_BREAK = re.compile(r"[\r\n]+(?:[^\S\r\n]*[\r\n]+)*")
_STOP = re.compile(r"(?:[。！？!?…；;]|\.(?=[\s\"'”’」』）)\]]|$))+[\"'”’」』）)\]】]*")
_WORD = re.compile(r"\S(?=\s)|[，、：,](?=\S)")


def _ends(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions right after paragraphs, and right after sentences or lines."""
    paragraphs, sentences = [], [m.end() for m in _STOP.finditer(text)]
    for m in _BREAK.finditer(text):
        at = m.start()
        while at and text[at - 1].isspace():
            at -= 1
        sentences.append(at)
        if m.group().replace("\r\n", "\n").replace("\r", "\n").count("\n") > 1:
            paragraphs.append(at)
    return np.array(paragraphs, dtype=np.int64), np.unique(np.array(sentences, dtype=np.int64))


def _landmarks(text: str) -> np.ndarray:
    """Positions after whose preceding characters the rolling hash is 0 under the mask."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < _WINDOW:
        return np.empty(0, dtype=np.int64)
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    # Polynomial hash of each window by doubling: h(2m) = h(m) * B^m + h(m), here for 8 + 16.
    base = 0x100000001B3
    h, m, parts = mixed, 1, {}
    while m <= 16:
        parts[m] = h
        h = h[: len(h) - m] * np.uint64(pow(base, m, 1 << 64)) + h[m:]
        m *= 2
    n = len(codes) - _WINDOW + 1
    w = parts[8][:n] * np.uint64(pow(base, 16, 1 << 64)) + parts[16][8 : 8 + n]
    w ^= w >> np.uint64(33)
    w *= np.uint64(0xFF51AFD7ED558CCD)
    return np.flatnonzero(((w >> np.uint64(40)) & np.uint64(_MASK)) == 0) + _WINDOW


def _nearest(at: np.ndarray, lo: int, hi: int, mark: int) -> int | None:
    i, j = np.searchsorted(at, lo), np.searchsorted(at, hi, side="right")
    if i >= j:
        return None
    inside = at[i:j]
    return int(inside[np.argmin(np.abs(inside - mark))])


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the pieces in reading order; each but the first begins ``overlap`` before the last one's end.

    Requires overlap < least < limit - overlap. A text within the limit is one piece.
    """
    if not overlap <= least < limit - overlap:
        raise ValueError("the least size must lie between the overlap and the limit less the overlap")
    if len(text) <= limit:
        return [(0, len(text))]
    marks = _landmarks(text)
    paragraphs, sentences = _ends(text)
    out, at, most = [], 0, limit - overlap

    def words(lo: int, hi: int) -> np.ndarray:
        return np.array([m.end() for m in _WORD.finditer(text, max(lo - 1, 0), hi + 1) if lo <= m.end() <= hi], dtype=np.int64)

    while True:
        first = max(0, at - overlap) if at else 0
        if len(text) - at <= most:
            out.append((first, len(text)))
            return out
        lo, hi = at + least, at + most
        k = np.searchsorted(marks, lo)
        mark = int(marks[k]) if k < len(marks) and marks[k] <= hi else hi
        end = _nearest(paragraphs, max(lo, mark - _NEAR), min(hi, mark + _NEAR), mark)
        if end is None:
            end = _nearest(sentences, lo, hi, mark)
        if end is None:
            end = _nearest(words(lo, hi), lo, hi, mark)
        if end is None:  # none of the usual size: the last one before it
            early = sentences[np.searchsorted(sentences, at + overlap) : np.searchsorted(sentences, lo)]
            early = early if len(early) else words(at + overlap, lo - 1)
            end = int(early[-1]) if len(early) else None
        if end is None:
            end = mark
            while end > lo and (text[end - 1 : end + 1] == "\r\n" or 0x300 <= ord(text[end]) < 0x370 or text[end] in "‍️" or text[end - 1] == "‍"):
                end -= 1  # not inside a line end or a composed character
        out.append((first, end))
        at = end


def split_oversized(entries: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST, with_text: bool = True) -> DataFrame:
    """(entry_id, piece_no, start, end[, piece]) of entries whose stripped text has more than ``limit`` characters.

    Pieces count from 1 in reading order, are at most ``limit`` long and cover the whole text as
    it stands; all but the first repeat the last ``overlap`` characters of the one before. Null,
    empty and short texts give no rows, nor does an empty table. Rows that repeat an entry_id and
    text come out once. Other columns are not read. The work is one Arrow map on the rows that the
    scan's length filter keeps. Without texts repeats go afterwards, from small columns; with texts
    before, by entry_id and a 64-bit hash, so that texts are shuffled once and no piece is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids, nos, starts, ends, pieces = [], [], [], [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if len(t.strip()) <= limit:
                        continue
                    for no, (s, e) in enumerate(split_text(t, limit, overlap, least), 1):
                        ids.append(i), nos.append(no), starts.append(s), ends.append(e)
                        if with_text:
                            pieces.append(t[s:e])
                cols = [pa.array(ids, part.schema[0].type), pa.array(nos, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(pieces, pa.string())] * with_text, names=["entry_id", "piece_no", "start", "end"] + ["piece"] * with_text)

    long = entries.select("entry_id", "text").where(F.length("text") > limit)
    kind = long.schema["entry_id"].dataType.simpleString()
    schema = f"entry_id {kind}, piece_no int, start int, end int" + ", piece string" * with_text
    if not with_text:
        return long.mapInArrow(run, schema).distinct()
    once = long.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["entry_id", "_hash"]).drop("_hash")
    return once.mapInArrow(run, schema)


def rebuilt_texts(pieces: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """(entry_id, pieces, longest, hash): number and greatest length of an entry's pieces, and the md5 of the text they give back.

    pieces: entry_id (of one text), piece_no, piece. An entry's pieces are as many as its text needs.
    """
    fresh = F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.substring("piece", overlap + 1, 1 << 30))
    g = pieces.groupBy("entry_id").agg(F.count("*").alias("pieces"), F.max(F.length("piece")).alias("longest"), F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("x")))).alias("all"))
    return g.select("entry_id", "pieces", "longest", F.md5(F.array_join(F.transform("all", lambda p: p["x"]), "")).alias("hash"))


def found_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: the entries that the splitter cut."""
    pieces = split_oversized(table(spark, sf_dir, "memory_entries"), with_text=False)
    return pieces.where("piece_no = 1").select("entry_id").distinct()


def pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_pieces: the pieces themselves."""
    return split_oversized(table(spark, sf_dir, "memory_entries"))


def rebuilt_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_rebuilt: what the pieces of each entry give back, as a digest, and that none is too long."""
    back = rebuilt_texts(pieces_query(spark, sf_dir))
    return back.select("entry_id", "hash", (F.col("longest") <= LIMIT).alias("within_limit"), (F.col("pieces") > 1).alias("cut"))
