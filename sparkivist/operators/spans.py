"""Spans in texts: occurrences, quotes, anchors, coverage and common substrings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkivist.operators.gates import narrow


def occurrences_of(text: Column | str, needle: str) -> Column:
    """array<int> of all places, from 0, where ``needle`` occurs, overlapping ones too; empty for null texts.

    The text is split before every occurrence, so that the places are running lengths.
    """
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    parts = F.split(c, f"(?=\\Q{needle}\\E)")
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    return F.filter(ends, lambda at: F.substring(c, at + 1, F.lit(len(needle))) == needle)


def locate_quotes(docs: DataFrame, quotes: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, quote, hits, start, end) of quotes found in a text; start and end, in characters from 0, only where there is one hit.

    White space and full-width forms make no difference; hits are counted without it. Quotes of
    less than two characters are an error. Null and empty texts have no rows.
    """
    bare = {q: re.sub(r"\s", "", q) for q in quotes}
    if any(len(b) < 2 for b in bare.values()):
        raise ValueError("a quote needs two characters")
    picked = docs.where(F.col(text).isNotNull()).select(id_col, narrow(F.col(text)).alias("t"))
    kind = picked.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, qs, hits, starts, ends = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                places = [k for k, c in enumerate(t) if not c.isspace()]
                hay = "".join(t[k] for k in places)
                for q, needle in bare.items():
                    at = [m.start() for m in re.finditer(f"(?={re.escape(needle)})", hay)]
                    if at:
                        one = len(at) == 1
                        ids.append(i), qs.append(q), hits.append(len(at))
                        starts.append(places[at[0]] if one else None), ends.append(places[at[0] + len(needle) - 1] + 1 if one else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema[0].type), pa.array(qs, pa.string()), *(pa.array(x, pa.int64()) for x in (hits, starts, ends))], names=[id_col, "quote", "hits", "start", "end"])

    return picked.mapInArrow(run, f"{id_col} {kind}, quote string, hits long, start long, end long")


def anchors(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, anchor_no, start, end): segments that tile a text without gaps, from 1.

    A blank line ends a segment and belongs to it; a heading line is a segment of its own. Blank
    segments go to the one before, those at the beginning to the first. Blank texts have none.
    """
    lines = docs.where(F.col(text).isNotNull()).select(id_col, F.posexplode(F.split(text, "(?<=\n)")).alias("n", "line"))
    w = W.partitionBy(id_col).orderBy("n")
    blank, head = F.trim(F.regexp_replace("line", r"\s+", " ")) == "", F.regexp_replace("line", r"^\s+", "").startswith("#")
    marked = lines.select(id_col, "n", "line", blank.alias("blank"), head.alias("head"))
    # A line begins a segment if it has text and a blank or heading line stands before it, or is a heading.
    last = F.lag(F.col("blank") | F.col("head"), 1, True).over(w)
    begins = ~F.col("blank") & (F.col("head") | last)
    size = F.sum(F.length("line")).over(w.rowsBetween(W.unboundedPreceding, 0))
    cut = marked.withColumns({"to": size, "no": F.sum(begins.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)), "from": size - F.length("line")})
    seg = cut.groupBy(id_col, F.greatest("no", F.lit(1)).alias("anchor_no")).agg(F.min("from").alias("start"), F.max("to").alias("end"), F.max(~F.col("blank")).alias("some"))
    return seg.where("some").select(id_col, F.col("anchor_no").cast("long").alias("anchor_no"), "start", "end")


def covered_share(docs: DataFrame, needles: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, covered, share) of texts in which any of the needles occurs: characters in the union of all occurrences."""
    def span(n: str):
        return lambda at: F.struct(at.alias("s"), (at + len(n)).alias("e"))

    spans = F.concat(*[F.transform(occurrences_of(text, n), span(n)) for n in needles])
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("sum"))
    union = F.aggregate(F.array_sort(spans), start, lambda a, x: F.struct(F.greatest(a["upto"], x["e"]).alias("upto"), (a["sum"] + F.greatest(x["e"] - F.greatest(a["upto"], x["s"]), F.lit(0))).alias("sum")), lambda a: a["sum"])
    return docs.where(F.col(text).isNotNull()).select(id_col, union.cast("long").alias("covered"), F.length(text).alias("_n")).where("covered > 0").select(id_col, "covered", F.round(F.col("covered") / F.col("_n"), 6).alias("share"))


def common_substring(text: Column | str, query: str, cap: int = 40) -> Column:
    """Length of the longest substring of ``query`` that the text holds, ``cap`` at most; 0 for null texts."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    out = F.lit(0)
    for n in range(1, min(cap, len(query)) + 1):  # the longest comes first in the chain
        parts = list(dict.fromkeys(query[i : i + n] for i in range(len(query) - n + 1)))
        out = F.when(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(c, p)), n).otherwise(out)
    return out


def blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, block_no, start, end, fenced): paragraphs with their exact spans; a fenced block is one, blank lines in it included.

    An open fence reaches to the end of the text. Blank lines between blocks belong to none.
    """
    picked = docs.where(F.col(text).isNotNull()).select(id_col, text)
    kind = picked.schema[0].dataType.simpleString()
    pattern = re.compile(r"^```.*?(?:^```[^\n]*$|\Z)|^(?!```)[^\n]*\S[^\n]*(?:\n(?!```)[^\n]*\S[^\n]*)*", re.S | re.M)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[(m.start(), m.end(), m.group().startswith("```")) for m in pattern.finditer(t)] for t in b.column(1).to_pylist()]
            place = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = [x for f in found for x in f]
            no = [k for f in found for k in range(1, len(f) + 1)]
            cols = [b.column(0).take(pa.array(place, pa.int64())), pa.array(no, pa.int64()), pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "block_no", "start", "end", "fenced"])

    return picked.mapInArrow(run, f"{id_col} {kind}, block_no long, start long, end long, fenced boolean")


def excerpt(docs: DataFrame, term: str, budget: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, excerpt) of texts with the term: the sentence of its first occurrence and its neighbours within ``budget`` UTF-8 bytes.

    Sentences are added in turn after and before while the excerpt stays within the budget; a sentence over it stands alone.
    """
    picked = docs.where(F.contains(F.coalesce(text, F.lit("")), F.lit(term))).select(id_col, text)
    kind = picked.schema[0].dataType.simpleString()
    end = re.compile(r"[。！？!?\n]|\.(?=\s)")

    def cut(t: str) -> str:
        stops = [m.end() for m in end.finditer(t)]
        bounds = [0, *stops] + ([len(t)] if not stops or stops[-1] < len(t) else [])
        at = t.index(term)
        lo = max(k for k in range(len(bounds) - 1) if bounds[k] <= at)
        hi, grown = lo + 1, True
        while grown:
            grown = False
            for down, up in ((0, 1), (1, 0)):
                a, z = lo - down, hi + up
                if 0 <= a and z < len(bounds) and len(t[bounds[a] : bounds[z]].encode()) <= budget:
                    lo, hi, grown = a, z, True
        return t[bounds[lo] : bounds[hi]].strip()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([cut(t) for t in b.column(1).to_pylist()], pa.string())], names=[id_col, "excerpt"])

    return picked.mapInArrow(run, f"{id_col} {kind}, excerpt string")
