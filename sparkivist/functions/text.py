"""Tokenising as Column expressions: everything stays inside the JVM and is linear in the text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Neither letter, digit nor underscore; spelled so that Java and RE2 read it alike.
_OTHER = r"[^\p{L}\p{N}_]"


def folded(text: Column | str, lower: bool = True) -> Column:
    """Text without anything but letters, digits and underscores; null becomes empty."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_replace(F.lower(c) if lower else c, _OTHER, "")


def ngrams(text: Column | str, n: int = 2, lower: bool = True) -> Column:
    """Overlapping character n-grams, in order, by one look-ahead scan; shorter texts have none."""
    return F.regexp_extract_all(folded(text, lower), F.lit(rf"(?=([\p{{L}}\p{{N}}_]{{{n}}}))"), F.lit(1))


def ngram_set(text: Column | str, n: int = 2, lower: bool = True) -> Column:
    return F.array_distinct(ngrams(text, n, lower))


def words(text: Column | str) -> Column:
    """Lower-case words of letters, digits and underscores; the tokeniser for spaced scripts."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def query_ngrams(query: str, n: int = 2, lower: bool = True) -> list[str]:
    """The distinct n-grams of a query string on the driver, in order, by the same rule."""
    s = re.sub(r"[^\w]", "", query.lower() if lower else query)
    return list(dict.fromkeys(s[i : i + n] for i in range(len(s) - n + 1)))


def occurrences(text: Column | str, grams: list[str], lower: bool = True) -> Column:
    """The n-grams of a text that are among ``grams``, in order and with repeats, by one look-ahead scan.

    The pattern branches on the first character, so the cost per position is that of the distinct
    first characters at most.
    """
    by: dict[str, list[str]] = {}
    for g in grams:
        by.setdefault(g[0], []).append(g[1:])
    branches = "|".join(f"{head}[{''.join(tails)}]" if all(len(t) == 1 for t in tails) else f"{head}(?:{'|'.join(tails)})" for head, tails in by.items())
    if not grams:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(folded(text, lower), F.lit(f"(?=({branches}))"), F.lit(1))


def squared_norm(tokens: Column) -> Column:
    """Sum of the squared counts of the tokens of an array: a fold over the sorted array."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))

    def step(s: Column, t: Column) -> Column:
        same = t == s["last"]
        return F.struct(
            t.alias("last"), F.when(same, s["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"), F.when(same, s["total"] + 2 * s["run"] + 1).otherwise(s["total"] + 1).alias("total")
        )

    return F.aggregate(F.array_sort(tokens), start, step, lambda s: s["total"])


def sentences(text: Column | str) -> Column:
    """Trimmed, non-empty pieces after sentence ends and line ends."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.filter(F.transform(F.split(c, r"(?<=[。！？!?\n])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def chunk_fixed(text: Column | str, size: int = 500, overlap: int = 100) -> Column:
    """array<struct<chunk_no, chunk>>: windows of ``size`` characters, stripped, blank ones dropped.

    Starts lie ``size - overlap`` apart while below max(length - overlap, 1).
    """
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - overlap, F.lit(1)) - 1, F.lit(size - overlap))
    cut = F.transform(starts, lambda s, i: F.struct(i.alias("chunk_no"), F.regexp_replace(F.substring(c, s + 1, F.lit(size)), r"^\s+|\s+$", "").alias("chunk")))
    return F.filter(cut, lambda x: x["chunk"] != "")
