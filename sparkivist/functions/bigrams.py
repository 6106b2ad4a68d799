"""Character bigrams of whole Arrow batches as 64-bit integers, with numpy.

A bigram of the code points a and b is the integer a * 2^21 + b. The rules are those of
``functions.text``: lower case on demand, then only letters, digits and underscores stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SHIFT = 21
SLICE_CHARS = 1 << 20  # characters worked on at once


@lru_cache(maxsize=1)
def _kept() -> np.ndarray:
    """Whether a code point is a letter, a digit or an underscore."""
    return np.fromiter((c == 95 or chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


def query_bigrams(query: str, lower: bool = True) -> dict[int, int]:
    """Bigrams of a query with their counts, in order of their first occurrence."""
    s = re.sub(r"[^\w]", "", query.lower() if lower else query)
    out: dict[int, int] = {}
    for a, b in zip(s, s[1:]):
        k = (ord(a) << SHIFT) | ord(b)
        out[k] = out.get(k, 0) + 1
    return out


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first position, texts) of runs of about SLICE_CHARS characters; a longer text is a run of its own."""
    at, held, size = 0, [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= SLICE_CHARS or len(held) >= 4096:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def stream(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(document's place, bigram) of every bigram of the texts, in order and with repeats."""
    codes = [np.frombuffer((t.lower() if lower else t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    place = np.repeat(np.arange(len(codes), dtype=np.int64), [len(c) for c in codes])
    flat = np.concatenate(codes) if codes else np.empty(0, dtype=np.uint32)
    keep = _kept()[flat]
    flat, place = flat[keep].astype(np.int64), place[keep]
    same = place[1:] == place[:-1]
    return place[1:][same], ((flat[:-1] << SHIFT) | flat[1:])[same]


def counted(place: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of n documents, distinct bigrams ascending, counts) from ``stream``."""
    key = np.sort((place << (2 * SHIFT)) | gram)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(key))).astype(np.int32)
    key = key[first]
    offsets = np.searchsorted(key >> (2 * SHIFT), np.arange(n + 1)).astype(np.int32)
    return offsets, key & ((1 << (2 * SHIFT)) - 1), counts


def find(grams: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where, which): positions in ``grams`` whose value is in ``wanted`` (ascending), and its place there."""
    if not len(wanted) or not len(grams):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    at = np.searchsorted(wanted, grams)
    at[at == len(wanted)] = 0
    where = np.flatnonzero(wanted[at] == grams)
    return where, at[where]
