"""Encoding of a corpus with a public byte-level BPE vocabulary, by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across, so a text may be
cut between its two bytes: merges never reach over the cut and both sides encode as they would in
the whole. ``CertainCuts`` marks such places, leaving out those where the cut would change how the
pre-splitting pattern reads the text (white space before it, an apostrophe on either side). Every
text, however short, is cut at all of them. The fragments are mostly words, which come again and
again; each is encoded by itself, once per worker as long as it is remembered, and the ids are
concatenated.

The stage is a scan and an Arrow map: no shuffle, no state that the result depends on, so it scales
with its input. The vocabulary file goes to the executors with the job.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from sparkivist.plans.session import table

#: Folder of the vocabulary files; callers pass another one as a parameter.
VOCABULARY_DIR = os.environ.get("SPARKIVIST_TOKENIZERS", "/opt/tokenizers")
#: A worker remembers the ids of so many fragments of at most so many bytes, then begins anew.
MEMO_FRAGMENTS, MEMO_BYTES = 1 << 18, 48
# Fixed value: the pattern that splits text before merging, as the vocabulary's description states it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class CertainCuts:
    """Places where a text can be cut without changing its ids."""

    def __init__(self, tokens: list[bytes]):
        seen = np.zeros(65536, dtype=bool)
        joined = np.frombuffer(b"".join(tokens), dtype=np.uint8).astype(np.uint16)
        inside = np.ones(len(joined), dtype=bool)
        inside[np.cumsum([len(t) for t in tokens]) - 1] = False  # pairs that reach into the next token
        pairs = (joined[:-1] << 8) | joined[1:]
        seen[pairs[inside[:-1]]] = True
        free = ~seen
        high, low = np.arange(65536) >> 8, np.arange(65536) & 255
        # The right byte must begin a character; neither side may be an apostrophe (contractions).
        free &= ((low & 0xC0) != 0x80) & (low != 0x27) & (high != 0x27)
        # White space looks ahead in the pattern: no cut after ASCII white space.
        free &= ~np.isin(high, [9, 10, 11, 12, 13, 32])
        self.free = free

    def of(self, data: bytes) -> np.ndarray:
        """Byte offsets of all certain cuts of UTF-8 ``data``, ascending."""
        b = np.frombuffer(data, dtype=np.uint8)
        at = np.flatnonzero(self.free[(b[:-1].astype(np.uint16) << 8) | b[1:]]) + 1
        # No cut after white space beyond ASCII either; the masks take in a few characters that are none.
        two, three = b[np.maximum(at - 2, 0)], b[np.maximum(at - 3, 0)]
        wide = ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80)) | (three == 0xE1) | (two == 0xC2)
        return at[~wide]


class _Memo(dict):
    """Ids by fragment, bounded in number and in the size of its keys."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: bytes) -> list[int]:
        ids = self.encode(piece.decode("utf-8", "surrogatepass"))
        if len(piece) <= MEMO_BYTES:
            if len(self) >= MEMO_FRAGMENTS:
                self.clear()
            self[piece] = ids
        return ids


class FragmentEncoder:
    """Encodes texts fragment by fragment; one per Python worker."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cuts = CertainCuts(list(ranks))
        self.memo = _Memo(self.encode)

    def fragments(self, text: str) -> list[bytes]:
        """UTF-8 pieces between certain cuts; together they are the text."""
        data = text.encode("utf-8", "surrogatepass")
        ends = self.cuts.of(data).tolist()
        return [data[i:j] for i, j in zip([0, *ends], [*ends, len(data)])]

    def ids(self, text: str | None) -> list[int]:
        """Token ids without special tokens; null and empty texts have none."""
        if not text:
            return []
        memo, out = self.memo, []
        for piece in self.fragments(text):
            out += memo[piece]
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        memo = self.memo
        return sum(len(memo[piece]) for piece in self.fragments(text))


@lru_cache(maxsize=4)
def encoder(path: str) -> FragmentEncoder:
    return FragmentEncoder(path)


def shipped(spark: SparkSession, path: str) -> str:
    """Sends the file with the job; its name, by which ``located`` finds it on an executor."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def located(name: str) -> FragmentEncoder:
    return encoder(SparkFiles.get(name))


def vocabulary(name: str, folder: str = VOCABULARY_DIR) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARY_DIR) -> DataFrame:
    """(id, ids array<int>), a row for each row of ``docs``.

    Null and empty texts give an empty list. Repeated rows come out as often as they come in, rows
    with a null id keep it, other columns are not read. An empty table gives no rows.
    """
    file = shipped(docs.sparkSession, vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = located(file)
        for b in batches:
            for at in range(0, b.num_rows, 500):  # bounds the ids held at once
                part = b.slice(at, 500)
                lists = [enc.ids(t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=ends[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_col, "ids"])

    picked = docs.select(id_col, text_col)
    return picked.mapInArrow(run, f"{id_col} {picked.schema[0].dataType.simpleString()}, ids array<int>")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = VOCABULARY_DIR) -> DataFrame:
    """(id, n_tokens int): the size of each text in tokens; 0 for null and empty texts."""
    file = shipped(docs.sparkSession, vocabulary(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = located(file)
        for b in batches:
            n = np.fromiter(map(enc.count, b.column(1).to_pylist()), dtype=np.int32, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=[id_col, "n_tokens"])

    picked = docs.select(id_col, text_col)
    return picked.mapInArrow(run, f"{id_col} {picked.schema[0].dataType.simpleString()}, n_tokens int")


def ids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_ids: every document's ids by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))
