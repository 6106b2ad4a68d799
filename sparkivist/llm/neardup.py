"""Near-duplicate entries by filtering under several global token orders.

Tokens are the runs of five letters or digits of a normalised text. Each of the global orders is a
pseudo-random permutation of all tokens. Two texts are candidates if they share their prefix token
(the first of each) under all ``ORDERS_PER_FILTER`` orders of at least one of ``FILTERS`` groups of
orders; the intersection inside a group is taken in the key by which texts meet. For similarity s a
group passes with probability s^6, so that of pairs at 0.75 about two in ten thousand escape all
groups, and of pairs at the threshold of 0.7 four in a thousand, while texts that share a tenth of
their tokens hardly ever meet. They do meet in a large table, in numbers that grow with its square, so
every key also carries a sketch, one bit of the prefix tokens of 128 orders: pairs are formed inside a
task and only those that agree in enough bits leave it. These must then agree in 256 bits, and what is
left is verified exactly on the whole token sets.

``exact=True`` misses nothing: prefixes long enough for the threshold under ``EXACT_ORDERS`` orders,
the first by rarity, intersected before the same verification. Its cost grows with the square of
the table where tokens are frequent, so it serves small tables and comparisons.

Equal normalised texts are one node, so copies meet neither in the filters nor in the
verification. Texts are read twice: for their signatures, and, compressed, for the verification.
A key's texts come in sorted chunks of ``CHUNK``, so a key that holds a third of all texts is never
gathered: its chunks meet one another as rows of a join that the engine can split. What copies of a text
add to the pairs goes straight to the result, without a shuffle or a file of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkivist.plans.session import cut_lineage, release, table

RUN = 5
LEAST_CHARS = 200
THRESHOLD = 0.7
FILTERS, ORDERS_PER_FILTER = 44, 6
#: Bits of a sketch, each of one order, and how many must agree; at similarity s a bit does with probability (1 + s) / 2,
#: so that pairs at 0.75 fall short with a probability below 2e-6 and pairs at 0.7 with one of about 1e-4.
SKETCH, SKETCH_AGREE = 256, 197
#: The same for the part of the sketch that travels with the keys.
PART, PART_AGREE = 128, 94
#: Texts of one key that are paired inside a task, and of them those that are compared with the others at once; and orders of the exact filter.
CHUNK, BLOCK = 4096, 64
EXACT_ORDERS = 3

_DELETED = re.compile(r"[\W_]+")
_ASCII_DELETED = {c: None for c in range(128) if not chr(c).isalnum()}


def _constants(n: int, seed: int) -> np.ndarray:
    """n odd 32-bit multipliers by the splitmix64 rule."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


_N_ORDERS = FILTERS * ORDERS_PER_FILTER
_MULTIPLIERS = _constants(_N_ORDERS, 17)


def normalise(text: str) -> str:
    """Lower case, letters and digits only (Unicode L and N)."""
    low = text.lower()
    return low.translate(_ASCII_DELETED) if low.isascii() else _DELETED.sub("", low)


def token_stream(norm: str) -> np.ndarray:
    """64-bit hashes of all runs of five characters, in order and with repeats."""
    codes = np.frombuffer(norm.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < RUN:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(len(codes) - RUN + 1, dtype=np.uint64)
    for i in range(RUN):
        h = h * np.uint64(0x100000001B3) + codes[i : i + len(h)]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def tokens(norm: str) -> np.ndarray:
    """Sorted distinct tokens."""
    h = np.sort(token_stream(norm))
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def prefixes(stream: np.ndarray, first: int, last: int) -> np.ndarray:
    """The place of the first token under each of the orders first..last-1; repeats don't matter."""
    low, by = (stream >> np.uint64(32)).astype(np.uint32), _MULTIPLIERS[first:last]
    best = np.full(last - first, 0xFFFFFFFF, dtype=np.uint32)
    block = max(1, 65536 // len(by))  # products that stay in the cache
    for at in range(0, len(low), block):
        np.minimum(best, (low[at : at + block, None] * by).min(axis=0), out=best)
    return best


def filter_keys(best: np.ndarray) -> np.ndarray:
    """(texts, FILTERS) 64-bit keys of (texts, orders) places: equal if the prefix tokens under all orders of the filter are."""
    groups = best.reshape(len(best), FILTERS, ORDERS_PER_FILTER).astype(np.uint64)
    key = np.broadcast_to(np.arange(FILTERS, dtype=np.uint64), groups.shape[:2]).copy()
    for i in range(ORDERS_PER_FILTER):
        key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ groups[:, :, i]
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketch_bits(best: np.ndarray) -> np.ndarray:
    """(texts, SKETCH / 8) bytes of (texts, orders) places: of each of the first orders one bit that depends on all of its place."""
    x = best[:, :SKETCH]
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return np.packbits((x >> np.uint32(31)).astype(bool), axis=1)


def node_id(norm: str) -> int:
    """64-bit id of a normalised text; two in 1e9 texts share one with a probability of three in a hundred."""
    import xxhash

    return xxhash.xxh3_64_intdigest(norm.encode("utf-8", "surrogatepass")) - (1 << 63)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = np.sort(np.concatenate((a, b)))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 0.0


def _signatures_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # nodes of this partition: copies have their keys once
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            ids, nodes, fresh, best = [], [], [], []
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                n = normalise(t)
                if len(n) < LEAST_CHARS:
                    continue
                node = node_id(n)
                ids.append(i), nodes.append(node), fresh.append(node not in seen)
                if node not in seen:
                    seen.add(node)
                    best.append(prefixes(token_stream(n), 0, _N_ORDERS))
            keys = iter([k.tobytes() for k in filter_keys(np.stack(best))] if best else [])
            drawn = iter([x.tobytes() for x in sketch_bits(np.stack(best))] if best else [])
            packed = [next(keys) if f else None for f in fresh]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array([next(drawn) if f else None for f in fresh], pa.binary()), pa.array(packed, pa.binary())], names=["entry_id", "node", "sketch", "keys"])


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, keys, sketch, root) to (key, node, part of the sketch as two integers, root)."""
    for b in batches:
        keys = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.int64)
        part = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.int64).reshape(-1, SKETCH // 64)
        cols = [b.column(0).to_numpy(), *part.T[: PART // 64], *(c.to_numpy() for c in b.columns[3:])]
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.repeat(c, FILTERS)) for c in cols)], names=["key", "node", "s0", "s1", "root"][: 1 + len(cols)])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, tuple[int, np.ndarray]]]:
    """(keys, nodes, marks, nodes of the first key before these, first of those nodes with its marks) of rows sorted by (key, node).

    marks: (nodes, columns) of the columns after the node. A key that goes on in the next batch is
    held back up to a multiple of CHUNK; repeats are dropped.
    """
    held, before, hub = None, 0, (0, np.empty(0, dtype=np.int64))
    for b in _then_none(batches):
        if b is not None:
            k, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            m = np.empty((len(k), b.num_columns - 2), dtype=np.int64)
            for i, c in enumerate(b.columns[2:]):
                m[:, i] = c.to_numpy()
            k, n, m = (np.concatenate(x) for x in zip(held, (k, n, m))) if held is not None else (k, n, m)
            keep = np.concatenate(([True], (k[1:] != k[:-1]) | (n[1:] != n[:-1]))) if len(k) else np.empty(0, dtype=bool)
            k, n, m = k[keep], n[keep], m[keep]
            begin = int(np.searchsorted(k, k[-1])) if len(k) else 0  # of the last key, which may go on
            cut = begin + (len(k) - 1 - begin) // CHUNK * CHUNK if len(k) else 0
            held, k, n, m = (k[cut:], n[cut:], m[cut:]), k[:cut], n[:cut], m[:cut]
        elif held is not None:
            (k, n, m), held = held, None
        else:
            return
        if len(k):
            yield k, n, m, before, hub
            same = held is not None and len(held[0]) and held[0][0] == k[-1]
            first = int(np.searchsorted(k, k[-1]))
            if same:
                hub = hub if before and first == 0 else (int(n[first]), m[first])
                before = (before if first == 0 else 0) + len(k) - first
            else:
                before, hub = 0, (0, np.empty(0, dtype=np.int64))


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


_MET = "a long, b long, key long, chunk int, nodes binary, marks binary"
_PACKED = "pairs binary, key long, chunk int, nodes binary, marks binary"


def _met(a: np.ndarray, b: np.ndarray, chunks: list[tuple[int, int, bytes, bytes]] = []) -> pa.RecordBatch:
    n, m = len(a), len(chunks)
    cols = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(m, pa.int64())]) for x in (a, b)]
    cols += [pa.concat_arrays([pa.nulls(n, t), pa.array([c[i] for c in chunks], t)]) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", "key", "chunk", "nodes", "marks"])


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows of marks agree in enough bits and, if there is a root, differ in it; without marks all."""
    if not x.shape[-1]:
        return np.ones(len(x), dtype=bool)
    differ = sum(np.bitwise_count((x[:, i] ^ y[:, i]).view(np.uint64)) for i in range(PART // 64))
    keep = differ <= PART - PART_AGREE
    return keep & (x[:, -1] != y[:, -1]) if x.shape[1] > PART // 64 else keep


def _chunks(k: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, size, number inside its key) of the chunks of rows from ``_runs``."""
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    place = np.arange(len(k)) - np.repeat(start, np.diff(np.append(start, len(k))))
    place[: start[1] if len(start) > 1 else len(k)] += before
    chunk = place // CHUNK
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (chunk[1:] != chunk[:-1]))))
    return first, np.diff(np.append(first, len(k))), chunk[first]


def _pairs_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, marks), sorted: all near pairs inside each chunk of a key, and the chunks themselves of keys with several."""
    for k, n, m, before, _ in _runs(batches):
        first, size, chunk = _chunks(k, before)
        out_a, out_b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for s in np.unique(size[(size > 1) & (size <= BLOCK)]).tolist():
            i, j = np.triu_indices(s, 1)
            some = max(1, 1_000_000 // len(i))
            at = first[size == s][:, None]
            for low in range(0, len(at), some):
                x, y = (at[low : low + some] + i).reshape(-1), (at[low : low + some] + j).reshape(-1)
                keep = _near(m[x], m[y])
                out_a.append(n[x[keep]]), out_b.append(n[y[keep]])
        yield _met(np.concatenate(out_a), np.concatenate(out_b), _several(k, n, m, first, size, chunk))
        for f, s in zip(first[size > BLOCK].tolist(), size[size > BLOCK].tolist()):
            for at in range(f, f + s, BLOCK):
                x, y = np.meshgrid(np.arange(at, min(at + BLOCK, f + s)), np.arange(at, f + s), indexing="ij")
                x, y = x[x < y], y[x < y]
                keep = _near(m[x], m[y])
                yield _met(n[x[keep]], n[y[keep]])


def _several(k: np.ndarray, n: np.ndarray, m: np.ndarray, first: np.ndarray, size: np.ndarray, chunk: np.ndarray) -> list[tuple[int, int, bytes, bytes]]:
    """The chunks of keys that have, or may have, more than one."""
    return [(int(k[f]), c, n[f : f + s].tobytes(), m[f : f + s].tobytes()) for f, s, c in zip(first.tolist(), size.tolist(), chunk.tolist()) if s == CHUNK or c > 0]


def _chunks_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks that ``_pairs_of_keys`` gives, without its pairs."""
    none = np.empty(0, dtype=np.int64)
    for k, n, m, before, _ in _runs(batches):
        yield _met(none, none, _several(k, n, m, *_chunks(k, before)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_pairs_of_keys`` with the pairs of a batch as one value, so that a file of them takes 16 bytes a pair."""
    for b in _pairs_of_keys(batches):
        n = b.num_rows - b.column(0).null_count
        pairs = np.stack([b.column(i).slice(0, n).to_numpy() for i in (0, 1)], axis=1)
        cols = [pa.concat_arrays([pa.nulls(1, c.type), c.slice(n)]) for c in b.columns[2:]]
        yield pa.RecordBatch.from_arrays([pa.array([pairs.tobytes() if n else None, *[None] * (b.num_rows - n)], pa.binary()), *cols], names=["pairs", "key", "chunk", "nodes", "marks"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column(0).to_pylist():
            pairs = np.frombuffer(x, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _stars_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, marks), sorted: each node that is near the first of its key with that, which keeps ``key``."""
    for k, n, m, before, hub in _runs(batches):
        start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(start, len(k)))
        first, marks = n[start].copy(), m[start].copy()
        if before:
            first[0], marks[0] = hub
        a = np.repeat(first, size)
        keep = (a != n) & _near(np.repeat(marks, size, axis=0), m)
        yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(a[keep]), pa.array(n[keep])], names=["key", "a", "b"])


def _across_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All near pairs of two chunks' nodes; rows (nodes, nodes, marks, marks), or without the marks."""
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            p, q = (np.frombuffer(x, dtype=np.int64) for x in row[:2])
            mp, mq = (np.frombuffer(x or b"", dtype=np.int64).reshape(len(z), -1) for x, z in zip(row[2:] or (None, None), (p, q)))
            for at in range(0, len(p), BLOCK):
                x, y = np.repeat(np.arange(at, min(at + BLOCK, len(p))), len(q)), np.tile(np.arange(len(q)), min(BLOCK, len(p) - at))
                keep = _near(mp[x], mq[y])
                x, y = p[x[keep]], q[y[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, sketch of a, sketch of b) that agree under enough orders."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint64).reshape(-1, SKETCH // 64) for i in (2, 3))
        keep = pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= SKETCH - SKETCH_AGREE)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])


def _bodies_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False)
    seen: set[int] = set()
    for b in batches:
        nodes, bodies = [], []
        for t in b.column(1).to_pylist():
            n = normalise(t)
            if len(n) >= LEAST_CHARS and (node := node_id(n)) not in seen:
                seen.add(node)
                nodes.append(node)
                bodies.append(pack.compress(n.encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(bodies, pa.binary())], names=["node", "body"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, node, body) sorted by (a, b, node): two or, from several partitions, more per pair."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    pair, first = None, None
    cache: dict[int, np.ndarray] = {}

    def toks(node: int, body: bytes) -> np.ndarray:
        if node not in cache:
            if len(cache) > 256:
                cache.clear()
            cache[node] = tokens(unpack.decompress(body).decode("utf-8", "surrogatepass"))
        return cache[node]

    for b in batches:
        out: tuple[list, list, list] = ([], [], [])
        for a, z, node, body in zip(*(c.to_pylist() for c in b.columns)):
            if (a, z) != pair:
                pair, first = (a, z), toks(node, body)
            elif node == z and first is not None:
                if (s := similarity(first, toks(node, body))) >= THRESHOLD:
                    out[0].append(a), out[1].append(z), out[2].append(s)
                first = None
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["a", "b", "similarity"])


def _texts(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("entry_id").cast("long").alias("entry_id"), "text").where(F.length("text") >= LEAST_CHARS)


def signatures(entries: DataFrame) -> DataFrame:
    """(entry_id, node, sketch, keys), cut off: entries with at least 200 letters and digits, and their text's id.

    sketch and keys are given once per node and partition, null in its other rows.
    """
    rows = _texts(entries).where("entry_id IS NOT NULL")
    return cut_lineage(rows.mapInArrow(_signatures_of, "entry_id long, node long, sketch binary, keys binary"))


def members(signed: DataFrame) -> DataFrame:
    """(entry_id, node), distinct."""
    return signed.select("entry_id", "node").distinct()


def _keyed(signed: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(key, node, s0, s1), sorted inside partitions by key: where the texts meet. The only shuffle of all keys.

    roots: (node, root); adds ``root``, a node that has none being its own.
    """
    rows = signed.where("keys IS NOT NULL").select("node", "keys", "sketch")
    schema = "key long, node long, s0 long, s1 long"
    if roots is not None:
        rows, schema = rows.join(roots, "node", "left").select("node", "keys", "sketch", F.coalesce("root", "node").alias("root")), schema + ", root long"
    return rows.mapInArrow(_keys_of, schema).repartition("key").sortWithinPartitions("key", "node")


def _far(chunks: DataFrame) -> DataFrame:
    """(a, b): the near pairs across the chunks (key, chunk, nodes, marks) of a key."""
    other = chunks.select(F.col("key").alias("k2"), F.col("chunk").alias("c2"), F.col("nodes").alias("n2"), F.col("marks").alias("m2"))
    met = chunks.join(other, (F.col("key") == F.col("k2")) & (F.col("chunk") < F.col("c2")))
    return met.select("nodes", "n2", "marks", "m2").mapInArrow(_across_chunks, "a long, b long")


def candidates(signed: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b, distinct and dealt out by a: pairs of nodes that share the prefix tokens under all
    orders of a filter and agree in enough bits; with ``roots`` only those of different roots."""
    met = cut_lineage(_keyed(signed, roots).mapInArrow(_packed, _PACKED))
    release(signed)
    near = met.where("pairs IS NOT NULL").select("pairs").mapInArrow(_unpacked, "a long, b long")
    far = _far(met.where("key IS NOT NULL").select("key", "chunk", "nodes", "marks"))
    return near.unionByName(far).repartition("a").distinct()


def _exact_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for b in batches:
        nodes, toks, others = [], [], []
        for t in b.column(1).to_pylist():
            n = normalise(t)
            if len(n) >= LEAST_CHARS and (node := node_id(n)) not in seen:
                seen.add(node)
                h = tokens(n)
                size = len(h) - math.ceil(THRESHOLD * len(h)) + 1
                low = (h >> np.uint64(32)).astype(np.uint32)
                nodes.append(node), toks.append(h.view(np.int64))
                others.append([h[np.lexsort((h, low * _MULTIPLIERS[i]))[:size]].view(np.int64) for i in range(EXACT_ORDERS - 1)])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(toks, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.list_(pa.int64())))], names=["node", "tokens", "others"])


def exact_candidates(entries: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs that share a prefix token under every one of ``EXACT_ORDERS`` orders; none at 0.7 is missed.

    Of n tokens a prefix has n - ceil(0.7 n) + 1. The rarest tokens come first in the first order,
    whose prefixes are joined; the others are compared on the pairs.
    """
    rows = _texts(entries).mapInArrow(_exact_prefixes, "node long, tokens array<long>, others array<array<long>>")
    rows = cut_lineage(rows.groupBy("node").agg(F.first("tokens").alias("tokens"), F.first("others").alias("others")))
    post = rows.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    df = post.groupBy("token").agg(F.count("*").alias("df"))
    ranked = post.join(df, "token").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o"))
    prefix = cut_lineage(ranked.select("node", F.explode(F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * THRESHOLD) + 1).cast("int"))).alias("x")).select("node", "x.token"))
    left, right = prefix.select("token", F.col("node").alias("a")), prefix.select("token", F.col("node").alias("b"))
    pairs = left.join(right, "token").where("a < b").select("a", "b").distinct()
    oa, ob = rows.select(F.col("node").alias("a"), F.col("others").alias("oa")), rows.select(F.col("node").alias("b"), F.col("others").alias("ob"))
    return pairs.join(oa, "a").join(ob, "b").where(F.forall(F.zip_with("oa", "ob", F.arrays_overlap), lambda x: x)).select("a", "b")


def verified(pairs: DataFrame, entries: DataFrame, signed: DataFrame | None) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of nodes at 0.7 or more; with ``signed`` only those that agree under enough further orders."""
    if signed is not None:
        sketches = signed.where("sketch IS NOT NULL").groupBy("node").agg(F.first("sketch").alias("sketch"))
        sa, sb = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
        pairs = pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(_agree, "a long, b long")
    pairs = cut_lineage(pairs)
    release(pairs)
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    bodies = _texts(entries).mapInArrow(_bodies_of, "node long, body binary")
    rows = sides.join(bodies, "node").select("a", "b", "node", "body")
    return rows.repartition("a", "b").sortWithinPartitions("a", "b", "node").mapInArrow(_verify, "a long, b long, similarity double")


def similar_pairs(entries: DataFrame, exact: bool = False) -> DataFrame:
    """(entry_a, entry_b), entry_a < entry_b: pairs of different entries with a similarity of at least 0.7.

    entries: entry_id, text; other columns are not read. Null and short texts take no part,
    repeated rows count once. Copies that are equal once normalised are paired with one another
    and with all partners of their text, as the result is defined; ``similar_groups`` gives the
    same classes without that expansion. An empty table gives no rows. exact: see the module.
    """
    signed = signatures(entries)
    found = verified(exact_candidates(entries) if exact else candidates(signed), entries, None if exact else signed).select("a", "b")
    found = cut_lineage(found)
    # An entry with one text, which is the rule, has each pair once: only the others' pairs are made distinct.
    of = signed.select("entry_id", "node").repartition("entry_id").distinct().withColumn("several", F.count("*").over(W.partitionBy("entry_id")) > 1)
    of = cut_lineage(of)
    ma, mb = of.select(F.col("entry_id").alias("ea"), F.col("node").alias("a"), F.col("several").alias("sa")), of.select(F.col("entry_id").alias("eb"), F.col("node").alias("b"), F.col("several").alias("sb"))
    release(signed)
    across = found.join(ma, "a").join(mb, "b").where("ea <> eb").select(F.least("ea", "eb").alias("entry_a"), F.greatest("ea", "eb").alias("entry_b"), (F.col("sa") | F.col("sb")).alias("several"))
    # Copies of a text meet in chunks as texts of a key do.
    copies = of.where("NOT several").select("node", "entry_id").repartition("node").sortWithinPartitions("node", "entry_id")
    within = copies.mapInArrow(_pairs_of_keys, _MET).where("a IS NOT NULL").select("a", "b")
    far = _far(copies.mapInArrow(_chunks_of_keys, _MET).where("key IS NOT NULL").select("key", "chunk", "nodes", "marks"))
    alone = across.where("NOT several").select("entry_a", "entry_b").unionByName(within.unionByName(far).select(F.col("a").alias("entry_a"), F.col("b").alias("entry_b")))
    same = ma.where("sa").join(mb.withColumnRenamed("b", "a"), "a").where("ea <> eb").select(F.least("ea", "eb").alias("entry_a"), F.greatest("ea", "eb").alias("entry_b"))
    return alone.unionByName(across.where("several").select("entry_a", "entry_b").unionByName(same).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b), by alternating large-star and small-star steps.

    Every round sends each node's neighbours to the least one; hubs are spread by the aggregation
    of minima, no neighbourhood is gathered. Ends when a round changes nothing.
    """
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        # Large star: larger neighbours of u move to the least of u and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours of u, and u itself, move to the least of them.
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u")
        e = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut_lineage(e)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def group_links(entries: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b): verified links that connect whatever any verified link connects, without all pairs of a key.

    First each node of a key is compared with the key's first node only. Then only nodes of a key
    that are still in different components are compared with one another; keys whose nodes have
    come together, such as those of the edited copies of one template, are done.
    """
    star = cut_lineage(_keyed(signed).mapInArrow(_stars_of_keys, "key long, a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    release(signed)
    first = cut_lineage(verified(star, entries, signed).select("a", "b"))
    release(signed)
    return first.unionByName(verified(candidates(signed, components(first)), entries, signed).select("a", "b"))


def similar_groups(entries: DataFrame) -> DataFrame:
    """(entry_id, group_id, group_size): one row per entry with a near-duplicate.

    group_id is the least entry_id of the group. The groups are the connected components of what
    ``similar_pairs`` links, from at most a star of links per key and what that leaves apart.
    """
    signed = signatures(entries)
    of = cut_lineage(members(signed))
    root = components(group_links(entries, signed))
    grouped = of.join(root, "node", "left").select("entry_id", F.coalesce("root", "node").alias("root"))
    heads = grouped.groupBy("root").agg(F.min("entry_id").alias("group_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return grouped.join(heads, "root").select("entry_id", "group_id", "group_size")


def found_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_found over the whole of memory_entries."""
    return similar_pairs(table(spark, sf_dir, "memory_entries").select("entry_id", "text"))


def groups_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_groups: the group of each entry that has near-duplicates."""
    return similar_groups(table(spark, sf_dir, "memory_entries"))
