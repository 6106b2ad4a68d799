"""Lexical, vector and graph ranking, and their fusion.

A query string is tokenised on the driver. One scan counts its bigrams in every document
(``index.scan`` from texts, ``index.hits`` from a stored index); statistics are one row aggregated
from these counts, and scoring is a map over them. Postings are not shuffled for a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkivist.functions import bigrams as B
from sparkivist.functions import text as T
from sparkivist.operators import index
from sparkivist.plans.session import cut_lineage, release

K1, B_LENGTH = 1.5, 0.75
RRF_K, GRAPH_RRF_K = 60, 5
GRAPH_SEEDS, GRAPH_TOP, GRAPH_DF_CAP = 3, 5, 64
#: So many frequent bigrams at most (8 bytes each) travel with a map over the index; beyond it the join alone drops them.
FREQUENT_BROADCAST = 500_000


def distinctive_cap(n: Column) -> Column:
    """Largest document frequency of a distinctive token: a fifth of the documents, three at least."""
    return F.greatest(F.lit(3).cast("long"), F.floor(n / 5))


def statistics_of(counted: DataFrame, tokens: int) -> DataFrame:
    """One row: n, total (summed lengths in bigrams), dfs (document frequency by query token) from counted documents."""
    dfs = [F.count_if(F.try_element_at("tf", F.lit(i + 1)) > 0) for i in range(tokens)]
    return counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), (F.array(*dfs) if dfs else F.array().cast("array<long>")).alias("dfs"))


def query_statistics(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    counted = index.scan(docs.select(F.lit(0).alias("_id"), text), query, "_id", text, cosine=False)
    return statistics_of(counted, len(T.query_ngrams(query)))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row: the generator keeps the optimizer from copying
    a costly expression into every place that uses it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def lexical_scores(counted: DataFrame, query: str, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, score, admitted) by BM25 of counted documents that share a token with the query.

    counted: the cut-off result of ``index.scan`` or ``index.hits``, which is read twice.
    """
    stats = statistics_of(counted, len(T.query_ngrams(query)))
    known = stats.select(F.struct("n", F.try_divide("total", "n").alias("avgdl"), "dfs")).scalar()  # one subquery for all three
    found = counted.where("tf IS NOT NULL").withColumn("known", known).select(id_col, *keep, F.greatest("dl", F.lit(1)).alias("dl"), "tf", "known.*")
    z = F.filter(F.arrays_zip(F.col("tf").alias("tf"), F.col("dfs").alias("df")), lambda x: x["tf"] > 0)
    found = once(found, z=z)
    norm = K1 * (1 - B_LENGTH + B_LENGTH * F.col("dl") / F.col("avgdl"))

    def part(x: Column) -> Column:
        return F.ln((F.col("n") - x["df"] + 0.5) / (x["df"] + 0.5) + 1) * x["tf"] * (K1 + 1) / (x["tf"] + norm)

    score = F.aggregate("z", F.lit(0.0), lambda acc, x: acc + part(x))
    admitted = F.exists("z", lambda x: x["df"] <= distinctive_cap(F.col("n")))
    return once(found, score=score, admitted=admitted).select(id_col, *keep, "score", "admitted")


def bm25_scores(docs: DataFrame, query: str, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, score, admitted) of documents that share a token with the query.

    admitted: they share one that is distinctive. Documents without tokens, null texts among
    them, count as length one and never score. A query without tokens gives no rows, nor does an
    empty table. The texts are scanned once; their counts are cut off and read twice.
    """
    return lexical_scores(cut_lineage(index.scan(docs, query, id_col, text, keep, cosine=False)), query, id_col, keep)


def vector_scores(counted: DataFrame, query: str, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, cosine) over bigram counts, case kept, of counted documents with a common bigram."""
    counts = list(B.query_bigrams(query, lower=False).values())
    norm = sum(c * c for c in counts) ** 0.5
    weights = F.array(*map(F.lit, counts)) if counts else F.array().cast("array<int>")
    dot = F.aggregate(F.zip_with("ctf", weights, lambda a, b: a * b), F.lit(0), lambda acc, x: acc + x)
    return counted.where("ctf IS NOT NULL").select(id_col, *keep, (dot / (F.sqrt(F.col("norm2").cast("double")) * F.lit(norm or 1.0))).alias("cosine"))


def cosine_scores(docs: DataFrame, query: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, cosine) over bigram counts, case kept; documents without a common bigram are left out."""
    return vector_scores(index.scan(docs, query, id_col, text), query, id_col)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows with ``rank`` from 1. A limit, then a window over k rows."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def global_rank(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ``rank0``, from 0 over the whole frame, without bringing it into one partition.

    Rows are sorted by range; a row's rank is its place in its partition plus the sizes of the
    partitions before, a table as long as there are partitions.
    """
    placed = df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = cut_lineage(placed)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    begins = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_begin"))
    return placed.join(F.broadcast(begins), "_part").withColumn("rank0", F.col("_place") + F.col("_begin")).drop("_part", "_place", "_begin")


def running_total(df: DataFrame, value: str, *order: Column) -> DataFrame:
    """Adds ``running``, the sum of ``value`` from the first row in order up to this one, by ranges.

    Each range is summed by itself; what lies before it is the sum of the ranges before, a table as
    long as there are partitions. The order must be total.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.sum(value).alias("_n"))
    begins = sizes.select(F.col("_part").alias("_p"), (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_begin"))
    inside = placed.withColumn("_run", F.sum(value).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return inside.join(F.broadcast(begins), F.col("_part") == F.col("_p")).withColumn("running", F.col("_run") + F.col("_begin")).drop("_part", "_p", "_begin", "_run")


def fuse(routes: list[tuple[DataFrame, int]], id_col: str = "doc_id") -> DataFrame:
    """(id, fused): summed 1 / (k + rank0 + 1) over routes, each (frame with id and rank0, k)."""
    parts = [r.select(id_col, (1.0 / (F.lit(k) + F.col("rank0") + 1)).alias("part")) for r, k in routes]
    return reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.sum("part").alias("fused"))


def balance_pool(rows: DataFrame, k: int, layer: str, *order: Column) -> DataFrame:
    """The k best rows and the best row of each layer, with ``rank0`` among them.

    All that ``layer_balanced`` looks at; the ranks of the k best are those of the whole frame.
    Both parts are pruned before their shuffle, so the last window sees k rows and one per layer.
    """
    best = rows.orderBy(*order).limit(k)
    heads = rows.withColumn("_n", F.row_number().over(W.partitionBy(layer).orderBy(*order))).where("_n = 1").drop("_n")
    pool = best.unionByName(heads).distinct()
    return pool.withColumn("rank0", F.row_number().over(W.orderBy(*order)) - 1)


def layer_balanced(ranked: DataFrame, k: int, layer: str = "layer", rank: str = "rank0") -> DataFrame:
    """The k best rows; if a layer is missing from them, its best row takes the last place.

    Only the best k rows and the best row of each layer are looked at. A null layer counts as one.
    """
    heads = ranked.groupBy(layer).agg(F.min(rank).alias("head"))
    best = ranked.join(F.broadcast(heads), ranked[layer].eqNullSafe(heads[layer])).drop(heads[layer])
    pool = best.where((F.col(rank) < k) | (F.col(rank) == F.col("head")))
    missing = F.min(F.when(F.col("head") >= k, F.col("head"))).over(W.partitionBy())
    pool = pool.withColumn("swap", missing)
    kept = pool.where(((F.col(rank) < k) & ((F.col("swap").isNull()) | (F.col(rank) < k - 1) | F.lit(k < 2))) | ((F.col(rank) == F.col("swap")) & F.lit(k >= 2)))
    return kept.drop("head", "swap")


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, token), distinct: a map, since each document's tokens are made distinct in its row."""
    return docs.select(id_col, F.explode(T.ngram_set(text)).alias("token"))


def graph_cap(n: int, cap: int | None = GRAPH_DF_CAP) -> int:
    """Largest document frequency of a bigram that makes edges, among n documents."""
    return min(max(3, n // 5), cap) if cap else max(3, n // 5)


def distinctive_postings(indexed: DataFrame, id_col: str = "doc_id", cap: int | None = GRAPH_DF_CAP) -> DataFrame:
    """(id, gram, df, idf) of bigrams in at least two and at most ``cap`` documents, or a fifth of them if that is less.

    indexed: the cut-off result of ``index.build``. What is too frequent goes before the shuffle if
    the frequent bigrams are few enough to travel with the map; the join with the frequencies
    leaves them out in any case.
    """
    dfs = cut_lineage(index.document_frequencies(indexed, 2))
    n = indexed.count()
    limit = graph_cap(n, cap)
    # One row more than the bound shows whether the frequent ones are few enough to travel with the map.
    frequent = np.array([r[0] for r in dfs.where(F.col("df") > limit).select("gram").limit(FREQUENT_BROADCAST + 1).collect()], dtype=np.int64)
    post = index.postings(indexed, id_col, np.sort(frequent) if len(frequent) <= FREQUENT_BROADCAST else None)
    return post.join(dfs.where(F.col("df") <= limit), "gram").select(id_col, "gram", "df", F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def entity_postings(entities: DataFrame, n: int, id_col: str = "doc_id", cap: int | None = GRAPH_DF_CAP) -> DataFrame:
    """(id, gram, weight) of entities in two documents at least: ln(1 + n / documents with it).

    entities: id, entity; nulls and repeats count for nothing. An entity of more than ``cap``
    documents makes no edges, as with bigrams, since its pairs grow with the square of its
    documents; ``cap=None`` takes them all.
    """
    e = entities.where(F.col(id_col).isNotNull() & F.col("entity").isNotNull()).select(id_col, "entity").distinct()
    df = e.groupBy("entity").agg(F.count("*").alias("df")).where((F.col("df") >= 2) & ((F.col("df") <= cap) if cap else F.lit(True)))
    return e.join(df, "entity").select(id_col, F.concat(F.lit("entity "), "entity").alias("gram"), F.log1p(F.lit(float(n)) / F.col("df")).alias("weight"))


def edges_of(indexed: DataFrame, id_col: str = "doc_id", top_k: int = GRAPH_TOP, entities: DataFrame | None = None) -> DataFrame:
    """(src, dst, strength, rank): as ``graph_edges``, from a cut-off index; shared entities add to the strength.

    The documents of a bigram, ``cap`` at most, come together in one row, which is dealt to each of
    them; a document's rows then give its sums, and only its ``top_k`` best leave the map.
    """
    shared = distinctive_postings(indexed, id_col).groupBy("gram").agg(F.first("idf").alias("w"), F.array_sort(F.collect_list(id_col)).alias("ids")).select("w", "ids")
    if entities is not None:
        e = entity_postings(entities, indexed.count(), id_col)
        shared = shared.unionByName(e.groupBy("gram").agg(F.first("weight").alias("w"), F.array_sort(F.collect_list(id_col)).alias("ids")).select("w", "ids"))
    mine = shared.select(F.explode("ids").alias("src"), "w", "ids").repartition("src").sortWithinPartitions("src")
    kind = indexed.schema[id_col].dataType.simpleString()
    return mine.mapInArrow(_strongest(top_k), f"src {kind}, dst {kind}, strength double, rank long")


def _strongest(top_k: int):
    """A map over rows (src, w, ids), sorted by src, to its ``top_k`` strongest neighbours; holds one src's rows over."""

    def best(rows: pa.Table) -> pa.RecordBatch:
        lists = rows.column("ids").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        src, at = np.unique(rows.column("src").to_numpy(), return_inverse=True)
        dst, to = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        at, w = np.repeat(at, size), np.repeat(rows.column("w").to_numpy(), size)
        other = src[at] != dst[to]
        key, w = at[other] * len(dst) + to[other], w[other]
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
        strength = np.round(np.add.reduceat(w, first), 6) if len(first) else np.empty(0)
        s, d = np.divmod(key[first], max(len(dst), 1))
        order = np.lexsort((d, -strength, s))
        s, d, strength = s[order], d[order], strength[order]
        rank = np.arange(len(s)) - np.searchsorted(s, s) + 1
        keep = rank <= top_k
        names = ["src", "dst", "strength", "rank"]
        return pa.RecordBatch.from_arrays([pa.array(src[s[keep]], rows.schema.field("src").type), pa.array(dst[d[keep]], rows.schema.field("src").type), pa.array(strength[keep]), pa.array(rank[keep], pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            ends = pc.sum(pc.not_equal(rows.column("src"), b.column(0)[b.num_rows - 1])).as_py() or 0
            if ends:
                yield best(rows.slice(0, ends))
            held = rows.slice(ends)
        if held is not None:
            yield best(held)

    return run


def graph_edges(docs: DataFrame, id_col: str = "doc_id", text: str = "text", top_k: int = GRAPH_TOP, entities: DataFrame | None = None) -> DataFrame:
    """(src, dst, strength, rank): each document's strongest neighbours by summed idf of shared distinctive tokens.

    The bound on document frequency makes the pairs linear: a token gives at most cap pairs per
    document. Ties go to the smaller id. Isolated documents have no rows. ids must be unique.
    """
    return edges_of(cut_lineage(index.build(docs, id_col, text)), id_col, top_k, entities)


def seed_neighbours(indexed: DataFrame, seeds: list, id_col: str = "doc_id", top_k: int = GRAPH_TOP, entities: DataFrame | None = None) -> DataFrame:
    """(src, dst, rank) for a few seeds only, by two maps over the index.

    Only the seeds' own bigrams reach the driver: first their document frequencies, then, of the
    distinctive ones, the weights by which every document's strength towards each seed is summed.
    """
    own = {r[0]: index.unpacked(r[1]) for r in indexed.where(F.col(id_col).isin(seeds)).select(id_col, "grams").toLocalIterator()}
    wanted = np.unique(np.concatenate([*own.values(), np.empty(0, dtype=np.int64)])).astype(np.int64)
    n = indexed.count()
    cap = graph_cap(n)
    df = {r[0]: r[1] for r in index.frequencies_among(indexed, wanted).where(F.col("df").between(2, cap)).toLocalIterator()}
    grams = np.array(sorted(df), dtype=np.int64)
    d = np.array([df[g] for g in grams.tolist()], dtype=np.float64)
    idf = np.log((n - d + 0.5) / (d + 0.5) + 1)
    order = sorted(own)
    weights = np.stack([np.where(np.isin(grams, own[s]), idf, 0.0) for s in order], axis=1) if order else np.zeros((len(grams), 0))
    kind = indexed.schema[id_col].dataType.simpleString()
    src = F.element_at(F.array(*[F.lit(s).cast(kind) for s in order]), F.col("column_no") + 1) if order else F.lit(None).cast(kind)
    found = index.shared_strength(indexed, grams, weights, id_col).select(src.alias("src"), F.col(id_col).alias("dst"), "strength")
    if entities is not None:
        e = entity_postings(entities, n, id_col)
        mine = e.where(F.col(id_col).isin(seeds)).select(F.col(id_col).alias("src"), "gram")
        found = found.unionByName(e.join(mine, "gram").select("src", F.col(id_col).alias("dst"), F.col("weight").alias("strength"))).groupBy("src", "dst").agg(F.sum("strength").alias("strength"))
    pairs = found.where("src <> dst").select("src", "dst", F.round("strength", 6).alias("strength"))
    w = W.partitionBy("src").orderBy(F.desc("strength"), "dst")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("src", "dst", "rank")


def hybrid_retrieve(
    docs: DataFrame,
    query: str,
    k: int = 10,
    id_col: str = "doc_id",
    layer: str = "layer",
    text: str = "text",
    visible: Column | None = None,
    vectors: DataFrame | None = None,
    floor: float | None = None,
    entities: DataFrame | None = None,
) -> DataFrame:
    """(id, layer, fused, rank): lexical, vector and graph routes fused, layers balanced; see ``retrieve_indexed``.

    For a single query no whole index is written: the texts' one scan counts the query's bigrams and
    keeps, for the graph, each document's distinct ones, a third of the index or less.
    """
    flag = F.lit(True) if visible is None else F.coalesce(visible, F.lit(False))
    scanned = cut_lineage(index.scan(docs.withColumn("_visible", flag), query, id_col, text, (layer, "_visible"), grams=True))
    release(scanned)
    return _retrieve(scanned.select(id_col, "grams"), cut_lineage(scanned.drop("grams")), query, k, id_col, layer, vectors, floor, entities)


def retrieve_indexed(indexed: DataFrame, query: str, k: int = 10, id_col: str = "doc_id", layer: str = "layer", vectors: DataFrame | None = None, floor: float | None = None, entities: DataFrame | None = None) -> DataFrame:
    """(id, layer, fused, rank): retrieval from a stored index with columns ``layer`` and ``_visible``.

    Candidates are visible and pass the lexical admission, or, with ``vectors`` (id, score) and a
    calibrated ``floor``, score over it. Without vectors the second route is the bigrams' cosine of
    the admitted; vectors without a floor rank what the words admitted and admit nothing. Ranks are
    taken among the candidates. Seeds are the first three of either route with a positive score;
    the graph route lists them, each followed by its visible neighbours, and joins the fusion only
    if it adds a document. Hidden documents count in the statistics and appear nowhere. Without a
    candidate there is no result.
    """
    return _retrieve(indexed, cut_lineage(index.hits(indexed, query, id_col, (layer, "_visible"))), query, k, id_col, layer, vectors, floor, entities)


def _retrieve(indexed: DataFrame, counted: DataFrame, query: str, k: int, id_col: str, layer: str, vectors: DataFrame | None, floor: float | None, entities: DataFrame | None) -> DataFrame:
    """``retrieve_indexed`` from the documents' bigrams (id, grams) and the query's counts, both cut off."""
    order = (F.desc("score"), F.asc(id_col))
    words = lexical_scores(counted, query, id_col, (layer, "_visible")).where("admitted AND score > 0 AND _visible")
    lexical = global_rank(words.select(id_col, layer, F.round("score", 6).alias("score")), *order)
    if vectors is None:
        admitted = counted.join(lexical.select(id_col), id_col, "left_semi")
        second = vector_scores(admitted, query, id_col, (layer,)).select(id_col, layer, F.round("cosine", 6).alias("score"))
    else:
        scored = vectors.where("score IS NOT NULL").join(counted.where("_visible").select(id_col, layer), id_col).select(id_col, layer, F.round("score", 6).alias("score"))
        second = scored.join(lexical.select(id_col), id_col, "left_semi") if floor is None else scored.where(F.col("score") > floor)
    vector = global_rank(second, *order)
    first = [r.where((F.col("rank0") < GRAPH_SEEDS) & (F.col("score") > 0)).select(id_col, (F.col("rank0") + off).alias("at")) for r, off in ((lexical, 0), (vector, GRAPH_SEEDS))]
    seeds: dict = {}
    for i, at in sorted(map(tuple, first[0].unionByName(first[1]).collect()), key=lambda x: x[1]):  # six rows at most
        seeds.setdefault(i, at)
    routes = [(lexical, RRF_K), (vector, RRF_K)]
    if seeds:
        near = seed_neighbours(indexed, list(seeds), id_col, GRAPH_TOP, entities)
        near = near.join(counted.where("_visible").select(F.col(id_col).alias("dst")), "dst", "left_semi")
        walk = list(seeds)
        for _, _, dst in sorted((seeds[r["src"]], r["rank"], r["dst"]) for r in near.collect()):  # thirty rows at most
            if dst not in walk:
                walk.append(dst)
        if len(walk) > len(seeds):
            kind = indexed.schema[id_col].dataType.simpleString()
            routes.append((indexed.sparkSession.createDataFrame(list(enumerate(walk)), f"rank0 int, {id_col} {kind}"), GRAPH_RRF_K))
    fused = fuse(routes, id_col).select(id_col, F.round("fused", 9).alias("fused"))
    pool = balance_pool(fused.join(counted.select(id_col, layer), id_col), k, layer, F.desc("fused"), F.asc(id_col))
    return layer_balanced(pool, k, layer).select(id_col, layer, "fused", F.least(F.col("rank0") + 1, F.lit(k)).cast("long").alias("rank"))


def retrieve_queries(docs: DataFrame, queries: list[str], k: int = 10, pool: int = 20, id_col: str = "doc_id", layer: str = "layer", visible: Column | None = None) -> DataFrame:
    """(id, layer, fused, rank): hybrid retrieval by a query and at most one rewording, fused with two votes to one.

    Each query gives its ``pool`` best rows, k at least; layers are balanced again after the fusion.
    A rewording equal to the query leaves the retrieval by one query.
    """
    wanted = list(dict.fromkeys(q.strip() for q in queries))
    if not 1 <= len(wanted) <= 2 or not all(wanted):
        raise ValueError("one query and at most one rewording, none of them blank")
    if len(wanted) == 1:
        return hybrid_retrieve(docs, wanted[0], k, id_col, layer, visible=visible)
    flagged = docs.withColumn("_visible", F.lit(True) if visible is None else F.coalesce(visible, F.lit(False)))
    indexed = cut_lineage(index.build(flagged, id_col, "text", (layer, "_visible")))  # both queries read it
    lists = [cut_lineage(retrieve_indexed(indexed, q, max(k, pool), id_col, layer).select(id_col, (F.col("rank") - 1).alias("rank0"))) for q in wanted]
    fused = fuse([(r, RRF_K) for r in (lists[0], *lists)], id_col).select(id_col, F.round("fused", 9).alias("fused"))
    best = balance_pool(indexed.select(id_col, layer).join(F.broadcast(fused), id_col), k, layer, F.desc("fused"), F.asc(id_col))
    return layer_balanced(best, k, layer).select(id_col, layer, "fused", F.least(F.col("rank0") + 1, F.lit(k)).cast("long").alias("rank"))
