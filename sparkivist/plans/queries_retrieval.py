"""Queries of the text, ranking and retrieval operators over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkivist.functions import chunkers
from sparkivist.functions import text as T
from sparkivist.operators import gates, index, ranking, vectors
from sparkivist.plans.session import cut_lineage, table

QUERY = "the budget for the winter trip to Haldenmere"
QUERY_HAN = "冬天出行的预算和两只白鹭的故事"
VARIANT = "what the winter trip costs"
PROBES = ["the budget for the winter trip", "两只白鹭的故事", "submarine quokka zeppelin", "a"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d).select("doc_id", T.ngrams("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_bigrams"), F.size(F.array_distinct("t")).alias("n_distinct"))


def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    n = _docs(spark, d).select(F.size(T.ngrams("text")).alias("n"))
    return n.agg(F.count("*").alias("n_docs"), F.sum("n").alias("total_bigrams"), F.round(F.avg("n"), 6).alias("avgdl"), F.max("n").alias("longest"))


def token_df(spark: SparkSession, d: str) -> DataFrame:
    return ranking.postings(_docs(spark, d)).groupBy("token").agg(F.count("*").alias("df"))


def word_df(spark: SparkSession, d: str) -> DataFrame:
    w = _docs(spark, d).select(F.explode(F.array_distinct(T.words("text"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("df"))


def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    c = _docs(spark, d).select("doc_id", F.explode(T.chunk_fixed("text")).alias("c"))
    return c.select("doc_id", F.col("c.chunk_no").cast("long").alias("chunk_no"), F.md5("c.chunk").alias("hash"))


def chunk_heading(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.chunk_table(_docs(spark, d), "heading")


def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    return chunkers.chunk_table(_docs(spark, d), "semantic")


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _docs(spark, d).select("doc_id", T.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"))


def record_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "memory_entries")
    return e.select("entry_id", "record_id", F.substring(F.md5("text"), 1, 16).alias("computed")).distinct()


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    s = ranking.bm25_scores(_docs(spark, d), QUERY).select("doc_id", F.round("score", 6).alias("score"))
    return ranking.top(s, 10, F.desc("score"), F.asc("doc_id"))


def bm25_han(spark: SparkSession, d: str) -> DataFrame:
    s = ranking.bm25_scores(_docs(spark, d), QUERY_HAN).select("doc_id", F.round("score", 6).alias("score"))
    return ranking.top(s, 10, F.desc("score"), F.asc("doc_id"))


def lexical_admit(spark: SparkSession, d: str) -> DataFrame:
    return ranking.bm25_scores(_docs(spark, d), QUERY).where("admitted").select("doc_id")


def _profile(docs: DataFrame, q: str) -> DataFrame:
    s = ranking.query_statistics(docs, q)
    n_tokens = len(T.query_ngrams(q))
    missing = F.size(F.filter("dfs", lambda x: x == 0))
    common = F.forall("dfs", lambda x: x > ranking.distinctive_cap(F.col("n")))
    rate = F.round(missing / n_tokens, 6) if n_tokens else F.lit(1.0)
    return s.select(F.lit(q).alias("query"), F.lit(n_tokens).alias("tokens"), rate.alias("miss_rate"), (rate >= 0.35).alias("annotate"), (common & F.lit(n_tokens > 0)).alias("too_common"))


def query_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    out = _profile(docs, PROBES[0])
    for q in PROBES[1:]:
        out = out.unionByName(_profile(docs, q))
    return out


def bigram_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    s = ranking.cosine_scores(_docs(spark, d), QUERY).select("doc_id", F.round("cosine", 6).alias("cosine"))
    return ranking.top(s, 10, F.desc("cosine"), F.asc("doc_id"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 100 = 0"), 5).select("query_id", "vec_id", F.round("cosine", 4).alias("cosine"), "rank")


def rrf_two_route(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    a = cut_lineage(ranking.bm25_scores(docs, QUERY).where("admitted").select("doc_id", F.round("score", 6).alias("score")))
    b = ranking.cosine_scores(docs.join(a.select("doc_id"), "doc_id", "left_semi"), QUERY).select("doc_id", F.round("cosine", 6).alias("score"))
    order = (F.desc("score"), F.asc("doc_id"))
    fused = ranking.fuse([(ranking.global_rank(a, *order), 60), (ranking.global_rank(b, *order), 60)]).select("doc_id", F.round("fused", 9).alias("fused"))
    return ranking.top(fused, 20, F.desc("fused"), F.asc("doc_id"))


def layer_balanced_topk(spark: SparkSession, d: str) -> DataFrame:
    s = ranking.bm25_scores(_docs(spark, d), QUERY_HAN, keep=("layer",)).where("admitted").select("doc_id", "layer", F.round("score", 6).alias("score"))
    ranked = ranking.global_rank(s, F.desc("score"), F.asc("doc_id"))
    return ranking.layer_balanced(ranked, 5).select("doc_id", "layer", "score")


def two_query_fusion(spark: SparkSession, d: str) -> DataFrame:
    docs, lists = _docs(spark, d), []
    for q, votes in ((QUERY, 2), (VARIANT, 1)):
        s = ranking.bm25_scores(docs, q).where("admitted").select("doc_id", F.round("score", 6).alias("score"))
        r = ranking.top(s, 20, F.desc("score"), F.asc("doc_id")).select("doc_id", (F.col("rank") - 1).alias("rank0"))
        lists += [(r, 60)] * votes
    fused = ranking.fuse(lists).select("doc_id", F.round("fused", 9).alias("fused"))
    return ranking.top(fused, 10, F.desc("fused"), F.asc("doc_id"))


def two_query_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The whole retrieval by two queries; ``two_query_fusion`` fuses their lexical lists only."""
    return ranking.retrieve_queries(_docs(spark, d), [QUERY, VARIANT])


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return ranking.graph_edges(_docs(spark, d))


def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return ranking.hybrid_retrieve(_docs(spark, d), QUERY)


def rerank_ngram(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    s = ranking.bm25_scores(docs, QUERY).where("admitted").select("doc_id", F.round("score", 6).alias("score"))
    coarse = docs.select("doc_id", "text").join(F.broadcast(s.orderBy(F.desc("score"), "doc_id").limit(20)), "doc_id")
    fine = F.lit(0.0)
    for n, w in ((2, 1.0), (3, 2.0), (4, 4.0)):
        q = T.query_ngrams(QUERY, n)
        fine = fine + w * F.size(F.array_intersect(T.ngrams("text", n), F.array(*map(F.lit, q)))) / len(q)
    return ranking.top(coarse.select("doc_id", "score", F.round(fine, 6).alias("fine")), 20, F.desc("fine"), F.desc("score"), F.asc("doc_id")).select("doc_id", "fine", "rank")


def same_claim_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share a distinctive bigram with any of the query's three best; a set, in no order."""
    docs = _docs(spark, d)
    s = ranking.bm25_scores(docs, QUERY).where("admitted").select("doc_id", F.round("score", 6).alias("score"))
    heads = cut_lineage(s.orderBy(F.desc("score"), "doc_id").limit(3).select("doc_id"))
    p = cut_lineage(ranking.distinctive_postings(cut_lineage(index.build(docs)), cap=None))
    claims = p.join(F.broadcast(heads), "doc_id").select("gram").distinct()
    near = p.join(claims, "gram", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))
    rest = near.join(F.broadcast(heads), "doc_id", "left_anti").join(docs.select("doc_id", "local_date"), "doc_id")
    return rest.select("doc_id", "shared", "local_date")


def gate_spans(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the n-gram gates of length two to eight admit for the query."""
    docs, aggs = _docs(spark, d), []
    for n in (2, 3, 4, 6, 8):
        q = F.array(*map(F.lit, T.query_ngrams(QUERY, n)))
        aggs.append(F.struct(F.lit(n).alias("span"), F.count_if(F.arrays_overlap(T.ngrams("text", n), q)).alias("admitted"), F.count_if(F.size(F.array_intersect(T.ngrams("text", n), q)) >= 2).alias("admitted_twice")))
    return docs.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def absent_probe_screen(spark: SparkSession, d: str) -> DataFrame:
    return gates.absent_probes(_docs(spark, d), [("a submarine", ["submarine", "潜水艇"]), ("the winter trip", ["winter trip"]), ("anything", []), ("白鹭", ["白鹭"])])


def gold1_screen(spark: SparkSession, d: str) -> DataFrame:
    return gates.present_probes(_docs(spark, d), [("one anchor", ["budget"]), ("herons and tea", ["two herons", "tea that tastes of smoke"]), ("nothing", ["submarine", "zeppelin"]), ("白鹭与茶", ["两只白鹭", "带烟味的茶"])])


def hotword_stats(spark: SparkSession, d: str) -> DataFrame:
    return gates.hotword_stats(_docs(spark, d))


def leakage_scan(spark: SparkSession, d: str) -> DataFrame:
    """Twelve-character strings of the facts that also occur in the documents."""
    return gates.shared_ngrams(_docs(spark, d), table(spark, d, "passive_facts").groupBy("fact_id").agg(F.max("fact").alias("text")).select(F.col("fact_id").alias("target_id"), "text"))


def term_matches(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return docs.agg(*[F.count_if(gates.contains_term("text", t)).alias(n) for n, t in (("winter", "winter"), ("tea", "tea"), ("herons", "two herons"), ("cat_han", "猫的生日"))])


def clipped_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut to 200 characters with a note of how many follow."""
    t = F.coalesce("text", F.lit(""))
    cut = F.concat(F.regexp_replace(F.substring(t, 1, 200), r"\s+$", ""), F.lit(" [+"), (F.length(t) - 200).cast("string"), F.lit("]"))
    return _docs(spark, d).select("doc_id", F.md5(F.when(F.length(t) > 200, cut).otherwise(t)).alias("hash"))


QUERIES = {
    f.__name__: f
    for f in (
        bigram_counts, doc_stats, token_df, word_df, chunk_fixed, chunk_heading, chunk_semantic, sentence_counts, record_ids, bm25_topk, bm25_han, lexical_admit, query_profile, bigram_cosine_topk, vector_topk,
        rrf_two_route, layer_balanced_topk, two_query_fusion, two_query_retrieve, graph_edges, hybrid_retrieve, rerank_ngram, same_claim_survivors, gate_spans, absent_probe_screen, gold1_screen, hotword_stats, leakage_scan, term_matches, clipped_texts,
    )
}
