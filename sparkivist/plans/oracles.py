"""The core queries as SQL for DuckDB, written for the data model rather than for speed."""

from __future__ import annotations

import re

from sparkivist.functions.text import query_ngrams
from sparkivist.operators import gates
from sparkivist.operators.gates import CURRENT_TERMS, GENERIC, HISTORY_TERMS, LOW_INFORMATION
from sparkivist.plans import oracles_folds, oracles_state
from sparkivist.plans.queries_records import NOW
from sparkivist.plans.queries_retrieval import PROBES, QUERY, QUERY_HAN, VARIANT
from sparkivist.plans.queries_evaluation import THRESHOLDS


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_lit, values)) + "]::VARCHAR[]"


_FOLD = r"regexp_replace(lower(coalesce(text, '')), '[^\pL\pN_]', '', 'g')"
_FOLD_CASE = r"regexp_replace(coalesce(text, ''), '[^\pL\pN_]', '', 'g')"


def _grams(folded: str, n: int = 2) -> str:
    """n-grams through the list of characters, so that long texts stay linear."""
    return f"list_transform(range(1, length({folded}) - {n - 2}), lambda i: substring({folded}, i, {n}))"


_TOKS = f"""f AS MATERIALIZED (SELECT doc_id, source, layer, local_date, text, {_FOLD} AS s, {_FOLD_CASE} AS sc FROM documents),
toks AS MATERIALIZED (SELECT doc_id, layer, local_date, {_grams('s')} AS t, {_grams('sc')} AS tc FROM f),
n AS (SELECT count(*) AS n, sum(len(t)) * 1.0 / count(*) AS avgdl FROM toks),
post AS MATERIALIZED (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM toks) GROUP BY ALL),
dfs AS MATERIALIZED (SELECT token, count(*) AS df FROM post GROUP BY token)"""


def _bm25(query: str, name: str = "b") -> str:
    """CTE: doc_id, score, admitted of documents with a token of the query."""
    return f"""{name} AS MATERIALIZED (SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(len(t), 1) / avgdl))), 6) AS score,
  bool_or(df <= greatest(3, n // 5)) AS admitted
FROM post JOIN dfs USING (token) JOIN toks USING (doc_id), n WHERE list_contains({_list(query_ngrams(query))}, token) GROUP BY doc_id)"""


def _cosine(query: str) -> str:
    s = re.sub(r"[^\w]", "", query)
    grams = [s[i : i + 2] for i in range(len(s) - 1)]
    return f"""pc AS MATERIALIZED (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(tc) AS token FROM toks) GROUP BY ALL),
qc AS (SELECT token, count(*) AS qf FROM (SELECT unnest({_list(grams)}) AS token) GROUP BY token),
c AS MATERIALIZED (SELECT doc_id, round(sum(tf * qf) / (max(norm) * (SELECT sqrt(sum(qf * qf)) FROM qc)), 6) AS cosine FROM pc JOIN qc USING (token)
  JOIN (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM pc GROUP BY doc_id) USING (doc_id) GROUP BY doc_id)"""


_DIST = """dp AS MATERIALIZED (SELECT doc_id, token, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM post JOIN dfs USING (token), n WHERE df >= 2 AND df <= {cap})"""
_CAP64 = "least(greatest(3, n // 5), 64)"

_NEAR = """unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
nrm AS MATERIALIZED (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM unit),
ranked AS MATERIALIZED (SELECT q.vec_id AS query_id, r.vec_id, round(list_dot_product(q.v, r.v), 6) AS c6, q.label = r.label AS relevant, r.label AS block,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, r.v), 6) DESC, r.vec_id) AS rank
  FROM nrm q, nrm r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
near AS MATERIALIZED (SELECT query_id, vec_id, round(c6, 4) AS cosine, rank, relevant, block FROM ranked WHERE rank <= {k})"""

_EPOCH = "CASE WHEN epoch IS NULL OR isnan(epoch) OR epoch <= 0 THEN NULL WHEN epoch > 1e11 THEN epoch / 1000 ELSE epoch END"
_WS = r"[\s\x{3000}\x{a0}]"
_EVENTS = f"""ev AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS ts, 1 + value / 100 AS weight, event_type = 'error' AS mtime, user_id || '|' || strftime(ts, '%Y-%m-%d %H') AS source_key, strftime(ts, '%Y-%m-%d') AS day FROM events),
sc AS (SELECT *, round((CASE WHEN mtime OR ts IS NULL OR ts > {NOW} + 86400 THEN 0.0 ELSE pow(0.5, greatest({NOW} - ts, 0.0) / 86400.0 / 7.0) END) * least(weight, 2.0), 9) AS score FROM ev)"""
_FACTS = """live AS (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY written NULLS LAST, fact_id) AS n FROM passive_facts WHERE fact IS NOT NULL AND trim(fact) <> '' AND coalesce(tag, '') <> 'meta'),
cf AS MATERIALIZED (SELECT * FROM live WHERE n = 1)"""
_FACT_SETS = r"""fs AS MATERIALIZED (SELECT fact_id, written, event_date, list_distinct(list_transform(range(1, length(s)), lambda i: substring(s, i, 2))) AS s FROM (SELECT *, regexp_replace(lower(fact), '[^\pL\pN_]', '', 'g') AS s FROM cf)),
fd AS (SELECT DISTINCT fact_id, s, day FROM (SELECT fact_id, s, written AS day FROM fs UNION ALL SELECT fact_id, s, event_date FROM fs) WHERE day IS NOT NULL AND len(s) > 0)"""


def _hybrid(query: str, p: str, k: int) -> str:
    """CTEs, their names begun with p, the last of them {p}top: doc_id and r of the k rows of hybrid retrieval."""
    s = re.sub(r"[^\w]", "", query)
    grams = [s[i : i + 2] for i in range(len(s) - 1)]
    return f"""{_bm25(query, p + 'b')},
{p}qc AS (SELECT token, count(*) AS qf FROM (SELECT unnest({_list(grams)}) AS token) GROUP BY token),
{p}c AS MATERIALIZED (SELECT doc_id, round(sum(tf * qf) / (max(norm) * (SELECT sqrt(sum(qf * qf)) FROM {p}qc)), 6) AS cosine FROM pc JOIN {p}qc USING (token) JOIN norms USING (doc_id) GROUP BY doc_id),
{p}lex AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM {p}b WHERE admitted),
{p}vec AS (SELECT doc_id, row_number() OVER (ORDER BY cosine DESC, doc_id) AS r FROM {p}c WHERE doc_id IN (SELECT doc_id FROM {p}lex)),
{p}seeds AS MATERIALIZED (SELECT doc_id, min(pos) AS pos FROM (SELECT doc_id, r - 1 AS pos FROM {p}lex WHERE r <= 3 UNION ALL SELECT doc_id, r + 2 FROM {p}vec WHERE r <= 3) GROUP BY doc_id),
{p}e AS (SELECT s.doc_id AS src, s.pos, b.doc_id AS dst, round(sum(a.idf), 6) AS strength FROM {p}seeds s JOIN dp a USING (doc_id) JOIN dp b USING (token) WHERE b.doc_id <> s.doc_id GROUP BY ALL),
{p}nb AS (SELECT pos, dst, row_number() OVER (PARTITION BY src ORDER BY strength DESC, dst) AS rank FROM {p}e),
{p}walk AS (SELECT doc_id, pos AS major, 0 AS minor FROM {p}seeds UNION ALL SELECT dst, 100, pos * 10 + rank FROM {p}nb WHERE rank <= 5),
{p}graph AS (SELECT doc_id, row_number() OVER (ORDER BY min(major * 1000 + minor)) AS r FROM {p}walk GROUP BY doc_id),
{p}fused AS (SELECT doc_id, round(sum(part), 9) AS fused FROM (
  SELECT doc_id, 1.0 / (60 + r) AS part FROM {p}lex UNION ALL SELECT doc_id, 1.0 / (60 + r) FROM {p}vec
  UNION ALL SELECT doc_id, 1.0 / (5 + r) FROM {p}graph WHERE EXISTS (SELECT 1 FROM {p}graph WHERE doc_id NOT IN (SELECT doc_id FROM {p}seeds))) GROUP BY doc_id),
{p}r AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY fused DESC, doc_id) AS r, layer FROM {p}fused JOIN toks USING (doc_id)),
{p}h AS (SELECT min(r) AS r FROM (SELECT min(r) AS r FROM {p}r GROUP BY layer) WHERE r > {k}),
{p}top AS MATERIALIZED (SELECT doc_id, least(r, {k}) AS r FROM {p}r WHERE r < {k} OR r = coalesce((SELECT r FROM {p}h), {k}))"""


def _contains(term: str) -> str:
    if term.isascii():
        return f"regexp_matches(coalesce(text, ''), '(?i)(^|[^A-Za-z0-9]){re.escape(term).replace(chr(92) + ' ', ' ')}([^A-Za-z0-9]|$)')"
    return f"contains(coalesce(text, ''), {_lit(term)})"


def _profile(q: str) -> str:
    grams = query_ngrams(q)
    if not grams:
        return f"SELECT {_lit(q)} AS query, 0 AS tokens, 1.0::DOUBLE AS miss_rate, true AS annotate, false AS too_common"
    return f"""SELECT {_lit(q)} AS query, {len(grams)} AS tokens, round(avg((df = 0)::INT), 6) AS miss_rate, round(avg((df = 0)::INT), 6) >= 0.35 AS annotate, bool_and(df > greatest(3, n // 5)) AS too_common
FROM (SELECT g, coalesce(df, 0) AS df FROM (SELECT unnest({_list(grams)}) AS g) LEFT JOIN dfs ON g = token), n GROUP BY ALL HAVING true"""


def _probe(q: str, terms: list[str]) -> str:
    hits = f"(SELECT count(*) FROM documents WHERE {' OR '.join(map(_contains, terms))})" if terms else "0"
    return f"SELECT {_lit(q)} AS question, CASE WHEN {len(terms)} = 0 THEN 'unverified' WHEN {hits} > 0 THEN 'void' ELSE 'valid' END AS verdict, {hits}::BIGINT AS hits"


def _anchors(q: str, anchors: list[str]) -> str:
    n = " + ".join(f"({_contains(a)})::INT" for a in anchors)
    k = len(anchors)
    return f"""SELECT {_lit(q)} AS question, "full", half, CASE WHEN {k} < 2 THEN 'too_few_anchors' WHEN "full" = 0 THEN 'absent' WHEN "full" > 1 THEN 'several' WHEN half > 0 THEN 'half_match' ELSE 'gold' END AS verdict
FROM (SELECT count(*) FILTER (m = {k}) AS "full", count(*) FILTER (m >= {-(-k // 2)} AND m < {k}) AS half FROM (SELECT {n} AS m FROM documents))"""


def _spans() -> str:
    parts = []
    for n in (2, 3, 4, 6, 8):
        q = _list(query_ngrams(QUERY, n))
        parts.append(f"SELECT {n} AS span, count(*) FILTER (k >= 1) AS admitted, count(*) FILTER (k >= 2) AS admitted_twice FROM (SELECT len(list_intersect({_grams('s', n)}, {q})) AS k FROM f)")
    return f"WITH {_TOKS} " + " UNION ALL ".join(parts)


def _fine() -> str:
    return " + ".join(f"{w} * len(list_intersect({_grams('s', n)}, {_list(query_ngrams(QUERY, n))})) / {len(query_ngrams(QUERY, n))}" for n, w in ((2, 1.0), (3, 2.0), (4, 4.0)))


def sql() -> dict[str, str]:
    out = {
        "bigram_counts": f"WITH {_TOKS} SELECT doc_id, len(t)::INT AS n_bigrams, len(list_distinct(t))::INT AS n_distinct FROM toks",
        "doc_stats": f"WITH {_TOKS} SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS total_bigrams, round(avg(len(t)), 6) AS avgdl, max(len(t))::INT AS longest FROM toks",
        "token_df": f"WITH {_TOKS} SELECT token, df FROM dfs",
        "word_df": r"SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+'))) AS word FROM documents) GROUP BY word",
        "chunk_fixed": r"""SELECT doc_id, i AS chunk_no, md5(c) AS hash FROM (
            SELECT doc_id, i, regexp_replace(substring(text, i * 400 + 1, 500), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') AS c FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text) - 100, 1) - 1) // 400 + 1)) AS i FROM documents WHERE text IS NOT NULL)) WHERE c <> ''""",
        "record_ids": "SELECT DISTINCT entry_id, record_id, substring(md5(text), 1, 16) AS computed FROM memory_entries",
        "bm25_topk": f"WITH {_TOKS}, {_bm25(QUERY)} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b ORDER BY score DESC, doc_id LIMIT 10",
        "bm25_han": f"WITH {_TOKS}, {_bm25(QUERY_HAN)} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b ORDER BY score DESC, doc_id LIMIT 10",
        "lexical_admit": f"WITH {_TOKS}, {_bm25(QUERY)} SELECT doc_id FROM b WHERE admitted",
        "query_profile": f"WITH {_TOKS} " + " UNION ALL ".join(map(_profile, PROBES)),
        "bigram_cosine_topk": f"WITH {_TOKS}, {_cosine(QUERY)} SELECT doc_id, cosine, row_number() OVER (ORDER BY cosine DESC, doc_id) AS rank FROM c ORDER BY cosine DESC, doc_id LIMIT 10",
        "vector_topk": f"WITH {_NEAR.format(k=5)} SELECT query_id, vec_id, cosine, rank FROM near",
        "rrf_two_route": f"""WITH {_TOKS}, {_bm25(QUERY)}, {_cosine(QUERY)},
            fused AS (SELECT doc_id, round(sum(1.0 / (60 + r)), 9) AS fused FROM (
              SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b WHERE admitted
              UNION ALL SELECT doc_id, row_number() OVER (ORDER BY cosine DESC, doc_id) FROM c WHERE doc_id IN (SELECT doc_id FROM b WHERE admitted)) GROUP BY doc_id)
            SELECT doc_id, fused, row_number() OVER (ORDER BY fused DESC, doc_id) AS rank FROM fused ORDER BY fused DESC, doc_id LIMIT 20""",
        "layer_balanced_topk": f"""WITH {_TOKS}, {_bm25(QUERY_HAN)},
            r AS (SELECT doc_id, layer, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b JOIN toks USING (doc_id) WHERE admitted),
            h AS (SELECT min(r) AS r FROM (SELECT layer, min(r) AS r FROM r GROUP BY layer) WHERE r > 5)
            SELECT doc_id, layer, score FROM r WHERE r <= 4 OR r = coalesce((SELECT r FROM h), 5)""",
        "two_query_fusion": f"""WITH {_TOKS}, {_bm25(QUERY)}, {_bm25(VARIANT, 'v')},
            fused AS (SELECT doc_id, round(sum(votes * 1.0 / (60 + r)), 9) AS fused FROM (
              SELECT doc_id, 2 AS votes, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b WHERE admitted
              UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY score DESC, doc_id) FROM v WHERE admitted) WHERE r <= 20 GROUP BY doc_id)
            SELECT doc_id, fused, row_number() OVER (ORDER BY fused DESC, doc_id) AS rank FROM fused ORDER BY fused DESC, doc_id LIMIT 10""",
        "two_query_retrieve": f"""WITH {_TOKS}, {_DIST.format(cap=_CAP64)},
            pc AS MATERIALIZED (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(tc) AS token FROM toks) GROUP BY ALL),
            norms AS MATERIALIZED (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM pc GROUP BY doc_id),
            {_hybrid(QUERY, 'q', 20)}, {_hybrid(VARIANT, 'v', 20)},
            fused AS (SELECT doc_id, round(sum(votes * 1.0 / (60 + r)), 9) AS fused FROM (SELECT doc_id, 2 AS votes, r FROM qtop UNION ALL SELECT doc_id, 1, r FROM vtop) GROUP BY doc_id),
            r AS (SELECT doc_id, layer, fused, row_number() OVER (ORDER BY fused DESC, doc_id) AS r FROM fused JOIN toks USING (doc_id)),
            h AS (SELECT min(r) AS r FROM (SELECT min(r) AS r FROM r GROUP BY layer) WHERE r > 10)
            SELECT doc_id, layer, fused, least(r, 10) AS rank FROM r WHERE r <= 9 OR r = coalesce((SELECT r FROM h), 10)""",
        "graph_edges": f"""WITH {_TOKS}, {_DIST.format(cap=_CAP64)},
            e AS (SELECT a.doc_id AS src, b.doc_id AS dst, round(sum(a.idf), 6) AS strength FROM dp a JOIN dp b USING (token) WHERE a.doc_id <> b.doc_id GROUP BY ALL)
            SELECT * FROM (SELECT src, dst, strength, row_number() OVER (PARTITION BY src ORDER BY strength DESC, dst) AS rank FROM e) WHERE rank <= 5""",
        "hybrid_retrieve": f"""WITH {_TOKS}, {_bm25(QUERY)}, {_cosine(QUERY)}, {_DIST.format(cap=_CAP64)},
            lex AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM b WHERE admitted),
            vec AS (SELECT doc_id, row_number() OVER (ORDER BY cosine DESC, doc_id) AS r FROM c WHERE doc_id IN (SELECT doc_id FROM lex)),
            seeds AS MATERIALIZED (SELECT doc_id, min(pos) AS pos FROM (SELECT doc_id, r - 1 AS pos FROM lex WHERE r <= 3 UNION ALL SELECT doc_id, r + 2 FROM vec WHERE r <= 3) GROUP BY doc_id),
            e AS (SELECT s.doc_id AS src, s.pos, b.doc_id AS dst, round(sum(a.idf), 6) AS strength FROM seeds s JOIN dp a USING (doc_id) JOIN dp b USING (token) WHERE b.doc_id <> s.doc_id GROUP BY ALL),
            nb AS (SELECT pos, dst, row_number() OVER (PARTITION BY src ORDER BY strength DESC, dst) AS rank FROM e),
            walk AS (SELECT doc_id, pos AS major, 0 AS minor FROM seeds UNION ALL SELECT dst, 100, pos * 10 + rank FROM nb WHERE rank <= 5),
            graph AS (SELECT doc_id, row_number() OVER (ORDER BY min(major * 1000 + minor)) AS r FROM walk GROUP BY doc_id),
            fused AS (SELECT doc_id, round(sum(p), 9) AS fused FROM (
              SELECT doc_id, 1.0 / (60 + r) AS p FROM lex UNION ALL SELECT doc_id, 1.0 / (60 + r) FROM vec
              UNION ALL SELECT doc_id, 1.0 / (5 + r) FROM graph WHERE EXISTS (SELECT 1 FROM graph WHERE doc_id NOT IN (SELECT doc_id FROM seeds))) GROUP BY doc_id),
            r AS (SELECT doc_id, layer, fused, row_number() OVER (ORDER BY fused DESC, doc_id) AS r FROM fused JOIN toks USING (doc_id)),
            h AS (SELECT min(r) AS r FROM (SELECT layer, min(r) AS r FROM r GROUP BY layer) WHERE r > 10)
            SELECT doc_id, layer, fused, least(r, 10) AS rank FROM r WHERE r <= 9 OR r = coalesce((SELECT r FROM h), 10)""",
        "rerank_ngram": f"""WITH {_TOKS}, {_bm25(QUERY)}, coarse AS (SELECT doc_id, score FROM b WHERE admitted ORDER BY score DESC, doc_id LIMIT 20),
            x AS (SELECT doc_id, score, round({_fine()}, 6) AS fine FROM coarse JOIN f USING (doc_id))
            SELECT doc_id, fine, row_number() OVER (ORDER BY fine DESC, score DESC, doc_id) AS rank FROM x""",
        "same_claim_survivors": f"""WITH {_TOKS}, {_bm25(QUERY)}, {_DIST.format(cap='greatest(3, n // 5)')}, heads AS (SELECT doc_id FROM b WHERE admitted ORDER BY score DESC, doc_id LIMIT 3)
            SELECT doc_id, count(*) AS shared, any_value(local_date) AS local_date FROM dp JOIN toks USING (doc_id) WHERE token IN (SELECT token FROM dp WHERE doc_id IN (SELECT doc_id FROM heads)) AND doc_id NOT IN (SELECT doc_id FROM heads) GROUP BY doc_id""",
        "gate_spans": _spans(),
        "absent_probe_screen": " UNION ALL ".join(_probe(q, t) for q, t in [("a submarine", ["submarine", "潜水艇"]), ("the winter trip", ["winter trip"]), ("anything", []), ("白鹭", ["白鹭"])]),
        "gold1_screen": " UNION ALL ".join(
            _anchors(q, t) for q, t in [("one anchor", ["budget"]), ("herons and tea", ["two herons", "tea that tastes of smoke"]), ("nothing", ["submarine", "zeppelin"]), ("白鹭与茶", ["两只白鹭", "带烟味的茶"])]
        ),
        "hotword_stats": r"""SELECT word, count(*) AS blocks, count(DISTINCT source) AS sources, count(*) FILTER (layer = 'timeline') AS timeline_blocks, count(*) FILTER (layer = 'index') AS index_blocks, min(local_date) AS first_day, max(local_date) AS last_day,
            count(DISTINCT source) <= 12 AND count(*) <= 18 AND length(word) >= 3 AND NOT regexp_matches(word, '^\pN+$') AS hot
            FROM (SELECT doc_id, source, layer, local_date, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+'))) AS word FROM documents) GROUP BY word HAVING count(*) >= 2""",
        "leakage_scan": f"""WITH f AS (SELECT doc_id, {_FOLD} AS s FROM documents), h AS MATERIALIZED (SELECT DISTINCT unnest({_grams('s', 12)}) AS g FROM f),
            t AS (SELECT fact_id, regexp_replace(lower(max(fact)), '[^\\pL\\pN_]', '', 'g') AS s FROM passive_facts GROUP BY fact_id), w AS (SELECT fact_id, unnest(list_distinct({_grams('s', 12)})) AS g FROM t)
            SELECT fact_id AS target_id, count(*) AS shared FROM w WHERE g IN (SELECT g FROM h) GROUP BY fact_id""",
        "term_matches": f"SELECT count(*) FILTER ({_contains('winter')}) AS winter, count(*) FILTER ({_contains('tea')}) AS tea, count(*) FILTER ({_contains('two herons')}) AS herons, count(*) FILTER ({_contains('猫的生日')}) AS cat_han FROM documents",
        "clipped_texts": r"""SELECT doc_id, md5(CASE WHEN length(coalesce(text, '')) > 200 THEN regexp_replace(substring(text, 1, 200), '[ \t\n\x0b\f\r]+$', '') || ' [+' || (length(text) - 200) || ']' ELSE coalesce(text, '') END) AS hash FROM documents""",
        "recall_recent": f"WITH {_EVENTS} SELECT id, score, row_number() OVER (ORDER BY score DESC, weight DESC, id) AS rank FROM sc ORDER BY score DESC, weight DESC, id LIMIT 20",
        "recall_per_day_cap": f"""WITH {_EVENTS}, b AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY score DESC, weight DESC, id) AS n FROM sc),
            c AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, weight DESC, id) AS m FROM b WHERE n = 1)
            SELECT id, day, score FROM c WHERE m <= 3 ORDER BY score DESC, weight DESC, id LIMIT 20""",
        "recall_weights": "SELECT r.record_id, count(*) AS recalls, round(1 + 0.05 * count(*), 6)::DOUBLE AS weight FROM (SELECT unnest(recall) AS r FROM recall_log) WHERE r.record_id IS NOT NULL GROUP BY r.record_id",
        "most_recalled": "SELECT r.record_id, count(*) AS recalls, round(1 + 0.05 * count(*), 6)::DOUBLE AS weight FROM (SELECT unnest(recall) AS r FROM recall_log) WHERE r.record_id IS NOT NULL GROUP BY r.record_id ORDER BY count(*) DESC, r.record_id LIMIT 25",
        "recalled_snippets": """WITH r AS (SELECT recall_id, unnest(range(0, len(recall)))::INT AS pos, recall FROM recall_log WHERE recalled_at >= (SELECT max(recalled_at) FROM recall_log) - 90 * 86400.0),
            one AS (SELECT record_id, min(substring(text, 1, 160)) AS snippet FROM memory_entries GROUP BY record_id)
            SELECT recall_id, pos, r.recall[pos + 1].record_id AS record_id, recall[pos + 1].local_date AS local_date, round(recall[pos + 1].score, 6) AS score, snippet FROM r LEFT JOIN one ON recall[pos + 1].record_id = one.record_id""",
        "recall_triggers": "SELECT coalesce(trigger_kind, 'none') AS kind, count(*) AS n, sum(coalesce(len(recall), 0))::BIGINT AS recalled, round(max(recalled_at), 3) AS last FROM recall_log GROUP BY kind",
        "days_overview": "WITH d AS (SELECT doc_id AS id, local_date AS day FROM documents WHERE local_date IS NOT NULL) SELECT day, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM d WHERE day::DATE > (SELECT max(day::DATE) FROM d) - 35 GROUP BY day",
        "retracted_visibility": "SELECT DISTINCT entry_id FROM memory_entries e WHERE NOT EXISTS (SELECT 1 FROM retraction_ledger WHERE hash = e.record_id)",
        "retraction_reasons": "SELECT coalesce(reason, '') AS reason, count(*) AS n, count(replaced_by) AS replaced, round(max(retracted_at), 3) AS last FROM retraction_ledger GROUP BY coalesce(reason, '')",
        "supersession_chain": """WITH RECURSIVE l AS (SELECT hash AS rid, min(replaced_by) AS nxt FROM retraction_ledger WHERE hash IS NOT NULL AND replaced_by IS NOT NULL AND hash <> replaced_by GROUP BY hash),
            w AS (SELECT rid, nxt AS current, 1 AS steps FROM l UNION ALL SELECT w.rid, l.nxt, steps + 1 FROM w JOIN l ON w.current = l.rid WHERE steps < 200)
            SELECT rid, current, steps::BIGINT AS steps FROM w WHERE current NOT IN (SELECT rid FROM l)""",
        "chain_violations": """WITH l AS (SELECT hash AS rid, replaced_by AS r FROM retraction_ledger WHERE replaced_by IS NOT NULL)
            SELECT rid, 'dangling' AS code FROM l WHERE NOT EXISTS (SELECT 1 FROM memory_entries WHERE record_id = r) UNION ALL SELECT rid, 'retracted_target' FROM l WHERE r IN (SELECT hash FROM retraction_ledger)
            UNION ALL SELECT rid, 'shared_target' FROM l WHERE r IN (SELECT r FROM l GROUP BY r HAVING count(*) > 1) UNION ALL SELECT rid, 'self_link' FROM l WHERE rid = r""",
        "file_difference": """WITH e AS (SELECT source_id AS place, record_id AS hash, coalesce(year(ingested_at) >= 2025, false) AS late FROM memory_entries WHERE source_id IS NOT NULL AND record_id IS NOT NULL AND ingested_at IS NOT NULL),
            d AS (SELECT place, hash, count(*) FILTER (late) - count(*) FILTER (NOT late) AS delta FROM e GROUP BY ALL HAVING count(*) FILTER (late) <> count(*) FILTER (NOT late)),
            u AS (SELECT place, hash, delta > 0 AS gained, unnest(range(1, abs(delta) + 1)) AS copy FROM d),
            r AS (SELECT *, row_number() OVER (PARTITION BY hash, gained ORDER BY place, copy) AS no, count(*) OVER (PARTITION BY hash, gained) AS mine, count(*) OVER (PARTITION BY hash) AS both_ FROM u)
            SELECT place, hash, CASE WHEN no <= least(mine, both_ - mine) THEN CASE WHEN gained THEN 'moved_in' ELSE 'moved_out' END WHEN gained THEN 'added' ELSE 'retired' END AS change, count(*) AS n FROM r GROUP BY ALL""",
        "session_gap": """SELECT event_id, user_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM (
            SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 > 1800 THEN 1 ELSE 0 END AS brk FROM events)""",
        "session_summary": """WITH s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM (
            SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 > 1800 THEN 1 ELSE 0 END AS brk FROM events))
            SELECT user_id, session_no, count(*) AS events, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS seconds FROM s GROUP BY ALL""",
        "message_epochs": f"SELECT row_id, round({_EPOCH}, 3) AS seconds FROM archive_msgs",
        "message_dedup": f"SELECT conv_key, key, round(min({_EPOCH}), 3) AS epoch, count(*) AS copies FROM archive_msgs GROUP BY conv_key, key",
        "archive_batches": f"""WITH m AS (SELECT source_id, row_id, length(text) AS n, t, strftime(make_timestamp((t * 1e6)::BIGINT), '%Y-%m-%d') AS day FROM (SELECT *, {_EPOCH} AS t FROM archive_msgs) WHERE t IS NOT NULL AND text IS NOT NULL),
            s AS (SELECT source_id, day, n, sum(n) OVER w AS total, row_number() OVER w = 1 AS f FROM m WINDOW w AS (PARTITION BY source_id, day ORDER BY t, row_id ROWS UNBOUNDED PRECEDING))
            SELECT source_id, day, count(*) FILTER (total <= 30000 OR f) AS in_batch, count(*) FILTER (NOT (total <= 30000 OR f)) AS left_over, sum(CASE WHEN total <= 30000 OR f THEN n ELSE 0 END)::BIGINT AS chars FROM s GROUP BY ALL""",
        "import_statistics": "SELECT source_id, count(*) AS rows, count(DISTINCT entry_id) AS entries, count(DISTINCT speaker) AS speakers, count(*) FILTER (lower(trim(timestamp_source)) = 'mtime') AS mtime_rows, count(timestamp) AS timed FROM memory_entries GROUP BY source_id",
        "entry_turns": "SELECT kind, speaker, count(*) AS n FROM (SELECT DISTINCT entry_id, speaker, coalesce(tags[1], 'none') AS kind FROM memory_entries WHERE trim(coalesce(speaker, '')) <> '' AND text IS NOT NULL) GROUP BY ALL",
        "input_gate": rf"""WITH m AS (SELECT row_id, regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '', 'g') AS t FROM archive_msgs WHERE lower(trim(role)) IN ('user', 'human')), w AS (SELECT *, translate(t, {_lit(gates._WIDE)}, {_lit(gates._NARROW)}) AS h FROM m),
            c AS (SELECT *, regexp_replace(lower(h), '[^\pL\pN_]', '', 'g') AS k, len(list_filter(regexp_extract_all(lower(h), '\p{{Han}}{{2,}}|[a-z0-9]{{3,}}'), lambda x: NOT list_contains({_list(GENERIC)}, x))) AS topics FROM w),
            r AS (SELECT row_id, CASE WHEN k = '' THEN 'low_information' WHEN regexp_matches(t, '^/[A-Za-z][A-Za-z0-9_-]*(\s[^\n]*)?$') THEN 'control_command'
              WHEN regexp_matches(t, '^("(?s:.*)"|“(?s:.*)”|「(?s:.*)」|```(?s:.*)```)$') OR (starts_with(t, '>') AND NOT regexp_matches(t, '(?m)^[^>\n]')) THEN 'quoted_or_code_only'
              WHEN k = '嗯' THEN 'licensed_short_trigger' WHEN list_contains({_list(re.sub(r'\W', '', x.lower()) for x in LOW_INFORMATION)}, k) OR topics = 0 THEN 'low_information' ELSE 'specific_user_signal' END AS reason FROM c)
            SELECT row_id, reason IN ('licensed_short_trigger', 'specific_user_signal') AS admit, reason FROM r""",
        "message_intent": f"""SELECT CASE WHEN list_bool_or(list_transform({_list(HISTORY_TERMS)}, lambda x: contains(t, x))) THEN 'history' WHEN list_bool_or(list_transform({_list(CURRENT_TERMS)}, lambda x: contains(t, x))) THEN 'current' ELSE 'none' END AS intent, count(*) AS n
            FROM (SELECT lower(coalesce(text, '')) AS t FROM archive_msgs) GROUP BY intent""",
        "clean_facts": f"WITH {_FACTS} SELECT fact_id, written, tag FROM cf",
        "near_dup_facts": f"""WITH {_FACTS}, {_FACT_SETS}
            SELECT DISTINCT a.fact_id AS fact_a, b.fact_id AS fact_b, round(len(list_intersect(a.s, b.s)) * 1.0 / least(len(a.s), len(b.s)), 6) AS overlap FROM fd a JOIN fd b USING (day) WHERE a.fact_id < b.fact_id AND round(len(list_intersect(a.s, b.s)) * 1.0 / least(len(a.s), len(b.s)), 6) >= 0.3""",
        "fact_search": f"""WITH x AS (SELECT fact_id, regexp_replace(lower(max(fact)), '[^\\pL\\pN_]', '', 'g') AS s, max(tag) AS tag FROM passive_facts GROUP BY fact_id)
            SELECT fact_id, round(len(list_intersect(list_distinct({_grams('s')}), {_list(query_ngrams('两只白鹭的故事 winter trip'))})) * 1.0 / {len(query_ngrams('两只白鹭的故事 winter trip'))}, 6) AS coverage FROM x WHERE coalesce(tag, '') <> 'meta' AND s IS NOT NULL ORDER BY coverage DESC, fact_id LIMIT 12""",
        "facts_per_day": "SELECT written AS day, count(*) FILTER (tag = 'life') AS life, count(*) FILTER (tag = 'work') AS work, count(*) FILTER (coalesce(tag, '') NOT IN ('life', 'work')) AS other, count(*) AS total FROM passive_facts WHERE written IS NOT NULL GROUP BY written",
        "older_states": "WITH s AS (SELECT DISTINCT fact_id, block, event_date FROM passive_facts WHERE kind = 'state' AND event_date IS NOT NULL AND block IS NOT NULL) SELECT DISTINCT fact_id, newest FROM (SELECT *, max(event_date) OVER (PARTITION BY block) AS newest FROM s) WHERE event_date < newest",
        "uncovered_records": "SELECT DISTINCT record_id FROM memory_entries WHERE record_id IS NOT NULL AND record_id NOT IN (SELECT block FROM passive_facts WHERE block IS NOT NULL)",
        "facts_live": "SELECT DISTINCT fact_id, block FROM passive_facts WHERE block IS NOT NULL AND written < '2026-01-01' AND block IN (SELECT record_id FROM memory_entries WHERE record_id IS NOT NULL) AND block NOT IN (SELECT hash FROM retraction_ledger WHERE hash IS NOT NULL)",
        "window_siblings": """WITH f AS (SELECT window_no, arg_min(local_date, doc_id) AS b FROM documents WHERE local_date IS NOT NULL AND window_no IS NOT NULL GROUP BY window_no)
            SELECT doc_id, coalesce(local_date, b) AS local_date, CASE WHEN local_date IS NOT NULL THEN 'own' WHEN b IS NOT NULL THEN 'window_sibling' ELSE 'none' END AS date_source FROM documents LEFT JOIN f USING (window_no)""",
        "index_bridge": "SELECT i.doc_id AS index_id, count(*) AS timeline_docs, min(t.doc_id) AS first_doc FROM documents i JOIN documents t USING (window_no, local_date) WHERE i.layer = 'index' AND t.layer = 'timeline' GROUP BY i.doc_id",
        "json_props": "SELECT event_type, count(*) AS n, sum((props->>'k')::INT)::BIGINT AS sum_k, max((props->>'k')::INT) AS max_k, round(sum(value), 2) AS sum_value FROM events GROUP BY event_type",
        "interval_coverage": """WITH l AS (SELECT l_suppkey, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS s, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) + 1 + l_linenumber AS e FROM lineitem),
            d AS (SELECT DISTINCT l_suppkey, unnest(range(s, e)) AS x FROM l), g AS (SELECT l_suppkey, x, lag(x) OVER (PARTITION BY l_suppkey ORDER BY x) AS p FROM d)
            SELECT l_suppkey, count(*)::BIGINT AS covered, count(*) FILTER (p IS NULL OR x - p > 1) AS pieces FROM g GROUP BY l_suppkey""",
        "event_windows": "SELECT (epoch_us(ts) // 3600000000 * 3600)::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
        "latest_by_user": "SELECT user_id, arg_max(event_id, {'ts': ts, 'id': event_id}) AS event_id, arg_max(event_type, {'ts': ts, 'id': event_id}) AS event_type FROM events GROUP BY user_id",
        "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity::DOUBLE), 2) AS sum_qty, round(sum(l_extendedprice::DOUBLE), 2) AS sum_price, count(*) AS n FROM lineitem GROUP BY ALL",
        "transcript": f"""WITH m AS (SELECT *, {_EPOCH} AS t FROM archive_msgs), x AS (SELECT conv_key, row_id, round(t, 3) AS t, strftime(make_timestamp((t * 1e6)::BIGINT), '%Y-%m-%d') AS day, '[' || strftime(make_timestamp((t * 1e6)::BIGINT), '%H:%M') || '] ' || coalesce(role, '') || '：' || text AS line FROM m WHERE t IS NOT NULL AND text IS NOT NULL)
            SELECT conv_key, day, row_number() OVER (PARTITION BY conv_key, day ORDER BY t, row_id) AS line_no, md5(line) AS hash FROM x""",
        "auc_rank_sum": f"""WITH {_NEAR.format(k=11)} SELECT round(sum(CASE WHEN a.cosine > b.cosine THEN 1.0 WHEN a.cosine = b.cosine THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), 6) AS auc, (SELECT count(*) FROM near WHERE relevant) AS positives, (SELECT count(*) FROM near WHERE NOT relevant) AS negatives
            FROM near a, near b WHERE a.relevant AND NOT b.relevant""",
        "auc_event_values": """WITH p AS (SELECT event_type = 'click' AS c, count(*) OVER (ORDER BY value) AS upto, count(*) OVER (PARTITION BY value) AS same FROM events WHERE value IS NOT NULL), r AS (SELECT c, upto - (same - 1) / 2.0 AS rank FROM p)
            SELECT round((sum(rank) FILTER (c) - count(*) FILTER (c) * (count(*) FILTER (c) + 1) / 2.0)::DOUBLE / (count(*) FILTER (c) * count(*) FILTER (NOT c)), 6) AS auc, count(*) FILTER (c) AS positives, count(*) FILTER (NOT c) AS negatives FROM r""",
        "floor_sweep": f"""WITH {_NEAR.format(k=11)} SELECT threshold, kept, relevant, round(CASE WHEN kept > 0 THEN relevant * 1.0 / kept END, 6)::DOUBLE AS precision, round(CASE WHEN a > 0 THEN relevant * 1.0 / a END, 6)::DOUBLE AS retention FROM (
            SELECT threshold, count(*) FILTER (cosine >= threshold) AS kept, count(*) FILTER (cosine >= threshold AND relevant) AS relevant, count(*) FILTER (relevant) AS a FROM near, (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold) GROUP BY threshold)""",
        "nearest_rank_percentiles": """WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
            SELECT event_type, percent, value FROM v, (SELECT unnest([5, 25, 50, 75, 90, 99]) AS percent) WHERE r = greatest(ceil(percent * n / 100.0), 1)""",
        "upper_medians": "WITH v AS (SELECT coalesce(source, '') AS source, n_chars, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY coalesce(source, '')) AS n FROM documents WHERE n_chars IS NOT NULL) SELECT source, n_chars AS median FROM v WHERE r = n // 2 + 1",
        "recall_mrr": f"""WITH {_NEAR.format(k=5)}, b AS (SELECT e.vec_id, 'label_' || label AS kind, (SELECT min(rank) FROM near WHERE query_id = e.vec_id AND relevant) AS rank FROM embeddings e WHERE vec_id % 100 = 0)
            SELECT kind, count(*) AS queries, round(avg((coalesce(rank, 0) = 1)::INT), 6) AS hit_at_1, round(avg((rank IS NOT NULL)::INT), 6) AS recall, round(avg(coalesce(1.0 / rank, 0)), 6)::DOUBLE AS mrr FROM b GROUP BY kind""",
        "fact_margin_lead": f"""WITH {_NEAR.format(k=11)} SELECT query_id, round(max(cosine) FILTER (rank = 1) - max(cosine) FILTER (rank = 2), 6) AS margin, round(max(cosine) FILTER (rank = 1) - avg(cosine) FILTER (rank BETWEEN 2 AND 11), 6) AS lead FROM near GROUP BY query_id""",
        "supersede_hint": f"""WITH {_NEAR.format(k=11)}, g AS (SELECT query_id, coalesce(max(cosine) FILTER (rank = 1), 0) AS s1, coalesce(max(cosine) FILTER (rank = 2), 0) AS s2, coalesce(max(cosine) FILTER (rank = 3), 0) AS s3 FROM near GROUP BY query_id)
            SELECT query_id, CASE WHEN s1 >= 0.4 AND round(s1 - s2, 4) >= 0.02 THEN 'first' WHEN s2 >= 0.4 AND round(s2 - s3, 4) >= 0.02 THEN 'second' ELSE 'none' END AS hint FROM g""",
        "hint_rate_grid": f"""WITH {_NEAR.format(k=11)}, g AS (SELECT query_id, coalesce(max(cosine) FILTER (rank = 1), 0) AS s1, coalesce(max(cosine) FILTER (rank = 2), 0) AS s2, coalesce(max(cosine) FILTER (rank = 3), 0) AS s3 FROM near GROUP BY query_id),
            p AS (SELECT line, lead FROM (SELECT unnest([0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS line), (SELECT unnest([0.0, 0.02, 0.05]::DOUBLE[]) AS lead))
            SELECT line, lead, round(avg(((s1 >= line AND round(s1 - s2, 4) >= lead) OR (s2 >= line AND round(s2 - s3, 4) >= lead))::INT), 6) AS rate FROM g, p GROUP BY ALL""",
    }
    role = "CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'model') THEN 'assistant' END"
    spoken = f"sp AS (SELECT conv_key, key, row_id, {role} AS role, round({_EPOCH}, 3) AS at_, length(coalesce(text, '')) AS chars FROM archive_msgs)"
    hits = " + ".join(f"({_contains(t)})::INT" for t in ("winter trip", "cat", "garden wall"))
    out |= {
        "topic_coverage": f"SELECT doc_id, hits, round(hits / 3.0, 6)::DOUBLE AS coverage FROM (SELECT doc_id, {hits} AS hits FROM documents) WHERE hits > 0 AND hits / 3.0 >= 0.6",
        "delivery_budget": """WITH one AS (SELECT record_id, max(strlen(text)) AS bytes FROM memory_entries WHERE text IS NOT NULL GROUP BY record_id),
            r AS (SELECT recall_id, unnest(range(0, len(recall))) AS pos, recall FROM recall_log),
            x AS (SELECT recall_id, pos, recall[pos + 1].record_id AS record_id, recall[pos + 1].score AS score FROM r),
            s AS (SELECT recall_id, x.record_id, sum(bytes) OVER (PARTITION BY recall_id ORDER BY -score NULLS FIRST, pos ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM x JOIN one ON x.record_id = one.record_id)
            SELECT recall_id, record_id, used FROM s WHERE used <= 2400""",
        "first_exchange": f"""WITH {spoken} SELECT conv_key, arg_min(key, {{'a': at_, 'k': key}}) FILTER (role = 'user') AS first_user, arg_min(key, {{'a': at_, 'k': key}}) FILTER (role = 'assistant') AS first_reply FROM sp WHERE at_ IS NOT NULL AND conv_key IS NOT NULL GROUP BY conv_key""",
        "boundary_cut": f"""WITH {spoken}, m AS (SELECT * FROM sp WHERE at_ IS NOT NULL AND conv_key IS NOT NULL), t AS (SELECT *, sum(chars) OVER (PARTITION BY conv_key ORDER BY at_ DESC, row_id DESC ROWS UNBOUNDED PRECEDING) AS tail FROM m),
            b AS (SELECT conv_key, max({{'a': at_, 'r': row_id}}) AS p FROM t WHERE tail >= 2000 GROUP BY conv_key)
            SELECT conv_key, arg_min(row_id, {{'a': at_, 'r': row_id}}) AS cut_at FROM m JOIN b USING (conv_key) WHERE role = 'user' AND {{'a': at_, 'r': row_id}} >= p GROUP BY conv_key""",
        "source_drift": """WITH c AS (SELECT source_id, count(*) FILTER (year(ingested_at) < 2025) AS before, count(*) FILTER (year(ingested_at) >= 2025) AS after FROM memory_entries WHERE source_id IS NOT NULL AND ingested_at IS NOT NULL GROUP BY source_id)
            SELECT source_id, before, after, CASE WHEN before = 0 THEN 'new' WHEN after = 0 THEN 'gone' WHEN after * 2 < before THEN 'collapsed' WHEN after > before THEN 'grown' ELSE 'same' END AS change FROM c""",
        "conflict_components": """WITH RECURSIVE e0 AS (SELECT hash AS a, replaced_by AS b FROM retraction_ledger UNION SELECT hash, source_id FROM retraction_ledger), e AS (SELECT a, b FROM e0 WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
            g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT DISTINCT a AS node, a AS seen FROM g UNION SELECT w.node, g.b FROM w JOIN g ON w.seen = g.a)
            SELECT node, min(seen) AS root FROM w GROUP BY node""",
        "frequent_strings": """SELECT gram, count(*) AS docs FROM (SELECT rowid_, unnest(list_distinct(list_filter(list_transform(range(1, length(fact) - 2), lambda i: substring(fact, i, 4)), lambda x: regexp_full_match(x, '\\p{Han}{4}')))) AS gram FROM (SELECT row_number() OVER () AS rowid_, fact FROM passive_facts WHERE fact IS NOT NULL)) GROUP BY gram HAVING count(*) >= 3""",
    }
    out["hybrid_visible"] = oracles_state.visible_only(out["hybrid_retrieve"])
    return out | oracles_folds.sql(_NEAR, _FACTS, _FACT_SETS) | oracles_state.sql(_TOKS, _bm25, _cosine, _hybrid, _NEAR, _DIST, _CAP64, _contains)
