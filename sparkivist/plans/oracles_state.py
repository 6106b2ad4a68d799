"""SQL of the span, chain, evidence and state queries."""

from __future__ import annotations

from sparkivist.functions.text import query_ngrams
from sparkivist.plans.queries_retrieval import PROBES, QUERY, VARIANT
from sparkivist.plans.queries_state import FACT_FLOOR, FLOORS, GRID, MARKERS, NEEDLES, PHRASE, QUOTES, TODAY

_EPOCH = "CASE WHEN epoch IS NULL OR isnan(epoch) OR epoch <= 0 THEN NULL WHEN epoch > 1e11 THEN epoch / 1000 ELSE epoch END"
_BLANK = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MSG = f"""m AS MATERIALIZED (SELECT source_id, key, min(round({_EPOCH}, 3)) AS "at", min(CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'model') THEN 'assistant' END) AS role, max(length(coalesce(text, '')))::BIGINT AS chars
FROM archive_msgs WHERE key IS NOT NULL GROUP BY source_id, key)"""
_CHAIN = """WITH RECURSIVE l AS (SELECT hash AS rid, min(replaced_by) AS nxt FROM retraction_ledger WHERE hash IS NOT NULL AND replaced_by IS NOT NULL AND hash <> replaced_by GROUP BY hash),
w AS (SELECT rid, nxt AS ptr, 1 AS steps FROM l UNION ALL SELECT w.rid, l.nxt, w.steps + 1 FROM w JOIN l ON w.ptr = l.rid WHERE w.steps < 200),
ends AS (SELECT rid, ptr AS current, steps::BIGINT AS steps FROM w WHERE ptr NOT IN (SELECT rid FROM l)),
mem AS (SELECT current, rid, steps FROM ends UNION SELECT current, current, 0 FROM ends)"""
_REC = """rec AS (SELECT recall_id, recalled_at, p AS pos, recall[p].record_id AS record_id, recall[p].score AS score, recall[p].local_date AS local_date FROM (SELECT recall_id, recalled_at, recall, unnest(range(1, len(recall) + 1)) AS p FROM recall_log WHERE recall IS NOT NULL))"""
_LIVE = "live AS (SELECT DISTINCT record_id FROM memory_entries WHERE record_id IS NOT NULL AND record_id NOT IN (SELECT hash FROM retraction_ledger WHERE hash IS NOT NULL))"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_lit, values)) + "]::VARCHAR[]"


def _lcs() -> str:
    parts = dict.fromkeys(PHRASE[i : i + n] for n in range(1, 41) for i in range(len(PHRASE) - n + 1))
    return f"coalesce(list_max(list_transform(list_filter({_list(parts)}, lambda p: contains(coalesce(text, ''), p)), lambda p: length(p))), 0)"


def _occurrences(needle: str, text: str = "text") -> str:
    return f"list_filter(range(0, length({text})), lambda i: substring({text}, i + 1, {len(needle)}) = {_lit(needle)})"


def _quotes() -> str:
    parts = []
    for q in QUOTES:
        bare = "".join(q.split())
        parts.append(f"SELECT doc_id, {_lit(q)} AS quote, len(found) AS hits, CASE WHEN len(found) = 1 THEN ps[found[1]] END AS start, CASE WHEN len(found) = 1 THEN ps[found[1] + {len(bare) - 1}] + 1 END AS \"end\" FROM (SELECT doc_id, ps, list_filter(range(1, length(hay) + 1), lambda i: substring(hay, i, {len(bare)}) = {_lit(bare)}) AS found FROM h WHERE contains(hay, {_lit(bare)}))")
    return f"""WITH c AS (SELECT doc_id, string_split(text, '') AS cs FROM documents WHERE text IS NOT NULL AND text <> ''),
        p AS (SELECT doc_id, cs, list_filter(range(0, len(cs)), lambda i: NOT regexp_full_match(cs[i + 1], '{_BLANK}')) AS ps FROM c),
        h AS MATERIALIZED (SELECT doc_id, ps, array_to_string(list_transform(ps, lambda i: cs[i + 1]), '') AS hay FROM p) """ + " UNION ALL ".join(parts)


def _admitted(query: str, name: str) -> str:
    return f"{name} AS (SELECT doc_id FROM post JOIN dfs USING (token), n WHERE list_contains({_list(query_ngrams(query))}, token) GROUP BY doc_id HAVING bool_or(df <= greatest(3, n // 5)))"


def visible_only(hybrid: str) -> str:
    """The SQL of hybrid retrieval over the live entries instead of the documents."""
    docs = """docs0 AS MATERIALIZED (SELECT entry_id AS doc_id, max(text) AS text, max(record_id) AS record_id, max(coalesce(tags[1], 'none')) AS layer, NULL AS source, NULL AS local_date FROM memory_entries WHERE record_id IS NOT NULL GROUP BY entry_id),
        hid AS MATERIALIZED (SELECT doc_id FROM docs0 WHERE record_id IN (SELECT hash FROM retraction_ledger WHERE hash IS NOT NULL)), """
    out = hybrid.replace("WITH ", "WITH " + docs, 1).replace("FROM documents", "FROM docs0")
    for a, b in (("FROM b WHERE admitted)", "FROM b WHERE admitted AND doc_id NOT IN (SELECT doc_id FROM hid))"), ("FROM nb WHERE rank <= 5)", "FROM nb WHERE rank <= 5 AND dst NOT IN (SELECT doc_id FROM hid))")):
        assert a in out
        out = out.replace(a, b)
    return out


def sql(toks: str, bm25, cosine, hybrid, near: str, dist: str, cap: str, contains) -> dict[str, str]:
    spans = " UNION ALL ".join(f"SELECT doc_id, i AS s, i + {len(n)} AS e FROM (SELECT doc_id, unnest({_occurrences(n)}) AS i FROM documents WHERE text IS NOT NULL)" for n in NEEDLES)
    several = " + ".join(f"contains(coalesce(text, ''), {_lit(m)})::INT" for m in MARKERS)
    near_term = " OR ".join(f"list_bool_or(list_transform(list_filter(range(0, length(t)), lambda i: lower(substring(t, i + 1, 4)) = 'trip'), lambda i: contains(substring(t, greatest(i - 30, 0) + 1, i + 34 - greatest(i - 30, 0)), {_lit(m)})))" for m in MARKERS)
    segs = f"""ln AS (SELECT doc_id, i, string_split(text, chr(10))[i] || CASE WHEN i < len(string_split(text, chr(10))) THEN chr(10) ELSE '' END AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
        k AS (SELECT doc_id, i, line, regexp_full_match(line, '[ \\t\\n\\x0b\\f\\r]*') AS blank, regexp_matches(line, '^[ \\t\\n\\x0b\\f\\r]*#') AS head FROM ln),
        b AS (SELECT *, NOT blank AND (head OR coalesce(lag(blank OR head) OVER w, true)) AS begins, sum(length(line)) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        g AS (SELECT *, greatest(sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 1) AS no FROM b)"""
    kill = " UNION ALL ".join(f"SELECT {_lit(q)} AS query, (SELECT count(*) FROM a{i}) AS admitted, round(1 - (SELECT count(*) FROM a{i}) / (SELECT count(*) FROM documents), 6) AS killed" for i, q in enumerate(PROBES))
    empties = [*PROBES, "qzxv", "ħŧ"]
    empty = " UNION ALL ".join(f"SELECT {_lit(q)} AS query, (SELECT count(*) FROM a{i}) = 0 AS empty" for i, q in enumerate(empties))
    hits = f"x AS MATERIALIZED (SELECT doc_id, count(*) FILTER (df <= greatest(3, n // 5)) AS k, count(*) FILTER (df <= 3) AS r FROM post JOIN dfs USING (token), n WHERE list_contains({_list(query_ngrams(QUERY))}, token) GROUP BY doc_id), e AS (SELECT doc_id FROM documents WHERE {contains('Haldenmere')} OR {contains('garden wall')})"
    hint = "((s1 >= line AND round(s1 - s2, 4) >= 0.02) OR (s2 >= line AND round(s2 - s3, 4) >= 0.02))"
    pron = [(f"sum(coalesce((length(text) - length(replace(text, {_lit(c)}, ''))) // {len(c)}, 0))", c) for c in ("他", "她", " he ", " she ")]
    pron_cols = ", ".join(f"{v} AS p{i}" for i, (v, _) in enumerate(pron))
    pron_best = " ".join(f"WHEN p{i} = greatest(p0, p1, p2, p3) THEN {_lit(c)}" for i, (_, c) in enumerate(pron))
    return {
        "quote_location": _quotes(),
        "term_occurrences": f"SELECT doc_id, unnest({_occurrences('the w')})::INT AS at FROM documents WHERE text IS NOT NULL",
        "anchor_table": f"WITH {segs} SELECT doc_id, no::BIGINT AS anchor_no, min(upto - length(line))::BIGINT AS start, max(upto)::BIGINT AS \"end\" FROM g GROUP BY doc_id, no HAVING bool_or(NOT blank)",
        "span_coverage": f"""WITH s AS ({spans}), r AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM s), c AS (SELECT doc_id, sum(greatest(e - greatest(s, coalesce(upto, 0)), 0))::BIGINT AS covered FROM r GROUP BY doc_id)
            SELECT doc_id, covered, round(covered / length(text), 6) AS share FROM c JOIN documents USING (doc_id)""",
        "common_substrings": f"SELECT doc_id, {_lcs()}::INT AS longest FROM documents",
        "substring_profile": f"WITH v AS (SELECT {_lcs()} AS v FROM documents) SELECT count(*) AS texts, round(avg((v <= 2)::INT), 6) AS upto_2, round(avg((v <= 3)::INT), 6) AS upto_3, round(avg((v <= 4)::INT), 6) AS upto_4, (SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM v) WHERE r = n // 2 + 1)::BIGINT AS median FROM v",
        "demoted_documents": f"SELECT doc_id, ({several} >= 2 OR {near_term.replace('(t,', '(text,').replace('length(t)', 'length(text)')}) AS demoted FROM documents WHERE contains(lower(coalesce(text, '')), 'trip')",
        "word_profile": rf"""WITH w AS (SELECT coalesce(source, '') AS source, layer, {several} >= 2 AS bad, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+'))) AS word FROM documents),
            p AS (SELECT word, source, count(*) AS n, count(*) FILTER (bad) AS b, bool_or(layer = 'index') AS i, bool_or(layer = 'timeline') AS t FROM w GROUP BY ALL),
            g AS (SELECT word, sum(n)::BIGINT AS blocks, sum(b)::BIGINT AS demoted_blocks, count(*) FILTER (b < n) AS clean_sources, count(*) FILTER (i) AS index_sources, count(*) FILTER (t) AS timeline_sources FROM p GROUP BY word HAVING sum(n) >= 2)
            SELECT *, clean_sources BETWEEN 1 AND 12 AND blocks - demoted_blocks <= 18 AND demoted_blocks < 0.8 * blocks AND length(word) >= 3 AND NOT regexp_full_match(word, '\pN+') AS hot FROM g""",
        "reduplicated_words": r"SELECT word, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct(list_filter(list_transform(range(1, length(text)), lambda i: substring(text, i, 2)), lambda x: x[1] = x[2] AND regexp_full_match(x, '\p{Han}{2}')))) AS word FROM documents WHERE text IS NOT NULL) GROUP BY word",
        "gate_variants": f"""WITH {toks}, {hits} SELECT 'one' AS gate, (SELECT count(*) FROM x WHERE k >= 1) AS admitted UNION ALL SELECT 'two', (SELECT count(*) FROM x WHERE k >= 2) UNION ALL SELECT 'rare', (SELECT count(*) FROM x WHERE r >= 1)
            UNION ALL SELECT 'entity', (SELECT count(*) FROM e) UNION ALL SELECT 'union', (SELECT count(*) FROM (SELECT doc_id FROM x WHERE k >= 1 UNION SELECT doc_id FROM e))""",
        "gate_kill_rate": f"WITH {toks}, {', '.join(_admitted(q, f'a{i}') for i, q in enumerate(PROBES))} {kill}",
        "gate_misses": f"WITH {toks}, {_admitted(VARIANT, 'a')} SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'winter trip') AND doc_id NOT IN (SELECT doc_id FROM a)",
        "correct_empty": f"WITH {toks}, {', '.join(_admitted(q, f'a{i}') for i, q in enumerate(empties))} {empty}",
        "vector_gate": f"WITH {near.format(k=11)} SELECT 'calibrated' AS state, count(*) FILTER (cosine > 0.3) AS admitted, count(*) FILTER (cosine > 0.3) AS ranked FROM near UNION ALL SELECT 'uncalibrated', 0, count(*) FROM near UNION ALL SELECT 'absent', 0, 0",
        "floor_table": f"WITH {near.format(k=1)} SELECT floor, count(*) FILTER (relevant AND cosine <= floor) AS blocked_present, count(*) FILTER (NOT relevant AND cosine > floor) AS admitted_absent FROM near, (SELECT unnest({FLOORS}::DOUBLE[]) AS floor) GROUP BY floor",
        "margin_sweep": f"""WITH {near.format(k=11)}, g AS (SELECT query_id, round(max(cosine) FILTER (rank = 1) - max(cosine) FILTER (rank = 2), 6) AS gap FROM near GROUP BY query_id), r AS (SELECT near.*, coalesce(gap, 'inf'::DOUBLE) AS gap FROM near JOIN g USING (query_id) WHERE rank <= 2 AND relevant IS NOT NULL),
            s AS (SELECT margin, count(*) FILTER (k) AS kept, count(*) FILTER (k AND relevant) AS relevant, count(*) FILTER (relevant) AS a, count(DISTINCT query_id) FILTER (k) AS surfaced FROM (SELECT *, cosine >= 0.2 AND gap >= margin AS k FROM r, (SELECT unnest([0.0, 0.01, 0.02, 0.05, 0.1]::DOUBLE[]) AS margin)) GROUP BY margin)
            SELECT margin, kept, relevant, round(CASE WHEN kept > 0 THEN relevant / kept END, 6) AS precision, round(CASE WHEN a > 0 THEN relevant / a END, 6) AS retention, surfaced FROM s""",
        "surfacing_alignment": f"""WITH {near.format(k=11)}, w AS (SELECT round(avg((b >= 0.3)::INT), 9) AS wanted FROM (SELECT query_id, max(cosine) AS b FROM near WHERE rank <= 2 GROUP BY query_id)), o AS (SELECT query_id, max(cosine) AS b FROM near WHERE rank BETWEEN 2 AND 3 GROUP BY query_id),
            s AS (SELECT floor, round(avg((b >= floor)::INT), 9) AS share FROM o, (SELECT unnest({GRID}::DOUBLE[]) AS floor) GROUP BY floor) SELECT wanted, floor, share FROM s, w ORDER BY abs(share - wanted), floor DESC LIMIT 1""",
        "best_hint_line": f"""WITH {near.format(k=11)}, g AS (SELECT query_id, coalesce(max(cosine) FILTER (rank = 1), 0) AS s1, coalesce(max(cosine) FILTER (rank = 2), 0) AS s2, coalesce(max(cosine) FILTER (rank = 3), 0) AS s3 FROM near GROUP BY query_id)
            SELECT line, round(avg({hint}::INT), 6) AS rate FROM g, (SELECT unnest({GRID}::DOUBLE[]) AS line) GROUP BY line HAVING round(avg({hint}::INT), 6) <= 0.333334 ORDER BY line LIMIT 1""",
        "present_pair_scores": f"WITH {near.format(k=3)} SELECT query_id, vec_id, rank AS place FROM near",
        "fact_problems": """WITH f AS (SELECT DISTINCT fact_id, block, fact, event_date, written, trim(coalesce(fact, '')) AS b FROM passive_facts), k AS (SELECT DISTINCT record_id FROM memory_entries WHERE record_id IS NOT NULL)
            SELECT fact_id, 'no_block' AS code FROM f WHERE block IS NULL UNION SELECT fact_id, 'unknown_block' FROM f WHERE block NOT IN (SELECT record_id FROM k) UNION SELECT fact_id, 'blank' FROM f WHERE b = '' UNION SELECT fact_id, 'too_short' FROM f WHERE b <> '' AND length(b) < 8
            UNION SELECT fact_id, 'bad_date' FROM f WHERE event_date IS NOT NULL AND try_cast(event_date AS DATE) IS NULL UNION SELECT fact_id, 'event_after_writing' FROM f WHERE event_date > written UNION SELECT fact_id, 'duplicate_id' FROM f GROUP BY fact_id HAVING count(*) > 1""",
        "pronoun_vote": f"""WITH e AS (SELECT DISTINCT entry_id, speaker, text FROM memory_entries WHERE trim(coalesce(speaker, '')) <> ''), g AS (SELECT speaker, {pron_cols} FROM e GROUP BY speaker)
            SELECT speaker, CASE WHEN p0 + p1 + p2 + p3 >= 5 AND greatest(p0, p1, p2, p3) >= 0.75 * (p0 + p1 + p2 + p3) THEN CASE {pron_best} END END AS pronoun, (p0 + p1 + p2 + p3)::BIGINT AS hits FROM g""",
        "source_specificity": r"""WITH g AS (SELECT source_id, max(CASE WHEN trim(coalesce(text, '')) <> '' THEN len(regexp_extract_all(text, '[0-9]+|[A-Z][a-z]{3,}')) END)::BIGINT AS best FROM memory_entries WHERE source_id IS NOT NULL GROUP BY source_id)
            SELECT source_id, CASE WHEN best IS NULL THEN 'missing' WHEN best < 12 THEN 'vague' ELSE 'ok' END AS state, best FROM g""",
        "date_coverage": "SELECT coalesce(source, '') AS source, min(local_date) AS first_day, max(local_date) AS last_day, count(local_date) AS dated, count(*) AS docs FROM documents GROUP BY 1",
        "retraction_plan": """WITH r AS (SELECT DISTINCT record_id, text FROM memory_entries WHERE record_id IS NOT NULL AND text IS NOT NULL AND record_id NOT IN (SELECT hash FROM retraction_ledger WHERE hash IS NOT NULL)),
            q AS (SELECT * FROM (VALUES ('the budget for the winter trip', NULL), ('  gave up on the trowel ', NULL), ('no such thing at all', NULL), ('我', 'f9445274d7710a7e')) v(quote, rid)),
            h AS (SELECT quote, count(record_id) AS matches, min(record_id) AS lo FROM q LEFT JOIN r ON contains(text, trim(quote)) AND (rid IS NULL OR rid = record_id) GROUP BY quote)
            SELECT quote, matches, CASE WHEN matches = 0 THEN 'none' WHEN matches > 1 THEN 'ambiguous' ELSE 'retract' END AS verdict, CASE WHEN matches = 1 THEN lo END AS record_id FROM h""",
        "retraction_followers": """WITH t AS (SELECT doc_id, layer, window_no, n_chars FROM documents WHERE window_no IS NOT NULL)
            SELECT i.doc_id, min(g.doc_id) AS via FROM t i JOIN t g USING (window_no) WHERE i.layer = 'index' AND g.layer = 'timeline' AND g.n_chars % 5 = 0 GROUP BY i.doc_id""",
        "supersession_plan": _CHAIN + """, k AS (SELECT DISTINCT record_id FROM memory_entries WHERE record_id IS NOT NULL), ln AS (SELECT * FROM retraction_ledger WHERE hash IS NOT NULL AND replaced_by IS NOT NULL),
            wi AS (SELECT hash AS old, replaced_by AS new FROM ln UNION SELECT replaced_by, hash FROM ln UNION SELECT hash, hash FROM retraction_ledger WHERE hash IS NOT NULL UNION SELECT upper(hash), hash FROM retraction_ledger WHERE hash IS NOT NULL
              UNION SELECT record_id, '0000000000000000' FROM k WHERE record_id LIKE 'a%' AND record_id NOT IN (SELECT hash FROM retraction_ledger WHERE hash IS NOT NULL))
            SELECT old, new, CASE WHEN NOT (regexp_full_match(old, '[0-9a-f]{16}') AND regexp_full_match(new, '[0-9a-f]{16}')) THEN 'malformed' WHEN old = new THEN 'self_link' WHEN old NOT IN (SELECT record_id FROM k) THEN 'unknown_old' WHEN new NOT IN (SELECT record_id FROM k) THEN 'unknown_new'
              WHEN new IN (SELECT hash FROM retraction_ledger WHERE hash IS NOT NULL AND replaced_by IS NULL) THEN 'retracted_new' WHEN old IN (SELECT hash FROM ln) THEN 'already_superseded' WHEN new IN (SELECT replaced_by FROM ln) THEN 'taken'
              WHEN EXISTS (SELECT 1 FROM ends WHERE rid = new AND current = old) THEN 'cycle' ELSE 'ok' END AS verdict FROM wi""",
        "integrity_codes": """WITH RECURSIVE b AS (SELECT replaced_by AS rid, min(hash) AS s FROM retraction_ledger WHERE replaced_by IS NOT NULL AND hash IS NOT NULL GROUP BY 1),
            r AS (SELECT hash AS rid, CASE WHEN replaced_by IS NOT NULL OR hash LIKE '0%' THEN 'superseded' ELSE 'current' END AS status, CASE WHEN substring(hash, 2, 1) < 'b' THEN b.s END AS s, replaced_by AS n FROM retraction_ledger LEFT JOIN b ON b.rid = hash WHERE hash IS NOT NULL
              UNION ALL SELECT * FROM (VALUES ('x1', 'superseded', 'x3', 'x2'), ('x2', 'superseded', 'x1', 'x3'), ('x3', 'superseded', 'x2', 'x1'), ('y', 'current', NULL, 'z'))),
            w AS (SELECT rid, n AS ptr, 1 AS k FROM r WHERE n IS NOT NULL AND n <> rid UNION ALL SELECT w.rid, r.n, k + 1 FROM w JOIN r ON r.rid = w.ptr WHERE r.n IS NOT NULL AND k < 200)
            SELECT rid, 'dangling' AS code FROM r WHERE (s IS NOT NULL AND s NOT IN (SELECT rid FROM r)) OR (n IS NOT NULL AND n NOT IN (SELECT rid FROM r))
            UNION SELECT a.rid, 'one_way' FROM r a JOIN r z ON a.n = z.rid WHERE z.s IS DISTINCT FROM a.rid UNION SELECT a.rid, 'one_way' FROM r a JOIN r z ON a.s = z.rid WHERE z.n IS DISTINCT FROM a.rid
            UNION SELECT rid, 'status_mismatch' FROM r WHERE (status = 'superseded' AND n IS NULL) OR (status = 'current' AND n IS NOT NULL)
            UNION SELECT rid, 'cycle' FROM w WHERE k = 200""",
        "chain_members": _CHAIN + " SELECT current, rid, steps::BIGINT AS steps FROM mem",
        "hit_chains": _CHAIN + f""", {_REC}, h AS (SELECT hash AS record_id FROM retraction_ledger WHERE substring(hash, 1, 1) < 'b' UNION SELECT record_id FROM rec)
            SELECT current, count(DISTINCT rid) AS hits FROM mem WHERE rid IN (SELECT record_id FROM h) GROUP BY current HAVING count(DISTINCT rid) >= 2""",
        "expanded_hits": _CHAIN + """, h AS (SELECT hash AS record_id, 16.0::DOUBLE AS score, row_number() OVER (ORDER BY hash) AS rank FROM retraction_ledger WHERE hash IS NOT NULL),
            j AS (SELECT h.*, current FROM h LEFT JOIN mem ON mem.rid = record_id), f AS (SELECT current, arg_min(score, rank) AS score, min(rank) AS rank FROM j WHERE current IS NOT NULL GROUP BY current)
            SELECT rid AS record_id, score, rank, steps::BIGINT AS steps FROM f JOIN mem USING (current) UNION ALL SELECT record_id, score, rank, NULL FROM j WHERE current IS NULL""",
        "supersede_pool": """WITH f AS (SELECT DISTINCT fact_id, block, event_date, written FROM passive_facts WHERE block IS NOT NULL AND written IS NOT NULL AND event_date IS NOT NULL), g AS (SELECT hash AS block, min(strftime(make_timestamp((retracted_at * 1e6)::BIGINT), '%Y-%m-%d')) AS gone FROM retraction_ledger GROUP BY hash),
            j AS (SELECT DISTINCT f.fact_id, o.fact_id AS older_id, o.written AS w FROM f JOIN f o ON f.block = o.block AND o.written < f.written AND o.event_date <> f.event_date LEFT JOIN g ON g.block = f.block WHERE gone IS NULL OR gone > f.written)
            SELECT fact_id, older_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY w DESC, older_id) AS rank FROM j) WHERE rank <= 3""",
        "index_gold": """WITH t AS (SELECT * FROM documents WHERE window_no IS NOT NULL), g AS (SELECT window_no, count(*) AS gold, min(doc_id) AS first_gold FROM t WHERE layer = 'timeline' GROUP BY window_no),
            s AS (SELECT doc_id, window_no, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '([。！？!?\\n])', '\\1' || chr(1), 'g'), chr(1)), lambda x: NOT regexp_full_match(x, '[ \\t\\n\\x0b\\f\\r]*')))::INT AS sentences FROM t WHERE layer = 'index')
            SELECT doc_id, sentences, gold, first_gold FROM s JOIN g USING (window_no) WHERE sentences > 0""",
        "bridge_keys": """WITH t AS (SELECT doc_id, layer, coalesce('w' || window_no, 'd' || local_date, 's' || source) AS key FROM documents), g AS (SELECT key, count(*) AS docs, min(doc_id) AS first_doc FROM t WHERE layer = 'timeline' AND key IS NOT NULL GROUP BY key)
            SELECT doc_id AS index_id, substring(key, 1, 1) AS by, docs, first_doc FROM t JOIN g USING (key) WHERE layer = 'index'""",
        "entity_edges": r"""WITH f AS (SELECT fact_id, max(fact) AS text, max(event_date) AS entity FROM passive_facts WHERE fact IS NOT NULL GROUP BY fact_id), s AS (SELECT fact_id, regexp_replace(lower(text), '[^\pL\pN_]', '', 'g') AS s FROM f), n AS (SELECT count(*) AS n FROM f),
            p AS (SELECT fact_id, unnest(list_distinct(list_transform(range(1, length(s)), lambda i: substring(s, i, 2)))) AS token FROM s), d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
            w AS (SELECT fact_id, token, ln((n - df + 0.5) / (df + 0.5) + 1) AS w FROM p JOIN d USING (token), n WHERE df BETWEEN 2 AND least(greatest(3, n // 5), 64)),
            e AS (SELECT fact_id, 'entity ' || entity AS token, ln(1 + n::DOUBLE / df) AS w FROM f JOIN (SELECT entity, count(*) AS df FROM f WHERE entity IS NOT NULL GROUP BY entity HAVING count(*) BETWEEN 2 AND 64) USING (entity), n),
            u AS (SELECT * FROM w UNION ALL SELECT * FROM e), x AS (SELECT a.fact_id AS src, b.fact_id AS dst, round(sum(a.w), 6) AS strength FROM u a JOIN u b USING (token) WHERE a.fact_id <> b.fact_id GROUP BY ALL)
            SELECT * FROM (SELECT src, dst, strength, row_number() OVER (PARTITION BY src ORDER BY strength DESC, dst) AS rank FROM x) WHERE rank <= 5""",
        "index_replace": r"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN substring(text, 1, 100) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7), s AS (SELECT regexp_replace(lower(coalesce(text, '')), '[^\pL\pN_]', '', 'g') AS s FROM c)
            SELECT count(*) AS docs, sum(greatest(length(s) - 1, 0))::BIGINT AS bigrams, sum(len(list_distinct(list_transform(range(1, length(s)), lambda i: substring(s, i, 2)))))::BIGINT AS postings FROM s""",
        "random_facts": "SELECT fact_id, md5('seed-7|' || fact_id) AS draw FROM (SELECT DISTINCT fact_id FROM passive_facts WHERE fact_id IS NOT NULL) ORDER BY draw LIMIT 12",
        "record_by_id": "SELECT record_id, count(DISTINCT entry_id) AS entries, coalesce(md5(max(text)), 'not found') AS hash FROM (SELECT unnest(['f9445274d7710a7e', '43a126c06bc15cef', '0000000000000000']) AS record_id) LEFT JOIN memory_entries USING (record_id) GROUP BY record_id",
        "facts_by_span": "SELECT DISTINCT fact_id, written, tag FROM passive_facts WHERE written BETWEEN '2024-01-01' AND '2024-06-30' AND tag IN ('life', 'work')",
        "checklist_items": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), i AS (SELECT doc_id, regexp_extract(line, '^- \[[ x]\] ([^:：\n]+)[:：] [^ \t\n\x0b\f\r]', 1) AS name FROM l WHERE starts_with(line, '- [')), p AS (SELECT doc_id, name, count(*) AS n FROM i GROUP BY ALL)
            SELECT doc_id, count(*) FILTER (name <> '') AS items, coalesce(sum(n) FILTER (name = ''), 0)::BIGINT AS malformed, coalesce(sum(n - 1) FILTER (name <> ''), 0)::BIGINT AS repeated FROM p GROUP BY doc_id""",
        "bold_items": r"SELECT doc_id, len(x)::INT AS items, md5(array_to_string(x, '|')) AS hash FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\*\*([^*:：\n]+)[:：]', 1) AS x FROM documents) WHERE len(x) > 0",
        "overwrite_conflicts": "SELECT window_no, source, count(DISTINCT md5(text)) AS texts FROM documents WHERE window_no IS NOT NULL AND text IS NOT NULL GROUP BY ALL HAVING count(DISTINCT md5(text)) > 1",
        "fact_vector_pairs": "SELECT fact_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 2) AS norm FROM (SELECT DISTINCT fact_id, substring(fact_id, 2)::BIGINT AS vec_id FROM passive_facts) JOIN embeddings USING (vec_id)",
        "pending_messages": f"""WITH {_MSG}, c AS (SELECT source_id, max("at") AS c FROM m WHERE "at" < 1704067200 GROUP BY source_id), k AS (SELECT source_id, key FROM m JOIN c USING (source_id) WHERE "at" = c)
            SELECT m.source_id, m.key FROM m LEFT JOIN c ON c.source_id = m.source_id WHERE "at" IS NOT NULL AND (c IS NULL OR "at" > c OR ("at" = c AND (m.source_id, m.key) NOT IN (SELECT (source_id, key) FROM k)))""",
        "archive_cursor": f"WITH {_MSG}, c AS (SELECT source_id, max(\"at\") AS c_at FROM m WHERE \"at\" IS NOT NULL GROUP BY source_id) SELECT source_id, c_at, string_agg(DISTINCT key, ',' ORDER BY key) AS keys FROM m JOIN c USING (source_id) WHERE \"at\" = c_at GROUP BY ALL",
        "archive_fire": f"""WITH {_MSG}, p AS (SELECT *, strftime(make_timestamp(("at" * 1e6)::BIGINT), '%Y-%m-%d') AS day FROM m WHERE "at" >= 1704067200), f AS (SELECT source_id, min(day) AS day FROM p GROUP BY source_id),
            r AS (SELECT p.*, sum(chars) OVER w AS total, row_number() OVER w AS no FROM p JOIN f USING (source_id, day) WINDOW w AS (PARTITION BY source_id ORDER BY "at", key ROWS UNBOUNDED PRECEDING)), i AS (SELECT *, total <= 3000 OR no = 1 AS inside FROM r),
            g AS (SELECT source_id, day, count(*) FILTER (inside) AS in_batch, count(*) FILTER (NOT inside) AS left_over, min("at") AS oldest, coalesce(bool_or(inside AND role = 'user'), false) AS u, coalesce(bool_or(inside AND role = 'assistant'), false) AS a FROM i GROUP BY ALL)
            SELECT source_id, day, in_batch, left_over, day < '2024-01-12' AS closed, (day < '2024-01-12' OR left_over > 0 OR in_batch + left_over >= 12 OR 1705017600.0 - oldest >= 14400) AND (day < '2024-01-12' OR (u AND a)) AS fires FROM g""",
        "idempotent_requests": """SELECT conv_key, key, count(*) AS requests, CASE WHEN count(DISTINCT (coalesce(role, chr(30)), coalesce(text, chr(30)))) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'repeat' ELSE 'single' END AS verdict FROM archive_msgs WHERE conv_key IS NOT NULL AND key IS NOT NULL GROUP BY conv_key, key""",
        "open_items": """WITH o AS (SELECT user_id AS item, epoch_us(ts) AS "at", event_id AS seq, CASE event_type WHEN 'error' THEN 'close' WHEN 'purchase' THEN 'open' ELSE 'update' END AS action FROM events),
            c AS (SELECT item, max(("at", seq)) AS e FROM o WHERE action = 'close' GROUP BY item), l AS (SELECT o.* FROM o LEFT JOIN c USING (item) WHERE action <> 'close' AND (e IS NULL OR ("at", seq) > e)), b AS (SELECT item, min(("at", seq)) AS s FROM l WHERE action = 'open' GROUP BY item)
            SELECT item, min("at") AS opened_at, max("at") FILTER (action = 'update') AS updated_at, count(*) FILTER (action = 'update') AS updates FROM l JOIN b USING (item) WHERE ("at", seq) >= s GROUP BY item""",
        "delivery_states": f"""WITH {_REC}, {_LIVE}, j AS (SELECT DISTINCT recall_id, record_id, record_id IN (SELECT record_id FROM live) AS ok FROM rec WHERE record_id IS NOT NULL), g AS (SELECT recall_id, count(*) FILTER (ok) AS covered, count(*) FILTER (NOT ok) AS invalidated FROM j GROUP BY recall_id)
            SELECT *, CASE WHEN invalidated = 0 THEN 'covered' WHEN covered = 0 THEN 'invalidated' ELSE 'partly' END AS state FROM g""",
        "same_month_recalls": f"""WITH {_REC}, s AS (SELECT *, coalesce(substring(local_date, 1, 7) = strftime(make_timestamp((recalled_at * 1e6)::BIGINT), '%Y-%m'), false) AS same FROM rec), f AS (SELECT recall_id, arg_min(same, pos) AS first FROM s GROUP BY recall_id)
            SELECT recall_id, record_id, (pos - 1)::INT AS pos FROM s JOIN f USING (recall_id) WHERE NOT same AND NOT first""",
        "recall_eligibility": f"""WITH {_REC}, {_LIVE}, v AS (SELECT recall_id, record_id, pos, CASE WHEN record_id IS NULL OR record_id NOT IN (SELECT record_id FROM live) THEN 'dead' WHEN coalesce(score < 0.3, true) THEN 'weak' WHEN coalesce(substring(local_date, 1, 7) = strftime(make_timestamp((recalled_at * 1e6)::BIGINT), '%Y-%m'), false) THEN 'same_day' ELSE 'eligible' END AS v FROM rec),
            g AS (SELECT recall_id, arg_min(v, pos) FILTER (v IN ('eligible', 'same_day')) AS d, arg_min(record_id, pos) FILTER (v IN ('eligible', 'same_day')) AS r, count(*) FILTER (v = 'weak') AS weak FROM v GROUP BY recall_id)
            SELECT recall_id, CASE WHEN d = 'eligible' THEN 'eligible' WHEN d = 'same_day' THEN 'same_day_record' WHEN weak > 0 THEN 'no_reliable_candidate' ELSE 'nothing_live' END AS reason, CASE WHEN d = 'eligible' THEN r END AS record_id FROM g""",
        "conversation_topics": rf"""WITH m AS (SELECT conv_key, row_id, text, round({_EPOCH}, 3) AS t FROM archive_msgs WHERE conv_key IS NOT NULL AND NOT regexp_full_match(coalesce(text, ''), ' *')), r AS (SELECT *, row_number() OVER (PARTITION BY conv_key ORDER BY t DESC, row_id DESC) AS n FROM m WHERE t IS NOT NULL)
            SELECT conv_key, md5(string_agg(substring(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'), 1, 40), ' / ' ORDER BY n DESC)) AS hash FROM r WHERE n <= 3 GROUP BY conv_key""",
        "source_ages": """WITH a AS (SELECT source_id, floor(greatest(1767225600.0 - epoch_us(exported_at) / 1e6, 0) / 86400)::BIGINT AS d FROM import_sources) SELECT source_id, CASE WHEN d IS NULL THEN NULL WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' ELSE d || ' days ago' END AS age FROM a""",
        "backfill_next": """WITH r AS (SELECT record_id, max(length(text)) AS chars FROM memory_entries WHERE record_id IS NOT NULL AND text IS NOT NULL GROUP BY record_id), t AS (SELECT * FROM r WHERE record_id NOT IN (SELECT block FROM passive_facts WHERE block IS NOT NULL) ORDER BY record_id LIMIT 40),
            u AS (SELECT record_id, sum(chars) OVER (ORDER BY record_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used, row_number() OVER (ORDER BY record_id) AS no FROM t) SELECT record_id, used FROM u WHERE used <= 12000 OR no = 1""",
        "rare_word_path": rf"""WITH h AS (SELECT doc_id, layer, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+')) AS w FROM documents), q AS (SELECT unnest({_list(sorted({w for w in QUERY.lower().split() if len(w) > 2}))}) AS x), c AS (SELECT x, count(*) AS n FROM q JOIN h ON list_contains(w, x) GROUP BY x),
            r AS (SELECT x FROM (SELECT * FROM c ORDER BY n, x LIMIT 1) WHERE n <= 18) SELECT doc_id, x AS term, (len(list_intersect(w, (SELECT list(x) FROM q))) - 1)::INT AS others FROM h, r WHERE layer = 'timeline' AND list_contains(w, x)""",
        "fact_mode": f"""WITH {_LIVE}, f AS (SELECT * FROM (SELECT fact_id, block, fact, kind, event_date, row_number() OVER (PARTITION BY fact_id ORDER BY written, fact) AS n FROM passive_facts WHERE coalesce(tag, '') <> 'meta' AND written < '{TODAY}' AND block IS NOT NULL AND fact IS NOT NULL) WHERE n = 1 AND block IN (SELECT record_id FROM live)),
            v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL), u AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v),
            s AS (SELECT q.vec_id AS query_id, f.*, u.vec_id, round(list_dot_product(q.v, u.v), 6) AS c FROM u q, u JOIN f ON u.vec_id = substring(f.fact_id, 2)::BIGINT WHERE q.vec_id % 100 = 0 AND u.vec_id <> q.vec_id),
            c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank, octet_length(encode(fact)) AS bytes, vec_id % 7 = 0 AS cooling FROM s) WHERE rank <= 11 AND round(c, 4) >= {FACT_FLOOR}),
            k AS (SELECT * FROM c WHERE rank <= 2 AND NOT cooling), us AS (SELECT query_id, sum(bytes)::BIGINT AS used, list(block) AS blocks FROM k GROUP BY query_id),
            x AS (SELECT c.query_id, any_value(used) AS used, list({{'v': c.vec_id, 'n': c.bytes::BIGINT}} ORDER BY rank) AS xs FROM c JOIN us USING (query_id) WHERE rank > 2 AND NOT cooling AND list_contains(blocks, c.block) GROUP BY c.query_id),
            sib AS (SELECT query_id, list_reduce(xs, lambda a, x: CASE WHEN len(a.o) < 3 AND a.used + x.n <= 1000 THEN {{'o': list_append(a.o, x.v), 'used': a.used + x.n}} ELSE a END, {{'o': []::BIGINT[], 'used': used}}) AS r FROM x),
            own AS (SELECT query_id, block, max(rank) AS major FROM k GROUP BY ALL),
            al AS (SELECT query_id, fact_id, block, kind, event_date, 'kept' AS role, rank AS major, 0 AS minor FROM k UNION ALL SELECT c.query_id, c.fact_id, c.block, c.kind, c.event_date, 'sibling', major, c.rank FROM sib JOIN c USING (query_id) JOIN own o ON o.query_id = c.query_id AND o.block = c.block WHERE list_contains(sib.r.o, c.vec_id))
            SELECT query_id, fact_id, role, row_number() OVER (PARTITION BY query_id ORDER BY major, minor) AS at, coalesce(kind = 'state' AND event_date < max(event_date) FILTER (kind = 'state') OVER (PARTITION BY query_id, block), false) AS older FROM al""",
    }
