"""SQL of the queries whose result depends on what came before, as folds over ordered lists."""

from __future__ import annotations

_BLANKS = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_JAVA = r"[ \t\n\x0b\f\r]"
_EPOCH = "CASE WHEN epoch IS NULL OR isnan(epoch) OR epoch <= 0 THEN NULL WHEN epoch > 1e11 THEN epoch / 1000 ELSE epoch END"


def _strip(x: str, blank: str = _BLANKS) -> str:
    return f"regexp_replace({x}, '^{blank}+|{blank}+$', '', 'g')"


def _bare(x: str) -> str:
    """Nothing but white space besides a first line that is a heading."""
    line_end = r"\n\r\x0b\f\x1c-\x1e\x85\x{2028}\x{2029}"
    return f"(regexp_full_match({x}, '{_BLANKS}*') OR regexp_full_match({x}, '[^\\S{line_end}]*#[^{line_end}]*([{line_end}]{_BLANKS}*)?'))"


def _sentences(text: str, blank: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({text}, '([。！？!?\\n])', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s', blank)}), lambda s: s <> '')"


def sql(near: str, facts: str, fact_sets: str) -> dict[str, str]:
    sections = f"list_filter(list_transform(string_split(regexp_replace(text, '(?m)^## ', chr(1) || '## ', 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"
    packed = f"""list_reduce(regexp_split_to_array(x.s, '\\n{{2,}}'), lambda a, p:
          CASE WHEN a.held <> '' AND length(a.held) + length(p) > 1500 AND NOT {_bare(_strip('a.held'))}
            THEN {{'done': list_append(a.done, {_strip('a.held')}), 'held': p || chr(10) || chr(10)}}
            ELSE {{'done': a.done, 'held': a.held || p || chr(10) || chr(10)}} END, {{'done': []::VARCHAR[], 'held': ''}})"""
    merged = """list_reduce(pieces, lambda a, c:
          CASE WHEN c.bare AND a.held <> '' AND length(a.held) + length(c.s) + 1 > 1500 THEN {'done': list_append(a.done, a.held), 'held': c.s}
            WHEN c.bare THEN {'done': a.done, 'held': CASE WHEN a.held = '' THEN c.s ELSE a.held || chr(10) || c.s END}
            WHEN a.held = '' THEN {'done': list_append(a.done, c.s), 'held': ''}
            WHEN length(a.held) + length(c.s) + 1 <= 1500 THEN {'done': list_append(a.done, a.held || chr(10) || c.s), 'held': ''}
            ELSE {'done': list_append(list_append(a.done, a.held), c.s), 'held': ''} END, {'done': []::VARCHAR[], 'held': ''})"""
    return {
        "sentence_counts": f"SELECT doc_id, len({_sentences("coalesce(text, '')", _JAVA)})::INT AS sentences FROM documents",
        "chunk_heading": f"""WITH sec AS (SELECT doc_id, i, {sections}[i] AS s FROM (SELECT doc_id, text, unnest(range(1, len({sections}) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
            pk AS (SELECT doc_id, i, s, CASE WHEN length(s) <= 1500 THEN {{'done': [s], 'held': ''}} ELSE {packed.replace('x.s', 's')} END AS p FROM sec),
            fl AS (SELECT doc_id, i, list_filter(CASE WHEN {_strip('p.held')} = '' THEN p.done ELSE list_append(p.done, {_strip('p.held')}) END, lambda c: c <> '') AS cs FROM pk),
            ps AS (SELECT doc_id, list_transform(flatten(list(cs ORDER BY i)), lambda c: {{'s': c, 'bare': {_bare('c')}}}) AS pieces FROM fl GROUP BY doc_id),
            m AS (SELECT doc_id, {merged} AS r FROM ps),
            o AS (SELECT doc_id, CASE WHEN r.held = '' THEN r.done ELSE list_append(r.done, r.held) END AS cs FROM m)
            SELECT doc_id, (i - 1)::INT AS chunk_no, cs[i] AS chunk FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM o)""",
        "chunk_semantic": f"""WITH d AS (SELECT doc_id, text, {_sentences('text', _BLANKS)} AS s FROM documents WHERE text IS NOT NULL),
            short AS (SELECT doc_id, 0 AS chunk_no, {_strip('text')} AS chunk FROM d WHERE len(s) BETWEEN 1 AND 6),
            w AS MATERIALIZED (SELECT doc_id, i, regexp_replace(array_to_string(s[i:i + 2], ''), '[^\\pL\\pN_]', '', 'g') AS t FROM (SELECT doc_id, s, unnest(range(1, len(s) - 1)) AS i FROM d WHERE len(s) > 6)),
            g AS MATERIALIZED (SELECT doc_id, i, b, count(*) AS n FROM (SELECT doc_id, i, unnest(list_transform(range(1, length(t)), lambda k: substring(t, k, 2))) AS b FROM w) GROUP BY ALL),
            q AS (SELECT doc_id, i, sum(n * n) AS q FROM g GROUP BY ALL),
            dots AS (SELECT a.doc_id, a.i, sum(a.n * b.n) AS dot FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.i = a.i + 3 AND a.b = b.b GROUP BY ALL),
            sims AS (SELECT w.doc_id, w.i, round(coalesce(dot / sqrt((x.q * y.q)::DOUBLE), 0), 9) AS sim FROM w JOIN w z ON z.doc_id = w.doc_id AND z.i = w.i + 3 LEFT JOIN dots ON dots.doc_id = w.doc_id AND dots.i = w.i
              LEFT JOIN q x ON x.doc_id = w.doc_id AND x.i = w.i LEFT JOIN q y ON y.doc_id = w.doc_id AND y.i = w.i + 3),
            lows AS (SELECT doc_id, list(i + 2) FILTER (sim < f) AS ends FROM (SELECT *, round(avg(sim) OVER p - 0.5 * stddev_pop(sim) OVER p, 9) AS f FROM sims WINDOW p AS (PARTITION BY doc_id)) GROUP BY doc_id),
            st AS (SELECT d.doc_id, list_transform(range(1, len(s) + 1), lambda k: {{'s': s[k], 'least': CASE WHEN list_contains(coalesce(ends, []), k) THEN 150 ELSE 1500 END}}) AS xs FROM d JOIN lows USING (doc_id)),
            r AS (SELECT doc_id, list_reduce(xs, lambda a, x: CASE WHEN length(a.held) + length(x.s) >= x.least THEN {{'done': list_append(a.done, a.held || x.s), 'held': ''}} ELSE {{'done': a.done, 'held': a.held || x.s}} END, {{'done': []::VARCHAR[], 'held': ''}}) AS r FROM st),
            o AS (SELECT doc_id, CASE WHEN r.held = '' THEN r.done ELSE list_append(r.done, r.held) END AS cs FROM r)
            SELECT doc_id, chunk_no::INT AS chunk_no, chunk FROM short UNION ALL SELECT doc_id, (i - 1)::INT, cs[i] FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM o)""",
        "session_size_cap": f"""WITH m AS (SELECT conv_key, row_id, length(coalesce(text, ''))::BIGINT AS n, ({_EPOCH})::DOUBLE AS t FROM archive_msgs WHERE conv_key IS NOT NULL),
            l AS (SELECT conv_key, list({{'row_id': row_id, 'n': n, 't': t}} ORDER BY t NULLS FIRST, row_id) AS xs FROM m GROUP BY conv_key),
            f AS (SELECT conv_key, list_reduce(xs, lambda a, x: CASE WHEN a.held AND (coalesce(x.t - a.last > 1800, false) OR a.filled + x.n > 800)
                THEN {{'out': list_append(a.out, {{'row_id': x.row_id, 'block': a.block + 1}}), 'block': a.block + 1, 'filled': x.n, 'held': true, 'last': coalesce(x.t, a.last)}}
                ELSE {{'out': list_append(a.out, {{'row_id': x.row_id, 'block': a.block}}), 'block': a.block, 'filled': a.filled + x.n, 'held': true, 'last': coalesce(x.t, a.last)}} END,
              {{'out': []::STRUCT(row_id BIGINT, block BIGINT)[], 'block': 0::BIGINT, 'filled': 0::BIGINT, 'held': false, 'last': NULL::DOUBLE}}) AS r FROM l)
            SELECT conv_key, o.row_id AS row_id, o.block AS block_no FROM (SELECT conv_key, unnest(r.out) AS o FROM f)""",
        "near_dup_survivors": f"""WITH {facts}, {fact_sets},
            p AS (SELECT DISTINCT a.day, a.fact_id AS x, b.fact_id AS y, length(fa.fact) AS nx, length(fb.fact) AS ny FROM fd a JOIN fd b ON a.day = b.day AND a.fact_id < b.fact_id JOIN cf fa ON fa.fact_id = a.fact_id JOIN cf fb ON fb.fact_id = b.fact_id
              WHERE round(len(list_intersect(a.s, b.s)) * 1.0 / least(len(a.s), len(b.s)), 6) >= 0.3),
            arcs AS (SELECT list({{'k': CASE WHEN nx >= ny THEN x ELSE y END, 'l': CASE WHEN nx >= ny THEN y ELSE x END}} ORDER BY day, -greatest(nx, ny), CASE WHEN nx >= ny THEN x ELSE y END) AS xs FROM p),
            gone AS (SELECT list_reduce(coalesce(xs, []), lambda a, x: CASE WHEN list_contains(a, x.k) THEN a ELSE list_append(a, x.l) END, []::VARCHAR[]) AS g FROM arcs)
            SELECT DISTINCT fact_id FROM cf, gone WHERE NOT list_contains(g, fact_id)""",
        "fact_top2_siblings": f"""WITH {near.format(k=11)}, c AS (SELECT query_id, vec_id, block, rank, 100 + vec_id % 300 AS bytes, vec_id % 7 = 0 AS cooling FROM near WHERE cosine >= 0.2),
            k AS (SELECT query_id, vec_id, block, rank, bytes FROM c WHERE rank <= 2 AND NOT cooling),
            u AS (SELECT query_id, sum(bytes)::BIGINT AS used, list(block) AS blocks FROM k GROUP BY query_id),
            s AS (SELECT c.query_id, any_value(u.used) AS used, list({{'v': c.vec_id, 'b': c.block, 'n': c.bytes::BIGINT}} ORDER BY rank) AS xs FROM c JOIN u USING (query_id) WHERE rank > 2 AND NOT cooling AND list_contains(u.blocks, c.block) GROUP BY c.query_id),
            f AS (SELECT query_id, list_reduce(xs, lambda a, x: CASE WHEN len(a.out) < 3 AND a.used + x.n <= 1000 THEN {{'out': list_append(a.out, x.v), 'used': a.used + x.n}} ELSE a END, {{'out': []::BIGINT[], 'used': used}}) AS r FROM s),
            owner AS (SELECT query_id, block, arg_max(vec_id, rank) AS own, max(rank) AS owner_rank FROM k GROUP BY ALL),
            rows_ AS (SELECT query_id, vec_id, 'kept' AS role, rank AS major, 0 AS minor FROM k
              UNION ALL SELECT c.query_id, c.vec_id, 'sibling', owner_rank, c.rank FROM f JOIN c USING (query_id) JOIN owner o ON o.query_id = c.query_id AND o.block = c.block WHERE list_contains(f.r.out, c.vec_id))
            SELECT query_id, vec_id AS fact_id, role, row_number() OVER (PARTITION BY query_id ORDER BY major, minor) AS at FROM rows_""",
    }
