"""Names of the training-data queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkivist.llm import chunking, conversations, neardup, packing, privacy, spam, tokenizer


# RE2 has no full Unicode white space class; the characters are listed.
_BLANKS = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LONG = rf"length(regexp_replace(text, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')) > 800"
_PAIRS = r"""
            e AS (SELECT DISTINCT entry_id, regexp_replace(lower(text), '[^\pL\pN]', '', 'g') AS s FROM memory_entries WHERE text IS NOT NULL),
            t AS MATERIALIZED (SELECT entry_id, unnest(list_distinct(list_transform(range(1, length(s) - 3), lambda i: substring(s, i, 5)))) AS g FROM e WHERE length(s) >= 200),
            n AS (SELECT entry_id, count(*) AS n FROM t GROUP BY entry_id),
            c AS (SELECT a.entry_id AS entry_a, b.entry_id AS entry_b, count(*) AS k FROM t a JOIN t b USING (g) WHERE a.entry_id < b.entry_id GROUP BY ALL)
            SELECT entry_a, entry_b FROM c JOIN n x ON entry_a = x.entry_id JOIN n y ON entry_b = y.entry_id WHERE k >= 0.7 * (x.n + y.n - k)"""
_SPEECH = r"""
            WITH judged AS (
              SELECT conv_key, key,
                CASE WHEN epoch IS NULL OR isnan(epoch) OR epoch <= 0 OR epoch >= 1e18 THEN NULL WHEN epoch > 1e11 THEN CAST(round(epoch) AS BIGINT) ELSE CAST(round(epoch * 1000) AS BIGINT) END AS ms,
                lower(regexp_replace(coalesce(role, ''), '^[\s\pZ\x{200b}\x{feff}]+|[\s\pZ\x{200b}\x{feff}]+$', '', 'g')) AS name,
                regexp_replace(regexp_replace(coalesce(text, ''), '<system-reminder(\s[^>]*)?>.*?</system-reminder\s*>', '', 'gs'), '<passive_recall_context(\s[^>]*)?>.*?</passive_recall_context\s*>', '', 'gs') AS said
              FROM archive_msgs WHERE conv_key IS NOT NULL AND key IS NOT NULL),
            merged AS (
              SELECT conv_key, key, min(ms) AS ms,
                min(CASE WHEN name IN ('user', 'human') THEN 'user' WHEN name IN ('assistant', 'ai', 'model', 'bot') THEN 'assistant' WHEN name <> '' THEN 'other' END) AS role,
                bool_or(regexp_matches(said, '[\pL\pN]')) AS words,
                bool_or(regexp_matches(said, '^[\s\pZ\x{200b}\x{feff}]*<(task-notification|(command|local-command|bash)-[\w-]+)')) AS host
              FROM judged GROUP BY conv_key, key),
            speech AS (
              SELECT conv_key, key, ms, role FROM merged
              WHERE words AND (role = 'assistant' OR (coalesce(role, 'user') = 'user' AND NOT host)))"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": chunking.found_query,
        "p1_pieces": chunking.pieces_query,
        "p1_rebuilt": chunking.rebuilt_query,
        "p3_found": neardup.found_query,
        "p3_groups": neardup.groups_query,
        "p4_found": privacy.found_query,
        "p4_redacted": privacy.redacted_query,
        "p5_found": conversations.found_query,
        "p5_turns": conversations.transcript_query,
        "p5_status": conversations.status_query,
        "p6_ids": tokenizer.ids_query,
        "p7_windows": packing.windows_query,
        "p7_fill": packing.fill_query,
        "p8_found": spam.found_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"SELECT DISTINCT entry_id FROM memory_entries WHERE {_LONG}",
        "p1_rebuilt": f"SELECT DISTINCT entry_id, md5(text) AS hash, true AS within_limit, true AS cut FROM memory_entries WHERE {_LONG}",
        # All pairs of texts that share a run of five; quick enough on the tables of the comparison.
        "p3_found": "WITH " + _PAIRS,
        "p3_groups": "WITH RECURSIVE p AS (WITH " + _PAIRS + r"""), g AS (SELECT entry_a AS a, entry_b AS b FROM p UNION SELECT entry_b, entry_a FROM p),
            w AS (SELECT DISTINCT a AS node, a AS seen FROM g UNION SELECT w.node, g.b FROM w JOIN g ON w.seen = g.a)
            SELECT node AS entry_id, min(seen) AS group_id, count(*) AS group_size FROM w GROUP BY node""",
        "p5_found": _SPEECH + r""",
            usable AS (
              SELECT conv_key FROM speech GROUP BY conv_key
              HAVING bool_and(role IS NOT NULL AND ms IS NOT NULL)
                AND arg_min(role, {'ms': ms, 'key': key}) = 'user' AND arg_max(role, {'ms': ms, 'key': key}) = 'assistant')
            SELECT conv_key, row_number() OVER (PARTITION BY conv_key ORDER BY ms, key) AS turn_no, key
            FROM speech WHERE conv_key IN (SELECT conv_key FROM usable)""",
        "p5_turns": _SPEECH + r""",
            usable AS (
              SELECT conv_key FROM speech GROUP BY conv_key
              HAVING bool_and(role IS NOT NULL AND ms IS NOT NULL)
                AND arg_min(role, {'ms': ms, 'key': key}) = 'user' AND arg_max(role, {'ms': ms, 'key': key}) = 'assistant'),
            texts AS (SELECT conv_key, key, max(regexp_replace(said, '^ +| +$', '', 'g')) AS text FROM judged WHERE regexp_matches(said, '[\pL\pN]') GROUP BY conv_key, key)
            SELECT conv_key, row_number() OVER (PARTITION BY conv_key ORDER BY ms, key) AS turn_no, key, role, text
            FROM speech JOIN texts USING (conv_key, key) WHERE conv_key IN (SELECT conv_key FROM usable)""",
        "p5_status": _SPEECH + r"""
            SELECT conv_key, CASE WHEN bool_or(role IS NULL OR ms IS NULL) OR arg_min(role, {'ms': ms, 'key': key}) <> 'user' THEN 'orphan'
              WHEN arg_max(role, {'ms': ms, 'key': key}) <> 'assistant' THEN 'unanswered' ELSE 'ok' END AS status FROM speech GROUP BY conv_key""",
    }
