"""SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from corpusmill.llm.splits import STAND_INS

_WIDE = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])
_NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _words(x: str) -> str:
    t = f"regexp_replace({x}, '(\\pL)[-\\x{{2010}}\\x{{2011}}\\x{{ad}}][ \\t]*\\r?\\n[ \\t]*(\\pL)', '\\1\\2', 'g')"
    t = f"regexp_replace(strip_accents(translate({t}, '{_WIDE}', '{_NARROW}')), '[\\x{{300}}-\\x{{36f}}\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{fe0f}}\\x{{feff}}]', '', 'g')"
    return f"regexp_extract_all(lower({t}), '[a-z0-9]+')"


_PASSAGES = f"""m AS (SELECT item_id, unnest(messages) AS m FROM (SELECT item_id, messages FROM assistant UNION ALL SELECT item_id, messages FROM posttrain_regression)),
 w AS (SELECT item_id, {_words("m.content")} AS w FROM m WHERE m.role <> 'system' AND m.content IS NOT NULL),
 g AS (SELECT DISTINCT item_id, least(12, len(w)) AS k, array_to_string(w[i:i + least(12, len(w)) - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - least(12, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
 d AS (SELECT doc_id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL),
 h AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g)))"""

_NONE = ", ".join("'" + x.replace("'", "''") + "'" for x in STAND_INS)


def _value(x: str) -> str:
    return f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"


def _links(table: str) -> str:
    parts = [f"SELECT '{table}' AS record_table, example_id, 'source' AS kind, source AS v FROM {table} WHERE source IS NOT NULL"]
    for kind, x in (("group", "split_group_id"), ("author", "metadata['author']"), ("entity", "metadata['entity']")):
        parts.append(f"SELECT '{table}', example_id, '{kind}', {_value(x)} FROM {table} WHERE {_value(x)} NOT IN ({_NONE})")
    return " UNION ".join(parts)


def oracle_sql() -> dict[str, str]:
    return {
        "p4_invariants": "SELECT count(*) AS records, 0 AS twice, 0 AS values_in_two_splits, 0 AS quotas_missed FROM (SELECT DISTINCT 's' AS t, example_id FROM sft_examples UNION ALL SELECT DISTINCT 'p', example_id FROM preference_examples) WHERE example_id IS NOT NULL",
        "p6_invariants": "SELECT count(DISTINCT name) AS sources, 0 AS over_limit, 0 AS over_epochs, 0 AS uneven_copies, 0 AS unweighted_drawn, 0 AS shares_not_one FROM data_sources WHERE trim(name) <> ''",
        "p8_invariants": "SELECT count(*) AS documents, count(*) FILTER (WHERE length(text) > 0) AS with_text, 0 AS not_whole, 0 AS split_but_fit, 0 AS without_container, 0 AS overfull, 0 AS wasteful FROM documents",
        "p3_found": f"WITH {_PASSAGES} SELECT DISTINCT item_id, doc_id FROM g JOIN h USING (k, gram)",
        "p4_found": f"""WITH RECURSIVE v AS ({_links("sft_examples")} UNION {_links("preference_examples")}),
 reach AS (SELECT v AS src, record_table, example_id FROM v WHERE kind = 'source' UNION SELECT r.src, b.record_table, b.example_id FROM reach r JOIN v a ON a.record_table = r.record_table AND a.example_id = r.example_id JOIN v b ON b.kind = a.kind AND b.v = a.v)
 SELECT record_table, example_id, min(src) AS group_source FROM reach GROUP BY 1, 2 HAVING count(DISTINCT src) > 1""",
    }
