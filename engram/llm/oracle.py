"""SQL for the queries that plain SQL can express on whole tables."""

from __future__ import annotations

from engram.functions.text import WHITE
from engram.llm import quality

_ID = "nullif(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '')"
_KIND = "nullif(regexp_replace(lower(trim(event_kind, ' ' || chr(9) || chr(10) || chr(13))), '[-\\s]', '_', 'g'), '')"
_REF = "nullif(regexp_replace(regexp_replace(lower(trim(ref)), '([a-z0-9])[^a-z0-9]*(retry|attempt|try)[^a-z0-9]*[0-9]+[^a-z0-9]*$', '\\1'), '[^a-z0-9]+', '', 'g'), '')"
_LINES = f"""SELECT {_ID.format('record_id')} AS id, record_id, pos, t, {_KIND} AS kind, {_REF} AS ref FROM timeline_events
    QUALIFY row_number() OVER (PARTITION BY {_ID.format('record_id')}, pos ORDER BY ingested_at DESC NULLS LAST) = 1"""


def _paths(n: int, kind: str) -> str:
    """Patterns of n steps by n - 1 self-joins, with their support."""
    steps = "||'>'||".join(f"s{i}.name" for i in range(1, n + 1))
    if kind == "event":
        joins = " ".join(f"JOIN seq s{i} ON s{i}.id = s1.id AND s{i}.no > s{i - 1}.no" for i in range(2, n + 1))
        return f"SELECT 'event' AS seq_kind, {steps} AS pattern, {n} AS n_steps, count(DISTINCT s1.id) AS support FROM seq s1 {joins} GROUP BY 2 HAVING count(DISTINCT s1.id) * 100 >= 6 * (SELECT count(DISTINCT id) FROM lines)"
    joins = " ".join(f"JOIN closure c{i} ON c{i}.id = s1.id AND c{i}.u = s{i - 1}.node JOIN nodes s{i} ON s{i}.id = s1.id AND s{i}.node = c{i}.v AND s{i}.name IS NOT NULL" for i in range(2, n + 1))
    return f"SELECT 'tool', {steps}, {n}, count(DISTINCT s1.id) FROM nodes s1 {joins} WHERE s1.name IS NOT NULL GROUP BY 2 HAVING count(DISTINCT s1.id) * 100 >= 6 * (SELECT count(DISTINCT id) FROM nodes)"


def _sets(field: str, rows: str) -> str:
    return f"SELECT '{field}' AS field, key, list_sort(list_distinct(regexp_extract_all(lower(value), '[a-z0-9]+'))) AS w FROM ({rows}) WHERE value IS NOT NULL"


_RECALL = "SELECT key, {0} AS value FROM (SELECT DISTINCT ON (key) * FROM recall_dataset WHERE type = 'record')"
_FACTS = f"SELECT record_id AS key, object AS value FROM semantic_facts QUALIFY row_number() OVER (PARTITION BY {_ID.format('record_id')} ORDER BY updated_at DESC NULLS LAST) = 1"

_LINES_OF = "list_filter(string_split_regex(text, '\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]'), lambda x: trim(x, '" + WHITE + "') <> '')"
_PLAIN = f"""SELECT doc_id, n_chars, CASE WHEN seen THEN len(w) ELSE 0 END AS n_words, CASE WHEN seen THEN len(l) ELSE 0 END AS n_lines, round(CASE WHEN seen THEN length(array_to_string(w, '')) / greatest(len(w), 1) ELSE 0 END, 6) AS mean_word_length,
    round(CASE WHEN seen THEN length(regexp_replace(text, '{quality.J_SYMBOL}', '', 'g')) / n_chars ELSE 0 END, 6) AS symbol_ratio, round(CASE WHEN seen THEN length(regexp_replace(text, '\\P{{Nd}}+', '', 'g')) / n_chars ELSE 0 END, 6) AS digit_ratio,
    round(CASE WHEN seen THEN len(list_filter(l, lambda x: regexp_matches(trim(x, '{WHITE}'), '{quality.J_ENDS.replace("'", "''")}'))) / greatest(len(l), 1) ELSE 0 END, 6) AS end_punctuation_share
    FROM (SELECT doc_id, text, length(text) AS n_chars, regexp_replace(text, '{quality.J_UNSEEN}', '', 'g') <> '' AS seen, regexp_extract_all(text, '{quality.J_WORD.replace("'", "''")}') AS w, {_LINES_OF} AS l
      FROM (SELECT doc_id, coalesce(min(text), '') AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY 1))"""

_MINED = f"""WITH RECURSIVE lines AS ({_LINES}), seq AS (SELECT id, kind AS name, row_number() OVER (PARTITION BY id ORDER BY t, pos) AS no FROM lines WHERE t IS NOT NULL AND kind IS NOT NULL),
    nodes AS (SELECT {_ID.format('record_id')} AS id, {_ID.format('node_id')} AS node, nullif(lower(trim(tool, ' ' || chr(9) || chr(10) || chr(13))), '') AS name, depends_on FROM tool_nodes
      QUALIFY row_number() OVER (PARTITION BY {_ID.format('record_id')}, {_ID.format('node_id')} ORDER BY called_at DESC NULLS LAST) = 1),
    edges AS (SELECT DISTINCT e.id, e.u, e.v FROM (SELECT id, lower(trim(unnest(depends_on))) AS u, node AS v FROM nodes) e JOIN nodes n ON n.id = e.id AND n.node = e.u),
    closure(id, u, v) AS (SELECT id, u, v FROM edges UNION SELECT c.id, c.u, e.v FROM closure c JOIN edges e ON e.id = c.id AND e.u = c.v),
    found AS ({_paths(3, 'event')} UNION ALL {_paths(4, 'event')} UNION ALL {_paths(3, 'tool')} UNION ALL {_paths(4, 'tool')})"""
_RUNS = f"""WITH l AS ({_LINES}), o AS (SELECT *, CASE WHEN kind IS NOT NULL AND ref IS NOT NULL AND kind = lag(kind) OVER w AND ref = lag(ref) OVER w AND epoch_us(t) - epoch_us(lag(t) OVER w) <= 600000000 THEN 0 ELSE 1 END AS new
      FROM l WHERE t IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY t, pos)), g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY t, pos) AS run FROM o),
    r AS (SELECT first(record_id ORDER BY t, pos) AS record_id, first(kind) AS event_kind, first(ref) AS ref, first(pos ORDER BY t, pos)::BIGINT AS first_pos, last(pos ORDER BY t, pos)::BIGINT AS last_pos, count(*) AS n_events,
      epoch_us(min(t)) AS first_us, (epoch_us(max(t)) - epoch_us(min(t))) / 1e6 AS seconds FROM g GROUP BY id, run HAVING count(*) > 1)"""
_ALIKE = f"WITH s AS ({_sets('text', _RECALL.format('text'))} UNION ALL {_sets('summary', _RECALL.format('summary'))} UNION ALL {_sets('object', _FACTS)})"
_NEAR = "a.field = b.field AND len(a.w) >= 6 AND len(b.w) >= 6 AND 5 * len(a.w) >= 3 * len(b.w) AND 5 * len(b.w) >= 3 * len(a.w)"
_SHARE = "5 * len(list_intersect(a.w, b.w)) >= 3 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))"

SQL = {
    "p10_counts": _PLAIN,
    "p3_found": f"{_MINED} SELECT seq_kind, pattern FROM found",
    "p3_patterns": f"{_MINED} SELECT seq_kind, pattern, n_steps, support FROM found",
    "p6_found": f"{_RUNS} SELECT record_id, first_pos, last_pos FROM r",
    "p6_runs": f"{_RUNS} SELECT record_id, event_kind, ref, first_pos, last_pos, n_events, first_us, seconds FROM r",
    "p7_found": f"{_ALIKE} SELECT a.field, a.key AS key_a, b.key AS key_b FROM s a JOIN s b ON {_NEAR} AND a.key < b.key WHERE {_SHARE}",
    "p7_classes": f"""{_ALIKE}, u AS (SELECT field, w, count(*) AS copies FROM s WHERE len(w) >= 6 GROUP BY 1, 2), l AS (SELECT a.field, a.w, sum(b.copies) AS links FROM u a JOIN u b ON {_NEAR} AND a.w <> b.w WHERE {_SHARE} GROUP BY 1, 2)
    SELECT s.field, s.key, md5(s.field || ' ' || array_to_string(s.w, ' ')) AS class_id, u.copies, coalesce(l.links, 0)::BIGINT AS links FROM s JOIN u ON u.field = s.field AND u.w = s.w LEFT JOIN l ON l.field = s.field AND l.w = s.w""",
}
