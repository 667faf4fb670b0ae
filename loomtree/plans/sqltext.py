"""Building blocks of the SQL that states the annotation queries over the same tables."""

from __future__ import annotations

from loomtree.functions import patterns as P


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, {quoted(f'^[{P.SPACE}]+|[{P.SPACE}]+$')}, '', 'g')"


def split(text: str, breaks: str = P.LINE_BREAK) -> str:
    p = f"string_split_regex({text}, {quoted(breaks)})"
    return f"(CASE WHEN {p}[-1] = '' THEN {p}[:-2] ELSE {p} END)"


def tokens(text: str) -> str:
    for pattern in (P.COMMENT, P.HEADER_LINE, P.MATH_BLOCK, P.MATH_INLINE):
        text = f"regexp_replace({text}, {quoted(pattern)}, ' ', 'g')"
    return f"regexp_extract_all(lower({text}), {quoted(P.CONTENT_TOKEN)})"


TEXTS = "texts AS (SELECT DISTINCT run_id AS doc, ordinal AS chunk, raw_content AS t FROM batch_plans WHERE raw_content IS NOT NULL)"
DOC_TEXTS = "texts AS (SELECT doc_id AS doc, 0 AS chunk, text AS t FROM documents WHERE text IS NOT NULL)"
LINES = f"""parts AS (SELECT doc, chunk, {split('t')} AS p FROM texts),
lines AS (SELECT doc, chunk, unnest(range(1, len(p) + 1))::INT AS line_no, unnest(p) AS line FROM parts)"""


FILE_SPLIT = LINES.replace(split("t"), split("t", P.FILE_LINE_BREAK))


def _value(key: str) -> str:
    v = f"vs[list_position(ks, '{key}')]"
    return f"(CASE WHEN starts_with({v}, '\"') AND ends_with({v}, '\"') THEN substr({v}, 2, greatest(length({v}) - 2, 0)) ELSE {v} END)"


def _deps(value: str) -> str:
    t = trimmed(value)
    inner = f"(CASE WHEN starts_with({t}, '[') AND ends_with({t}, ']') THEN substr({t}, 2, greatest(length({t}) - 2, 0)) ELSE {t} END)"
    part = f"trim(trim({trimmed('x')}, '\"'), '''')"
    return f"coalesce(list_filter(list_transform(string_split({inner}, ','), lambda x: {part}), lambda x: x <> ''), []::VARCHAR[])"


MARKED = f"""marked AS (SELECT *, min(CASE WHEN regexp_matches(line, {quoted(P.CUTOFF)}) THEN line_no END) OVER (PARTITION BY doc, chunk) AS cutoff_line FROM lines),
heads0 AS (SELECT doc, chunk, line_no, length(regexp_extract(line, {quoted(P.HEADER)}, 1))::INT AS depth,
    regexp_extract(line, {quoted(P.HEADER)}, 2) AS rest FROM marked
  WHERE (cutoff_line IS NULL OR line_no < cutoff_line) AND regexp_matches(line, {quoted(P.HEADER)})),
attrs AS (SELECT *, list_reverse(regexp_extract_all(rest, {quoted(P.ATTRIBUTE)}, 1)) AS ks,
    list_reverse(regexp_extract_all(rest, {quoted(P.ATTRIBUTE)}, 2)) AS vs FROM heads0)"""

PARSED = f"""{MARKED},
events AS (
  SELECT doc, chunk, line_no, 0 AS event_id, 'header' AS event_type, {_value('id')} AS id, depth, {_value('title')} AS title,
    {_value('type')} AS node_type, {_value('proves')} AS proves, {_deps(_value('deps'))} AS deps
  FROM attrs WHERE coalesce({_value('id')}, '') <> ''
  UNION ALL
  SELECT DISTINCT doc, chunk, cutoff_line, 0, 'cutoff', '', 0, NULL, NULL, NULL, []::VARCHAR[] FROM marked WHERE cutoff_line IS NOT NULL)"""

STORED = """stored AS (SELECT DISTINCT run_id AS doc, chunk_number AS chunk, line_number AS line_no, event_id, event_type,
    coalesce(id, '') AS id, coalesce(depth, 0) AS depth, title, node_type, proves, deps FROM annotation_events),
events AS (SELECT * EXCLUDE (cut) FROM (SELECT *, min(CASE WHEN event_type = 'cutoff' THEN line_no END) OVER (PARTITION BY doc, chunk) AS cut FROM stored)
  WHERE (cut IS NULL OR line_no <= cut) AND (event_type = 'cutoff' OR id <> ''))"""

HEADS = """heads AS (SELECT *, {'c': chunk, 'l': line_no, 'e': event_id} AS place FROM events WHERE event_type = 'header'),
firsts AS (SELECT doc, id, min(place) AS first_place FROM heads GROUP BY ALL)"""

NODES = f"""h1 AS (SELECT *, greatest(1, depth) AS d, row_number() OVER (PARTITION BY doc ORDER BY chunk, line_no, event_id) AS k
  FROM events WHERE event_type = 'header'),
h2 AS (SELECT *, (k + least(0, min(d - k) OVER (PARTITION BY doc ORDER BY k ROWS UNBOUNDED PRECEDING)))::INT AS e FROM h1),
h3 AS (SELECT doc, k, e AS level, k AS given, NULL::BIGINT AS asks FROM h2 UNION ALL SELECT doc, k, e - 1, NULL::BIGINT, k FROM h2),
h4 AS (SELECT doc, asks, coalesce(max(given) OVER (PARTITION BY doc, level ORDER BY k, asks NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS parent
  FROM h3),
nodes AS (SELECT h2.doc, chunk, line_no, k::INT AS node_seq, id, coalesce(nullif(title, ''), id) AS title,
    CASE WHEN node_type IN {listed(P.NODE_TYPES)} THEN node_type ELSE 'generic' END AS node_type, proves, deps, d AS depth, e AS eff_depth,
    parent::INT AS parent_seq FROM h2 JOIN h4 ON h2.doc = h4.doc AND h2.k = h4.asks)"""

SPANS = f"""ends AS (SELECT doc, chunk, len(p) AS n_lines FROM parts),
marks AS (SELECT doc, chunk, line_no, event_type FROM events
  UNION ALL SELECT doc, chunk, n_lines + 1, 'end' FROM ends
    WHERE (doc, chunk) NOT IN (SELECT (doc, chunk) FROM events WHERE event_type = 'cutoff')),
s1 AS (SELECT doc, chunk, line_no, coalesce(lag(line_no) OVER c, 0) + 1 AS first_line,
    coalesce(sum(CASE WHEN event_type = 'header' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY chunk, line_no, event_type = 'end'
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS owner
  FROM marks WINDOW c AS (PARTITION BY doc, chunk ORDER BY line_no, event_type = 'end')),
spans AS (SELECT doc, chunk, owner::INT AS node_seq, first_line::INT AS first_line, (line_no - 1)::INT AS last_line FROM s1
  WHERE owner > 0 AND first_line <= line_no - 1)"""

#: Ancestors of event-built trees: parent links followed up.
CLOSURE = """closure AS (SELECT doc, node_seq AS node, node_seq AS ancestor, parent_seq AS up FROM nodes
  UNION ALL SELECT c.doc, c.node, n.node_seq, n.parent_seq FROM closure c JOIN nodes n ON n.doc = c.doc AND n.node_seq = c.up)"""


def query(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select
