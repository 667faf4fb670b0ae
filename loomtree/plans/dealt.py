"""Queries of the general training-data problems (1, 2, 4) and their SQL."""

from __future__ import annotations

from loomtree.operators import intervals, nested, references
from loomtree.session import table


def _p2(spark, d):
    return references.orphan_references(table(spark, d, "annotation_events"), table(spark, d, "node_removals"))


def _trees(spark, d):
    return table(spark, d, "tree_snapshots", spread=True)


QUERIES = {
    "p1_found": lambda spark, d: intervals.owned_lines(table(spark, d, "content_spans")),
    "p2_found": lambda spark, d: _p2(spark, d).select("event_id", "field", "target_id", "reason"),
    "p2_report": lambda spark, d: references.orphan_report(_p2(spark, d)),
    "p4_found": lambda spark, d: nested.flatten_trees(_trees(spark, d)).select("tree_id", "kind", "node_path", "pos", "value"),
    "p4_nodes": lambda spark, d: nested.tree_nodes(_trees(spark, d)),
    "p4_content": lambda spark, d: nested.tree_content(_trees(spark, d)),
    "p4_dependencies": lambda spark, d: nested.tree_dependencies(_trees(spark, d)),
    "p4_levels": lambda spark, d: nested.shredded_columns(_trees(spark, d)),
}

_ORPHANS = """
WITH ev AS (SELECT DISTINCT event_id, run_id, chunk_number, line_number, id, proves, deps, received_at
            FROM annotation_events WHERE event_type = 'header'),
refs AS (
  SELECT DISTINCT event_id, run_id, chunk_number c, line_number l, received_at, 'deps' AS field, target_id
  FROM (SELECT *, unnest(deps) AS target_id FROM ev) WHERE target_id <> ''
  UNION ALL
  SELECT event_id, run_id, chunk_number, line_number, received_at, 'proves', proves FROM ev WHERE proves <> ''),
heads AS (SELECT run_id, id, min({'c': chunk_number, 'l': line_number}) AS place FROM ev WHERE id IS NOT NULL GROUP BY ALL),
gone AS (SELECT run_id, node_id AS id, min(removed_in_chunk) AS gone FROM node_removals GROUP BY ALL),
found AS (
  SELECT r.*, CASE WHEN h.place IS NULL THEN 'missing' WHEN h.place > {'c': r.c, 'l': r.l} THEN 'late'
                   WHEN g.gone <= r.c THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN heads h ON h.run_id = r.run_id AND h.id = r.target_id
              LEFT JOIN gone g ON g.run_id = r.run_id AND g.id = r.target_id)
"""

_TREES = """
WITH RECURSIVE docs AS (
  SELECT DISTINCT tree_id, run_id, tree_json AS j FROM tree_snapshots WHERE tree_json IS NOT NULL AND json_valid(tree_json)),
inner1 AS (
  SELECT tree_id, run_id, CASE WHEN json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$') ELSE j END AS j FROM docs),
inner2 AS (
  SELECT tree_id, run_id, CASE WHEN json_valid(j) AND json_type(j) = 'OBJECT' AND json_extract(j, '$.id') IS NULL
      AND json_type(j, '$.tree') = 'OBJECT' THEN json_extract(j, '$.tree') ELSE j::JSON END AS j
  FROM inner1 WHERE json_valid(j)),
nodes AS (
  SELECT tree_id, run_id, '0' AS node_path, NULL::VARCHAR AS parent_path, 0 AS pos, j FROM inner2 WHERE json_type(j) = 'OBJECT'
  UNION ALL
  SELECT tree_id, run_id, node_path || '.' || (i - 1), node_path, (i - 1)::INT, kids[i]
  FROM (SELECT *, unnest(range(1, len(kids) + 1)) AS i
        FROM (SELECT tree_id, run_id, node_path, json_extract(j, '$.children[*]') AS kids FROM nodes
              WHERE json_type(j, '$.children') = 'ARRAY'))
  WHERE json_type(kids[i]) = 'OBJECT'),
content AS (
  SELECT tree_id, run_id, node_path, (i - 1)::INT AS pos, items[i] AS x
  FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i
        FROM (SELECT tree_id, run_id, node_path, CASE json_type(j, '$.content') WHEN 'ARRAY' THEN json_extract(j, '$.content[*]')
                WHEN 'OBJECT' THEN [json_extract(j, '$.content')] ELSE [] END AS items FROM nodes))
  WHERE json_type(items[i]) = 'OBJECT'),
deps AS (
  SELECT tree_id, run_id, node_path, (i - 1)::INT AS pos, trim(items[i]) AS dep_id
  FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i
        FROM (SELECT tree_id, run_id, node_path, CASE json_type(j, '$.dependencies')
                WHEN 'ARRAY' THEN list_transform(json_extract(j, '$.dependencies[*]'), lambda v: json_extract_string(v, '$'))
                WHEN 'VARCHAR' THEN string_split(json_extract_string(j, '$.dependencies'), ',') ELSE [] END AS items FROM nodes))
  WHERE items[i] IS NOT NULL AND trim(items[i]) <> '')
"""

ORACLES = {
    "p1_found": """
WITH s AS (SELECT DISTINCT run_id, chunk_number, first_line f, last_line l FROM content_spans
           WHERE run_id IS NOT NULL AND chunk_number IS NOT NULL AND first_line <= last_line),
m AS (SELECT *, max(l) OVER (PARTITION BY run_id, chunk_number ORDER BY f, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR f > reach + 1 THEN 1 ELSE 0 END)
        OVER (PARTITION BY run_id, chunk_number ORDER BY f, l ROWS UNBOUNDED PRECEDING) AS n FROM m),
p AS (SELECT run_id, chunk_number, n, min(f) AS f, max(l) AS l FROM g GROUP BY ALL)
SELECT run_id, chunk_number, 'period' AS kind, f::INT AS first_line, l::INT AS last_line FROM p
UNION ALL
SELECT run_id, chunk_number, 'gap', (l + 1)::INT, (nx - 1)::INT
FROM (SELECT *, lead(f) OVER (PARTITION BY run_id, chunk_number ORDER BY f) AS nx FROM p) WHERE nx IS NOT NULL""",
    "p2_found": _ORPHANS + "SELECT event_id, field, target_id, reason FROM found WHERE reason IS NOT NULL",
    "p2_report": _ORPHANS
    + """SELECT field, run_id, strftime(received_at, '%Y-%m') AS month, reason, count(*) AS n_references,
       count(DISTINCT event_id) AS n_events FROM found WHERE reason IS NOT NULL GROUP BY ALL""",
    "p4_found": _TREES
    + """
SELECT tree_id, 'node' AS kind, node_path, pos, coalesce(json_extract_string(j, '$.id'), '') AS value FROM nodes
UNION ALL
SELECT tree_id, 'content', node_path, pos, coalesce(json_extract_string(x, '$.chunk_number'), '') || ':' ||
  coalesce(json_extract_string(x, '$.first_line'), '') || ':' || coalesce(json_extract_string(x, '$.last_line'), '') FROM content
UNION ALL SELECT tree_id, 'dependency', node_path, pos, dep_id FROM deps""",
    "p4_nodes": _TREES
    + """SELECT tree_id, run_id, node_path, parent_path, pos, coalesce(json_extract_string(j, '$.id'), '') AS id,
  json_extract_string(j, '$.title') AS title, json_extract_string(j, '$.node_type') AS node_type,
  json_extract_string(j, '$.proves_id') AS proves_id FROM nodes""",
    "p4_content": _TREES
    + """SELECT tree_id, run_id, node_path, pos, try_cast(json_extract_string(x, '$.chunk_number') AS INT) AS chunk_number,
  try_cast(json_extract_string(x, '$.first_line') AS INT) AS first_line, try_cast(json_extract_string(x, '$.last_line') AS INT) AS last_line
FROM content""",
    "p4_dependencies": _TREES + "SELECT tree_id, run_id, node_path, pos, dep_id FROM deps",
}
