"""Queries of sources, serialization, sessions and streams, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtree.checkpoints import checkpointed, removed_folder, shared_folder
from loomtree.functions import patterns as P
from loomtree.operators import lines, preview, rules, tree, treejson
from loomtree.plans import annotation_queries as A
from loomtree.plans import tools
from loomtree.plans.dealt import _TREES
from loomtree.plans.sqltext import CLOSURE, FILE_SPLIT, LINES, NODES, PARSED, SPANS, TEXTS, listed, query, quoted
from loomtree.session import table
from loomtree.sources import files, sinks, tables
from loomtree.streaming import fold


def _clean(s, d):
    """Batch texts in the place of clean texts."""
    return A._plans(s, d).select(F.col("run_id").alias("doc"), "ordinal", F.col("raw_content").alias("text"))


def _steps(s, d):
    """Batches with the number of their place in the run, found from their ordinals alone: no text is sorted or gathered."""
    keys = A._plan_keys(s, d)
    step = keys.select(F.col("doc").alias("k_doc"), F.col("ordinal").alias("k_ordinal"), (F.row_number().over(W.partitionBy("doc").orderBy("ordinal")) - 1).alias("step"))
    rows = _clean(s, d)
    return rows.join(step, (F.col("doc") == F.col("k_doc")) & F.col("ordinal").eqNullSafe(F.col("k_ordinal"))).select("doc", "ordinal", "step", "text")


def _file_order(s, d):
    names = A._plan_keys(s, d).select("doc", F.concat(F.lit("clean_"), F.col("ordinal").cast("string"), F.lit(".md")).alias("name"))
    place = F.row_number().over(W.partitionBy("doc").orderBy(tables.numeric_order(F.col("name"))))
    return names.select("doc", "name", place.alias("place"))


def _memory(s, d):
    """Every batch with the memory text of its run's latest context; repeated rows change no maximum."""
    memory = table(s, d, "batch_contexts").groupBy(F.col("run_id").alias("doc")).agg(F.max_by("memory_text", "ordinal").alias("memory_text"))
    return tables.with_memory(A._plan_keys(s, d), memory)


def _exists(s, d):
    return tables.clean_exists(A._plan_keys(s, d), table(s, d, "batch_contexts").select(F.col("run_id").alias("doc"), "ordinal"))


def _read_clean(s, d):
    """The clean text of the first batch of every document, as reading it by its number gives it."""
    return tables.read_clean(_clean(s, d), None, 0).select("doc", F.md5("text").alias("text_hash"))


def _trees(s, d):
    return table(s, d, "tree_snapshots")


def _rule(which):
    def run(s, d):
        nodes, content, _ = treejson.load(_trees(s, d), keep=True)
        whole = content.where("chunk_number IS NOT NULL AND first_line IS NOT NULL AND last_line IS NOT NULL")
        link = nodes.select("doc", "node", "parent")
        return which(link, whole, rules.path_bounds(whole)).select("doc", "node", "parent")

    return run


def _content_order(s, d):
    _, content, _ = treejson.load(_trees(s, d))
    whole = content.where("chunk_number IS NOT NULL AND first_line IS NOT NULL AND last_line IS NOT NULL")
    return rules.out_of_order_content(whole, "pos").select("doc", "node", "pos")


def _export(s, d):
    nodes = checkpointed(A._nodes(s, d))
    spans = tree.content_spans(A._parsed(s, d), A._ends(s, d)).withColumnRenamed("chunk", "chunk_number")
    return treejson.export(nodes, spans)


def _sessions(s, d):
    """Every batch plan as a session of its own: its first four fifths of lines are the cleaned text."""
    rows = table(s, d, "batch_plans").select("plan_id", "raw_content", "clean_token_target", "start_line").distinct()
    parts = lines.split_lines(F.col("raw_content"))
    cleaned = F.array_join(F.slice(parts, 1, F.greatest(F.lit(1), F.floor(F.size(parts) * 0.8).cast("int"))), "\n")
    return rows.where("raw_content IS NOT NULL").select(
        F.col("plan_id").alias("doc"), F.col("raw_content").alias("raw"), cleaned.alias("cleaned"), "clean_token_target", F.col("start_line").alias("raw_start_line")
    )


def _submitted(s, d):
    return tools.submit(checkpointed(_sessions(s, d)))


def _committed(s, d):
    return tools.commit(checkpointed(_submitted(s, d)), _sessions(s, d))


def _payloads(s, d):
    """The latest context of every run with the tree and ids of its batches. The latest is found by number, then read."""
    nodes = checkpointed(A._nodes(s, d))
    contexts = table(s, d, "batch_contexts")
    last = contexts.groupBy("run_id").agg(F.max(F.struct("ordinal", "context_id"))["context_id"].alias("context_id")).select("context_id")
    latest = contexts.join(last, "context_id", "left_semi").dropDuplicates(["context_id"])
    known = nodes.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("node_seq", "id"))), lambda x: x["id"]).alias("known_ids"))
    rows = tools.read_batch(latest.withColumnRenamed("run_id", "doc"), preview.tree_preview(nodes), known)
    return A._flat(rows)


def _state(s):
    return files.StateDir(f"{shared_folder(s)}/state-{uuid.uuid4().hex}")


def _read_back(s, state, rows):
    """What was read from a state directory that is needed no more."""
    kept = checkpointed(rows)
    removed_folder(s, state.root)
    return kept


def _batch_rows(s, d):
    return A._plans(s, d).where("raw_content IS NOT NULL").select(F.col("run_id").alias("doc"), "ordinal", F.col("raw_content").alias("text"))


def _raw_mirror(s, d):
    """All batches written, the first of each document written again, and read back."""
    state, rows = _state(s), _batch_rows(s, d).withColumnRenamed("text", "raw_content")
    sinks.write_raw_batches(rows, state)
    sinks.write_raw_batches(rows.where("ordinal = 0").withColumn("raw_content", F.lit("again")), state)
    back = tables.latest(s.read.parquet(state.raw), "doc", "ordinal")
    return _read_back(s, state, back.select("doc", "ordinal", F.md5("raw_content").alias("content_hash")))


def _clean_written(s, d):
    state, rows = _state(s), _batch_rows(s, d)
    sinks.write_clean_batches(rows, state)
    sinks.write_clean_batches(rows.where("ordinal = 0").withColumn("text", F.lit("again")), state)
    back = tables.latest(s.read.parquet(state.clean), "doc", "ordinal")
    return _read_back(s, state, back.select("doc", "ordinal", F.md5("text").alias("text_hash")))


def _logs(s, d):
    """Every batch logged, every other one among the failures too."""
    state, rows = _state(s), _batch_rows(s, d)
    entry = rows.select(F.format_string("chunk_%03d", "ordinal").alias("chunk_id"), "doc", "ordinal", F.col("text").alias("content"))
    sinks.append_log(entry, state)
    sinks.append_failures(entry.where("ordinal % 2 = 0"), state)
    both = s.read.json(state.logs).withColumn("kind", F.lit("log")).unionByName(s.read.json(state.failures).withColumn("kind", F.lit("failure")))
    return _read_back(s, state, both.select("kind", "doc", F.col("chunk_id"), F.md5("content").alias("content_hash")))


def _snapshots_written(s, d):
    """The cursors of every run written, those of every other run advanced and written again, and read back."""
    state = _state(s)
    rows = tables.snapshot(table(s, d, "parse_runs")).select(F.col("run_id").cast("string").alias("doc"), "next_start_line", "next_chunk_id", "sections_completed")
    sinks.write_snapshot(rows, state)
    sinks.write_snapshot(rows.where("CAST(doc AS BIGINT) % 2 = 0").withColumn("sections_completed", F.col("sections_completed") + 1), state)
    return _read_back(s, state, files.read_snapshot(s, state))


def _tree_written(s, d):
    state, nodes = _state(s), checkpointed(A._nodes(s, d))
    sinks.write_tree(nodes, tree.content_spans(A._parsed(s, d), A._ends(s, d)), state)
    back = s.read.parquet(f"{state.tree}/nodes").groupBy("doc").agg(F.count(F.lit(1)).alias("n_nodes"))
    spans = s.read.parquet(f"{state.tree}/content").groupBy("doc").agg(F.count(F.lit(1)).alias("n_spans"))
    return _read_back(s, state, back.join(spans, "doc", "left").select("doc", "n_nodes", F.coalesce("n_spans", F.lit(0)).alias("n_spans")))


def _final_written(s, d):
    """Lines of the merged text as it was written."""
    state = _state(s)
    sinks.write_final(_clean(s, d), state)
    return _read_back(s, state, s.read.text(state.final).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n")))


def _json_written(s, d):
    """Every run as an indented JSON document, written and read back."""
    state = _state(s)
    runs = table(s, d, "parse_runs").select(F.to_json(F.struct("run_id", "raw_path", "task_model", "batch_tokens")).alias("json"))
    sinks.write_json(runs, state.at("out"))
    text = s.read.text(state.at("out")).where("value LIKE '  \"%'")
    parts = [F.regexp_extract("value", r'^  "(\w+)": (.*?),?$', k).alias(name) for k, name in ((1, "key"), (2, "value"))]
    return _read_back(s, state, text.select(*parts))


def _json_read(s, d):
    """The runs written as JSON objects and read by their schema."""
    state, columns = _state(s), "run_id BIGINT, raw_path STRING, batch_tokens INT, started_at STRING"
    runs = table(s, d, "parse_runs").select("run_id", "raw_path", "batch_tokens", F.date_format("started_at", "yyyy-MM-dd").alias("started_at"))
    runs.write.json(state.at("runs"))
    return _read_back(s, state, files.read_json(s, state.at("runs"), columns, one_a_file=False))


def _paths(s, d):
    """The places of a state directory."""
    state = files.StateDir("root/")
    names = ("raw", "clean", "logs", "failures", "tree", "snapshot", "memory", "final", "commits")
    return s.createDataFrame([(n, getattr(state, n)) for n in names], "name string, path string")


def _commits(s, d):
    """A manifest of all batches, committed a document's even and odd ones apart; an empty commit adds nothing."""
    state, rows = _state(s), A._plan_keys(s, d).withColumn("chunk_id", F.format_string("chunk_%03d", "ordinal"))
    for part in ("ordinal % 2 = 0", "ordinal % 2 = 1", "false"):
        sinks.commit(rows.where(part), state)
    return _read_back(s, state, s.read.json(state.commits).select("doc", "ordinal", "chunk_id"))


def _stream(s, d):
    return fold.fold_table(_steps(s, d))


QUERIES = {
    "src_3_snapshot": lambda s, d: tables.snapshot(table(s, d, "parse_runs")),
    "src_4_tree_scan": lambda s, d: tree.with_root(_as_events(s, d)),
    "src_5_clean_batch": _read_clean,
    "src_5_6_clean_batches": _exists,
    "src_7_prior_clean_tail": lambda s, d: tables.prior_clean_tails(_clean(s, d), 5),
    "src_8_memory": _memory,
    "src_9_final_merge": lambda s, d: tables.merged_lines(_clean(s, d)),
    "src_10_file_order": _file_order,
    "src_11_json_read": _json_read,
    "src_12_paths": _paths,
    "snk_1_raw_mirror": _raw_mirror,
    "snk_2_clean_batches": _clean_written,
    "snk_3_4_logs": _logs,
    "snk_5_snapshots": _snapshots_written,
    "snk_6_tree": _tree_written,
    "snk_7_final": _final_written,
    "snk_8_json": _json_written,
    "snk_9_commits": _commits,
    "ord_12_15_rule_1": _rule(rules.rule_1_violations),
    "ord_13_14_rule_2": _rule(lambda link, _, bounds: rules.rule_2_violations(link, bounds)),
    "ord_16_content_order": _content_order,
    "ser_1_content": lambda s, d: treejson.load(_trees(s, d))[1],
    "ser_2_4_export": _export,
    "ser_3_load": lambda s, d: treejson.load(_trees(s, d))[0].select("doc", "node", "parent", "pos", "id", "title", "type", "proves_id"),
    "ser_3_load_issues": lambda s, d: treejson.load_issues(_trees(s, d)),
    "api_2_read_batch": _payloads,
    "api_3_4_5_submit": _submitted,
    "api_6_commit": _committed,
    "api_12_stream_fold": _stream,
}


def _as_events(s, d):
    """Loaded trees as nodes in pre-order."""
    nodes, _, _ = treejson.load(_trees(s, d))
    place = F.transform(F.split("node", r"\."), lambda x: x.cast("int"))
    seq = F.row_number().over(W.partitionBy("doc").orderBy(place))
    numbered = nodes.select("doc", "node", "parent", "id", F.coalesce(F.nullif("title", F.lit("")), F.col("id")).alias("title"), seq.alias("node_seq"))
    above = numbered.select(F.col("doc").alias("d"), F.col("node").alias("p"), F.col("node_seq").alias("parent_seq"))
    on = (F.col("doc") == F.col("d")) & (F.col("parent") == F.col("p"))
    return numbered.join(above, on, "left").select("doc", "node_seq", "id", "title", F.coalesce("parent_seq", F.lit(0)).alias("parent_seq"))


_CLEAN = f"""texts AS (SELECT DISTINCT run_id AS doc, ordinal AS chunk, raw_content AS t FROM batch_plans WHERE raw_content IS NOT NULL),
{FILE_SPLIT},
kept AS (SELECT doc, chunk, line_no, line FROM (SELECT *, min(CASE WHEN contains(line, {quoted(P.CUTOFF_LITERAL)}) THEN line_no END) OVER (PARTITION BY doc, chunk) AS cut FROM lines)
  WHERE cut IS NULL OR line_no < cut)"""
_LOADED = _TREES + """, cn AS (SELECT tree_id AS doc, node_path AS node, pos, try_cast(json_extract_string(x, '$.chunk_number') AS INT) AS c,
  try_cast(json_extract_string(x, '$.first_line') AS INT) AS f, try_cast(json_extract_string(x, '$.last_line') AS INT) AS l FROM content),
whole AS (SELECT *, {'c': c, 'f': f} AS key FROM cn WHERE c IS NOT NULL AND f IS NOT NULL AND l IS NOT NULL),
nd AS (SELECT tree_id AS doc, node_path AS node, parent_path AS parent, pos, coalesce(json_extract_string(j, '$.id'), '') AS id, json_extract_string(j, '$.title') AS title,
  coalesce(json_extract_string(j, '$.node_type'), 'generic') AS type, json_extract_string(j, '$.proves_id') AS proves_id FROM nodes),
bounds AS (SELECT n.doc, n.node, min(key) AS lo, max(key) AS hi FROM nd n JOIN whole w ON w.doc = n.doc AND (w.node = n.node OR starts_with(w.node, n.node || '.')) GROUP BY ALL),
r1 AS (SELECT n.doc, n.node, n.parent FROM nd n JOIN bounds b ON b.doc = n.doc AND b.node = n.node
  JOIN (SELECT doc, node, max(key) AS top FROM whole GROUP BY ALL) o ON o.doc = n.doc AND o.node = n.parent WHERE NOT lo > top),
r2 AS (SELECT doc, node, parent FROM (SELECT n.doc, n.node, n.parent, lo, max(hi) OVER (PARTITION BY n.doc, n.parent ORDER BY lo, hi, n.node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM nd n JOIN bounds b ON b.doc = n.doc AND b.node = n.node WHERE n.parent IS NOT NULL) WHERE lo <= reach)
"""
ORACLES = {
    "src_3_snapshot": "SELECT run_id, coalesce(next_start_line, 0) AS next_start_line, coalesce(next_chunk_id, 0) AS next_chunk_id, coalesce(sections_completed, 0) AS sections_completed FROM parse_runs",
    "src_4_tree_scan": _LOADED + """, num AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY list_transform(string_split(node, '.'), lambda x: x::INT))::INT AS s FROM nd)
SELECT n.doc, n.s AS node_seq, n.id, coalesce(nullif(n.title, ''), n.id) AS title, coalesce(p.s, 0) AS parent_seq FROM num n LEFT JOIN num p ON p.doc = n.doc AND p.node = n.parent
UNION ALL SELECT DISTINCT doc, 0, '__doc_root__', 'Document Root', NULL FROM nd""",
    "src_5_clean_batch": "SELECT DISTINCT run_id AS doc, md5(raw_content) AS text_hash FROM batch_plans WHERE ordinal = 0",
    "src_11_json_read": "SELECT run_id, raw_path, batch_tokens, strftime(started_at, '%Y-%m-%d') AS started_at FROM parse_runs",
    "src_12_paths": """SELECT name, 'root/' || path AS path FROM (VALUES ('raw', 'raw'), ('clean', 'clean'), ('logs', 'logs'), ('failures', 'failures'), ('tree', 'tree'),
('snapshot', 'state'), ('memory', 'memory.md'), ('final', 'final'), ('commits', 'commits')) AS t(name, path)""",
    "snk_1_raw_mirror": "SELECT DISTINCT run_id AS doc, ordinal, md5(CASE WHEN ordinal = 0 THEN 'again' ELSE raw_content END) AS content_hash FROM batch_plans WHERE raw_content IS NOT NULL",
    "snk_2_clean_batches": """SELECT DISTINCT run_id AS doc, ordinal, md5(CASE WHEN ordinal = 0 THEN 'again' || chr(10) WHEN raw_content = '' OR ends_with(raw_content, chr(10)) THEN raw_content
  ELSE raw_content || chr(10) END || '<!-- cutoff -->' || chr(10)) AS text_hash FROM batch_plans WHERE raw_content IS NOT NULL""",
    "snk_3_4_logs": """WITH b AS (SELECT DISTINCT run_id AS doc, ordinal, raw_content FROM batch_plans WHERE raw_content IS NOT NULL)
SELECT kind, doc, 'chunk_' || lpad(ordinal::VARCHAR, greatest(3, length(ordinal::VARCHAR))::INT, '0') AS chunk_id, md5(raw_content) AS content_hash
FROM b, (VALUES ('log'), ('failure')) AS k(kind) WHERE kind = 'log' OR ordinal % 2 = 0""",
    "snk_5_snapshots": """SELECT run_id::VARCHAR AS doc, coalesce(next_start_line, 0) AS next_start_line, coalesce(next_chunk_id, 0) AS next_chunk_id,
coalesce(sections_completed, 0) + CASE WHEN run_id % 2 = 0 THEN 1 ELSE 0 END AS sections_completed FROM parse_runs""",
    "snk_6_tree": query(TEXTS, LINES, PARSED, NODES, SPANS, select="""SELECT doc, n_nodes, coalesce(n_spans, 0) AS n_spans FROM (SELECT doc, count(*) AS n_nodes FROM nodes GROUP BY ALL)
LEFT JOIN (SELECT doc, count(*) AS n_spans FROM spans GROUP BY ALL) USING (doc)"""),
    "snk_7_final": f"WITH {_CLEAN} SELECT line, count(*) AS n FROM kept GROUP BY ALL",
    "snk_8_json": """SELECT key, value FROM (SELECT unnest([{'key': 'run_id', 'value': run_id::VARCHAR}, {'key': 'raw_path', 'value': '"' || raw_path || '"'},
{'key': 'task_model', 'value': '"' || task_model || '"'}, {'key': 'batch_tokens', 'value': batch_tokens::VARCHAR}], recursive := true) FROM parse_runs) WHERE value IS NOT NULL""",
    "snk_9_commits": "SELECT DISTINCT run_id AS doc, ordinal, 'chunk_' || lpad(ordinal::VARCHAR, greatest(3, length(ordinal::VARCHAR))::INT, '0') AS chunk_id FROM batch_plans",
    "src_5_6_clean_batches": """SELECT DISTINCT run_id AS doc, ordinal, (run_id, ordinal) IN (SELECT (run_id, ordinal) FROM batch_contexts) AS has_clean FROM batch_plans""",
    "src_7_prior_clean_tail": f"""WITH {_CLEAN} SELECT doc, chunk + 1 AS ordinal, string_agg(line || chr(10), '' ORDER BY line_no) AS prior_clean_tail
FROM (SELECT *, row_number() OVER (PARTITION BY doc, chunk ORDER BY line_no DESC) AS back FROM kept) WHERE back <= 5 GROUP BY ALL""",
    "src_8_memory": """SELECT DISTINCT p.run_id AS doc, p.ordinal, coalesce(m.memory_text, '') AS memory_text FROM batch_plans p
LEFT JOIN (SELECT run_id, arg_max_null(memory_text, ordinal) AS memory_text FROM batch_contexts GROUP BY ALL) m USING (run_id)""",
    "src_9_final_merge": f"WITH {_CLEAN} SELECT doc, chunk AS ordinal, line_no, line FROM kept",
    "src_10_file_order": """SELECT doc, 'clean_' || ordinal || '.md' AS name, (row_number() OVER (PARTITION BY doc ORDER BY ordinal))::INT AS place
FROM (SELECT DISTINCT run_id AS doc, ordinal FROM batch_plans)""",
    "ord_12_15_rule_1": _LOADED + "SELECT doc, node, parent FROM r1",
    "ord_13_14_rule_2": _LOADED + "SELECT doc, node, parent FROM r2",
    "ord_16_content_order": _LOADED + "SELECT doc, node, pos FROM (SELECT *, lag(key) OVER (PARTITION BY doc, node ORDER BY pos) AS prev FROM whole) WHERE NOT key > prev",
    "ser_1_content": _LOADED + "SELECT doc, node, pos, c AS chunk_number, f AS first_line, l AS last_line FROM cn",
    "ser_3_load": _LOADED + "SELECT doc, node, parent, pos, id, title, type, proves_id FROM nd",
    "ser_3_load_issues": _LOADED + f"""SELECT doc, node, 'id missing' AS issue FROM nd WHERE id = ''
UNION ALL SELECT doc, node, 'title missing' FROM nd WHERE title IS NULL
UNION ALL SELECT doc, node, 'unknown type' FROM nd WHERE type NOT IN {listed(P.NODE_TYPES)}
UNION ALL SELECT doc, node, 'duplicate id' FROM (SELECT *, min(node) OVER (PARTITION BY doc, id) AS fn FROM nd WHERE id <> '') WHERE node <> fn
UNION ALL SELECT doc, node, 'proves on non-proof' FROM nd WHERE proves_id IS NOT NULL AND type <> 'proof'
UNION ALL SELECT DISTINCT doc, node, 'content incomplete' FROM cn WHERE c IS NULL OR f IS NULL OR l IS NULL
UNION ALL SELECT doc, node, 'rule 1' FROM r1 UNION ALL SELECT doc, node, 'rule 2' FROM r2""",
    "ser_2_4_export": query(TEXTS, LINES, PARSED, NODES, SPANS, """listed AS (SELECT doc, node_seq, '[' || string_agg('{"chunk_number":' || chunk || ',"first_line":' || first_line || ',"last_line":' || last_line || '}', ',' ORDER BY chunk, first_line) || ']' AS c
  FROM spans GROUP BY ALL),
own AS (SELECT n.doc, n.node_seq, eff_depth AS d, lead(eff_depth, 1, 0) OVER (PARTITION BY n.doc ORDER BY n.node_seq) AS nx,
    max(CASE WHEN eff_depth = 1 THEN n.node_seq END) OVER (PARTITION BY n.doc ORDER BY n.node_seq ROWS UNBOUNDED PRECEDING) AS top,
    '{"id":' || to_json(id) || ',"title":' || to_json(title) || coalesce(',"content":' || c, '') || CASE WHEN node_type <> 'generic' THEN ',"node_type":"' || node_type || '"' ELSE '' END
      || CASE WHEN coalesce(proves, '') <> '' THEN ',"proves_id":' || to_json(proves) ELSE '' END || CASE WHEN len(deps) > 0 THEN ',"dependencies":' || to_json(deps) ELSE '' END AS o
  FROM nodes n LEFT JOIN listed l ON l.doc = n.doc AND l.node_seq = n.node_seq)""",
        select="""SELECT doc, top AS node_seq, string_agg(o || CASE WHEN nx > d THEN ',"children":[' ELSE '}' || repeat(']}', d - greatest(nx, 1)) || CASE WHEN nx > 1 THEN ',' ELSE '' END END, '' ORDER BY node_seq) AS json
FROM own GROUP BY doc, top"""),
    "api_2_read_batch": query(TEXTS, LINES, PARSED, NODES, CLOSURE, A._DRAWN, A._TRACED, """shown AS (SELECT doc, string_agg(line, chr(10) ORDER BY node_seq) AS preview FROM (
SELECT d.*, t.on_trace, sum(CASE WHEN t.on_trace THEN 0 ELSE 1 END) OVER (PARTITION BY d.doc ORDER BY d.node_seq ROWS UNBOUNDED PRECEDING) AS n
FROM drawn d JOIN traced t ON t.doc = d.doc AND t.node_seq = d.node_seq) WHERE on_trace OR n <= 100 GROUP BY doc),
known AS (SELECT doc, string_agg(id, '|' ORDER BY node_seq) AS known_ids FROM nodes GROUP BY ALL),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal DESC NULLS LAST, context_id DESC) AS n FROM (SELECT DISTINCT * FROM batch_contexts)) WHERE n = 1)""",
        select="""SELECT run_id AS doc, raw_content, raw_line_count AS batch_line_count, coalesce(preview, '') AS current_tree, coalesce(prior_clean_tail, '') AS prior_clean_tail,
coalesce(known_ids, '') AS known_ids, coalesce(memory_text, '') AS memory_text FROM latest LEFT JOIN shown ON shown.doc = run_id LEFT JOIN known ON known.doc = run_id""", recursive=True),
    "api_12_stream_fold": query(TEXTS, "steps AS (SELECT doc, chunk, row_number() OVER (PARTITION BY doc ORDER BY chunk) - 1 AS step FROM texts)", LINES, PARSED, NODES,
        select="""SELECT n.doc, step::INT AS step, line_no, node_seq, id, title, node_type, eff_depth, parent_seq FROM nodes n JOIN steps USING (doc, chunk)"""),
}
