"""Queries of the annotation engine and their SQL, by operator id."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtree.checkpoints import checkpointed
from loomtree.functions import patterns as P
from loomtree.operators import align, annotations, graph, lines, preview, rules, segment, tree, validate
from loomtree.plans.sqltext import (
    CLOSURE, DOC_TEXTS, FILE_SPLIT, HEADS, LINES, MARKED, NODES, PARSED, SPANS, STORED, TEXTS, listed, query, quoted, tokens, trimmed,
)
from loomtree.session import table


def _plans(s, d):
    return table(s, d, "batch_plans").select("run_id", "ordinal", "raw_content").distinct()


def _plan_keys(s, d):
    """The batches without their texts."""
    return table(s, d, "batch_plans").select(F.col("run_id").alias("doc"), "ordinal").distinct()


def _lines(s, d):
    return lines.text_lines(_plans(s, d), "run_id", "ordinal", "raw_content")


def _ends(s, d):
    rows = _plans(s, d).where(F.col("raw_content").isNotNull())
    return rows.select(F.col("run_id").alias("doc"), F.col("ordinal").alias("chunk"), F.size(lines.split_lines(F.col("raw_content"))).alias("n_lines"))


def _parsed(s, d):
    return annotations.parse_events(_lines(s, d))


def _stored(s, d):
    return annotations.stored_events(table(s, d, "annotation_events"))


def _heads(s, d):
    return validate.headers(_stored(s, d))


def _nodes(s, d):
    return tree.nodes(_parsed(s, d))


def _kept_nodes(s, d):
    """Nodes computed once, for plans that read them many times."""
    return checkpointed(_nodes(s, d))


def _kept_stored_nodes(s, d):
    return checkpointed(_stored_nodes(s, d))


def _stored_nodes(s, d):
    return tree.nodes(_stored(s, d))


def _docs(s, d):
    return table(s, d, "documents", spread=True)


def _doc_events(s, d):
    return annotations.parse_events(lines.text_lines(_docs(s, d), "doc_id", None, "text"))


def _attributes(s, d):
    line = F.col("line")
    marked = annotations.before_cutoff(_lines(s, d).where(annotations.is_header(line) | annotations.is_cutoff(line)))
    kept = marked.where(~F.coalesce(F.col("line_no") == F.col("cutoff_line"), F.lit(False)))
    rest = F.regexp_extract("line", P.HEADER, 2)
    return kept.select("doc", "chunk", "line_no", F.explode(annotations.attribute_map(rest)).alias("key", "value"))


def _depths(s, d):
    kept = _lines(s, d).withColumn("depth", annotations.header_depth(F.col("line")))
    return kept.where(F.col("depth").isNotNull()).select("doc", "chunk", "line_no", "depth")


def _content(s, d):
    """Spans of event-built trees as content rows of the rules."""
    spans = tree.content_spans(_parsed(s, d), _ends(s, d))
    return spans.select("doc", F.col("node_seq").alias("node"), F.col("chunk").alias("chunk_number"), "first_line", "last_line")


def _bounds(s, d):
    found = rules.content_bounds(_kept_nodes(s, d), _content(s, d))
    return found.select("doc", F.col("node").alias("node_seq"), F.col("lo.chunk_number").alias("lo_chunk"), F.col("lo.first_line").alias("lo_line"),
                        F.col("hi.chunk_number").alias("hi_chunk"), F.col("hi.first_line").alias("hi_line"))


def _ancestor_tops(s, d):
    found = rules.max_ancestor_content(_kept_nodes(s, d), _content(s, d))
    return found.select("doc", F.col("node").alias("node_seq"), F.col("top.chunk_number").alias("top_chunk"), F.col("top.first_line").alias("top_line"))


def _flat(frame):
    """Lists of strings as one string, so that any two engines' results compare."""
    lists = {c: F.array_join(c, "|") for c, kind in frame.dtypes if kind == "array<string>"}
    return frame.withColumns(lists)


def _issues(frame):
    return frame.select("doc", "chunk", "line_no", "severity", "code", "message")


def _stored_spans(s, d):
    return table(s, d, "content_spans").distinct()


def _sibling_order(s, d):
    from pyspark.sql import Window as W

    nodes = _kept_nodes(s, d)
    bounds = rules.content_bounds(nodes, _content(s, d))
    kids = nodes.select("doc", F.col("node_seq").alias("node"), "parent_seq").join(bounds, ["doc", "node"])
    w = W.partitionBy("doc", "parent_seq").orderBy("node")
    return kids.select("doc", F.col("node").alias("node_seq"), rules.is_after(F.col("lo"), F.lag("hi").over(w)).alias("after_previous"))


def _interval_algebra(s, d):
    """Each span of a chunk with the next one of the chunk: union and what they share."""
    from pyspark.sql import Window as W

    rows = _stored_spans(s, d).where("chunk_number IS NOT NULL AND first_line <= last_line")
    w = W.partitionBy("run_id", "chunk_number").orderBy("first_line", "span_id")
    lo, hi = F.col("first_line"), F.col("last_line")
    lo2, hi2 = F.lead("first_line").over(w), F.lead("last_line").over(w)
    pairs = rows.select("span_id", lo.alias("lo"), hi.alias("hi"), lo2.alias("lo2"), hi2.alias("hi2")).where("lo2 IS NOT NULL")
    a = [F.col(c) for c in ("lo", "hi", "lo2", "hi2")]
    u, i = rules.bound_union(*a), rules.bound_intersect(*a)
    return pairs.select("span_id", rules.n_lines(a[0], a[1]).alias("n_lines"), u["lo"].alias("union_lo"), u["hi"].alias("union_hi"), i["lo"].alias("both_lo"), i["hi"].alias("both_hi"))


def _partition(s, d):
    return rules.partition_violations(_stored_spans(s, d).where("chunk_number IS NOT NULL"), ["run_id", "chunk_number"], "span_id")


def _progress(s, d):
    runs, plans = table(s, d, "parse_runs"), table(s, d, "batch_plans").select("run_id", "ordinal", "start_line", "end_line").distinct()
    totals = plans.groupBy("run_id").agg(F.max("end_line").alias("total_lines"))
    state = runs.select("run_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("next_start_line", "next_chunk_id", "sections_completed")])
    rows = plans.join(state, "run_id").join(totals, "run_id")
    cut = segment.clamp_cutoff(F.col("next_start_line").cast("bigint"), F.col("start_line"), F.col("end_line"))
    after = segment.advance(F.col("next_chunk_id"), F.col("sections_completed"), cut)
    done = segment.is_complete(F.col("next_start_line"), F.col("total_lines"))
    return rows.select("run_id", "ordinal", done.alias("complete"), after["next_start_line"].alias("cutoff"), after["next_chunk_id"].alias("chunk_after"), after["sections_completed"].alias("sections_after"))


def _within(s, d):
    return segment.within_sections(table(s, d, "batch_plans").select("run_id", "ordinal", "chunk_id").distinct(), 3)


def _batches(s, d):
    found = segment.plan_batches(_docs(s, d), "doc_id", "text", 120)
    return found.withColumn("content_hash", F.md5("raw_content")).drop("raw_content")


def _pairs(s, d):
    """Raw batches and, as cleaned text, the first three fifths of their content tokens."""
    rows = _plans(s, d).where(F.col("raw_content").isNotNull())
    raw = F.transform(align.raw_tokens(F.col("raw_content")), lambda x: x["token"])
    cut = F.slice(raw, 1, F.greatest(F.lit(1), F.floor(F.size(raw) * 0.6).cast("int")))
    return rows.select(F.col("run_id").alias("doc"), F.col("ordinal").alias("chunk"), F.col("raw_content").alias("raw"), F.array_join(cut, " ").alias("cleaned"))


_ALIGNED = ["ok", "error_code", "cutoff_line", "confidence", "cleaned_token_count", "raw_token_count", "matched_token_count",
            "cutoff_token_count", "min_cleaned_token_requirement"]


def _unequal_pairs(s, d):
    """Raw batches with another text of their run and ordinal, a context's, as cleaned text: whole texts that share words only."""
    other = table(s, d, "batch_contexts").select(F.col("run_id").alias("r"), F.col("ordinal").alias("o"), F.col("raw_content").alias("cleaned")).distinct()
    rows = _plans(s, d).where(F.col("raw_content").isNotNull())
    met = rows.join(other.where(F.col("cleaned").isNotNull()), (F.col("run_id") == F.col("r")) & (F.col("ordinal") == F.col("o")))
    return met.select(F.col("run_id").alias("doc"), F.col("ordinal").alias("chunk"), F.col("raw_content").alias("raw"), "cleaned")


def _unequal(s, d):
    rows = align.align(_unequal_pairs(s, d))
    gates = [align.low_confidence().alias("low_confidence"), align.early_cutoff().alias("early_cutoff"), F.array_join(align.alignment_errors(rows), "|").alias("errors")]
    return rows.select("doc", "chunk", F.md5("cleaned").alias("cleaned_hash"), *_ALIGNED, *gates)


def _aligned(s, d):
    return align.align(_pairs(s, d)).select("doc", "chunk", *_ALIGNED)


def _gates(s, d):
    rows = align.align(_pairs(s, d))
    return rows.select("doc", "chunk", align.low_confidence().alias("low_confidence"), align.early_cutoff().alias("early_cutoff"),
                       F.size(align.alignment_errors(rows)).alias("n_errors"))


def _slices(s, d):
    rows = align.align(_pairs(s, d)).where("ok")
    return _flat(rows.select("doc", "chunk", align.raw_context(F.col("raw"), F.col("cutoff_line")).alias("raw_context"), align.clean_tail(F.col("raw")).alias("clean_tail")))


def _previews(s, d):
    return preview.tree_preview(_kept_nodes(s, d))


def _removed(s, d):
    gone = table(s, d, "node_removals").select(F.col("run_id").alias("doc"), F.col("node_id").alias("id"))
    return tree.removed(_stored_nodes(s, d), gone).select("doc", "node_seq", "id")


def _lookup(s, d):
    wanted = table(s, d, "content_spans").where("node_id IS NOT NULL").select(F.col("run_id").alias("doc"), F.col("node_id").alias("id")).distinct()
    return tree.lookup(_stored_nodes(s, d), wanted)


def _size_warnings(s, d):
    rows = table(s, d, "batch_plans").where("clean_token_target IS NOT NULL").select("plan_id", "raw_content", "clean_token_target").distinct()
    n = segment.word_count(F.col("raw_content")).cast("int")
    return rows.select("plan_id", validate.token_size_warning(n, F.col("clean_token_target")).alias("warning")).where("warning IS NOT NULL")


def _validity(s, d):
    events = checkpointed(_stored(s, d))
    return validate.batch_validity(validate.validate(events), events)


_NODE = "SELECT doc, chunk, line_no, node_seq, id, title, node_type, proves, array_to_string(deps, '|') AS deps, depth, eff_depth, parent_seq FROM nodes"
_EVENT = "SELECT doc, chunk, line_no, event_type, id, depth, title, node_type, proves, array_to_string(deps, '|') AS deps FROM events"
_WITH_TREE = (TEXTS, LINES, PARSED, NODES)
_TRACED = "traced AS (SELECT *, coalesce(eff_depth < min(eff_depth) OVER (PARTITION BY doc ORDER BY node_seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), true) AS on_trace FROM nodes)"
_BOUNDS = """own AS (SELECT doc, node_seq AS node, {'c': chunk, 'l': first_line} AS key FROM spans),
bounds AS (SELECT c.doc, c.ancestor AS node, min(key) AS lo, max(key) AS hi FROM closure c JOIN own o ON o.doc = c.doc AND o.node = c.node GROUP BY ALL)"""
_LABEL = """id || CASE WHEN x <> '' THEN ' [' || x || ']' ELSE '' END"""
_DRAWN = f"""lasts AS (SELECT doc, parent_seq, max(node_seq) AS last_seq FROM nodes GROUP BY ALL),
roots AS (SELECT doc, count(*) AS n_roots FROM nodes WHERE eff_depth = 1 GROUP BY ALL),
flagged AS (SELECT n.*, n.node_seq = l.last_seq AS is_last, n_roots,
    concat_ws('; ', CASE WHEN node_type = 'proof' AND coalesce(proves, '') <> '' THEN 'proof -> ' || proves WHEN node_type <> 'generic' THEN node_type END,
      CASE WHEN len(deps) > 0 THEN 'deps: ' || array_to_string(deps, ', ') END) AS x
  FROM nodes n JOIN lasts l ON l.doc = n.doc AND l.parent_seq = n.parent_seq JOIN roots r ON r.doc = n.doc),
ups AS (SELECT c.doc, c.node AS node_seq, string_agg(CASE WHEN f.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY c.ancestor) AS strokes
  FROM closure c JOIN flagged f ON f.doc = c.doc AND f.node_seq = c.ancestor WHERE c.ancestor <> c.node GROUP BY ALL),
drawn AS (SELECT f.doc, f.node_seq, coalesce(strokes, '') || CASE WHEN eff_depth = 1 AND n_roots = 1 THEN '' WHEN is_last THEN '└── ' ELSE '├── ' END || {_LABEL} AS line
  FROM flagged f LEFT JOIN ups u ON u.doc = f.doc AND u.node_seq = f.node_seq)"""
_ISSUE = "SELECT doc, chunk, line_no, '{}' AS severity, '{}' AS code, 'Line ' || line_no || ': ' || {} AS message FROM {}"
_LATEST = """latest AS (SELECT a.doc, a.chunk, a.line_no, a.proves, arg_max({'t': t.node_type}, t.place).t AS tt
  FROM heads a JOIN heads t ON t.doc = a.doc AND t.chunk = a.chunk AND t.id = a.proves AND t.place <= a.place WHERE a.proves <> ''
  GROUP BY a.doc, a.chunk, a.line_no, a.place, a.id, a.proves)"""
_CHECKS = {
    "val_2_duplicate_id": _ISSUE.format("error", "duplicate_id", "'duplicate id ''' || id || ''''", "heads JOIN firsts USING (doc, id) WHERE place > first_place"),
    "val_3_unknown_type": _ISSUE.format("warning", "unknown_type", "'unknown type ''' || node_type || ''' on node ''' || id || ''''", f"heads WHERE node_type NOT IN {listed(P.NODE_TYPES)}"),
    "val_4_proves_on_non_proof": _ISSUE.format("warning", "proves_on_non_proof", "'non-proof node ''' || id || ''' has proves=''' || proves || ''''", "heads WHERE proves <> '' AND node_type IS DISTINCT FROM 'proof'"),
    "val_5_proof_without_proves": _ISSUE.format("warning", "proof_without_proves", "'proof node ''' || id || ''' missing proves attribute'", "heads WHERE node_type = 'proof' AND coalesce(proves, '') = ''"),
    "val_6_proves_bad_target": _ISSUE.format("warning", "proves_bad_target", "'proves=''' || proves || ''' targets type ''' || tt || ''', expected one of [''corollary'', ''lemma'', ''proposition'', ''theorem'']'", f"latest WHERE tt NOT IN {listed(P.PROVEABLE_TYPES)}"),
    "val_7_missing_dependency": _ISSUE.format("warning", "missing_dependency", "'dependency ''' || dep || ''' on node ''' || id || ''' not found'",
        "(SELECT *, unnest(deps) AS dep FROM heads) q WHERE dep <> '' AND NOT EXISTS (SELECT 1 FROM firsts f WHERE f.doc = q.doc AND f.id = q.dep AND f.first_place <= q.place)"),
}
_LEADING = f"""SELECT doc, chunk, line_no, 'error' AS severity, 'leading_content' AS code, {quoted(validate.LEADING)} AS message FROM (
  SELECT doc, chunk, min(line_no) FILTER (WHERE regexp_matches(line, {quoted(P.CUTOFF)})) AS cut,
    min(line_no) FILTER (WHERE s <> '' AND NOT regexp_matches(line, {quoted(P.CUTOFF)})) AS line_no,
    arg_min(s, line_no) FILTER (WHERE s <> '' AND NOT regexp_matches(line, {quoted(P.CUTOFF)})) AS s
  FROM (SELECT *, {trimmed('line')} AS s FROM lines) GROUP BY ALL)
WHERE line_no IS NOT NULL AND (cut IS NULL OR line_no < cut) AND NOT starts_with(s, '@')
  AND chunk <= coalesce((SELECT min(h.chunk) FROM events h WHERE h.event_type = 'header' AND h.doc = doc_), chunk)""".replace(
    "SELECT doc, chunk, min(line_no) FILTER", "SELECT doc, doc AS doc_, chunk, min(line_no) FILTER"
).replace("GROUP BY ALL)", "GROUP BY doc, chunk)")


def _check(fn):
    return lambda s, d: _issues(fn(_heads(s, d)))


QUERIES = {
    "src_1_2_raw_lines": lambda s, d: lines.text_lines(_docs(s, d), "doc_id", None, "text", as_file=True).select("doc", "line_no", "line"),
    "prs_1_lines": lambda s, d: _lines(s, d),
    "prs_2_cutoff": lambda s, d: annotations.cutoff_lines(_lines(s, d)),
    "prs_3_4_header_depth": _depths,
    "prs_5_attributes": _attributes,
    "prs_6_7_8_events": lambda s, d: _flat(_parsed(s, d)),
    "prs_8_document_events": lambda s, d: _flat(_doc_events(s, d).drop("chunk")),
    "prs_9_10_11_defaults": lambda s, d: _stored(s, d).where("event_type = 'header'").select(
        "event_id", annotations.node_type_of(F.col("node_type")).alias("node_type"), annotations.title_of(F.col("title"), F.col("id")).alias("title"),
        annotations.declared_depth(F.col("depth")).alias("depth")),
    "val_1_leading_content": lambda s, d: _issues(validate.leading_content(_lines(s, d), validate.headers(_parsed(s, d)))),
    "val_2_duplicate_id": _check(validate.duplicate_ids),
    "val_3_unknown_type": _check(validate.unknown_types),
    "val_4_proves_on_non_proof": _check(validate.proves_on_non_proof),
    "val_5_proof_without_proves": _check(validate.proof_without_proves),
    "val_6_proves_bad_target": _check(validate.proves_bad_target),
    "val_7_missing_dependency": _check(validate.missing_dependencies),
    "val_8_9_known_ids": lambda s, d: validate.known_id_counts(_stored(s, d)),
    "val_8_known_id_list": lambda s, d: validate.known_ids(_stored(s, d)),
    "val_10_token_size": _size_warnings,
    "val_11_all": lambda s, d: _issues(validate.validate(checkpointed(_parsed(s, d)), _lines(s, d))),
    "val_11_validity": _validity,
    "seg_1_4_5_progress": _progress,
    "seg_2_3_batches": _batches,
    "seg_6_max_sections": _within,
    "seg_7_tokens": lambda s, d: _docs(s, d).select("doc_id", segment.word_count(F.col("text")).alias("words"), segment.char_count(F.col("text")).alias("chars")),
    "seg_7_bpe_tokens": lambda s, d: _docs(s, d).select("doc_id", segment.bpe_count(s)(F.col("text")).alias("n_tokens")),
    "aln_1_content_tokens": lambda s, d: _docs(s, d).select("doc_id", F.size(align.content_tokens(F.col("text"))).alias("n_tokens"), F.md5(F.array_join(align.content_tokens(F.col("text")), " ")).alias("tokens")).where("text IS NOT NULL"),
    "aln_2_token_lines": lambda s, d: _plans(s, d).select(F.col("run_id").alias("doc"), F.col("ordinal").alias("chunk"), F.posexplode(align.raw_tokens(F.col("raw_content"))).alias("p", "t")).select("doc", "chunk", (F.col("p") + 1).alias("pos"), "t.token", "t.line"),
    "aln_3_to_8_alignment": _aligned,
    "aln_5_unequal_texts": _unequal,
    "aln_9_10_gates": _gates,
    "aln_11_slices": _slices,
    "tre_1_root": lambda s, d: tree.with_root(_nodes(s, d)),
    "tre_2_visible_roots": lambda s, d: tree.visible_roots(_nodes(s, d)).select("doc", "node_seq", "id"),
    "tre_3_has_nodes": lambda s, d: tree.visible_documents(_plan_keys(s, d), _nodes(s, d)),
    "tre_4_5_active_trace": lambda s, d: _flat(tree.active_trace(_nodes(s, d), include_root=True)),
    "tre_6_7_11_12_nodes": lambda s, d: _flat(_nodes(s, d)),
    "tre_6_7_stored_nodes": lambda s, d: _flat(_stored_nodes(s, d)),
    "tre_8_9_spans": lambda s, d: tree.content_spans(_parsed(s, d), _ends(s, d)),
    "tre_10_metrics": lambda s, d: tree.batch_metrics(_nodes(s, d), _ends(s, d)),
    "tre_13_14_19_registry": lambda s, d: tree.registry_issues(_kept_stored_nodes(s, d)),
    "tre_15_removed": _removed,
    "tre_16_lookup": _lookup,
    "tre_17_cardinality": lambda s, d: _stored_nodes(s, d).groupBy("doc").agg(F.count(F.lit(1)).alias("n_nodes")),
    "ord_2_3_4_interval_algebra": _interval_algebra,
    "ord_5_6_7_bounds": _bounds,
    "ord_8_max_ancestor_content": _ancestor_tops,
    "ord_9_10_11_sibling_order": _sibling_order,
    "ord_17_18_partition": _partition,
    "grf_1_dependencies": lambda s, d: graph.dependencies(_kept_stored_nodes(s, d)),
    "grf_2_proves": lambda s, d: graph.proved(_kept_stored_nodes(s, d)),
    "grf_3_theory": lambda s, d: _stored_nodes(s, d).select("doc", "node_seq", graph.is_theory(F.col("node_type")).alias("theory")),
    "prv_1_2_lines": lambda s, d: preview.preview_lines(_kept_nodes(s, d)).select("doc", "node_seq", "line"),
    "prv_3_preview": _previews,
}


_T = (TEXTS, LINES)
_ALN = f"""rt AS (SELECT doc, chunk, flatten(list_transform(list_zip(p, range(1, len(p) + 1)), lambda q: list_transform({tokens('q[1]')}, lambda w: {{'token': w, 'line': q[2]::INT}}))) AS r FROM parts),
c AS (SELECT *, len(r)::INT AS n, CASE WHEN len(r) = 0 THEN 0 ELSE greatest(1, floor(len(r) * 0.6))::INT END AS k FROM rt),
a AS (SELECT *, CASE WHEN n = 0 THEN 'raw_has_no_content_tokens' WHEN k < least(20, n) THEN 'cleaned_too_short_for_alignment' END AS error_code FROM c)"""
ORACLES = {
    "src_1_2_raw_lines": query(DOC_TEXTS, FILE_SPLIT, select="SELECT doc, line_no, line FROM lines"),
    "prs_1_lines": query(*_T, select="SELECT doc, chunk, line_no, line FROM lines"),
    "prs_2_cutoff": query(*_T, MARKED, select="SELECT DISTINCT doc, chunk, cutoff_line FROM marked WHERE cutoff_line IS NOT NULL"),
    "prs_3_4_header_depth": query(*_T, select=f"SELECT doc, chunk, line_no, length(regexp_extract(line, {quoted(P.HEADER)}, 1))::INT AS depth FROM lines WHERE regexp_matches(line, {quoted(P.HEADER)})"),
    "prs_5_attributes": query(*_T, MARKED, select="""SELECT doc, chunk, line_no, key, CASE WHEN starts_with(v, '"') AND ends_with(v, '"') THEN substr(v, 2, greatest(length(v) - 2, 0)) ELSE v END AS value
FROM (SELECT doc, chunk, line_no, ks[i] AS key, vs[i] AS v FROM (SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM attrs) WHERE list_position(ks, ks[i]) = i)"""),
    "prs_6_7_8_events": query(*_T, PARSED, select=_EVENT),
    "prs_8_document_events": query(DOC_TEXTS, LINES, PARSED, select=_EVENT.replace("chunk, ", "")),
    "prs_9_10_11_defaults": query(STORED, select=f"""SELECT event_id, CASE WHEN node_type IN {listed(P.NODE_TYPES)} THEN node_type ELSE 'generic' END AS node_type,
coalesce(nullif(title, ''), id) AS title, greatest(1, depth) AS depth FROM events WHERE event_type = 'header'"""),
    "val_1_leading_content": query(*_T, PARSED, select=_LEADING),
    **{name: query(STORED, HEADS, _LATEST, select=sql) for name, sql in _CHECKS.items()},
    "val_8_9_known_ids": query(STORED, HEADS, """new AS (SELECT doc, c AS chunk, count(*) AS n_new FROM (SELECT doc, first_place.c AS c FROM firsts) GROUP BY ALL)""",
        select="""SELECT doc, chunk, coalesce(sum(coalesce(n_new, 0)) OVER (PARTITION BY doc ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_known,
coalesce(n_new, 0) AS n_new FROM (SELECT DISTINCT doc, chunk FROM events) LEFT JOIN new USING (doc, chunk)"""),
    "val_8_known_id_list": query(STORED, HEADS, select="SELECT doc, id, first_place.c AS chunk, first_place.l AS line_no FROM firsts"),
    "val_10_token_size": r"""SELECT plan_id, warning FROM (SELECT plan_id, CASE
  WHEN n < h THEN 'Cleaned text is ~' || n || ' tokens, hard minimum is ~' || h || ' tokens (hard warning).'
  WHEN n < t THEN 'Cleaned text is ~' || n || ' tokens, suggested minimum is ~' || t || ' tokens (soft warning).' END AS warning
FROM (SELECT DISTINCT plan_id, clean_token_target AS t, greatest(1, floor(clean_token_target * 0.4))::INT AS h, len(regexp_extract_all(raw_content, '[^ \t\n\x0b\f\r]+')) AS n
      FROM batch_plans WHERE clean_token_target IS NOT NULL)) WHERE warning IS NOT NULL""",
    "val_11_all": query(*_T, PARSED, HEADS, _LATEST, select=" UNION ALL ".join(f"({x})" for x in [*_CHECKS.values(), _LEADING])),
    "val_11_validity": query(STORED, HEADS, _LATEST, "issues AS (" + " UNION ALL ".join(f"({x})" for x in _CHECKS.values()) + ")", select="""SELECT doc, chunk,
coalesce(count(severity) FILTER (WHERE severity = 'error'), 0) AS n_errors, coalesce(count(severity) FILTER (WHERE severity = 'warning'), 0) AS n_warnings,
count(severity) FILTER (WHERE severity = 'error') = 0 AS valid FROM (SELECT DISTINCT doc, chunk FROM events) LEFT JOIN issues USING (doc, chunk) GROUP BY ALL"""),
    "seg_1_4_5_progress": """SELECT p.run_id, p.ordinal, coalesce(r.next_start_line, 0) >= t.total AS complete,
greatest(p.start_line + 1, least(coalesce(r.next_start_line, 0), greatest(p.end_line, p.start_line + 1))) AS cutoff,
coalesce(r.next_chunk_id, 0) + 1 AS chunk_after, coalesce(r.sections_completed, 0) + 1 AS sections_after
FROM (SELECT DISTINCT run_id, ordinal, start_line, end_line FROM batch_plans) p JOIN parse_runs r USING (run_id)
JOIN (SELECT run_id, max(end_line) AS total FROM batch_plans GROUP BY ALL) t USING (run_id)""",
    "seg_2_3_batches": r"""WITH RECURSIVE src AS (SELECT doc_id AS doc, regexp_replace(text, '\r\n|\r', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL AND text <> ''),
sp AS (SELECT doc, t, CASE WHEN ends_with(t, chr(10)) THEN string_split(t, chr(10))[:-2] ELSE string_split(t, chr(10)) END AS p FROM src),
ls AS (SELECT doc, len(p) AS n, list_transform(list_zip(p, range(1, len(p) + 1)), lambda q: q[1] || CASE WHEN q[2] < len(p) OR ends_with(t, chr(10)) THEN chr(10) ELSE '' END) AS l FROM sp),
cs AS (SELECT *, list_transform(l, lambda x: len(regexp_extract_all(x, '[^ \t\n\x0b\f\r]+'))) AS c FROM ls),
walk AS (SELECT doc, 0 AS i, 0 AS s, 0 AS start, -1 AS ordinal, false AS full FROM cs
  UNION ALL
  SELECT w.doc, w.i + 1, CASE WHEN w.full OR w.i = 0 THEN 0 ELSE w.s END + cs.c[w.i + 1], CASE WHEN w.full OR w.i = 0 THEN w.i ELSE w.start END,
    CASE WHEN w.full OR w.i = 0 THEN w.ordinal + 1 ELSE w.ordinal END,
    CASE WHEN w.full OR w.i = 0 THEN 0 ELSE w.s END + cs.c[w.i + 1] >= 120
  FROM walk w JOIN cs ON cs.doc = w.doc WHERE w.i < cs.n),
cut AS (SELECT doc, ordinal, start, max(i) AS stop FROM walk WHERE ordinal >= 0 GROUP BY ALL),
b AS (SELECT cut.doc, ordinal, start, stop, array_to_string(cs.l[start + 1:stop], '') AS content FROM cut JOIN cs ON cs.doc = cut.doc),
k AS (SELECT *, len(regexp_extract_all(content, '[^ \t\n\x0b\f\r]+')) AS tokens FROM b)
SELECT doc, ordinal, 'chunk_' || lpad(ordinal::VARCHAR, greatest(3, length(ordinal::VARCHAR))::INT, '0') AS chunk_id, start AS start_line, stop AS end_line,
stop - start AS raw_line_count, tokens AS raw_token_count, greatest(1, floor(tokens * 0.5))::BIGINT AS clean_token_target, md5(content) AS content_hash FROM k""",
    "seg_6_max_sections": "SELECT DISTINCT run_id, ordinal, chunk_id FROM batch_plans WHERE ordinal < 3",
    "seg_7_tokens": r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+'))::INT AS words, length(text)::INT AS chars FROM documents",
    "aln_1_content_tokens": f"SELECT doc_id, len({tokens('text')})::INT AS n_tokens, md5(array_to_string({tokens('text')}, ' ')) AS tokens FROM documents WHERE text IS NOT NULL",
    "aln_2_token_lines": query(*_T, f"w AS (SELECT doc, chunk, line_no, {tokens('line')} AS ws FROM lines)",
        "x AS (SELECT doc, chunk, line_no, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS token FROM w)",
        select="SELECT doc, chunk, (row_number() OVER (PARTITION BY doc, chunk ORDER BY line_no, i))::INT AS pos, token, line_no AS line FROM x"),
    "aln_3_to_8_alignment": query(*_T, _ALN, select="""SELECT doc, chunk, error_code IS NULL AS ok, error_code, CASE WHEN error_code IS NULL THEN r[k].line END AS cutoff_line,
CASE WHEN error_code IS NULL THEN 1.0::DOUBLE END AS confidence, k AS cleaned_token_count, n AS raw_token_count, CASE WHEN error_code IS NULL THEN k ELSE 0 END AS matched_token_count,
CASE WHEN error_code IS NULL THEN k END AS cutoff_token_count, least(20, n) AS min_cleaned_token_requirement FROM a"""),
    "aln_9_10_gates": query(*_T, _ALN, select="""SELECT doc, chunk, false AS low_confidence, coalesce(error_code IS NULL AND k < greatest(1, floor(n * 0.2)), false) AS early_cutoff,
(CASE WHEN error_code IS NULL AND k >= greatest(1, floor(n * 0.2)) THEN 0 ELSE 1 END)::INT AS n_errors FROM a"""),
    "aln_11_slices": query(*_T, _ALN, select="""SELECT a.doc, a.chunk, array_to_string(p[greatest(0, r[k].line - 5) + 1 : least(len(p), r[k].line + 2)], '|') AS raw_context,
array_to_string(p[greatest(1, len(p) - 4) : len(p)], '|') AS clean_tail
FROM a JOIN parts ON parts.doc = a.doc AND parts.chunk = a.chunk WHERE error_code IS NULL"""),
    "tre_1_root": query(*_WITH_TREE, select="""SELECT doc, node_seq, id, title, parent_seq FROM nodes UNION ALL
SELECT DISTINCT doc, 0, '__doc_root__', 'Document Root', NULL FROM nodes"""),
    "tre_2_visible_roots": query(*_WITH_TREE, select="SELECT doc, node_seq, id FROM nodes WHERE eff_depth = 1"),
    "tre_3_has_nodes": query(*_WITH_TREE, select="SELECT DISTINCT t.doc, t.doc IN (SELECT doc FROM nodes) AS has_nodes FROM texts t"),
    "tre_4_5_active_trace": query(*_WITH_TREE, _TRACED, select="SELECT doc, array_to_string(list_concat(['__doc_root__'], list(id ORDER BY node_seq)), '|') AS trace FROM traced WHERE on_trace GROUP BY doc"),
    "tre_6_7_11_12_nodes": query(*_WITH_TREE, select=_NODE),
    "tre_6_7_stored_nodes": query(STORED, NODES, select=_NODE),
    "tre_8_9_spans": query(*_WITH_TREE, SPANS, select="SELECT doc, chunk, node_seq, first_line, last_line FROM spans"),
    "tre_10_metrics": query(*_WITH_TREE, """per AS (SELECT doc, chunk, count(*) AS n, arg_max(eff_depth, node_seq) AS leaf FROM nodes GROUP BY ALL)""", select="""
SELECT doc, chunk, coalesce(n, 0) AS added_nodes, coalesce(last_value(leaf IGNORE NULLS) OVER (PARTITION BY doc ORDER BY chunk ROWS UNBOUNDED PRECEDING), 0) AS active_depth
FROM (SELECT doc, chunk FROM texts) LEFT JOIN per USING (doc, chunk)"""),
    "tre_13_14_19_registry": query(STORED, NODES, select="""SELECT doc, node_seq, id, 'duplicate id' AS issue FROM (SELECT *, row_number() OVER (PARTITION BY doc, id ORDER BY node_seq) AS n FROM nodes) WHERE n > 1
UNION ALL SELECT doc, node_seq, id, 'id of the root' FROM nodes WHERE id = '__doc_root__'
UNION ALL SELECT doc, node_seq, id, 'proves on non-proof' FROM nodes WHERE proves IS NOT NULL AND node_type <> 'proof'"""),
    "tre_15_removed": query(STORED, NODES, select="SELECT doc, node_seq, id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM node_removals r WHERE r.run_id = n.doc AND r.node_id = n.id)"),
    "tre_16_lookup": query(STORED, NODES, select="""SELECT w.doc, w.id, min(n.node_seq) AS node_seq FROM (SELECT DISTINCT run_id AS doc, node_id AS id FROM content_spans WHERE node_id IS NOT NULL) w
LEFT JOIN nodes n ON n.doc = w.doc AND n.id = w.id GROUP BY ALL"""),
    "tre_17_cardinality": query(STORED, NODES, select="SELECT doc, count(*) AS n_nodes FROM nodes GROUP BY doc"),
    "ord_2_3_4_interval_algebra": """SELECT span_id, last_line - first_line + 1 AS n_lines, least(first_line, lo2) AS union_lo, greatest(last_line, hi2) AS union_hi,
CASE WHEN greatest(first_line, lo2) <= least(last_line, hi2) THEN greatest(first_line, lo2) END AS both_lo, CASE WHEN greatest(first_line, lo2) <= least(last_line, hi2) THEN least(last_line, hi2) END AS both_hi
FROM (SELECT *, lead(first_line) OVER w AS lo2, lead(last_line) OVER w AS hi2 FROM (SELECT DISTINCT * FROM content_spans WHERE chunk_number IS NOT NULL AND first_line <= last_line)
  WINDOW w AS (PARTITION BY run_id, chunk_number ORDER BY first_line, span_id)) WHERE lo2 IS NOT NULL""",
    "ord_5_6_7_bounds": query(*_WITH_TREE, SPANS, CLOSURE, _BOUNDS, recursive=True, select="SELECT doc, node AS node_seq, lo.c AS lo_chunk, lo.l AS lo_line, hi.c AS hi_chunk, hi.l AS hi_line FROM bounds"),
    "ord_8_max_ancestor_content": query(*_WITH_TREE, SPANS, CLOSURE, _BOUNDS, recursive=True, select="""SELECT doc, node_seq, t.c AS top_chunk, t.l AS top_line FROM (
SELECT c.doc, c.node AS node_seq, max(key) AS t FROM closure c JOIN own o ON o.doc = c.doc AND o.node = c.ancestor GROUP BY ALL)"""),
    "ord_9_10_11_sibling_order": query(*_WITH_TREE, SPANS, CLOSURE, _BOUNDS, recursive=True, select="""SELECT b.doc, b.node AS node_seq,
coalesce(lo > lag(hi) OVER (PARTITION BY b.doc, parent_seq ORDER BY b.node), false) AS after_previous FROM bounds b JOIN nodes n ON n.doc = b.doc AND n.node_seq = b.node"""),
    "ord_17_18_partition": """SELECT run_id, chunk_number, span_id, issue FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY run_id, chunk_number, first_line ORDER BY span_id) > 1 THEN 'duplicate start'
WHEN first_line <= max(last_line) OVER (PARTITION BY run_id, chunk_number ORDER BY first_line, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'overlap' END AS issue
FROM (SELECT DISTINCT * FROM content_spans WHERE chunk_number IS NOT NULL AND first_line <= last_line)) WHERE issue IS NOT NULL""",
    "grf_1_dependencies": query(STORED, NODES, "firstn AS (SELECT doc, id, min(node_seq) AS s FROM nodes GROUP BY ALL)", select="""SELECT n.doc, n.node_seq, n.pos, n.dep_id, f.s AS dep_seq
FROM (SELECT doc, node_seq, unnest(range(0, len(deps)))::INT AS pos, unnest(deps) AS dep_id FROM nodes) n LEFT JOIN firstn f ON f.doc = n.doc AND f.id = n.dep_id"""),
    "grf_2_proves": query(STORED, NODES, "firstn AS (SELECT doc, id, min(node_seq) AS s FROM nodes GROUP BY ALL)", select="SELECT n.doc, n.node_seq, n.proves, f.s AS proved_seq FROM nodes n LEFT JOIN firstn f ON f.doc = n.doc AND f.id = n.proves WHERE n.proves IS NOT NULL"),
    "grf_3_theory": query(STORED, NODES, select="SELECT doc, node_seq, node_type <> 'generic' AS theory FROM nodes"),
    "prv_1_2_lines": query(*_WITH_TREE, CLOSURE, _DRAWN, recursive=True, select="SELECT doc, node_seq, line FROM drawn"),
    "prv_3_preview": query(*_WITH_TREE, CLOSURE, _DRAWN, _TRACED, recursive=True, select="""SELECT doc, string_agg(line, chr(10) ORDER BY node_seq) AS preview FROM (
SELECT d.*, t.on_trace, sum(CASE WHEN t.on_trace THEN 0 ELSE 1 END) OVER (PARTITION BY d.doc ORDER BY d.node_seq ROWS UNBOUNDED PRECEDING) AS n
FROM drawn d JOIN traced t ON t.doc = d.doc AND t.node_seq = d.node_seq) WHERE on_trace OR n <= 100 GROUP BY doc"""),
}
