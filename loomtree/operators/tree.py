"""The fold of header events into an ordered tree, as window plans.

Effective depth: a header closes open nodes of its depth or more, and a jump deeper hangs below the active leaf, so
``eff_k = min(depth_k, eff_(k-1) + 1)``, which unrolls to ``k + least(0, running min of (depth_j - j))``. The parent is
the last earlier header whose effective depth is one less. The owner of a stretch of lines is the last header before it.
All three are running values of a document; each is computed inside its chunk and completed with what
``with_carry`` brings in from the chunks before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtree.functions.patterns import ROOT_ID, ROOT_TITLE
from loomtree.operators.annotations import declared_depth, node_type_of, title_of
from loomtree.operators.lines import with_carry


def _order(events: DataFrame) -> list[str]:
    return ["line_no", "event_id"] if "event_id" in events.columns else ["line_no"]


def effective_depths(events: DataFrame) -> DataFrame:
    """Headers with node_seq (from 1, in document order), depth and eff_depth."""
    heads = events.where(F.col("event_type") == "header").withColumn("depth", declared_depth(F.col("depth")))
    chunk = W.partitionBy("doc", "chunk").orderBy(*_order(heads))
    local = heads.withColumn("k", F.row_number().over(chunk)).withColumn("gap", F.col("depth") - F.col("k"))
    local = local.withColumn("low", F.min("gap").over(chunk.rowsBetween(W.unboundedPreceding, 0)))
    carried = with_carry(
        local,
        {"n_heads": F.count(F.lit(1)).cast("int"), "lowest": F.min("gap")},
        [
            ("before", lambda earlier: F.coalesce(F.sum("n_heads").over(earlier), F.lit(0)).cast("int")),
            ("low_before", lambda earlier: F.min(F.col("lowest") - F.col("before")).over(earlier)),
        ],
    )
    low = F.least(F.lit(0), F.col("low") - F.col("before"), F.coalesce("low_before", F.lit(0)))
    seq = F.col("k") + F.col("before")
    return carried.withColumn("node_seq", seq).withColumn("eff_depth", seq + low).drop("k", "gap", "low", "before", "low_before")


def _last_at_level(levelled: DataFrame, level: str, what: str, name: str) -> DataFrame:
    """For rows with ``level``: the last non-null ``what`` of an earlier row of the document at that level.

    What earlier chunks leave at each level comes as one map per chunk, so the rows themselves, partitioned by document and
    chunk for the window, are not shuffled again for the join.
    """
    inside = W.partitionBy("doc", "chunk", level).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    local = levelled.withColumn("_here", F.last(what, ignorenulls=True).over(inside))
    tops = levelled.groupBy("doc", "chunk", level).agg(F.max_by(what, F.when(F.col(what).isNotNull(), F.col("at"))).alias("_top"))
    earlier = W.partitionBy("doc", level).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    before = tops.withColumn("_early", F.last("_top", ignorenulls=True).over(earlier)).where(F.col("_early").isNotNull())
    maps = before.groupBy(F.col("doc").alias("_d"), F.col("chunk").alias("_c")).agg(
        F.map_from_entries(F.collect_list(F.struct(level, "_early"))).alias("_levels")  # as many as the tree is deep
    )
    joined = local.join(maps, (F.col("doc") == F.col("_d")) & (F.col("chunk") == F.col("_c")), "left")
    found = F.coalesce("_here", F.try_element_at("_levels", F.col(level)))
    return joined.where(F.col("doc").isNotNull() & F.col("chunk").isNotNull()).withColumn(name, found).drop("_d", "_c", "_levels", "_here")


def nodes(events: DataFrame) -> DataFrame:
    """One row per header: doc, chunk, line_no, node_seq, id, title, node_type, proves, deps, depth, eff_depth,
    parent_seq (0 for the hidden root).

    Each header is looked at twice, as what later headers may find at its level and as one that asks one level up;
    the asking copy carries the header along, so that nothing has to be joined back.
    """
    eff = effective_depths(events).select(
        "doc", "chunk", "line_no", "node_seq", "id", title_of(F.col("title"), F.col("id")).alias("title"),
        node_type_of(F.col("node_type")).alias("node_type"), "proves", "deps", "depth", "eff_depth",
    )
    row = F.struct(*[c for c in eff.columns if c not in ("doc", "chunk")])
    none = F.lit(None).cast(eff.select(row.alias("r")).schema["r"].dataType)
    given = F.struct(F.col("eff_depth").alias("level"), F.col("node_seq").alias("provider"), none.alias("row"))
    asks = F.struct((F.col("eff_depth") - 1).alias("level"), F.lit(None).cast("int").alias("provider"), row.alias("row"))
    both = eff.select("doc", "chunk", F.col("node_seq").alias("at"), F.explode(F.array(given, asks)).alias("r"))
    found = _last_at_level(both.select("doc", "chunk", "at", "r.*"), "level", "provider", "parent_seq")
    return found.where(F.col("row").isNotNull()).select("doc", "chunk", "row.*", F.coalesce("parent_seq", F.lit(0)).alias("parent_seq"))


def content_spans(events: DataFrame, ends: DataFrame) -> DataFrame:
    """(doc, chunk, node_seq, first_line, last_line): stretches of lines between headers, owned by the last header.

    ``ends``: (doc, chunk, n_lines) of every text, those without events included. Lines before a document's first
    header belong to nobody; the first lines of a later chunk go on with the leaf of the chunk before.
    """
    heads = events.select("doc", "chunk", "line_no", "event_type")
    last = ends.select("doc", "chunk", (F.col("n_lines") + 1).cast("int").alias("line_no"), F.lit("end").alias("event_type"))
    marks = heads.unionByName(last)
    order = [F.col("line_no"), F.col("event_type") == "end"]
    chunk = W.partitionBy("doc", "chunk").orderBy(*order)
    cut = F.max(F.col("event_type") == "cutoff").over(W.partitionBy("doc", "chunk"))
    marks = marks.withColumn("cut", cut).where(~(F.col("cut") & (F.col("event_type") == "end"))).drop("cut")
    head = F.when(F.col("event_type") == "header", 1).otherwise(0)
    local = marks.select(
        "doc", "chunk", "line_no", head.alias("head"),
        (F.coalesce(F.lag("line_no").over(chunk), F.lit(0)) + 1).alias("first_line"),
        F.coalesce(F.sum(head).over(chunk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("seen"),
    )
    carried = with_carry(local, {"n": F.sum("head")}, [("before", lambda earlier: F.sum("n").over(earlier))])
    owner = (F.col("seen") + F.coalesce("before", F.lit(0))).cast("int")
    spans = carried.select("doc", "chunk", owner.alias("node_seq"), "first_line", (F.col("line_no") - 1).alias("last_line"))
    return spans.where((F.col("node_seq") > 0) & (F.col("first_line") <= F.col("last_line")))


def on_active_trace(nodes_: DataFrame) -> DataFrame:
    """Nodes with ``on_trace``: whether they lie on the way from the root to the last header."""
    after = W.partitionBy("doc", "chunk").orderBy(F.desc("node_seq")).rowsBetween(W.unboundedPreceding, -1)
    local = nodes_.withColumn("_low", F.min("eff_depth").over(after))
    chunks = nodes_.groupBy("doc", "chunk").agg(F.min("eff_depth").alias("_m"))
    later = W.partitionBy("doc").orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select(F.col("doc").alias("_d"), F.col("chunk").alias("_c"), F.min("_m").over(later).alias("_later"))
    on = (F.col("doc") == F.col("_d")) & (F.col("chunk") == F.col("_c"))
    joined = local.join(chunks, on)
    low = F.least("_low", "_later")
    return joined.withColumn("on_trace", F.coalesce(F.col("eff_depth") < low, F.lit(True))).drop("_low", "_later", "_d", "_c")


def active_trace(nodes_: DataFrame, include_root: bool = False) -> DataFrame:
    """(doc, trace): ids from the top to the active leaf; its length is the leaf's depth."""
    rows = on_active_trace(nodes_).where("on_trace").groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("node_seq", "id"))).alias("t")
    )
    ids = F.transform("t", lambda x: x["id"])
    return rows.select("doc", (F.concat(F.array(F.lit(ROOT_ID)), ids) if include_root else ids).alias("trace"))


def visible_roots(nodes_: DataFrame) -> DataFrame:
    return nodes_.where(F.col("eff_depth") == 1)


def visible_documents(docs: DataFrame, nodes_: DataFrame) -> DataFrame:
    """(doc, has_nodes) for every document of ``docs``."""
    some = nodes_.select("doc").distinct().withColumn("has_nodes", F.lit(True))
    return docs.select("doc").distinct().join(some, "doc", "left").select("doc", F.coalesce("has_nodes", F.lit(False)).alias("has_nodes"))


def batch_metrics(nodes_: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc, chunk, added_nodes, active_depth) for every chunk; depth is carried on through chunks without headers."""
    per = nodes_.groupBy("doc", "chunk").agg(
        F.count(F.lit(1)).alias("added_nodes"), F.max_by("eff_depth", "node_seq").alias("leaf_depth")
    )
    every = chunks.select("doc", "chunk").distinct().join(per, ["doc", "chunk"], "left")
    so_far = W.partitionBy("doc").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)
    return every.select(
        "doc", "chunk", F.coalesce("added_nodes", F.lit(0)).alias("added_nodes"),
        F.coalesce(F.last("leaf_depth", ignorenulls=True).over(so_far), F.lit(0)).alias("active_depth"),
    )


def with_root(nodes_: DataFrame) -> DataFrame:
    """Adjacency rows of the whole tree with its hidden root: (doc, node_seq, id, title, parent_seq)."""
    rows = nodes_.select("doc", "node_seq", "id", "title", "parent_seq")
    root = nodes_.select("doc").distinct().select(
        "doc", F.lit(0).alias("node_seq"), F.lit(ROOT_ID).alias("id"), F.lit(ROOT_TITLE).alias("title"), F.lit(None).cast("int").alias("parent_seq")
    )
    return root.unionByName(rows)


def registry_issues(nodes_: DataFrame) -> DataFrame:
    """(doc, node_seq, id, issue): ids registered twice, ids that clash with the root's, proves on what is no proof."""
    # counted by id, not in a window: a hot id is combined before the shuffle
    firsts = nodes_.groupBy("doc", "id").agg(F.min("node_seq").alias("first_seq"))
    joined = nodes_.join(firsts, ["doc", "id"])
    issue = F.array_compact(F.array(
        F.when(F.col("node_seq") > F.col("first_seq"), F.lit("duplicate id")),
        F.when(F.col("id") == ROOT_ID, F.lit("id of the root")),
        F.when(F.col("proves").isNotNull() & (F.col("node_type") != "proof"), F.lit("proves on non-proof")),
    ))
    return joined.select("doc", "node_seq", "id", F.explode(issue).alias("issue"))


def lookup(nodes_: DataFrame, wanted: DataFrame, *, strict: bool = False) -> DataFrame:
    """``wanted`` (doc, id) with node_seq of the first node of that id; null, or an error if ``strict``, without one."""
    firsts = nodes_.groupBy("doc", "id").agg(F.min("node_seq").alias("node_seq"))
    found = wanted.join(firsts, ["doc", "id"], "left")
    if not strict:
        return found
    missing = F.raise_error(F.concat(F.lit("no node with id "), F.coalesce("id", F.lit("null"))))
    return found.withColumn("node_seq", F.when(F.col("node_seq").isNull(), missing.cast("int")).otherwise(F.col("node_seq")))


def removed(nodes_: DataFrame, removals: DataFrame) -> DataFrame:
    """Nodes that no row of ``removals`` (doc, id) takes out."""
    return nodes_.join(removals.select("doc", "id").distinct(), ["doc", "id"], "left_anti")
