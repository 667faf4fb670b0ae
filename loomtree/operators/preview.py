"""Trees drawn as indented lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtree.checkpoints import checkpointed
from loomtree.operators.lines import with_carry
from loomtree.operators.rules import level_closure
from loomtree.operators.tree import on_active_trace

# The strokes.
LAST, INNER, BLANK, BAR = "└── ", "├── ", "    ", "│   "
CAP = 100


def node_label(ident: Column, node_type: Column, proves: Column, deps: Column) -> Column:
    """id [type; deps: a, b]; a proof shows what it proves, a generic node no type."""
    kind = F.when((node_type == "proof") & (F.coalesce(proves, F.lit("")) != ""), F.concat(F.lit("proof -> "), proves)).when(
        node_type != "generic", node_type
    )
    named = F.when(F.size(deps) > 0, F.concat(F.lit("deps: "), F.array_join(deps, ", ")))
    details = F.concat_ws("; ", kind, named)
    return F.when(details != "", F.concat(ident, F.lit(" ["), details, F.lit("]"))).otherwise(ident)


def preview_lines(nodes_: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """(doc, chunk, node_seq, eff_depth, line) of every node, in order of node_seq; of ``shown`` nodes alone, if given, which
    must hold the ancestors of each. Only those are joined with what stands above them."""
    last_child = nodes_.groupBy("doc", "parent_seq").agg(F.max("node_seq").alias("last_seq"))
    roots = nodes_.where(F.col("eff_depth") == 1).groupBy("doc").agg(F.count(F.lit(1)).alias("n_roots"))
    flagged = (nodes_ if shown is None else shown).join(last_child, ["doc", "parent_seq"]).withColumn("is_last", F.col("node_seq") == F.col("last_seq"))
    if shown is not None:
        flagged = checkpointed(flagged)  # a bounded number of each document
    above = level_closure(flagged, given=F.col("is_last")).where(F.col("node") != F.col("ancestor"))
    up = F.sort_array(F.collect_list(F.struct("ancestor", "given")))  # as many as the node is deep
    indent = above.groupBy("doc", F.col("node").alias("node_seq")).agg(up.alias("up"))
    strokes = F.array_join(F.transform("up", lambda x: F.when(x["given"], BLANK).otherwise(BAR)), "")
    rows = flagged.join(indent, ["doc", "node_seq"], "left").join(roots, "doc")
    bare = (F.col("eff_depth") == 1) & (F.col("n_roots") == 1)
    own = F.when(bare, "").when(F.col("is_last"), LAST).otherwise(INNER)
    label = node_label(F.col("id"), F.col("node_type"), F.col("proves"), F.col("deps"))
    line = F.concat(F.coalesce(strokes, F.lit("")), own, label)
    return rows.select("doc", "chunk", "node_seq", "eff_depth", line.alias("line"))


def capped_nodes(nodes_: DataFrame, cap: int = CAP) -> DataFrame:
    """The nodes a preview keeps, with ``on_trace``: those of the active trace and the first ``cap`` others. A node's ancestors
    stand before it or on the trace, so they are kept too."""
    other = F.when(F.col("on_trace"), 0).otherwise(1)
    inside = W.partitionBy("doc", "chunk").orderBy("node_seq").rowsBetween(W.unboundedPreceding, 0)
    rows = on_active_trace(nodes_).withColumn("_n", F.sum(other).over(inside))
    counted = with_carry(rows, {"_total": F.max("_n")}, [("_before", lambda earlier: F.sum("_total").over(earlier))])
    kept = counted.where(F.col("on_trace") | (F.col("_n") + F.coalesce("_before", F.lit(0)) <= cap))
    return kept.drop("_n", "_before")


def capped_lines(nodes_: DataFrame, cap: int = CAP) -> DataFrame:
    """(doc, node_seq, line) of the nodes a preview keeps."""
    return preview_lines(nodes_, capped_nodes(nodes_, cap)).select("doc", "node_seq", "line")


def tree_preview(nodes_: DataFrame, cap: int = CAP) -> DataFrame:
    """(doc, preview): kept lines joined; bounded by the cap and the trace's depth."""
    kept = capped_lines(nodes_, cap).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("node_seq", "line"))).alias("l"))
    return kept.select("doc", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("preview"))
