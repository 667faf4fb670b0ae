"""Tree documents from and to JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtree.checkpoints import checkpointed
from loomtree.functions.patterns import NODE_TYPES
from loomtree.operators.nested import content_of, dependencies_of, flatten_trees, nodes_of
from loomtree.operators.rules import content_key, path_bounds, rule_1_violations, rule_2_violations

ContentCodec = Callable[[Column, Column, Column], Column]


def content_struct(chunk: Column, first: Column, last: Column) -> Column:
    """The default form of a content entry; any function of the three columns may take its place."""
    return F.struct(chunk.alias("chunk_number"), first.alias("first_line"), last.alias("last_line"))


def load(trees: DataFrame, *, keep: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, content, dependencies) with defaults filled in: title '', type generic; keyed by doc and node path. With
    ``keep`` the documents are shredded once and the rows written, for plans that read several of the three."""
    flat = checkpointed(flatten_trees(trees)) if keep else flatten_trees(trees)
    found = nodes_of(flat)
    nodes = found.select(
        F.col("tree_id").alias("doc"), F.col("node_path").alias("node"), F.col("parent_path").alias("parent"), "pos", "id",
        "title", "node_type", F.coalesce("node_type", F.lit("generic")).alias("type"), "proves_id",
    )
    content = content_of(flat).select(F.col("tree_id").alias("doc"), F.col("node_path").alias("node"), "pos", "chunk_number", "first_line", "last_line")
    deps = dependencies_of(flat).select(F.col("tree_id").alias("doc"), F.col("node_path").alias("node"), "pos", "dep_id")
    return nodes, content, deps


def load_issues(trees: DataFrame) -> DataFrame:
    """(doc, node, issue): why a document would be refused: missing ids or titles, unknown types, ids given twice,
    proves on what is no proof, content without its numbers, and breaches of the two ordering rules."""
    nodes, content, _ = load(trees, keep=True)
    firsts = nodes.where(F.col("id") != "").groupBy("doc", "id").agg(F.min("node").alias("first"))
    own = nodes.join(firsts, ["doc", "id"], "left")
    found = F.array_compact(F.array(
        F.when(F.col("id") == "", F.lit("id missing")),
        F.when(F.col("title").isNull(), F.lit("title missing")),
        F.when(~F.col("type").isin(NODE_TYPES), F.lit("unknown type")),
        F.when(F.col("node") != F.col("first"), F.lit("duplicate id")),
        F.when(F.col("proves_id").isNotNull() & (F.col("type") != "proof"), F.lit("proves on non-proof")),
    ))
    single = own.select("doc", "node", F.explode(found).alias("issue"))
    whole = F.col("chunk_number").isNotNull() & F.col("first_line").isNotNull() & F.col("last_line").isNotNull()
    part = content.where(~whole).select("doc", "node", F.lit("content incomplete").alias("issue")).distinct()
    tree, usable = nodes.select("doc", "node", "parent"), content.where(whole)
    bounds = checkpointed(path_bounds(usable))
    one = rule_1_violations(tree, usable, bounds).select("doc", "node", F.lit("rule 1").alias("issue"))
    two = rule_2_violations(tree, bounds).select("doc", "node", F.lit("rule 2").alias("issue"))
    return single.unionByName(part).unionByName(one).unionByName(two)


def export(nodes_: DataFrame, content: DataFrame, *, codec: ContentCodec = content_struct) -> DataFrame:
    """(doc, node_seq, json) of the trees below every top node, for event-built trees.

    In document order a tree's text is its nodes' texts one after the other: each is opened, and what follows it, its first
    child, a sibling or the end of some levels, is told by the depth of the next node alone. So nothing is joined by level,
    whatever the depth, and one gathering below the top node ends it. Empty parts are left out, and a generic type too.
    """
    entry = codec(F.col("chunk_number"), F.col("first_line"), F.col("last_line"))
    spans = content.groupBy("doc", "node_seq").agg(F.sort_array(F.collect_list(F.struct(content_key().alias("k"), entry.alias("e")))).alias("c"))
    rows = nodes_.select("doc", "chunk", "node_seq", "eff_depth", "id", "title", "node_type", "proves", "deps").join(spans, ["doc", "node_seq"], "left")
    own = F.to_json(F.struct(
        "id", "title", F.transform("c", lambda x: x["e"]).alias("content"),
        F.when(F.col("node_type") != "generic", F.col("node_type")).alias("node_type"),
        F.when(F.col("proves") != "", F.col("proves")).alias("proves_id"),
        F.when(F.size("deps") > 0, F.col("deps")).alias("dependencies"),
    ))
    inside = W.partitionBy("doc", "chunk").orderBy("node_seq")
    top = F.when(F.col("eff_depth") == 1, F.col("node_seq"))
    local = rows.select(
        "doc", "chunk", "node_seq", "eff_depth", own.alias("own"), F.lead("eff_depth").over(inside).alias("next_here"),
        F.max(top).over(inside.rowsBetween(W.unboundedPreceding, 0)).alias("top_here"),
    )
    chunks = nodes_.groupBy("doc", "chunk").agg(F.min_by("eff_depth", "node_seq").alias("opens"), F.max(top).alias("last_top"))
    earlier = W.partitionBy("doc").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy("doc").orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, -1)
    carried = chunks.select(
        F.col("doc").alias("d"), F.col("chunk").alias("c"), F.last("opens").over(later).alias("next_later"), F.max("last_top").over(earlier).alias("top_before")
    )
    on = (F.col("doc") == F.col("d")) & (F.col("chunk") == F.col("c"))
    placed = local.join(carried, on).select(
        "doc", "node_seq", "own", F.col("eff_depth").alias("depth"), F.coalesce("next_here", "next_later", F.lit(0)).alias("next"),
        F.coalesce("top_here", "top_before").alias("top_seq"),
    )
    closed = F.repeat(F.lit("]}"), F.col("depth") - F.greatest("next", F.lit(1)))
    text = F.when(
        F.col("next") > F.col("depth"), F.concat(F.expr("substr(own, 1, length(own) - 1)"), F.lit(',"children":['))
    ).otherwise(F.concat("own", closed, F.when(F.col("next") > 1, ",").otherwise("")))
    parts = placed.select("doc", "node_seq", "top_seq", text.alias("text")).groupBy("doc", "top_seq").agg(
        F.sort_array(F.collect_list(F.struct("node_seq", "text"))).alias("p")  # one tree is one string
    )
    return parts.select("doc", F.col("top_seq").alias("node_seq"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("json"))
