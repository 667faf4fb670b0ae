"""Ordering rules of content in a tree, and the interval algebra they rest on.

Content is ordered and equal by (chunk_number, first_line) alone; last_line never takes part, but for the overlap of
line ranges in a partition. Frames: ``content`` (doc, node, chunk_number, first_line, last_line), ``tree`` (doc, node,
parent), ``bounds`` (doc, node, lo, hi); a closure has each node as its own ancestor too.

A closure is as large as the sum of the depths. That is linear in the input: a header at depth n has n dashes, and a
node's path names n positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def content_key(chunk: str = "chunk_number", first: str = "first_line") -> Column:
    """The ordered key of a content row."""
    return F.struct(F.col(chunk).alias("chunk_number"), F.col(first).alias("first_line"))


def n_lines(first: Column, last: Column) -> Column:
    return last - first + 1


def bound_union(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """The bound that covers both; a missing one is left out."""
    return F.struct(F.least(lo, other_lo).alias("lo"), F.greatest(hi, other_hi).alias("hi"))


def bound_intersect(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """What two closed bounds share, or null."""
    low, high = F.greatest(lo, other_lo), F.least(hi, other_hi)
    return F.when(lo.isNotNull() & other_lo.isNotNull() & (low <= high), F.struct(low.alias("lo"), high.alias("hi")))


def is_after(lo: Column, other_hi: Column) -> Column:
    """Whether everything of one subtree follows everything of another; false if either has no content."""
    return F.coalesce(lo > other_hi, F.lit(False))


def is_before_content(hi: Column, key: Column) -> Column:
    return F.coalesce(hi < key, F.lit(False))


def is_after_content(lo: Column, key: Column) -> Column:
    return F.coalesce(lo > key, F.lit(False))


def path_bounds(content: DataFrame) -> DataFrame:
    """``content_bounds`` of trees whose nodes are dotted paths: a node's ancestors are its path's beginnings, so nothing is
    joined, and a task combines what it has of a node before it sends."""
    parts = F.split("node", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    up = content.select("doc", content_key().alias("key"), F.explode(prefixes).alias("node"))
    return up.groupBy("doc", "node").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))


def level_closure(nodes_: DataFrame, *, given: Column | None = None, asks: Column | None = None, only: Column | None = None) -> DataFrame:
    """(doc, node, ancestor, given, asks) of event-built trees: at each level above, the ancestor is the last earlier node of
    that level. ``given`` is a value that each ancestor brings along, ``asks`` one that each node does, so neither has to be
    joined later; ``only``: which nodes ask for their ancestors."""
    from loomtree.operators.tree import _last_at_level

    empty = F.lit(None).cast("boolean")
    up = F.struct(F.col("node_seq").alias("seq"), (empty if given is None else given).alias("value"))
    own = F.struct(F.col("node_seq").alias("seq"), (empty if asks is None else asks).alias("value"))
    kinds = nodes_.select(up.alias("up"), own.alias("own")).schema
    provides = F.struct(F.col("eff_depth").alias("level"), up.alias("provider"), F.lit(None).cast(kinds["own"].dataType).alias("asks"))
    some = (F.col("eff_depth") > 1) if only is None else (F.col("eff_depth") > 1) & only
    levels = F.when(some, F.sequence(F.lit(1), F.greatest(F.col("eff_depth") - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    asked = F.transform(levels, lambda x: F.struct(x.alias("level"), F.lit(None).cast(kinds["up"].dataType).alias("provider"), own.alias("asks")))
    rows = nodes_.select("doc", "chunk", F.col("node_seq").alias("at"), F.explode(F.concat(F.array(provides), asked)).alias("r"))
    found = _last_at_level(rows.select("doc", "chunk", "at", "r.*"), "level", "provider", "found").where(F.col("asks").isNotNull())
    above = found.select("doc", F.col("asks.seq").alias("node"), F.col("found.seq").alias("ancestor"), F.col("found.value").alias("given"), F.col("asks.value").alias("asks"))
    itself = nodes_ if only is None else nodes_.where(only)
    return above.unionByName(itself.select("doc", F.col("node_seq").alias("node"), F.col("node_seq").alias("ancestor"), up["value"].alias("given"), own["value"].alias("asks")))


def _with_own(nodes_: DataFrame, content: DataFrame) -> DataFrame:
    """Nodes with ``lo`` and ``hi``, the smallest and largest key of their own content, null without any."""
    own = content.groupBy("doc", F.col("node").alias("node_seq")).agg(F.min(content_key()).alias("lo"), F.max(content_key()).alias("hi"))
    return nodes_.select("doc", "chunk", "node_seq", "eff_depth").join(own, ["doc", "node_seq"], "left")


def content_bounds(nodes_: DataFrame, content: DataFrame) -> DataFrame:
    """(doc, node, lo, hi): the smallest and largest key in the subtree of each node of an event-built tree; no row without
    content. A node with content tells its bounds to its ancestors, and a task combines what it has of one before it sends."""
    with_own = _with_own(nodes_, content)
    told = level_closure(with_own, asks=F.struct("lo", "hi"), only=F.col("lo").isNotNull())
    return told.groupBy("doc", F.col("ancestor").alias("node")).agg(F.min("asks.lo").alias("lo"), F.max("asks.hi").alias("hi"))


def max_ancestor_content(nodes_: DataFrame, content: DataFrame) -> DataFrame:
    """(doc, node, top): the largest key of each node and its ancestors in an event-built tree; no row where none has content."""
    told = level_closure(_with_own(nodes_, content), given=F.col("hi")).where(F.col("given").isNotNull())
    return told.groupBy("doc", "node").agg(F.max("given").alias("top"))


def rule_1_violations(tree: DataFrame, content: DataFrame, bounds: DataFrame) -> DataFrame:
    """(doc, node, parent): children whose subtree does not start after their parent's own content."""
    own = content.groupBy(F.col("doc"), F.col("node").alias("parent")).agg(F.max(content_key()).alias("top"))
    children = tree.join(bounds, ["doc", "node"]).join(own, ["doc", "parent"])
    return children.where(~(F.col("lo") > F.col("top"))).select("doc", "node", "parent")


def rule_2_violations(tree: DataFrame, bounds: DataFrame) -> DataFrame:
    """(doc, node, parent): nodes whose span meets the span of a sibling that starts no later."""
    spans = tree.where(F.col("parent").isNotNull()).join(bounds, ["doc", "node"])
    before = W.partitionBy("doc", "parent").orderBy("lo", "hi", "node").rowsBetween(W.unboundedPreceding, -1)
    return spans.where(F.col("lo").isNotNull()).withColumn("reach", F.max("hi").over(before)).where(
        F.col("lo") <= F.col("reach")
    ).select("doc", "node", "parent")


def out_of_order_content(content: DataFrame, order: str) -> DataFrame:
    """Rows of a node whose key does not follow the key before it in the order of arrival."""
    arrival = W.partitionBy("doc", "node").orderBy(order)
    key = content_key()
    return content.withColumn("_prev", F.lag(key).over(arrival)).where(~(key > F.col("_prev"))).drop("_prev")


def partition_violations(content: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """(keys..., ident, issue): spans of one partition that start where another does, or overlap an earlier one.

    Of spans with one start, every one after the first (by ``ident``) is a duplicate. Only the reach of what starts
    before is carried along, so a partition of any size streams through its task.
    """
    rows = content.where(F.col("first_line").isNotNull() & F.col("last_line").isNotNull() & (F.col("first_line") <= F.col("last_line")))
    part = W.partitionBy(*keys)
    order = part.orderBy("first_line", ident)
    same = F.row_number().over(W.partitionBy(*keys, "first_line").orderBy(ident)) > 1
    reach = F.max("last_line").over(order.rowsBetween(W.unboundedPreceding, -1))
    issue = F.when(same, "duplicate start").when(F.col("first_line") <= reach, "overlap")
    return rows.withColumn("issue", issue).where(F.col("issue").isNotNull()).select(*keys, ident, "issue")
