"""Links between nodes by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtree.functions.patterns import SEMANTIC_TYPES
from loomtree.operators.tree import lookup


def dependencies(nodes_: DataFrame, *, strict: bool = False) -> DataFrame:
    """(doc, node_seq, pos, dep_id, dep_seq) of every dependency in order; dep_seq null, or an error, if none has the id."""
    named = nodes_.select("doc", F.col("node_seq").alias("from_seq"), F.posexplode("deps").alias("pos", "id"))
    found = lookup(nodes_, named, strict=strict)
    return found.select("doc", F.col("from_seq").alias("node_seq"), "pos", F.col("id").alias("dep_id"), F.col("node_seq").alias("dep_seq"))


def proved(nodes_: DataFrame, *, strict: bool = False) -> DataFrame:
    """(doc, node_seq, proves, proved_seq) of every node that proves another."""
    named = nodes_.where(F.col("proves").isNotNull()).select("doc", F.col("node_seq").alias("from_seq"), F.col("proves").alias("id"))
    found = lookup(nodes_, named, strict=strict)
    return found.select("doc", F.col("from_seq").alias("node_seq"), F.col("id").alias("proves"), F.col("node_seq").alias("proved_seq"))


def is_theory(node_type: Column) -> Column:
    return F.coalesce(node_type.isin(SEMANTIC_TYPES), F.lit(False))
