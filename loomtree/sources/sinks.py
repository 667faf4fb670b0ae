"""Writing a run's state.

Every table is only added to: a batch written again does not touch what any other document or round has written, and a
reader takes the latest rows (``tables.latest``), or those of the rounds that were committed (``committed``). The
manifest row written last is what makes a batch count, as a commit does.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtree.functions.patterns import CUTOFF_LITERAL
from loomtree.session import ship
from loomtree.sources.files import StateDir
from loomtree.sources.tables import merged_lines


def _add(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Appends rows with the time of writing; rows of a round go to its own folder."""
    rows = df.withColumn("written_at", F.current_timestamp())
    writer = rows.write.mode("append")
    (writer.partitionBy("round") if "round" in df.columns else writer).format(form).save(path)


def write_raw_batches(batches: DataFrame, state: StateDir) -> None:
    """Mirrors batches (doc, ordinal, raw_content, ...)."""
    _add(batches, state.raw)


def marked(text: Column) -> Column:
    """A clean text ended by the cutoff marker on a line of its own."""
    whole = F.when((text != "") & ~text.endswith("\n"), F.concat(text, F.lit("\n"))).otherwise(text)
    return F.concat(whole, F.lit(CUTOFF_LITERAL + "\n"))


def write_clean_batches(clean: DataFrame, state: StateDir) -> None:
    """Writes clean texts (doc, ordinal, text), each ended by the cutoff marker."""
    _add(clean.withColumn("text", marked(F.col("text"))), state.clean)


def append_log(rows: DataFrame, state: StateDir) -> None:
    """Adds (chunk_id, content, ...) of invocations."""
    _add(rows, state.logs, "json")


def append_failures(rows: DataFrame, state: StateDir) -> None:
    """Adds (chunk_id, content, ...) of what failed: the dead-letter table."""
    _add(rows, state.failures, "json")


def write_snapshot(rows: DataFrame, state: StateDir) -> None:
    """Adds cursors (doc, next_start_line, next_chunk_id, sections_completed, ...); the latest of a document count."""
    _add(rows, state.snapshot, "json")


def write_tree(nodes: DataFrame, content: DataFrame, state: StateDir) -> None:
    """Adds nodes and their content to two tables; nothing if there is no node."""
    if nodes.isEmpty():
        return
    _add(nodes, f"{state.tree}/nodes")
    _add(content, f"{state.tree}/content")


def _indented(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False) for t in texts], dtype=object)


def indented(text: Column) -> Column:
    """JSON text with two blanks a level, characters kept as they are."""
    return F.pandas_udf(_indented, "string")(text)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON documents (json) as text files, indented, one after the other."""
    ship(rows.sparkSession)
    rows.select(indented(F.col("json"))).write.mode("overwrite").text(path)


def write_final(clean: DataFrame, state: StateDir) -> bool:
    """The merged document as text files whose names keep the order; nothing, and False, if it is empty."""
    lines = merged_lines(clean)
    if lines.isEmpty():
        return False
    ordered = lines.repartitionByRange("doc", "ordinal", "line_no").sortWithinPartitions("doc", "ordinal", "line_no")
    ordered.select("line").write.mode("overwrite").text(state.final)
    return True


def commit(batches: DataFrame, state: StateDir) -> None:
    """Adds the manifest rows (chunk_id, ...) that make batches count; no row, no commit."""
    if not batches.isEmpty():
        batches.withColumn("committed_at", F.current_timestamp()).write.mode("append").json(state.commits)
