"""Texts as ordered lines: (doc, chunk, line_no, line), line_no from 1.

Every operator of the annotation engine takes frames keyed by ``doc`` and ``chunk`` with an explicit order, so a
document's chunks are tasks of their own and order never depends on where a row is stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from loomtree.functions.patterns import FILE_LINE_BREAK, LINE_BREAK, OTHER_BREAKS


def split_lines(text: Column, breaks: str = LINE_BREAK) -> Column:
    """The lines of a text: none for '', and no empty one after a final break.

    The final break is taken off before the split, so the split is written, and computed, once.
    """
    others = rf"[{OTHER_BREAKS}]" if breaks == LINE_BREAK else r"\r"
    # a plain line feed is split without a pattern
    plain = F.split(F.when(text.endswith("\n"), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text), "\n")
    mixed = F.split(F.regexp_replace(text, rf"(?:{breaks})\z", ""), breaks)
    return F.when(text == "", F.array().cast("array<string>")).when(text.rlike(others), mixed).otherwise(plain)


def file_lines(text: Column) -> Column:
    """The lines that reading a text file gives: only line feed, carriage return and both together end one."""
    return split_lines(text, FILE_LINE_BREAK)


def text_lines(texts: DataFrame, doc: str, chunk: Column | str | None, text: str, *, as_file: bool = False) -> DataFrame:
    """(doc, chunk, line_no, line) of a table of texts; null text has no lines."""
    part = F.lit(0) if chunk is None else F.col(chunk) if isinstance(chunk, str) else chunk
    lines = file_lines(F.col(text)) if as_file else split_lines(F.col(text))
    picked = texts.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), part.alias("chunk"), lines.alias("lines"))
    return picked.select("doc", "chunk", F.posexplode("lines").alias("p", "line")).select(
        "doc", "chunk", (F.col("p") + 1).alias("line_no"), "line"
    )


def with_carry(df: DataFrame, summary: dict[str, Column], carry: list[tuple[str, Callable[[WindowSpec], Column]]]) -> DataFrame:
    """Adds to each row of a (doc, chunk) values carried in from the document's earlier chunks.

    ``summary`` aggregates each chunk; ``carry`` are columns over the chunk summaries, given the window of the earlier
    chunks, each free to use those before it. A document's running state is thus one row per chunk, and no task ever
    holds a whole document: the way to scan a document that has a third of all rows. Rows without a document or
    chunk belong to no document and are left out.
    """
    chunks = df.groupBy("doc", "chunk").agg(*[c.alias(n) for n, c in summary.items()])
    earlier = W.partitionBy("doc").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    for name, column in carry:
        chunks = chunks.withColumn(name, column(earlier))
    carried = chunks.select(F.col("doc").alias("_doc"), F.col("chunk").alias("_chunk"), *[n for n, _ in carry])
    on = (F.col("doc") == F.col("_doc")) & (F.col("chunk") == F.col("_chunk"))
    return df.join(carried, on).drop("_doc", "_chunk")
