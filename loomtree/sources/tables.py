"""State of a run as tables: clean texts by (doc, ordinal), the tail of the batch before, and the merged document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtree.functions.patterns import CUTOFF_LITERAL
from loomtree.operators.lines import file_lines


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows written more than once (the same keys) the last by ``written_at``."""
    rest = [c for c in rows.columns if c not in (*keys, "written_at")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.coalesce("written_at", F.timestamp_seconds(F.lit(0)))).alias("r"))
    return last.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def _kept(clean: DataFrame) -> DataFrame:
    """(doc, ordinal, lines): the file lines of clean texts before the first that holds the literal cutoff marker."""
    rows = clean.where(F.col("text").isNotNull()).select("doc", "ordinal", F.explode(F.array(file_lines(F.col("text")))).alias("l"))
    cut = F.array_position(F.transform("l", lambda x: x.contains(CUTOFF_LITERAL)), True)
    return rows.select("doc", "ordinal", F.when(cut > 0, F.slice("l", 1, (cut - 1).cast("int"))).otherwise(F.col("l")).alias("lines"))


def clean_lines(clean: DataFrame) -> DataFrame:
    """(doc, ordinal, line_no, line) of clean texts (doc, ordinal, text) before their cutoff marker; nothing is shuffled."""
    rows = _kept(clean).select("doc", "ordinal", F.posexplode("lines").alias("p", "line"))
    return rows.select("doc", "ordinal", (F.col("p") + 1).alias("line_no"), "line")


def prior_clean_tails(clean: DataFrame, n: int) -> DataFrame:
    """(doc, ordinal, prior_clean_tail) for the batch after each clean text: its last ``n`` lines before the marker."""
    rows = _kept(clean).where(F.size("lines") > 0)
    tail = F.slice("lines", F.greatest(F.lit(1), F.size("lines") - (n - 1)), n)
    text = F.array_join(F.transform(tail, lambda x: F.concat(x, F.lit("\n"))), "")
    return rows.select("doc", (F.col("ordinal") + 1).alias("ordinal"), text.alias("prior_clean_tail"))


def merged_lines(clean: DataFrame) -> DataFrame:
    """The final document as ordered lines (doc, ordinal, line_no, line): every clean text up to its marker, headers kept.

    The order is numeric by ordinal; a document of any size stays a table.
    """
    return clean_lines(clean)


def numeric_order(name: Column, prefix: str = "clean_", suffix: str = ".md") -> Column:
    """Sort key of file names: numbered ones by their number, others after them by name."""
    pattern = rf"^{prefix}(\d+){suffix.replace('.', chr(92) + '.')}$"
    numbered = name.rlike(pattern)
    number = F.when(numbered, F.try_to_number(F.regexp_extract(name, pattern, 1), F.lit("999999999999999999")).cast("bigint"))
    return F.struct(F.when(numbered, 0).otherwise(1).alias("group"), number.alias("number"), F.when(~numbered, name).alias("name"))


def clean_exists(plans: DataFrame, clean: DataFrame) -> DataFrame:
    """Plans (doc, ordinal) with ``has_clean``."""
    some = clean.select("doc", "ordinal").distinct().withColumn("has_clean", F.lit(True))
    return plans.join(some, ["doc", "ordinal"], "left").withColumn("has_clean", F.coalesce("has_clean", F.lit(False)))


def read_clean(clean: DataFrame, doc, ordinal: int) -> DataFrame:
    """(doc, text): the clean text of one batch, or of that batch of every document without ``doc``; no row if there is none."""
    found = clean.where(F.col("ordinal") == ordinal)
    return (found if doc is None else found.where(F.col("doc") == F.lit(doc))).select("doc", "text")


def with_memory(batches: DataFrame, memory: DataFrame) -> DataFrame:
    """Batches with their document's memory text, '' without one."""
    return batches.join(memory.select("doc", "memory_text"), "doc", "left").withColumn("memory_text", F.coalesce("memory_text", F.lit("")))


def snapshot(state: DataFrame) -> DataFrame:
    """Cursors of saved runs; those never written start at 0."""
    return state.select(
        "run_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("next_start_line", "next_chunk_id", "sections_completed")]
    )
