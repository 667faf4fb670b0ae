"""Cutting ordered lines into batches under a token budget, and a run's progress through them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtree.functions import bpe
from loomtree.operators.lines import file_lines, with_carry
from loomtree.session import ship

#: Lines of a document summed by one task.
LINES_A_BLOCK = 1 << 16

#: Any expression that gives the number of tokens of a text.
TokenCounter = Callable[[Column], Column]


def word_count(text: Column) -> Column:
    """The default counter: strings between white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def char_count(text: Column) -> Column:
    return F.length(text)


def bpe_count(spark: SparkSession, path: str = bpe.RANKS) -> TokenCounter:
    """The counter of a public byte-level tokenizer, in Arrow batches; its rank file is sent along."""
    name = bpe.shipped(ship(spark), path)

    def count(texts: pd.Series) -> pd.Series:
        encode = bpe.encoding(name).encode_ordinary
        return pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return F.pandas_udf(count, "bigint")


def numbered_lines(texts: DataFrame, counter: TokenCounter = word_count) -> DataFrame:
    """(doc, at, line, upto) of texts (doc, text): lines from 0 with their line ends, and the tokens before each.

    Computed once per document, so that any batch of it can be read without the rest: one that starts where ``s`` tokens
    are behind takes the lines with ``upto < s + budget``. The sums are made per block of lines and completed with one
    row per block, so no task holds a whole document's lines.
    """
    normal = F.regexp_replace(F.col("text"), r"\r\n|\r", "\n")
    rows = texts.where(F.col("text").isNotNull()).select("doc", normal.alias("t"))
    split = rows.select("doc", F.col("t").endswith("\n").alias("ended"), F.explode(F.array(file_lines(F.col("t")))).alias("p"))
    each = split.select("doc", "ended", F.size("p").alias("n"), F.posexplode("p").alias("at", "x"))
    line = F.when((F.col("at") + 1 < F.col("n")) | F.col("ended"), F.concat("x", F.lit("\n"))).otherwise(F.col("x"))
    counted = each.select("doc", F.col("at").cast("bigint").alias("at"), line.alias("line"))
    counted = counted.select("*", counter(F.col("line")).cast("bigint").alias("n"), F.floor(F.col("at") / LINES_A_BLOCK).alias("chunk"))
    inside = W.partitionBy("doc", "chunk").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    summed = with_carry(
        counted.withColumn("here", F.coalesce(F.sum("n").over(inside), F.lit(0))), {"total": F.sum("n")},
        [("before", lambda earlier: F.coalesce(F.sum("total").over(earlier), F.lit(0)))],
    )
    return summed.select("doc", "at", "line", (F.col("here") + F.col("before")).alias("upto"), "n")


def plan_batches(texts: DataFrame, doc: str, text: str, budget: int | Column, counter: TokenCounter = word_count) -> DataFrame:
    """Greedy batches of each document: (doc, ordinal, chunk_id, start_line, end_line, raw_content, raw_line_count,
    raw_token_count, clean_token_target).

    A batch takes lines until their tokens reach the budget, the crossing line included, so it has one line at
    least. Its own token count is that of the joined text. The greedy walk depends on every line before, so it is a
    fold over one document's line counts in the row that holds its text: nothing is shuffled, and a document costs its
    lines and, for the list of ends, half the square of its batches (a text of 1 GB in batches of 16,000 tokens: 15,000
    batches). Where a text is larger than a row can hold, ``numbered_lines`` serves one batch at a time.
    """
    # Line ends stay with their lines; a last line without one stays as it is.
    limit = F.lit(budget) if isinstance(budget, int) else budget
    normal = F.regexp_replace(F.col(text), r"\r\n|\r", "\n")
    rows = texts.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), normal.alias("t"), limit.alias("budget"))
    # explode of one element keeps an array from being computed again for every use of it
    rows = rows.select("doc", "budget", "t", F.explode(F.array(file_lines(F.col("t")))).alias("p"))
    n, ended = F.size("p"), F.col("t").endswith("\n")
    lines = F.transform("p", lambda x, i: F.when((i + 1 < n) | ended, F.concat(x, F.lit("\n"))).otherwise(x))
    rows = rows.where(n > 0).select("doc", "budget", F.explode(F.array(lines)).alias("lines"))
    tokens = F.transform("lines", lambda x: counter(x).cast("bigint"))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("ends"))

    def step(state: Column, t: Column) -> Column:
        total, i = state["sum"] + t, state["i"] + 1
        full = total >= F.col("budget")
        return F.struct(
            F.when(full, F.lit(0).cast("bigint")).otherwise(total).alias("sum"),
            i.alias("i"),
            F.when(full, F.array_append(state["ends"], i)).otherwise(state["ends"]).alias("ends"),
        )

    folded = rows.select("doc", "lines", F.explode(F.array(F.aggregate(tokens, start, step))).alias("f"))
    last = F.coalesce(F.element_at("f.ends", F.when(F.size("f.ends") > 0, -1)), F.lit(0))
    ends = F.when(last < F.size("lines"), F.array_append("f.ends", F.size("lines"))).otherwise(F.col("f.ends"))
    cut = folded.select("doc", "lines", F.explode(F.array(ends)).alias("ends")).select("doc", "lines", "ends", F.posexplode("ends").alias("ordinal", "end_line"))
    begin = F.when(F.col("ordinal") > 0, F.element_at("ends", F.greatest("ordinal", F.lit(1)))).otherwise(0)
    cut = cut.withColumn("start_line", begin)
    count = F.col("end_line") - F.col("start_line")
    content = F.array_join(F.slice("lines", F.col("start_line") + 1, count), "")
    return batch_attributes(cut.select("doc", "ordinal", "start_line", "end_line", content.alias("raw_content")), counter)


def batch_attributes(batches: DataFrame, counter: TokenCounter = word_count) -> DataFrame:
    """Adds chunk_id, line and token counts and the target for the cleaned text."""
    tokens = counter(F.col("raw_content")).cast("bigint")
    return batches.select(
        "doc", "ordinal", F.format_string("chunk_%03d", F.col("ordinal")).alias("chunk_id"), "start_line", "end_line", "raw_content",
        (F.col("end_line") - F.col("start_line")).alias("raw_line_count"), tokens.alias("raw_token_count"),
        F.greatest(F.lit(1).cast("bigint"), F.floor(tokens * 0.5)).alias("clean_token_target"),
    )


def is_complete(next_start_line: Column, total_lines: Column) -> Column:
    return next_start_line >= total_lines


def clamp_cutoff(source_line: Column, start_line: Column, end_line: Column) -> Column:
    """A cutoff within (start, end], leaving one line at least."""
    low = start_line + 1
    return F.greatest(low, F.least(source_line, F.greatest(end_line, low)))


def advance(next_chunk_id: Column, sections_completed: Column, cutoff: Column) -> Column:
    """The run's state after a batch."""
    return F.struct(
        cutoff.alias("next_start_line"), (next_chunk_id + 1).alias("next_chunk_id"), (sections_completed + 1).alias("sections_completed")
    )


def within_sections(batches: DataFrame, max_sections: int | None) -> DataFrame:
    """Batches of a run that may have so many sections, over all its resumptions."""
    return batches if max_sections is None else batches.where(F.col("ordinal") < max_sections)
