"""Aligning cleaned text with its raw batch by content tokens, to find the raw line at which it ends."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtree.functions.patterns import COMMENT, CONTENT_TOKEN, HEADER_LINE, MATH_BLOCK, MATH_INLINE
from loomtree.operators.lines import split_lines
from loomtree.session import ship

# Tokens that a cleaned text must have, and the gates.
LEAST_TOKENS, LEAST_CONFIDENCE, LEAST_SHARE = 20, 0.6, 0.2


def content_tokens(text: Column) -> Column:
    """Lower-case runs of three ASCII letters or digits and more, outside comments, headers and formulas."""
    for pattern in (COMMENT, HEADER_LINE, MATH_BLOCK, MATH_INLINE):
        text = F.regexp_replace(text, pattern, " ")
    return F.regexp_extract_all(F.lower(text), F.lit(CONTENT_TOKEN), F.lit(0))


def raw_tokens(text: Column) -> Column:
    """(token, line) of a raw text, each line for itself; lines from 1."""
    per = F.transform(split_lines(text), lambda line, i: F.transform(content_tokens(line), lambda t: F.struct(t.alias("token"), (i + 1).alias("line"))))
    return F.flatten(per)


def _blocks(cleaned: pd.Series, raw: pd.Series) -> pd.Series:
    return pd.Series([
        [{"a": m.a, "b": m.b, "size": m.size} for m in SequenceMatcher(None, list(a), list(b), autojunk=False).get_matching_blocks() if m.size]
        for a, b in zip(cleaned, raw)
    ])


def matching_blocks(cleaned: Column, raw: Column) -> Column:
    """Matching blocks of two token sequences, the empty last one left out; Arrow batches of bounded texts."""
    # not deterministic for the optimizer: evaluated once and never copied into a pushed filter
    return F.pandas_udf(_blocks, "array<struct<a:int,b:int,size:int>>").asNondeterministic()(cleaned, raw)


def align(pairs: DataFrame) -> DataFrame:
    """Adds to (…, cleaned, raw) the outcome of the alignment: ok, error_code, cutoff_line, confidence, token counts."""
    ship(pairs.sparkSession)
    rows = pairs.withColumn("_c", content_tokens(F.col("cleaned"))).withColumn("_r", raw_tokens(F.col("raw")))
    n_c, n_r = F.size("_c"), F.size("_r")
    rows = rows.withColumn("least", F.least(F.lit(LEAST_TOKENS), n_r))
    early = F.when(n_r == 0, "raw_has_no_content_tokens").when(n_c < F.col("least"), "cleaned_too_short_for_alignment")
    rows = rows.withColumn("_early", early)
    none = F.array().cast("array<string>")
    usable = F.col("_early").isNull()
    blocks = matching_blocks(
        F.when(usable, F.col("_c")).otherwise(none), F.when(usable, F.transform("_r", lambda x: x["token"])).otherwise(none)
    )
    rows = rows.withColumn("_b", blocks)
    code = F.coalesce("_early", F.when(F.size("_b") == 0, "no_token_overlap"))
    last = F.try_element_at("_b", F.lit(-1))
    matched = F.aggregate("_b", F.lit(0), lambda s, x: s + x["size"])
    end = last["b"] + last["size"]
    ok = F.col("error_code").isNull()
    return (
        rows.withColumn("error_code", code)
        .withColumn("ok", ok)
        .withColumn("cleaned_token_count", n_c)
        .withColumn("raw_token_count", n_r)
        .withColumn("matched_token_count", F.when(ok, matched).otherwise(0))
        .withColumn("cutoff_token_count", F.when(ok, end))
        .withColumn("cutoff_line", F.when(ok, F.try_element_at("_r", end)["line"]))
        .withColumn("confidence", F.when(ok, matched / n_c))
        .withColumnRenamed("least", "min_cleaned_token_requirement")
        .drop("_c", "_r", "_b", "_early")
    )


def alignment_errors(aligned: DataFrame) -> Column:
    """The error messages of an aligned row, in order."""
    c, r, least = F.col("cleaned_token_count"), F.col("raw_token_count"), F.col("min_cleaned_token_requirement")
    floor_ = F.greatest(F.lit(1), F.floor(r * LEAST_SHARE).cast("int"))
    # The messages.
    failed = (
        F.when(F.col("error_code") == "raw_has_no_content_tokens", F.lit("Alignment failed: raw batch has 0 alignable content tokens."))
        .when(F.col("error_code") == "cleaned_too_short_for_alignment", F.format_string(
            "Alignment failed: cleaned text has %d content tokens, minimum required is %d (derived from raw content token count=%d).", c, least, r))
        .when(F.col("error_code") == "no_token_overlap", F.format_string(
            "Alignment failed: no token overlap between cleaned and raw content (cleaned content tokens=%d, raw content tokens=%d).", c, r))
    )
    unsure = F.when(low_confidence(), F.format_string(
        "Alignment confidence check failed: confidence=%.3f is below the required minimum 0.600 (matched_content_tokens=%d, "
        "cleaned_content_tokens=%d, inferred_cutoff_batch_line=%d).",
        F.col("confidence"), F.col("matched_token_count"), c, F.col("cutoff_line")))
    early = F.when(early_cutoff(), F.format_string(
        "Cutoff position check failed: inferred cutoff lands at content token %d, but minimum allowed is %d (20%% of raw content "
        "tokens=%d). This usually means the submission stops too early in the batch.", F.col("cutoff_token_count"), floor_, r))  # fmt: skip
    return F.array_compact(F.array(failed, unsure, early))


def low_confidence() -> Column:
    return F.coalesce(F.col("confidence") < LEAST_CONFIDENCE, F.lit(False))


def early_cutoff() -> Column:
    least = F.greatest(F.lit(1), F.floor(F.col("raw_token_count") * LEAST_SHARE).cast("int"))
    return F.coalesce(F.col("cutoff_token_count") < least, F.lit(False))


def raw_context(raw: Column, cutoff_line: Column) -> Column:
    """Five raw lines up to the cutoff and two behind it."""
    lines = split_lines(raw)
    first = F.greatest(F.lit(0), cutoff_line - 5)
    return F.slice(lines, first + 1, F.greatest(F.lit(0), F.least(F.size(lines), cutoff_line + 2) - first))


def clean_tail(cleaned: Column, n: int = 5) -> Column:
    lines = split_lines(cleaned)
    return F.slice(lines, F.greatest(F.lit(1), F.size(lines) - n + 1), n)


