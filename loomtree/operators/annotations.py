"""Annotation headers and cutoff markers of lines, as ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtree.functions.patterns import ATTRIBUTE, CUTOFF, HEADER, NODE_TYPES, SPACE
from loomtree.operators.lines import split_lines


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def is_header(line: Column) -> Column:
    return line.contains("@") & line.rlike(HEADER)


def is_cutoff(line: Column) -> Column:
    return line.contains("cutoff") & line.rlike(CUTOFF)


def header_depth(line: Column) -> Column:
    """Number of dashes of a header line, null for other lines."""
    return F.when(is_header(line), F.length(F.regexp_extract(line, HEADER, 1)))


def _unquoted(value: Column) -> Column:
    """Without one pair of double quotes; a lone one is both its ends."""
    quoted = value.startswith('"') & value.endswith('"')
    return F.when(quoted, F.substr(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0)))).otherwise(value)


def attribute_map(header: Column) -> Column:
    """key=value pairs of a header's rest; of repeated keys the last counts."""
    none = F.array().cast("array<string>")

    def add(seen: Column, pair: Column) -> Column:
        key, value = F.regexp_extract(pair, ATTRIBUTE, 1), F.regexp_extract(pair, ATTRIBUTE, 2)
        return F.map_concat(F.map_filter(seen, lambda k, _: k != key), F.create_map(key, _unquoted(strip(value))))

    return F.aggregate(F.regexp_extract_all(header, F.lit(ATTRIBUTE), F.lit(0)), F.map_from_arrays(none, none), add)


def dependency_list(value: Column) -> Column:
    """Ids of a bracketed, comma-separated list, without quotes and empty ones; null gives none."""
    text = strip(value)
    inner = F.when(
        text.startswith("[") & text.endswith("]"), F.substr(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))
    ).otherwise(text)
    parts = F.transform(
        F.split(inner, ","), lambda x: F.btrim(F.btrim(strip(x), F.lit('"')), F.lit("'"))
    )
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def cutoff_lines(lines: DataFrame) -> DataFrame:
    """(doc, chunk, cutoff_line): the first cutoff marker of each text that has one."""
    marked = lines.where(is_cutoff(F.col("line")))
    return marked.groupBy("doc", "chunk").agg(F.min("line_no").alias("cutoff_line"))


def before_cutoff(lines: DataFrame) -> DataFrame:
    """Lines with ``cutoff_line`` (null where there is none), those behind it left out."""
    part = W.partitionBy("doc", "chunk")
    marked = lines.withColumn("cutoff_line", F.min(F.when(is_cutoff(F.col("line")), F.col("line_no"))).over(part))
    return marked.where(F.col("cutoff_line").isNull() | (F.col("line_no") <= F.col("cutoff_line")))


def parse_events(lines: DataFrame) -> DataFrame:
    """(doc, chunk, line_no, event_type, id, depth, title, node_type, proves, deps) of all headers with an id and of the
    cutoff that ends a text's events. A header without an id is no event."""
    rows = before_cutoff(lines.where(is_header(F.col("line")) | is_cutoff(F.col("line"))))  # only these are shuffled
    rows = rows.withColumn("is_cut", F.coalesce(F.col("line_no") == F.col("cutoff_line"), F.lit(False)))
    attrs = F.when(~F.col("is_cut"), attribute_map(F.regexp_extract("line", HEADER, 2)))
    # explode of one element keeps the map from being computed again for every attribute
    rows = rows.select("*", F.explode(F.array(attrs)).alias("attrs")).where(F.col("is_cut") | (F.coalesce(F.col("attrs")["id"], F.lit("")) != ""))
    return rows.select(
        "doc",
        "chunk",
        "line_no",
        F.when(F.col("is_cut"), "cutoff").otherwise("header").alias("event_type"),
        F.coalesce(F.col("attrs")["id"], F.lit("")).alias("id"),
        F.coalesce(header_depth(F.when(~F.col("is_cut"), F.col("line"))), F.lit(0)).alias("depth"),
        F.col("attrs")["title"].alias("title"),
        F.col("attrs")["type"].alias("node_type"),
        F.col("attrs")["proves"].alias("proves"),
        F.coalesce(dependency_list(F.col("attrs")["deps"]), F.array().cast("array<string>")).alias("deps"),
    )


def header_array(text: Column) -> Column:
    """The headers of one text in order, defaults filled in: array of (line_no, id, title, node_type, depth).

    ``parse_events`` for a single row: nothing is shuffled and no window is needed, so a stream can use it too.
    """
    numbered = F.transform(split_lines(text), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    marked = F.filter(numbered, lambda x: is_header(x["line"]) | is_cutoff(x["line"]))
    cuts = F.transform(F.filter(marked, lambda x: is_cutoff(x["line"])), lambda x: x["n"])
    heads = F.filter(marked, lambda x: is_header(x["line"]) & (F.array_min(cuts).isNull() | (x["n"] < F.array_min(cuts))))
    read = F.transform(heads, lambda x: F.struct(
        x["n"].alias("n"), header_depth(x["line"]).alias("depth"), attribute_map(F.regexp_extract(x["line"], HEADER, 2)).alias("given")
    ))
    kept = F.filter(read, lambda x: F.coalesce(x["given"]["id"], F.lit("")) != "")
    return F.transform(kept, lambda x: F.struct(
        x["n"].alias("line_no"), x["given"]["id"].alias("id"), title_of(x["given"]["title"], x["given"]["id"]).alias("title"),
        node_type_of(x["given"]["type"]).alias("node_type"), declared_depth(x["depth"]).alias("depth"),
    ))


def node_type_of(value: Column) -> Column:
    """Unknown and missing types count as 'generic'."""
    return F.when(value.isin(NODE_TYPES), value).otherwise(F.lit("generic"))


def title_of(title: Column, ident: Column) -> Column:
    """A missing or empty title is the id."""
    return F.coalesce(F.nullif(title, F.lit("")), ident)


def declared_depth(depth: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(depth, F.lit(1)))


def stored_events(events: DataFrame) -> DataFrame:
    """A table of events (annotation_events) in the same shape, rows delivered twice once; a chunk's events end at its
    first cutoff. One shuffle by chunk serves the removal of repeats and all that looks at a chunk later."""
    once = events.select(
        F.col("run_id").alias("doc"), F.col("chunk_number").alias("chunk"), F.col("line_number").alias("line_no"), "event_id",
        "event_type", F.coalesce("id", F.lit("")).alias("id"), F.coalesce("depth", F.lit(0)).alias("depth"), "title", "node_type",
        "proves", "deps",
    ).repartition("doc", "chunk").distinct()
    part = W.partitionBy("doc", "chunk")
    cut = F.min(F.when(F.col("event_type") == "cutoff", F.col("line_no"))).over(part)
    kept = once.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col("line_no") <= F.col("_cut"))).drop("_cut")
    return kept.where((F.col("event_type") == "cutoff") | (F.col("id") != ""))
