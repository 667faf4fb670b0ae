"""Validation of header events: errors block a batch, warnings do not.

All checks are frames of (doc, chunk, line_no, severity, code, message, pos); pos orders what one check says about one
line. Each is an operator of its own, and ``validate`` gives all of them from two looks at the headers. Ids known from earlier
chunks and ids seen earlier in the chunk are one rule: an id's first place in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtree.functions.patterns import NODE_TYPES, PROVEABLE_TYPES
from loomtree.operators.annotations import is_cutoff, strip

# Fixed value: the message for text before a document's first header.
LEADING = "Batch starts with content before the first node header. Start the document with a depth-1 header like '@ - id=...'."


def _place(df: DataFrame) -> Column:
    parts = ["chunk", "line_no", *(["event_id"] if "event_id" in df.columns else [])]
    return F.struct(*parts)


def _issue(df: DataFrame, severity: str, code: str, message: Column) -> DataFrame:
    pos = F.col("pos") if "pos" in df.columns else F.lit(0)
    return df.select(
        "doc", "chunk", "line_no", F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"), pos.alias("pos")
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _line(*rest: Column | str) -> Column:
    return _text("Line ", F.col("line_no").cast("string"), ": ", *rest)


def headers(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "header").withColumn("place", _place(events))


def first_places(heads: DataFrame) -> DataFrame:
    """(doc, id, first_place): where each id stands first; combined before the shuffle, so a hot id is no burden."""
    return heads.groupBy("doc", "id").agg(F.min("place").alias("first_place"))


def leading_content(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Text before the first header, in chunks before which the document has no node."""
    marked = lines.withColumn("s", strip(F.col("line"))).withColumn("cut", is_cutoff(F.col("line")))
    per = marked.groupBy("doc", "chunk").agg(
        F.min(F.when(F.col("cut"), F.col("line_no"))).alias("cut_at"),
        F.min(F.when(~F.col("cut") & (F.col("s") != ""), F.struct("line_no", "s"))).alias("first"),
    )
    first_chunk = heads.groupBy("doc").agg(F.min("chunk").alias("first_chunk"))
    bad = per.join(first_chunk, "doc", "left").where(
        (F.col("first_chunk").isNull() | (F.col("chunk") <= F.col("first_chunk")))
        & F.col("first").isNotNull()
        & (F.col("cut_at").isNull() | (F.col("first.line_no") < F.col("cut_at")))
        & ~F.col("first.s").startswith("@")
    )
    return _issue(bad.withColumn("line_no", F.col("first.line_no")), "error", "leading_content", F.lit(LEADING))


def duplicate_ids(heads: DataFrame) -> DataFrame:
    later = heads.join(first_places(heads), ["doc", "id"]).where(F.col("place") > F.col("first_place"))
    return _issue(later, "error", "duplicate_id", _line("duplicate id '", F.col("id"), "'"))


def unknown_types(heads: DataFrame) -> DataFrame:
    bad = heads.where(F.col("node_type").isNotNull() & ~F.col("node_type").isin(NODE_TYPES))
    return _issue(bad, "warning", "unknown_type", _line("unknown type '", F.col("node_type"), "' on node '", F.col("id"), "'"))


def _proves(heads: DataFrame) -> Column:
    return F.coalesce(F.col("proves"), F.lit("")) != ""


def proves_on_non_proof(heads: DataFrame) -> DataFrame:
    bad = heads.where(_proves(heads) & ~F.col("node_type").eqNullSafe("proof"))
    return _issue(bad, "warning", "proves_on_non_proof", _line("non-proof node '", F.col("id"), "' has proves='", F.col("proves"), "'"))


def proof_without_proves(heads: DataFrame) -> DataFrame:
    bad = heads.where((F.col("node_type") == "proof") & ~_proves(heads))
    return _issue(bad, "warning", "proof_without_proves", _line("proof node '", F.col("id"), "' missing proves attribute"))


def proves_bad_target(heads: DataFrame) -> DataFrame:
    """The target is the latest header of the same chunk with that id at or before the proof; untyped ones pass.

    Each header stands once for its own id and once, after that, for the id it proves: the latest type is then a running
    last value, whatever number of headers have one id.
    """
    kind = F.struct(F.col("node_type").alias("t"))
    own = F.struct(F.col("id").alias("key"), F.lit(0).alias("asks"), kind.alias("kind"))
    asked = F.struct(F.col("proves").alias("key"), F.lit(1).alias("asks"), F.lit(None).cast("struct<t:string>").alias("kind"))
    rows = heads.select("doc", "chunk", "line_no", "place", "id", "proves", F.explode(F.when(_proves(heads), F.array(own, asked)).otherwise(F.array(own))).alias("r"))
    so_far = W.partitionBy("doc", "chunk", "r.key").orderBy("place", "r.asks").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("kind", F.last("r.kind", ignorenulls=True).over(so_far)).where(F.col("r.asks") == 1)
    bad = found.where(F.col("kind.t").isNotNull() & ~F.col("kind.t").isin(PROVEABLE_TYPES))
    listed = "[" + ", ".join(f"'{t}'" for t in PROVEABLE_TYPES) + "]"
    message = _line("proves='", F.col("proves"), "' targets type '", F.col("kind.t"), f"', expected one of {listed}")
    return _issue(bad, "warning", "proves_bad_target", message)


def missing_dependencies(heads: DataFrame) -> DataFrame:
    """Dependencies on ids that stand nowhere at or before the header."""
    asked = heads.select("doc", "chunk", "line_no", "place", "id", F.posexplode("deps").alias("pos", "dep")).where(
        F.col("dep").isNotNull() & (F.col("dep") != "")
    )
    known = first_places(heads).select(F.col("doc").alias("k_doc"), F.col("id").alias("k_id"), "first_place")
    on = (F.col("doc") == F.col("k_doc")) & (F.col("dep") == F.col("k_id")) & (F.col("first_place") <= F.col("place"))
    missing = asked.join(known, on, "left_anti")
    return _issue(missing, "warning", "missing_dependency", _line("dependency '", F.col("dep"), "' on node '", F.col("id"), "' not found"))


def _by_id(heads: DataFrame) -> DataFrame:
    """All issues that need at most the first place of one id, in one join: what a header says about itself travels with
    its own id, what it says about a dependency with that."""
    said = {
        "unknown_type": (F.col("node_type").isNotNull() & ~F.col("node_type").isin(NODE_TYPES), _line("unknown type '", F.col("node_type"), "' on node '", F.col("id"), "'")),
        "proves_on_non_proof": (_proves(heads) & ~F.col("node_type").eqNullSafe("proof"), _line("non-proof node '", F.col("id"), "' has proves='", F.col("proves"), "'")),
        "proof_without_proves": ((F.col("node_type") == "proof") & ~_proves(heads), _line("proof node '", F.col("id"), "' missing proves attribute")),
    }

    def ask(key: Column, code: Column | str, message: Column, pos: Column) -> Column:
        return F.struct(key.alias("key"), (F.lit(code) if isinstance(code, str) else code).alias("code"), message.alias("message"), pos.alias("pos"))

    zero = F.lit(0)
    own = [ask(F.col("id"), "duplicate_id", _line("duplicate id '", F.col("id"), "'"), zero)]
    alone = [F.when(cond, ask(F.col("id"), code, message, zero)) for code, (cond, message) in said.items()]
    deps = F.transform("deps", lambda x, i: F.when(
        x.isNotNull() & (x != ""), ask(x, "missing_dependency", _line("dependency '", x, "' on node '", F.col("id"), "' not found"), i)
    ))
    every = F.array_compact(F.concat(F.array(*own, *alone), F.coalesce(deps, F.array().cast(heads.select(deps.alias("d")).schema["d"].dataType))))
    rows = heads.select("doc", "chunk", "line_no", "place", F.explode(every).alias("a")).select("doc", "chunk", "line_no", "place", "a.*")
    firsts = first_places(heads).select(F.col("doc").alias("k_doc"), F.col("id").alias("key"), "first_place")
    met = rows.join(firsts.withColumnRenamed("key", "k_id"), (F.col("doc") == F.col("k_doc")) & (F.col("key") == F.col("k_id")), "left")
    later = F.col("place") > F.col("first_place")
    absent = F.col("first_place").isNull() | (F.col("first_place") > F.col("place"))
    kept = F.when(F.col("code") == "duplicate_id", later).when(F.col("code") == "missing_dependency", absent).otherwise(True)
    severity = F.when(F.col("code") == "duplicate_id", "error").otherwise("warning")
    return met.where(F.coalesce(kept, F.lit(False))).select("doc", "chunk", "line_no", severity.alias("severity"), "code", "message", "pos")


def validate(events: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """All issues of a set of documents; ``lines`` adds the check for leading text."""
    heads = headers(events)
    out = _by_id(heads).unionByName(proves_bad_target(heads))
    return out if lines is None else out.unionByName(leading_content(lines, heads))


def known_ids(events: DataFrame) -> DataFrame:
    """(doc, id, chunk, line_no): each id with the place at which it is registered. What a chunk finds registered are the
    ids of smaller chunks, in order of their places, so no list need be kept per chunk."""
    first = first_places(headers(events))
    return first.select("doc", "id", F.col("first_place.chunk").alias("chunk"), F.col("first_place.line_no").alias("line_no"))


def known_id_counts(events: DataFrame) -> DataFrame:
    """(doc, chunk, n_known, n_new): how many ids a chunk finds registered and how many it adds, without listing them."""
    heads = headers(events)
    new = heads.groupBy("doc", "id").agg(F.min("chunk").alias("chunk")).groupBy("doc", "chunk").agg(F.count(F.lit(1)).alias("n_new"))
    every = events.select("doc", "chunk").distinct().join(new, ["doc", "chunk"], "left")
    earlier = W.partitionBy("doc").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    n = F.coalesce("n_new", F.lit(0))
    return every.select("doc", "chunk", F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("n_known"), n.alias("n_new"))


def token_size_warning(cleaned_tokens: Column, target: Column) -> Column:
    """The warning about too short a cleaned text, null if it is long enough."""
    hard = F.greatest(F.lit(1), F.floor(target * 0.4).cast("int"))
    said = "Cleaned text is ~%d tokens, %s minimum is ~%d tokens (%s warning)."
    return F.when(
        cleaned_tokens < hard, F.format_string(said, cleaned_tokens, F.lit("hard"), hard, F.lit("hard"))
    ).when(cleaned_tokens < target, F.format_string(said, cleaned_tokens, F.lit("suggested"), target, F.lit("soft")))


def batch_validity(issues: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc, chunk, n_errors, n_warnings, valid) of every chunk; counted before the shuffle."""
    every = chunks.select("doc", "chunk", F.lit("none").alias("severity")).unionByName(issues.select("doc", "chunk", "severity"))
    per = every.groupBy("doc", "chunk").agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"),
        F.count_if(F.col("severity") == "none").alias("n"),
    )
    return per.where("n > 0").select("doc", "chunk", "n_errors", "n_warnings", (F.col("n_errors") == 0).alias("valid"))
