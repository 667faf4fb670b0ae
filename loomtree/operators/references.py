"""References to records that are missing, come later or were deleted.

1. Every header's ``deps`` and ``proves`` become (event, field, target) references, distinct per event.
2. Parents are reduced, with partial aggregation, to one row per (run_id, id): the earliest place of its header and the
   earliest chunk of its removal. They are written once, counted, and a Bloom filter sized by their number is made.
3. References that the filter rejects are definite orphans. A filter of ``bloom.BROADCAST_BYTES`` at most is broadcast, and
   what it rejects is never shuffled; a larger one, split by hash, meets the references in a join of its own.
4. The rest meets the parents in one exact join on (run_id, id). A hot target is split by adaptive skew join, as nothing
   is aggregated between the shuffle and the join.
5. Events delivered twice give equal results, so the few rows that remain are made distinct, not the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtree.checkpoints import checkpointed
from loomtree.functions.bloom import bloom_table, n_rows, with_maybe


def _key(run: str, ident: str) -> Column:
    return F.xxhash64(F.col(run), F.col(ident))


def references(events: DataFrame) -> DataFrame:
    """(event_id, run_id, chunk_number, line_number, received_at, field, target_id), distinct within an event."""
    none = F.array().cast("array<string>")
    targets = F.array_distinct(F.coalesce(F.col("deps"), none))
    targets = F.filter(targets, lambda x: x.isNotNull() & (x != ""))
    deps = F.transform(targets, lambda x: F.struct(F.lit("deps").alias("field"), x.alias("target_id")))
    named = F.col("proves").isNotNull() & (F.col("proves") != "")
    one = F.struct(F.lit("proves").alias("field"), F.col("proves").alias("target_id"))
    proves = F.when(named, F.array(one)).otherwise(F.array().cast("array<struct<field:string,target_id:string>>"))
    return (
        events.where(F.col("event_type") == "header")
        .select("event_id", "run_id", "chunk_number", "line_number", "received_at", F.concat(deps, proves).alias("refs"))
        .where(F.size("refs") > 0)
        .select("event_id", "run_id", "chunk_number", "line_number", "received_at", F.explode("refs").alias("r"))
        .select("event_id", "run_id", "chunk_number", "line_number", "received_at", "r.field", "r.target_id")
    )


def parents(events: DataFrame, removals: DataFrame) -> DataFrame:
    """One row per (run_id, id): place (chunk, line) of its earliest header, null if only removed; earliest removal."""
    headers = events.where((F.col("event_type") == "header") & F.col("id").isNotNull() & F.col("run_id").isNotNull())
    headers = headers.select(
        F.col("run_id").alias("p_run"),
        F.col("id").alias("p_id"),
        F.struct(F.col("chunk_number").alias("c"), F.col("line_number").alias("l")).alias("place"),
        F.lit(None).cast("int").alias("gone"),
    )
    removed = removals.where(F.col("node_id").isNotNull() & F.col("run_id").isNotNull()).select(
        F.col("run_id").alias("p_run"),
        F.col("node_id").alias("p_id"),
        F.lit(None).cast(headers.schema["place"].dataType).alias("place"),
        F.col("removed_in_chunk").cast("int").alias("gone"),
    )
    return headers.unionByName(removed).groupBy("p_run", "p_id").agg(
        F.min("place").alias("place"), F.min("gone").alias("gone")
    )


def filtered_references(events: DataFrame, known: DataFrame, *, rows: int | None = None) -> DataFrame:
    """References with ``maybe``: false where the filter of ``known`` parents proves that no header has the id.

    ``rows``: size of the filter in rows of ``bloom.ROW`` words, by the number of parents if not given.
    """
    refs, heads = references(events), known.where(F.col("place").isNotNull())
    rows = n_rows(heads.count()) if rows is None else rows
    hashed = F.when(F.col("run_id").isNotNull(), _key("run_id", "target_id"))
    return with_maybe(refs, bloom_table(heads, _key("p_run", "p_id"), rows), hashed, rows)


def orphan_references(events: DataFrame, removals: DataFrame, *, rows: int | None = None) -> DataFrame:
    """(event_id, run_id, received_at, field, target_id, reason), reason in 'missing', 'late', 'deleted'.

    Defined results: null or empty targets, null deps and null proves refer to nothing; a reference of an event
    with a null run_id is 'missing'; a header with a null id is no parent; a null place sorts before all others and
    a null chunk never counts as after a removal; repeated rows, repeated targets and ties count once; empty tables
    give no rows, or only 'missing' where there are no headers; other columns are ignored. Writes the parents when called.
    """
    right = checkpointed(parents(events, removals))
    tested = filtered_references(events, right, rows=rows)
    keep = ["event_id", "run_id", "received_at", "field", "target_id"]
    certain = tested.where(~F.col("maybe")).select(*keep, F.lit("missing").alias("reason"))
    left = tested.where(F.col("maybe"))
    here = F.struct(F.col("chunk_number").alias("c"), F.col("line_number").alias("l"))
    reason = (
        F.when(F.col("place").isNull(), "missing")
        .when(F.col("place") > here, "late")
        .when(F.col("gone") <= F.col("chunk_number"), "deleted")
    )
    on = (F.col("run_id") == F.col("p_run")) & (F.col("target_id") == F.col("p_id"))
    checked = left.join(right, on, "left").select(*keep, reason.alias("reason")).where(F.col("reason").isNotNull())
    return certain.unionByName(checked).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references counted per field, run, month of arrival and reason."""
    month = F.date_format(F.date_trunc("month", "received_at"), "yyyy-MM")
    return (
        orphans.groupBy("field", "run_id", month.alias("month"), "reason")
        .agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("event_id").alias("n_events"))
    )
