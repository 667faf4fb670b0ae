"""Merging overlapping closed intervals into periods and listing the gaps between them.

Plan, for ``keys`` = the entity the intervals belong to:

1. ``max(hi)`` per (keys, lo). The hash aggregate combines before its shuffle, so a key that holds a
   third of all rows is reduced where it is read; afterwards an entity has one row per start.
2. ``session_window`` per (keys, block of starts): an interval is a session that starts at ``lo`` and lasts
   ``hi - lo + 1`` seconds, so Spark's own session merge joins what overlaps, streaming over sorted rows.
   Blocks of starts keep one long entity from becoming one task.
   The sessions are written once, so the table itself is read once.
3. Per block, its largest end is carried into the blocks after it (a window over one row per block).
4. A session opens a period when it starts beyond everything before it plus one (touching sessions join).
   The end of a period is what precedes the next opening, found with ``lead`` in the block and, for its last
   opening, with one row per block. The openings are written once too, as both look at them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtree.checkpoints import checkpointed

#: Line numbers that start in one block share a task.
BLOCK = 1 << 16


def _usable(df: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Only the named columns, renamed so that no extra column can clash; unusable intervals own nothing."""
    cols = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    out = df.select(*cols, F.col(f"`{lo}`").cast("long").alias("lo"), F.col(f"`{hi}`").cast("long").alias("hi"))
    ok = F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("lo") <= F.col("hi"))
    return out.where(ok)


def merge_intervals(
    df: DataFrame, keys: Sequence[str], lo: str, hi: str, *, block: int = BLOCK, skip_null_keys: bool = True
) -> DataFrame:
    """Periods and gaps of closed integer intervals: keys..., kind ('period' or 'gap'), lo, hi.

    Defined results: a null bound or lo > hi owns nothing; a null key drops the row unless
    ``skip_null_keys`` is false, when nulls form their own entity; repeated rows and ties change nothing;
    touching intervals (hi + 1 = lo) are one period; an empty table gives no rows; other columns are ignored.
    Bounds must lie within +-2**40. Writes sessions and openings when called.
    """
    n, nulls = [f"k{i}" for i in range(len(keys))], not skip_null_keys
    rows = _usable(df, keys, lo, hi)
    if skip_null_keys:
        rows = rows.dropna(subset=n)
    starts = rows.groupBy(*n, "lo").agg(F.max("hi").alias("hi"))
    starts = starts.withColumn("block", F.floor(F.col("lo") / F.lit(block)).cast("long"))
    as_time = F.timestamp_seconds(F.col("lo"))
    duration = F.concat((F.col("hi") - F.col("lo") + 1).cast("string"), F.lit(" seconds"))
    sessions = checkpointed(
        starts.withColumn("at", as_time)
        .groupBy(*n, "block", F.session_window("at", duration).alias("w"))
        .agg(F.max("hi").alias("hi"))
        .select(*n, "block", F.unix_seconds("w.start").alias("lo"), "hi")
    )
    entity, inside = W.partitionBy(*n), W.partitionBy(*n, "block").orderBy("lo")
    ends = sessions.groupBy(*n, "block").agg(F.max("hi").alias("top"))
    carried = ends.select(
        *n,
        "block",
        F.max("top").over(entity.orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("before"),
        F.max("top").over(entity.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("end"),
    )
    seen = sessions.withColumn("so_far", F.max("hi").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    joined = _meet(seen, carried, [*n, "block"], nulls)
    reach = F.greatest("before", "so_far")
    opened = joined.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("lo") > F.col("reach") + 1))
    # The reach before the next opening is where this period ends; the last opening of a block asks later blocks.
    opened = checkpointed(opened.select(*n, "block", "lo", "reach", "end", F.lead("reach").over(inside).alias("end_here")))
    first_open = opened.groupBy(*n, "block").agg(F.min_by("reach", "lo").alias("first_reach"))
    # looking ahead is looking back in falling order: a frame that only grows is evaluated in one pass
    ahead = entity.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    later = first_open.select(*n, "block", F.last("first_reach", ignorenulls=True).over(ahead).alias("end_later"))
    periods = _meet(opened, later, [*n, "block"], nulls).withColumn("hi", F.coalesce("end_here", "end_later", "end"))
    gap = F.struct(F.lit("gap").alias("kind"), (F.col("reach") + 1).alias("lo"), (F.col("lo") - 1).alias("hi"))
    period = F.struct(F.lit("period").alias("kind"), F.col("lo"), F.col("hi"))
    both = F.when(F.col("reach").isNull(), F.array(period)).otherwise(F.array(period, gap))
    flat = periods.select(*n, F.explode(both).alias("r"))
    return flat.select(*[F.col(a).alias(k) for a, k in zip(n, keys)], "r.kind", "r.lo", "r.hi")


def _meet(left: DataFrame, right: DataFrame, on: Sequence[str], nulls: bool) -> DataFrame:
    """Equi-join that keeps one copy of the key columns and lets null keys meet if there may be ``nulls``; a plain
    equality, unlike a null-safe one, finds both sides already partitioned by the keys."""
    right = right.select(*[F.col(c).alias(f"r_{c}") if c in on else F.col(c) for c in right.columns])
    cond: Column | None = None
    for c in on:
        test = F.col(c).eqNullSafe(F.col(f"r_{c}")) if nulls else F.col(c) == F.col(f"r_{c}")
        cond = test if cond is None else cond & test
    return left.join(right, cond).drop(*[f"r_{c}" for c in on])


def owned_lines(spans: DataFrame) -> DataFrame:
    """Periods and gaps of the lines owned per (run_id, chunk_number) of a content_spans table."""
    out = merge_intervals(spans, ["run_id", "chunk_number"], "first_line", "last_line")
    return out.select(
        "run_id",
        "chunk_number",
        "kind",
        F.col("lo").cast("int").alias("first_line"),
        F.col("hi").cast("int").alias("last_line"),
    )
