"""Texts of varying length packed into containers of fixed capacity.

Every text is a vector (tokens, segments, loss-bearing tokens) and a container has a limit on each. Texts over a
limit are the only ones split: pieces that fill a container are containers of their own, the rest is packed.

Packing is the dot-product heuristic of vector bin packing: the open container takes, among the items that fit in every
dimension, the one whose vector has the largest weighted dot product with the space left, until none fits. Items of one
size are interchangeable, so the choice is made among the distinct sizes with numpy.

Scale: a text is tokenized where it is read and leaves as a few numbers, which are written once. Those that need packing,
however many pieces a text gives, are counted and spread by hash over blocks of about ``BLOCK_ITEMS`` items, one task
each; a block wastes less than one container more than the whole would. Nothing depends on a key's frequency.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtree.checkpoints import checkpointed
from loomtree.llm import tokens
from loomtree.llm.arrow import emit, schema
from loomtree.session import ship

CAPACITY, SEGMENTS = 2048, 64
#: Items per block: bounds the memory of a task (some 5 MB) and its time (about a second).
BLOCK_ITEMS = 40_000
#: Tasks at most: with more blocks a task packs several, one after the other.
MOST_TASKS = 10_000

SIZES = "doc_id bigint,piece_no int,start_token bigint,n_tokens int,loss_tokens int"
PACKED = "container_id bigint,position int,doc_id bigint,piece_no int,start_token bigint,n_tokens int,loss_tokens int"


def markup(text: str) -> str:
    """The part of a text that bears no loss: its annotation header lines."""
    if not text.startswith("@ ") and "\n@ " not in text:
        return ""
    return "\n".join(line for line in text.split("\n") if line.startswith("@ "))


def sizes(
    docs: DataFrame, *, capacity: int = CAPACITY, loss_capacity: int | None = None, path: str = tokens.RANKS,
    no_loss: Callable[[str], str] = markup,
) -> DataFrame:
    """Items: see SIZES. Texts over a limit give full pieces and a rest; null and empty texts one item of 0."""
    name = tokens.shipped(ship(docs.sparkSession), path)
    to, most_loss = schema(SIZES), capacity if loss_capacity is None else loss_capacity

    def rows(batches) -> Iterator[tuple]:
        encode = tokens.encoding(name).encode_ordinary
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(encode(text)) if text else 0
                quiet = no_loss(text) if text else ""
                loss = max(0, n - len(encode(quiet))) if quiet else n
                step = capacity if not n or -(-loss * min(n, capacity) // n) <= most_loss else min(capacity, most_loss)
                for piece, start in enumerate(range(0, max(n, 1), step)):
                    size = min(step, n - start)
                    yield doc, piece, start, size, min(size, -(-loss * size // n) if n else 0)

    return docs.select("doc_id", "text").mapInArrow(lambda batches: emit(rows(batches), to), SIZES)


def pack(
    size: np.ndarray, loss: np.ndarray, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_capacity: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Container and position of each item, given in the order in which equal ones are taken."""
    loss_capacity = capacity if loss_capacity is None else loss_capacity
    if len(size) and (size.max() > capacity or loss.max() > loss_capacity or segments < 1):
        raise ValueError("an item exceeds a limit")
    order = np.lexsort((np.arange(len(size)), loss, size))[::-1]
    kinds, first, left = np.unique(
        np.stack([-size[order], -loss[order]], 1), axis=0, return_index=True, return_counts=True
    ) if len(size) else (np.zeros((0, 2), int), np.zeros(0, int), np.zeros(0, int))
    t, q, left, taken = -kinds[:, 0], -kinds[:, 1], left.copy(), np.zeros(len(kinds), int)
    container, position = np.zeros(len(size), np.int64), np.zeros(len(size), np.int32)
    # Weights make the dimensions comparable: the share of all containers that each needs at the least.
    need = np.array([size.sum() / capacity, len(size) / segments, loss.sum() / loss_capacity]) if len(size) else np.zeros(3)
    weight = need / max(need.sum(), 1e-9)
    a, c = t / capacity * weight[0], q / loss_capacity * weight[2]
    now, remaining, tokens_left, loss_left = 0, len(size), int(size.sum()), int(loss.sum())
    small = t * segments < capacity  # so small that full slots leave a container unfilled
    small_left = int(left[small].sum())
    while remaining:
        room, slots, quiet = capacity, segments, loss_capacity
        # a share of the small ones goes into each container still needed, lest they be left among themselves at the end
        share = int(-(-small_left // max(1.0, tokens_left / capacity, remaining / segments, loss_left / loss_capacity)))
        while slots:
            k0 = int(np.searchsorted(-t, -room, "left"))  # sizes fall: only these fit by tokens
            if k0 == len(t):
                break
            fits = (left[k0:] > 0) & (q[k0:] <= quiet)
            if segments - slots < share and (fits & small[k0:]).any():
                fits &= small[k0:]
            score = a[k0:] * (room / capacity) + c[k0:] * (quiet / loss_capacity)
            k = int(np.argmax(np.where(fits, score, -1.0)))
            if not fits[k]:
                break
            k += k0
            item = order[first[k] + taken[k]]
            container[item], position[item] = now, segments - slots
            taken[k] += 1
            left[k] -= 1
            small_left -= bool(small[k])
            room, slots, quiet, remaining = room - t[k], slots - 1, quiet - q[k], remaining - 1
        tokens_left, loss_left = tokens_left - (capacity - room), loss_left - (loss_capacity - quiet)
        now += 1
        if now % 1024 == 0:  # forget sizes that are used up
            keep = left > 0
            t, q, a, c, left, taken, first, small = (x[keep] for x in (t, q, a, c, left, taken, first, small))
    return container, position


def packed(
    docs: DataFrame, *, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_capacity: int | None = None,
    path: str = tokens.RANKS, no_loss: Callable[[str], str] = markup, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Every document's items with their container: see PACKED.

    Defined results: a container never exceeds a limit; only texts over a limit have several pieces; null
    and empty texts need no space and have a null container; of repeated rows each is packed, as each is a text;
    empty tables give no rows; ties are broken by doc_id; other columns are ignored. Containers of one piece that fills
    them have negative ids. Tokenizes and counts when called.
    """
    to = schema(PACKED)
    items = checkpointed(sizes(docs, capacity=capacity, loss_capacity=loss_capacity, path=path, no_loss=no_loss))
    fills, empty = F.col("n_tokens") == capacity, F.col("n_tokens") == 0
    rest = items.where(~fills & ~empty)
    blocks = max(1, -(-rest.count() // block_items))
    # a partition holds whole blocks, one if they are not very many, and adaptive execution leaves it alone
    block = F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(blocks)).cast("int")
    rest = rest.withColumn("block", block).repartitionById(min(blocks, MOST_TASKS), F.col("block"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece_no", "ascending")])
        size, loss = (table.column(c).to_numpy().astype(np.int64) for c in ("n_tokens", "loss_tokens"))
        container, position = pack(size, loss, capacity, segments, loss_capacity)
        base = int(table.column("block")[0].as_py()) << 32
        out = {c: table.column(c) for c in ("doc_id", "piece_no", "start_token", "n_tokens", "loss_tokens")}
        out["container_id"] = pa.array(container + base, pa.int64())
        out["position"] = pa.array(position, pa.int32())
        return pa.table([out[f.name] for f in to], schema=to)

    names = [f.name for f in to]
    # items are read from where they were written, so a task that is run again numbers them the same
    own = items.where(fills | empty).withColumn("container_id", F.when(fills, -1 - F.monotonically_increasing_id()))
    alone = own.withColumn("position", F.when(fills, F.lit(0))).select(names)
    return rest.groupBy("block").applyInArrow(run, PACKED).unionByName(alone)


def containers(placed: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """One row per container: its texts, tokens and unused space."""
    used = placed.where(F.col("container_id").isNotNull()).groupBy("container_id")
    out = used.agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("n_tokens").alias("n_tokens"), F.sum("loss_tokens").alias("loss_tokens")
    )
    return out.withColumn("unused", F.lit(capacity) - F.col("n_tokens"))


def summary(
    placed: DataFrame, *, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_capacity: int | None = None
) -> DataFrame:
    """One row: containers used, the least that any packing needs (the largest of the three sums over its limit), and in
    how many containers each limit leaves no room for the smallest item."""
    quiet = capacity if loss_capacity is None else loss_capacity
    each = containers(placed, capacity=capacity)
    total = each.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n_segments").alias("n_items"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("loss_tokens").alias("loss_tokens"), F.sum("unused").alias("unused"),
        F.count_if(F.col("n_tokens") == capacity).alias("token_limit"), F.count_if(F.col("n_segments") == segments).alias("segment_limit"),
        F.count_if(F.col("loss_tokens") == quiet).alias("loss_limit"),
    )
    least = [F.ceil(F.col(c) / limit) for c, limit in (("n_tokens", capacity), ("n_items", segments), ("loss_tokens", quiet))]
    return total.withColumn("least_containers", F.greatest(*least))
