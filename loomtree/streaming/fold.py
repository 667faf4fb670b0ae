"""The tree fold over a stream of batches.

Headers are read from each batch's text in its own row, before anything is shuffled, so only header rows meet the state.
Batches arrive in any order, also over several micro-batches and more than once. Per document the state holds the open
path (one node number per level), the next node number, the next batch expected, and the headers of batches that came
too early. Each batch's nodes are emitted once, when all before it have been folded. A restart goes on from the query's
checkpoint.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtree.checkpoints import checkpointed, removed_folder, shared_folder
from loomtree.operators.annotations import header_array
from loomtree.session import ship

NODES = "doc bigint, step int, line_no int, node_seq int, id string, title string, node_type string, eff_depth int, parent_seq int"
STATE = "path array<int>, next_node int, next_step int, early string"
BATCH = "doc bigint, step int, text string"
HEADS = "doc bigint, step int, heads array<struct<line_no:int,id:string,title:string,node_type:string,depth:int>>"
HEAD = ("line_no", "id", "title", "node_type", "depth")


def fold_batch(path: list[int], next_node: int, heads: list[list]) -> tuple[list[tuple], int]:
    """Adds a batch's headers to the open path, which is changed; returns their nodes and the next node number."""
    nodes = []
    for line, ident, title, kind, depth in heads:
        level = min(depth, len(path) + 1)
        parent = path[level - 2] if level > 1 else 0
        path[level - 1 :] = [next_node]
        nodes.append((line, next_node, ident, title, kind, level, parent))
        next_node += 1
    return nodes, next_node


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    path, next_node, next_step, early = state.get if state.exists else ([], 1, 0, "{}")
    path, waiting = list(path), json.loads(early)
    for frame in frames:
        for step, heads in zip(frame["step"], frame["heads"]):
            if step >= next_step:
                rows = [] if heads is None else [[h[c] for c in HEAD] for h in heads]
                waiting.setdefault(str(step), [[int(n), i, t, k, int(d)] for n, i, t, k, d in rows])
    out = []
    while str(next_step) in waiting:
        nodes, next_node = fold_batch(path, next_node, waiting.pop(str(next_step)))
        out += [(key[0], next_step, *node) for node in nodes]
        next_step += 1
    state.update((path, next_node, next_step, json.dumps(waiting)))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])


def with_heads(batches: DataFrame) -> DataFrame:
    """(doc, step, heads) of batches (doc, step, text), streaming or not."""
    return batches.select("doc", F.col("step").cast("int").alias("step"), header_array(F.col("text")).alias("heads"))


def fold_heads(batches: DataFrame) -> DataFrame:
    """Streaming nodes of streaming batches (doc, step, heads), step counting a document's batches from 0."""
    ship(batches.sparkSession)
    return batches.groupBy("doc").applyInPandasWithState(_fold, NODES, STATE, "append", GroupStateTimeout.NoTimeout)


def fold_stream(batches: DataFrame) -> DataFrame:
    """The same for batches (doc, step, text)."""
    return fold_heads(with_heads(batches))


def _run(nodes: DataFrame, out: str) -> DataFrame:
    query = (
        nodes.writeStream.format("parquet")
        .option("path", f"{out}/nodes")
        .option("checkpointLocation", f"{out}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return nodes.sparkSession.read.schema(NODES).parquet(f"{out}/nodes")


def fold_available(spark: SparkSession, source: str, out: str, *, files_per_trigger: int = 8) -> DataFrame:
    """Folds all batches that lie in ``source`` (Parquet files of BATCH) and stops; called again with the same
    ``out`` it goes on with the files that are new. Returns all nodes written so far."""
    stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return _run(fold_stream(stream), out)


def fold_table(batches: DataFrame) -> DataFrame:
    """The fold of a whole table of batches run as a stream, in the shared checkpoint folder. Only header rows are
    written there for the stream to read, and all is removed when the nodes are kept as a checkpoint."""
    spark = batches.sparkSession
    folder = f"{shared_folder(spark)}/fold-{uuid.uuid4().hex}"
    with_heads(batches).write.parquet(f"{folder}/in")
    nodes = _run(fold_heads(spark.readStream.schema(HEADS).option("maxFilesPerTrigger", 8).parquet(f"{folder}/in")), folder)
    kept = checkpointed(nodes)
    removed_folder(spark, folder)
    return kept
