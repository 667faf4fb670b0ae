"""The run loop: plan, mirror, clean, submit, commit, advance, until every document is complete.

A round takes the next batch of every open document at once; only the rounds are sequential, because a batch starts at
the cutoff of the one before. A round costs what its own batches cost:

* The lines of all documents are written once, with the tokens before each, in folders by token offset. A batch is read
  from the one or two folders that its offset names; nothing else of a document is opened.
* A document's state between rounds is its snapshot row: cursors, the open path of its tree and its number of nodes. New
  headers are folded below the open path, so no earlier text is parsed again; earlier nodes are only looked up by id.
* The tail shown to the cleaner comes from the round that the snapshot names.

The cleaner is any function of a frame. The commit rows are written last in a round and make it count: what a broken
round has written is never read, and a resumed run goes on from the last commit.
"""

from __future__ import annotations

import argparse
import importlib
import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtree.checkpoints import checkpointed
from loomtree.operators import annotations, lines, preview, segment, tree, treejson
from loomtree.plans import tools
from loomtree.sources import sinks, tables
from loomtree.sources.files import StateDir, read_memory, read_table, read_text

log = logging.getLogger("loomtree")

#: (doc, ordinal, raw_content, prior_clean_tail, memory_text, clean_token_target, ...) -> (doc, cleaned)
Cleaner = Callable[[DataFrame], DataFrame]
SNAPSHOT = (
    "doc string, ordinal int, round string, next_start_line bigint, next_chunk_id int, sections_completed int, next_upto bigint, "
    "path array<int>, n_nodes int"
)
NODES = (
    "doc string, chunk int, line_no int, node_seq int, id string, title string, node_type string, proves string, deps array<string>, "
    "depth int, eff_depth int, parent_seq int, round string"
)
CONTENT = "doc string, chunk int, node_seq int, first_line int, last_line int, round string"
CLEAN = "doc string, ordinal int, text string, round string"


@dataclass(frozen=True)
class RunConfig:
    batch_tokens: int = 16_000
    context_lines: int = 20
    max_sections: int | None = None
    dry_run: bool = False
    resume: bool = False
    counter: segment.TokenCounter = segment.word_count
    #: Whether the cleaner is shown the tree so far and the ids in it, as ``read_batch`` shows them.
    show_tree: bool = False
    #: For cleaners that call a model.
    task_model: str = "default"
    timeout: int = 600


def annotated_as_is(context: DataFrame) -> DataFrame:
    """A cleaner for texts that are clean already: each batch starts with its first header."""
    return context.select("doc", F.col("raw_content").alias("cleaned"))


def _commits(spark: SparkSession, state: StateDir) -> DataFrame:
    return read_table(spark, state.commits, "doc string, ordinal int, round string", "json")


def _committed(spark: SparkSession, state: StateDir, path: str, schema: str, ordinal: str = "ordinal") -> DataFrame:
    """Rows of the rounds that count; the commits name few rounds, which prune the folders that are read."""
    done = _commits(spark, state).select("doc", F.col("ordinal").alias(ordinal), "round")
    return read_table(spark, path, schema).join(done, ["doc", ordinal, "round"], "left_semi")


def snapshots(spark: SparkSession, state: StateDir) -> DataFrame:
    """The latest committed snapshot of each document."""
    rows = read_table(spark, state.snapshot, SNAPSHOT, "json").join(_commits(spark, state), ["doc", "ordinal", "round"], "left_semi")
    rest = [c for c in rows.columns if c != "doc"]
    last = rows.groupBy("doc").agg(F.max_by(F.struct(*rest), "ordinal").alias("s"))
    return last.select("doc", *[F.col("s")[c].alias(c) for c in rest])


def progress(spark: SparkSession, state: StateDir) -> DataFrame:
    """(doc, next_start_line, next_chunk_id, sections_completed): the latest committed state of each document."""
    return snapshots(spark, state).select("doc", "next_start_line", "next_chunk_id", "sections_completed")


def clean_table(spark: SparkSession, state: StateDir) -> DataFrame:
    """(doc, ordinal, text) of the batches that count."""
    return _committed(spark, state, state.clean, CLEAN).select("doc", "ordinal", "text")


def node_table(spark: SparkSession, state: StateDir) -> DataFrame:
    """The tree's nodes so far, as ``tree.nodes`` gives them."""
    return _committed(spark, state, f"{state.tree}/nodes", NODES, "chunk").drop("round")


def content_table(spark: SparkSession, state: StateDir) -> DataFrame:
    """The lines owned by the nodes so far, as ``tree.content_spans`` gives them."""
    return _committed(spark, state, f"{state.tree}/content", CONTENT, "chunk").drop("round")


def prepare(spark: SparkSession, raw: DataFrame, state: StateDir, config: RunConfig) -> DataFrame:
    """Writes the lines of documents that the state does not hold yet; (doc, load, n_lines, width) of all.

    ``width`` is the token range of a folder: a batch within the budget it was written for lies in two at most.
    """
    schema = "doc string, load string, n_lines bigint, width bigint"
    new = raw.select(F.col("doc").cast("string").alias("doc"), "text").join(read_table(spark, state.documents, schema).select("doc"), "doc", "left_anti")
    if not new.isEmpty():
        load, width = uuid.uuid4().hex, max(1, config.batch_tokens)
        rows = segment.numbered_lines(new, config.counter).withColumn("load", F.lit(load))
        rows.withColumn("slab", F.floor(F.col("upto") / width)).write.mode("append").partitionBy("slab").parquet(state.lines)
        mine = _lines(spark, state).where(F.col("load") == load).groupBy("doc").agg(F.count(F.lit(1)).alias("n_lines"))
        every = new.select("doc").join(mine, "doc", "left").select("doc", F.lit(load).alias("load"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
        every.withColumn("width", F.lit(width).cast("bigint")).write.mode("append").parquet(state.documents)
    return read_table(spark, state.documents, schema)


def _lines(spark: SparkSession, state: StateDir) -> DataFrame:
    return read_table(spark, state.lines, "doc string, at bigint, line string, upto bigint, n bigint, load string, slab bigint")


def next_batches(spark: SparkSession, state: StateDir, docs: DataFrame, config: RunConfig) -> DataFrame:
    """The next batch of every open document with its cursors, open path and the tokens before each of its lines."""
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("next_start_line", "next_chunk_id", "sections_completed", "next_upto", "n_nodes")}
    at = docs.join(snapshots(spark, state).withColumnRenamed("round", "last_round").drop("ordinal"), "doc", "left")
    at = at.withColumns(zero).withColumn("path", F.coalesce("path", F.array().cast("array<int>")))
    open_ = at.where(~segment.is_complete(F.col("next_start_line"), F.col("n_lines")))
    if config.max_sections is not None:
        open_ = open_.where(F.col("sections_completed") < config.max_sections)
    end = F.col("next_upto") + config.batch_tokens
    slabs = F.sequence(F.floor(F.col("next_upto") / F.col("width")), F.floor((end - 1) / F.col("width")))
    asked = open_.select("doc", "load", "next_start_line", end.alias("end"), F.explode(slabs).alias("slab"))
    found = _lines(spark, state).join(asked, ["doc", "load", "slab"])
    # the first line is taken whatever it holds, the crossing one is the last
    found = found.where((F.col("at") >= F.col("next_start_line")) & (F.col("upto") < F.col("end")))
    rows = found.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "line", (F.col("upto") + F.col("n")).alias("through")))).alias("r"))
    cut = rows.join(open_.drop("load", "width", "n_lines"), "doc").select(
        "*", F.col("next_chunk_id").alias("ordinal"), F.col("next_start_line").alias("start_line"), (F.col("next_start_line") + F.size("r")).alias("end_line"),
        F.array_join(F.transform("r", lambda x: x["line"]), "").alias("raw_content"), F.transform("r", lambda x: x["through"]).alias("through"),
    )
    attributes = segment.batch_attributes(cut.select("doc", "ordinal", "start_line", "end_line", "raw_content"), config.counter)
    carried = cut.select("doc", "next_start_line", "next_chunk_id", "sections_completed", "next_upto", "n_nodes", "path", "last_round", "through")
    return attributes.join(carried, "doc")


def _context(spark: SparkSession, state: StateDir, batches: DataFrame, config: RunConfig) -> DataFrame:
    """What a cleaner is shown."""
    before = batches.select("doc", (F.col("ordinal") - 1).alias("ordinal"), F.col("last_round").alias("round"))
    last = read_table(spark, state.clean, CLEAN).join(before, ["doc", "ordinal", "round"])
    tails = tables.prior_clean_tails(last, config.context_lines)
    out = batches.drop("through", "path", "last_round").join(tails, ["doc", "ordinal"], "left")
    out = out.withColumn("prior_clean_tail", F.coalesce("prior_clean_tail", F.lit(""))).withColumn("memory_text", F.lit(read_memory(spark, state)))
    if config.show_tree:
        nodes = checkpointed(node_table(spark, state).join(batches.select("doc"), "doc", "left_semi"))
        ids = nodes.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("node_seq", "id"))), lambda x: x["id"]).alias("known_ids"))
        out = out.join(preview.tree_preview(nodes).withColumnRenamed("preview", "current_tree"), "doc", "left").join(ids, "doc", "left")
    return out


def _grown(batches: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, content, ends) of a round. The open path stands before a batch as headers of its own, so that depth,
    parent and owner come out as in the whole document; its numbers are then put back. ends: (doc, path, n_nodes)."""
    state = batches.select("doc", "ordinal", "path", "n_nodes")
    path = state.select("doc", F.lit(-1).alias("chunk"), F.posexplode("path").alias("p", "seq"))
    no_text = {c: F.lit(None).cast("string") for c in ("title", "node_type", "proves")}
    path = path.select("doc", "chunk", (F.col("p") + 1).alias("line_no"), F.lit("header").alias("event_type"), F.lit("").alias("id"), (F.col("p") + 1).alias("depth"),
                       *[c.alias(n) for n, c in no_text.items()], F.array().cast("array<string>").alias("deps"))
    events = annotations.parse_events(lines.text_lines(texts, "doc", F.lit(0), "text"))
    every = checkpointed(path.unionByName(events))
    numbers = state.withColumn("deep", F.size("path"))

    def real(seq: str):
        above = F.try_element_at("path", F.when(F.col(seq) >= 1, F.col(seq)))
        return F.when(F.col(seq) > F.col("deep"), F.col("n_nodes") + F.col(seq) - F.col("deep")).otherwise(F.coalesce(above, F.lit(0))).cast("int")

    found = checkpointed(tree.nodes(every).join(numbers, "doc").withColumn("parent_seq", real("parent_seq")).withColumn("node_seq", real("node_seq")))
    nodes = found.where("chunk = 0").withColumn("chunk", F.col("ordinal")).drop("ordinal", "path", "n_nodes", "deep")
    n_lines = texts.select("doc", F.lit(0).alias("chunk"), F.size(lines.split_lines(F.col("text"))).alias("n_lines"))
    spans = tree.content_spans(every, n_lines).where("chunk = 0").join(numbers, "doc").withColumn("node_seq", real("node_seq"))
    content = spans.select("doc", F.col("ordinal").alias("chunk"), "node_seq", "first_line", "last_line")
    trace = tree.on_active_trace(found).where("on_trace").groupBy("doc").agg(F.sort_array(F.collect_list("node_seq")).alias("path"))
    added = nodes.groupBy("doc").agg(F.count(F.lit(1)).cast("int").alias("added"))
    ends = state.select("doc", "n_nodes").join(trace, "doc", "left").join(added, "doc", "left")
    return nodes, content, ends.select("doc", F.coalesce("path", F.array().cast("array<int>")).alias("path"), (F.col("n_nodes") + F.coalesce("added", F.lit(0))).alias("n_nodes"))


def _known(spark: SparkSession, state: StateDir, batches: DataFrame) -> DataFrame:
    """Earlier nodes of the round's documents as events, their chunks counted back from the batch."""
    here = batches.select("doc", "ordinal")
    rows = node_table(spark, state).join(here, "doc")
    return rows.select("doc", (F.col("chunk") - F.col("ordinal")).alias("chunk"), "line_no", F.lit("header").alias("event_type"), "id", "depth", "title",
                       "node_type", "proves", "deps")


def run(spark: SparkSession, raw: DataFrame, state: StateDir, cleaner: Cleaner, config: RunConfig = RunConfig()) -> DataFrame:
    """Runs all documents (doc, text) to their end, or to ``max_sections``, and merges what is clean.

    Returns their progress. A batch that is not valid is written to the failures and ends the run with an error; what
    was committed stays. Without ``resume`` the state directory must be a new one.
    """
    if not config.resume and not _commits(spark, state).isEmpty():
        raise ValueError(f"{state.root} holds a run already; resume it or name another folder")
    docs = prepare(spark, raw, state, config)
    while True:
        batches = checkpointed(next_batches(spark, state, docs, config))
        if batches.isEmpty():
            break
        round_ = F.lit(uuid.uuid4().hex).alias("round")
        sinks.write_raw_batches(batches.drop("through", "path", "last_round").select("*", round_), state)
        context = _context(spark, state, batches, config)
        if config.dry_run:
            break
        cleaned = checkpointed(cleaner(context).select("doc", "cleaned"))
        here = batches.select("doc", "ordinal", "chunk_id")
        sinks.append_log(cleaned.join(here, "doc").select("chunk_id", "doc", "ordinal", F.col("cleaned").alias("content"), round_), state)
        asked = batches.select("doc", F.col("raw_content").alias("raw"), "clean_token_target").join(cleaned, "doc")
        verdict = checkpointed(tools.submit(asked, _known(spark, state, batches), config.counter, draw=False))
        bad = verdict.where(~F.col("valid")).select("doc", "errors")
        missing = here.join(verdict, "doc", "left_anti").select("doc", F.array(F.lit("No result submitted.")).alias("errors"))
        failed = checkpointed(bad.unionByName(missing).join(here, "doc"))
        if some := failed.take(3):
            sinks.append_failures(failed.select("chunk_id", "doc", "ordinal", F.to_json(F.struct("doc", "errors")).alias("content"), round_), state)
            raise RuntimeError(f"batches that are not valid are in {state.failures}, for example: {some}")
        texts = checkpointed(cleaned.join(here, "doc").select("doc", "ordinal", "chunk_id", "cleaned", sinks.marked(F.col("cleaned")).alias("text")))
        sinks.write_clean_batches(texts.select("doc", "ordinal", F.col("cleaned").alias("text"), round_), state)
        nodes, content, ends = _grown(batches, texts)
        sinks.write_tree(nodes.select("*", round_), content.select("*", round_), state)
        starts = batches.select("doc", F.col("start_line").alias("raw_start_line"))
        done = tools.commit(verdict, starts).join(batches.drop("path", "n_nodes"), "doc").join(ends, "doc")
        cut = segment.clamp_cutoff(F.col("source_line"), F.col("start_line"), F.col("end_line"))
        after = done.withColumn("a", segment.advance(F.col("next_chunk_id"), F.col("sections_completed"), cut))
        upto = F.element_at("through", (F.col("a.next_start_line") - F.col("start_line")).cast("int"))
        rows = after.select("doc", "ordinal", round_, F.col("a.next_start_line").cast("bigint").alias("next_start_line"), "a.next_chunk_id", "a.sections_completed",
                            upto.alias("next_upto"), "path", "n_nodes")
        sinks.write_snapshot(rows, state)
        sinks.commit(here.select("chunk_id", "doc", "ordinal", round_), state)
        log.info("a round is done: %s", config)
    if not config.dry_run:
        sinks.write_final(clean_table(spark, state), state)
        nodes = checkpointed(node_table(spark, state))
        if not nodes.isEmpty():
            sinks.write_json(treejson.export(nodes, content_table(spark, state).withColumnRenamed("chunk", "chunk_number")), state.at("tree_json"))
    return progress(spark, state)


def main(args: list[str] | None = None) -> None:
    """Job entry: ``python -m loomtree.plans.run --raw 'books/*.md' --state out [--resume] ...``."""
    parser = argparse.ArgumentParser(description="Runs annotated texts through the batch loop.")
    parser.add_argument("--raw", required=True)
    parser.add_argument("--state", required=True)
    parser.add_argument("--resume", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--batch-tokens", type=int, default=RunConfig.batch_tokens)
    parser.add_argument("--context-lines", type=int, default=RunConfig.context_lines)
    parser.add_argument("--max-sections", type=int)
    parser.add_argument("--task-model", default=RunConfig.task_model)
    parser.add_argument("--timeout", type=int, default=RunConfig.timeout)
    parser.add_argument("--tokenizer", help="rank file of a byte-level tokenizer; words are counted without one")
    parser.add_argument("--cleaner", help="module:function that takes the configuration and gives a cleaner")
    parser.add_argument("--verbose", "-v", action="store_true")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.DEBUG if given.verbose else logging.INFO)
    spark = SparkSession.builder.appName("loomtree").getOrCreate()
    counter = segment.bpe_count(spark, given.tokenizer) if given.tokenizer else segment.word_count
    config = RunConfig(
        given.batch_tokens, given.context_lines, given.max_sections, given.dry_run, given.resume, counter,
        task_model=given.task_model, timeout=given.timeout,
    )
    cleaner: Cleaner = annotated_as_is
    if given.cleaner:
        module, name = given.cleaner.split(":")
        cleaner = getattr(importlib.import_module(module), name)(config)
    raw = read_text(spark, given.raw).select(F.col("path").alias("doc"), "text")
    run(spark, raw, StateDir(given.state), cleaner, config).show(truncate=False)


if __name__ == "__main__":
    main()
