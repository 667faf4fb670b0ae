"""The batch session: reading a batch, submitting its cleaned text, committing it.

``submit`` judges any number of batches at once, each a session of its own over a tree that may have nodes already.
``BatchTools`` is the same for one batch at a time, by tool name.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtree.checkpoints import checkpointed
from loomtree.functions.patterns import ROOT_ID
from loomtree.operators import align, annotations, lines, preview, segment, tree, validate

# What the tools answer.
NOT_VALID = "No valid submit_clean available. Call submit_clean until valid=true before commit_batch."
TOOLS = {
    "read_batch": {"type": "object", "properties": {}},
    "submit_clean": {"type": "object", "properties": {"cleaned_text": {"type": "string"}}, "required": ["cleaned_text"]},
    "commit_batch": {"type": "object", "properties": {"cutoff_batch_line": {"type": "integer"}}},
}
_RANK = ["leading_content", "duplicate_id", "unknown_type", "proves_on_non_proof", "proof_without_proves", "proves_bad_target", "missing_dependency"]


def read_batch(contexts: DataFrame, trees: DataFrame, known: DataFrame) -> DataFrame:
    """Contexts (doc, raw_content, raw_line_count, prior_clean_tail, memory_text) with the document's current tree (doc,
    preview) and known ids (doc, known_ids)."""
    rows = contexts.join(trees, "doc", "left").join(known, "doc", "left")
    return rows.select(
        "doc", "raw_content", F.col("raw_line_count").alias("batch_line_count"), F.coalesce("preview", F.lit("")).alias("current_tree"),
        F.coalesce("prior_clean_tail", F.lit("")).alias("prior_clean_tail"),
        F.coalesce("known_ids", F.array().cast("array<string>")).alias("known_ids"), F.coalesce("memory_text", F.lit("")).alias("memory_text"),
    )


def _messages(issues: DataFrame) -> DataFrame:
    """(doc, errors, warnings) in the order in which a text is read."""
    rank = F.array_position(F.lit(_RANK), F.col("code"))
    ordered = issues.groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct(F.when(F.col("code") == "leading_content", 0).otherwise(F.col("line_no")).alias("l"), rank.alias("r"), F.col("pos"), F.col("severity"), F.col("message")))).alias("m")
    )

    def only(severity: str) -> Column:
        return F.transform(F.filter("m", lambda x: x["severity"] == severity), lambda x: x["message"])

    return ordered.select("doc", only("error").alias("v_errors"), only("warning").alias("v_warnings"))


def submit(
    batches: DataFrame, known: DataFrame | None = None, counter: segment.TokenCounter = segment.word_count, *, draw: bool = True
) -> DataFrame:
    """Judges (doc, raw, cleaned, clean_token_target), a row per session: (doc, valid, errors, warnings,
    inferred_cutoff_batch_line, match_confidence, raw_context_around_cutoff, clean_tail, proposed_tree).

    ``known``: (doc, chunk, line_no, id, depth, ...) events of earlier chunks (chunk < 0), the tree so far. Without
    ``draw`` the proposed tree is left empty and earlier nodes are only looked up by id.
    """
    texts = batches.select("doc", F.lit(0).alias("chunk"), "cleaned")
    rows = lines.text_lines(texts, "doc", "chunk", "cleaned")
    events = checkpointed(annotations.parse_events(rows))
    every = events if known is None else checkpointed(events.unionByName(known))
    issues = validate.validate(every, rows).where(F.col("chunk") == 0)
    none = F.array().cast("array<string>")
    proof = annotations.node_type_of(F.col("node_type")) == "proof"
    issue = F.when(F.col("id") == ROOT_ID, "id of the root").when(F.col("proves").isNotNull() & ~proof, "proves on non-proof")
    broken = events.where("event_type = 'header'").withColumn("issue", issue).where(F.col("issue").isNotNull())
    broken = broken.groupBy("doc").agg(F.min_by(F.struct("id", "issue"), "line_no").alias("b"))
    why = F.when(F.col("b.issue") == "id of the root", F.concat(F.lit("Node with id '"), F.col("b.id"), F.lit("' is already registered."))).otherwise(
        F.concat(F.lit("Node '"), F.col("b.id"), F.lit("' has proves_id but is not a proof node."))
    )
    proposed = preview.tree_preview(checkpointed(tree.nodes(every))) if draw else texts.select("doc", F.lit("").alias("preview"))
    aligned = align.align(batches)
    joined = aligned.join(_messages(issues), "doc", "left").join(proposed, "doc", "left").join(broken, "doc", "left")
    before = F.concat(F.coalesce("v_errors", none), align.alignment_errors(aligned))
    written = F.size("before") == 0
    late = F.when(written & F.col("b").isNotNull(), F.array(F.concat(F.lit("Could not build proposed_tree: "), why))).otherwise(none)
    size = validate.token_size_warning(counter(F.col("cleaned")).cast("int"), F.col("clean_token_target"))
    out = joined.withColumn("before", before).withColumn("errors", F.concat("before", late))
    return out.select(
        "doc", (F.size("errors") == 0).alias("valid"), "errors",
        F.array_compact(F.concat(F.array(size), F.coalesce("v_warnings", none))).alias("warnings"),
        F.col("cutoff_line").alias("inferred_cutoff_batch_line"), F.round("confidence", 3).alias("match_confidence"),
        F.when(written, align.raw_context(F.col("raw"), F.col("cutoff_line"))).otherwise(none).alias("raw_context_around_cutoff"),
        F.when(written, align.clean_tail(F.col("cleaned"))).otherwise(none).alias("clean_tail"),
        F.when(written & F.col("b").isNull(), F.coalesce("preview", F.lit(""))).otherwise(F.lit("")).alias("proposed_tree"),
    )


def commit(submitted: DataFrame, starts: DataFrame, override: Column | None = None) -> DataFrame:
    """(doc, success, error, source_line): the committed raw line of (doc, raw_start_line), by the override or the inferred
    one; only after a valid submission."""
    line = F.col("inferred_cutoff_batch_line") if override is None else F.coalesce(override, F.col("inferred_cutoff_batch_line"))
    rows = submitted.join(starts.select("doc", "raw_start_line"), "doc")
    ok = F.col("valid") & line.isNotNull()
    return rows.select("doc", ok.alias("success"), F.when(~ok, F.lit(NOT_VALID)).alias("error"), F.when(ok, F.col("raw_start_line") + line).alias("source_line"))


class BatchTools:
    """One batch after another for a caller that works by tool name."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.context: dict[str, Any] | None = None
        self.known: DataFrame | None = None
        self._reset()

    def _reset(self) -> None:
        self.last: dict[str, Any] | None = None
        self.cleaned: str | None = None
        self.source_line: int | None = None

    @property
    def succeeded(self) -> bool:
        return self.source_line is not None

    def begin_batch(self, context: dict[str, Any], known: DataFrame | None = None) -> None:
        """``context``: raw_content, raw_start_line, clean_token_target, prior_clean_tail, memory_text; ``known``: events so far."""
        self.context, self.known = dict(context), known
        self._reset()

    def call_tool(self, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
        if name not in TOOLS:
            raise ValueError(f"Unknown tool: {name}")
        if self.context is None:
            raise ValueError("No active batch. begin_batch() must be called first.")
        return getattr(self, f"_{name}")(**arguments)

    def _read_batch(self) -> dict[str, Any]:
        c, tree_text, ids = self.context, "", []
        if self.known is not None:
            nodes = tree.nodes(self.known)
            shown = preview.tree_preview(nodes).first()
            tree_text = shown.preview if shown else ""
            ids = [r.id for r in nodes.orderBy("node_seq").select("id").collect()]
        return {
            "raw_content": c["raw_content"], "batch_line_count": len(c["raw_content"].splitlines()), "current_tree": tree_text,
            "prior_clean_tail": c.get("prior_clean_tail") or "", "known_ids": ids, "memory_text": c.get("memory_text") or "",
        }

    def _submit_clean(self, cleaned_text: str) -> dict[str, Any]:
        row = [("batch", self.context["raw_content"], cleaned_text, int(self.context["clean_token_target"]))]
        batch = self.spark.createDataFrame(row, "doc string, raw string, cleaned string, clean_token_target int")
        self.last = submit(batch, self.known).drop("doc").first().asDict(recursive=True)
        self.cleaned = cleaned_text
        return self.last

    def _commit_batch(self, cutoff_batch_line: int | None = None) -> dict[str, Any]:
        if cutoff_batch_line is None and self.last:
            cutoff_batch_line = self.last["inferred_cutoff_batch_line"]
        if cutoff_batch_line is None or not (self.last and self.last["valid"]):
            return {"status": "error", "error": NOT_VALID}
        self.source_line = int(self.context["raw_start_line"]) + cutoff_batch_line
        return {"status": "ok"}
