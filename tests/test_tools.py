"""Segmentation, validation, alignment and the batch session on known cases."""

from pyspark.sql import functions as F

from loomtree.operators import align, annotations, lines, segment, validate
from loomtree.plans.tools import NOT_VALID, BatchTools
from loomtree.sources import tables


def issues(spark, *texts):
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc int, chunk int, text string")
    rows = lines.text_lines(df, "doc", "chunk", "text")
    return [(r.chunk, r.code) for r in validate.validate(annotations.parse_events(rows), rows).orderBy("chunk", "line_no", "code").collect()]


def test_greedy_batches(spark):
    df = spark.createDataFrame([(1, "aa\nbbbb\ncc\n"), (2, "x\r\ny"), (3, ""), (4, None)], "doc int, text string")
    rows = segment.plan_batches(df, "doc", "text", 5, segment.char_count).orderBy("doc", "ordinal").collect()
    assert [(r.doc, r.start_line, r.end_line, r.raw_content, r.raw_token_count, r.clean_token_target) for r in rows] == [
        (1, 0, 2, "aa\nbbbb\n", 8, 4), (1, 2, 3, "cc\n", 3, 1), (2, 0, 2, "x\ny", 3, 1)]
    assert rows[0].chunk_id == "chunk_000"


def test_clamp(spark):
    got = spark.range(1).select(*[segment.clamp_cutoff(F.lit(x), F.lit(10), F.lit(20)) for x in (5, 15, 99)]).first()
    assert tuple(got) == (11, 15, 20)


def test_validation_messages(spark):
    assert issues(spark, "text\n@ - id=a") == [(0, "leading_content")]
    assert issues(spark, "@ - id=a", "text\n@ - id=b") == []
    assert issues(spark, "@ - id=a type=lemma", "@ - id=a type=odd proves=a\n@ - id=c type=proof deps=[a,zz]") == [
        (1, "duplicate_id"), (1, "proves_bad_target"), (1, "proves_on_non_proof"), (1, "unknown_type"), (1, "missing_dependency"), (1, "proof_without_proves")]
    assert issues(spark, "@ - id=t type=remark\n@ - id=p type=proof proves=t") == [(0, "proves_bad_target")]
    assert issues(spark, "@ - id=t type=remark", "@ - id=p type=proof proves=t") == []


def test_alignment_gates(spark):
    raw = "\n".join(["alpha beta gamma delta epsilon zeta eta theta iota kappa"] * 30)
    cleaned = " ".join((" ".join(raw.split()[:20]) + " " + " ".join(f"other{k}" for k in range(20))).split())
    df = spark.createDataFrame([(1, raw, cleaned), (2, "$$ 1 $$\n", "abc"), (3, raw, "alpha beta"), (4, raw, " ".join(f"w{k}x" for k in range(30)))], "doc int, raw string, cleaned string")
    out = align.align(df)
    rows = {r.doc: r for r in out.select("doc", "error_code", "confidence", "cutoff_line", align.alignment_errors(out).alias("errors")).collect()}
    assert rows[1].confidence == 0.5 and len(rows[1].errors) == 2
    assert [rows[k].error_code for k in (2, 3, 4)] == ["raw_has_no_content_tokens", "cleaned_too_short_for_alignment", "no_token_overlap"]


def test_a_session(spark):
    tools = BatchTools(spark)
    tools.begin_batch({"raw_content": "# Title here\nThe first content line\n", "raw_start_line": 40, "clean_token_target": 1})
    assert tools.call_tool("commit_batch", {}) == {"status": "error", "error": NOT_VALID}
    assert tools.call_tool("read_batch", {})["batch_line_count"] == 2
    got = tools.call_tool("submit_clean", {"cleaned_text": "@ - id=a\nTitle here The first content line"})
    assert got["valid"] and got["inferred_cutoff_batch_line"] == 2 and got["proposed_tree"] == "a" and got["match_confidence"] == 1.0
    assert got["raw_context_around_cutoff"] == ["# Title here", "The first content line"]
    assert tools.call_tool("commit_batch", {}) == {"status": "ok"} and tools.source_line == 42
    bad = tools.call_tool("submit_clean", {"cleaned_text": "@ - id=a proves=b\nTitle here The first content line"})
    assert bad["errors"] == ["Could not build proposed_tree: Node 'a' has proves_id but is not a proof node."]
    try:
        tools.call_tool("other", {})
        raise AssertionError
    except ValueError as error:
        assert str(error) == "Unknown tool: other"


def test_tails_merge_and_order(spark):
    clean = spark.createDataFrame([(1, 0, "a\nb\nc\n<!-- cutoff -->\nz\n"), (1, 1, "@ - id=x\nd<!--cutoff-->\ne\n")], "doc int, ordinal int, text string")
    assert [r.line for r in tables.merged_lines(clean).orderBy("ordinal", "line_no").collect()] == ["a", "b", "c", "@ - id=x", "d<!--cutoff-->", "e"]
    assert {(r.ordinal, r.prior_clean_tail) for r in tables.prior_clean_tails(clean, 2).collect()} == {(1, "b\nc\n"), (2, "d<!--cutoff-->\ne\n")}
    names = spark.createDataFrame([(n,) for n in ("clean_10.md", "notes.md", "clean_2.md", "clean_0.md", "clean_1.md", "a.md")], "name string")
    assert [r.name for r in names.orderBy(tables.numeric_order(F.col("name"))).collect()] == ["clean_0.md", "clean_1.md", "clean_2.md", "clean_10.md", "a.md", "notes.md"]
