"""The run loop over small documents, broken off and resumed."""

import pytest
from pyspark.sql import functions as F

from loomtree.operators import annotations, lines, segment, tree
from loomtree.plans.run import RunConfig, annotated_as_is, clean_table, content_table, main, next_batches, node_table, prepare, progress, run
from loomtree.sources import sinks
from loomtree.sources.files import StateDir


def text(name, n):
    rows = []
    for k in range(n):
        rows += [f"@ {'-' * (1 + k % 3)} id={name}{k}", f"{name} words number{k} about something{k} else{k} entirely{k} here{k}"]
    return "\n".join(rows) + "\n"


def test_a_run_is_resumed_and_merges_to_the_text(spark, tmp_path):
    raw = spark.createDataFrame([("a", text("a", 5)), ("b", text("b", 3)), ("c", "")], "doc string, text string")
    state = StateDir(str(tmp_path / "state"))
    first = run(spark, raw, state, annotated_as_is, RunConfig(batch_tokens=18, max_sections=2))
    assert {(r.doc, r.sections_completed) for r in first.collect()} == {("a", 2), ("b", 2)}
    with pytest.raises(ValueError):
        run(spark, raw, state, annotated_as_is)
    last = run(spark, raw, state, annotated_as_is, RunConfig(batch_tokens=18, resume=True))
    assert {(r.doc, r.next_start_line) for r in last.collect()} == {("a", 10), ("b", 6)}
    merged = [r.value for r in spark.read.text(state.final).collect()]
    assert sorted(merged) == sorted((text("a", 5) + text("b", 3)).splitlines())
    clean = clean_table(spark, state)
    events = annotations.parse_events(lines.text_lines(clean, "doc", "ordinal", "text"))
    want = tree.nodes(events)
    cols = ["doc", "chunk", "line_no", "node_seq", "id", "eff_depth", "parent_seq"]
    assert sorted(map(tuple, node_table(spark, state).select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    ends = clean.select("doc", F.col("ordinal").alias("chunk"), F.size(lines.split_lines(F.col("text"))).alias("n_lines"))
    assert sorted(map(tuple, content_table(spark, state).collect())) == sorted(map(tuple, tree.content_spans(events, ends).collect()))
    assert spark.read.text(state.at("tree_json"), wholetext=True).first().value.startswith('{\n  "id": "')
    assert spark.read.json(state.logs).count() == spark.read.json(state.commits).count() == clean.count()


def test_a_resumed_run_keeps_earlier_documents_and_takes_new_ones(spark, tmp_path):
    schema, state = "doc string, text string", StateDir(str(tmp_path / "state"))
    run(spark, spark.createDataFrame([("a", text("a", 2))], schema), state, annotated_as_is, RunConfig(batch_tokens=18))
    mirrored = {(r.doc, r.ordinal) for r in spark.read.parquet(state.raw).collect()}
    both = spark.createDataFrame([("a", text("a", 2)), ("b", text("b", 2))], schema)
    run(spark, both, state, annotated_as_is, RunConfig(batch_tokens=25, resume=True))
    after = {(r.doc, r.ordinal) for r in spark.read.parquet(state.raw).collect()}
    assert mirrored < after and {d for d, _ in after - mirrored} == {"b"}
    assert {(r.doc, r.next_start_line) for r in progress(spark, state).collect()} == {("a", 4), ("b", 4)}


def test_a_run_broken_at_any_point_goes_on_from_its_last_commit(spark, tmp_path, monkeypatch):
    raw, state = spark.createDataFrame([("a", text("a", 4))], "doc string, text string"), StateDir(str(tmp_path / "state"))

    def lost(original):
        def write(*args):
            original(*args)
            raise OSError("lost")

        return write

    for point in ("write_raw_batches", "append_log", "write_clean_batches", "write_tree", "write_snapshot", "commit"):
        with monkeypatch.context() as m, pytest.raises(OSError):
            m.setattr(sinks, point, lost(getattr(sinks, point)))
            run(spark, raw, state, annotated_as_is, RunConfig(batch_tokens=18, resume=True))
        done = {(r.doc, r.sections_completed) for r in progress(spark, state).collect()}
        assert done == ({("a", 1)} if point == "commit" else set())
    run(spark, raw, state, annotated_as_is, RunConfig(batch_tokens=18, resume=True))
    assert [r.value for r in spark.read.text(state.final).collect()] == text("a", 4).splitlines()
    assert [(r.node_seq, r.id) for r in node_table(spark, state).orderBy("node_seq").collect()] == [(k + 1, f"a{k}") for k in range(4)]


def test_a_round_plans_one_batch_as_the_greedy_walk_does(spark, tmp_path):
    rows = [("a", text("a", 7)), ("b", "\n\none\n" + "two words here\n" * 9 + "end"), ("c", "x " * 50 + "\ny\n")]
    raw, state, config = spark.createDataFrame(rows, "doc string, text string"), StateDir(str(tmp_path / "state")), RunConfig(batch_tokens=8)
    first = next_batches(spark, state, prepare(spark, raw, state, config), config)
    want = segment.plan_batches(raw, "doc", "text", 8).where("ordinal = 0")
    cols = ["doc", "ordinal", "chunk_id", "start_line", "end_line", "raw_content", "raw_line_count", "raw_token_count", "clean_token_target"]
    assert sorted(map(tuple, first.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_a_cleaner_is_shown_tail_memory_and_tree(spark, tmp_path):
    raw, state, shown = spark.createDataFrame([("a", text("a", 4))], "doc string, text string"), StateDir(str(tmp_path / "state")), []
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "memory.md").write_text("note")

    def cleaner(context):
        shown.append(context.first())
        return annotated_as_is(context)

    run(spark, raw, state, cleaner, RunConfig(batch_tokens=18, context_lines=1, max_sections=2, show_tree=True, counter=segment.bpe_count(spark)))
    assert [r.memory_text for r in shown] == ["note", "note"] and shown[0].known_ids is None and shown[0].prior_clean_tail == ""
    assert shown[1].known_ids == ["a0"] and shown[1].current_tree == "a0" and shown[1].prior_clean_tail == text("a", 1).splitlines()[1] + "\n"


def test_an_invalid_batch_ends_the_run_and_is_kept(spark, tmp_path):
    raw = spark.createDataFrame([("a", text("a", 4))], "doc string, text string")
    state = StateDir(str(tmp_path / "state"))
    with pytest.raises(RuntimeError):
        run(spark, raw, state, lambda c: c.select("doc", F.lit("nothing alike at all").alias("cleaned")), RunConfig(batch_tokens=18))
    assert progress(spark, state).count() == 0 and spark.read.json(state.failures).count() == 1


def test_dry_run_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "x.md").write_text(text("x", 4))
    main(["--raw", str(tmp_path / "x.md"), "--state", str(tmp_path / "s"), "--dry-run", "--batch-tokens", "10"])
    assert spark.read.parquet(str(tmp_path / "s" / "raw")).count() == 1
    assert not (tmp_path / "s" / "final").exists()
