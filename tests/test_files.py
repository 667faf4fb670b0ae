import os
from types import SimpleNamespace

import pytest

from loomtree.checkpoints import shared_folder
from loomtree.operators import annotations, lines, tree
from loomtree.sources import files, sinks, tables


def test_state_directory_round_trip(spark, tmp_path):
    state = files.StateDir(str(tmp_path / "state"))
    raw = tmp_path / "raw.md"
    raw.write_bytes(b"one\r\ntwo\rthree\n")
    assert [(r.line_no, r.line) for r in files.read_raw_lines(spark, str(raw)).orderBy("line_no").collect()] == [(1, "one"), (2, "two"), (3, "three")]
    snap = spark.createDataFrame([("a", 5, 2, None), ("b", 1, 1, 1)], files.SNAPSHOT)
    sinks.write_snapshot(snap, state)
    sinks.write_snapshot(spark.createDataFrame([("a", 9, 3, 3)], files.SNAPSHOT), state)
    assert {tuple(r) for r in files.read_snapshot(spark, state).collect()} == {("a", 9, 3, 3), ("b", 1, 1, 1)}
    clean = spark.createDataFrame([(1, 0, "@ - id=a\nbody"), (1, 1, "more\n")], "doc bigint, ordinal int, text string")
    sinks.write_clean_batches(clean, state)
    sinks.write_clean_batches(clean.where("ordinal = 1").selectExpr("doc", "ordinal", "'new' AS text"), state)
    sinks.write_clean_batches(spark.createDataFrame([(2, 0, "")], "doc bigint, ordinal int, text string"), state)
    back = tables.latest(spark.read.parquet(state.clean), "doc", "ordinal")
    kept = {(r.doc, r.ordinal, r.text) for r in back.collect()}
    assert kept == {(1, 0, "@ - id=a\nbody\n<!-- cutoff -->\n"), (1, 1, "new\n<!-- cutoff -->\n"), (2, 0, "<!-- cutoff -->\n")}
    assert [tables.read_clean(back, 1, n).count() for n in (0, 1, 2)] == [1, 1, 0]
    assert sinks.write_final(back, state)
    assert [r.value for r in spark.read.text(state.final).collect()] == ["@ - id=a", "body", "new"]
    assert not sinks.write_final(back.limit(0), state)


def test_logs_commits_and_trees(spark, tmp_path):
    state = files.StateDir(str(tmp_path / "s"))
    row = spark.createDataFrame([("chunk_000", "out")], "chunk_id string, content string")
    sinks.append_log(row, state)
    sinks.append_log(row, state)
    sinks.append_failures(row, state)
    sinks.commit(row, state)
    sinks.commit(row.limit(0), state)
    assert spark.read.json(state.logs).count() == 2 and spark.read.json(state.commits).count() == 1
    text = spark.createDataFrame([(1, 0, "@ - id=a\nx")], "doc int, chunk int, t string")
    nodes = tree.nodes(annotations.parse_events(lines.text_lines(text, "doc", "chunk", "t")))
    sinks.write_tree(nodes.limit(0), nodes, state)
    assert not os.path.exists(state.tree)
    sinks.write_tree(nodes, nodes.select("doc"), state)
    assert spark.read.parquet(state.tree + "/nodes").count() == 1
    sinks.write_json(spark.createDataFrame([('{"title":"Größe","n":[1]}',)], "json string"), state.at("out"))
    assert spark.read.text(state.at("out"), wholetext=True).first().value == '{\n  "title": "Größe",\n  "n": [\n    1\n  ]\n}\n'
    assert files.read_memory(spark, state) == ""
    (tmp_path / "s" / "memory.md").write_text("note")
    assert files.read_memory(spark, state) == "note"
    (tmp_path / "t.json").write_text('{"id": "r", "title": ""}')
    assert files.read_trees(spark, str(tmp_path / "t.json")).first().tree_json == '{"id": "r", "title": ""}'


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default)))
