from loomtree.operators import annotations, lines, tree
from loomtree.streaming import fold


def test_fold_goes_on_after_a_restart_and_waits_for_early_batches(spark, tmp_path):
    texts = [(d, k, f"@ {'-' * (1 + (d + 3 * k) % 4)} id=n{d}_{k}\nbody\n@ -- id=m{d}_{k}") for d in (1, 2) for k in range(6)]
    want = tree.nodes(annotations.parse_events(lines.text_lines(spark.createDataFrame(texts, "doc bigint, step int, text string"), "doc", "step", "text")))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (texts[3:5] + texts[7:9], texts[:3] + texts[6:7], texts[:2] + texts[5:6] + texts[9:]):
        spark.createDataFrame(part, fold.BATCH).coalesce(1).write.mode("append").parquet(source)
        got = fold.fold_available(spark, source, out)
    cols = ["doc", "node_seq", "id", "eff_depth", "parent_seq"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
