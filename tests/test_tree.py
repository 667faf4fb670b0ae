"""The fold, its windows and previews against a stack machine, with known small cases."""

import random

from pyspark.sql import functions as F

from loomtree.operators import annotations, lines, preview, rules, tree, treejson

TEXTS = "doc bigint, chunk int, text string"


def frames(spark, texts):
    df = spark.createDataFrame(texts, TEXTS)
    rows = lines.text_lines(df, "doc", "chunk", "text")
    ends = df.select("doc", "chunk", F.size(lines.split_lines(F.col("text"))).alias("n_lines"))
    return annotations.parse_events(rows), ends


def stack_machine(texts):
    nodes, spans = [], []
    for doc in sorted({t[0] for t in texts}):
        path, seq = [], 0
        for _, chunk, text in sorted(t for t in texts if t[0] == doc):
            last = 0

            def flush(upto, chunk=chunk):
                if last + 1 <= upto - 1 and path:
                    spans.append((doc, chunk, path[-1], last + 1, upto - 1))

            total, cut = len(text.splitlines()), False
            for n, line in enumerate(text.splitlines(), 1):
                if "cutoff" in line:
                    flush(n)
                    cut = True
                    break
                if line.startswith("@ -"):
                    flush(n)
                    last = n
                    depth = line.count("-")
                    path = path[: depth - 1]
                    seq += 1
                    nodes.append((doc, chunk, n, seq, len(path) + 1, path[-1] if path else 0))
                    path = [*path, seq]
            if not cut and total > last:
                flush(total + 1)
    return nodes, spans


def make(seed):
    rnd = random.Random(seed)
    texts = []
    for doc in range(4):
        for chunk in range(rnd.randint(1, 5)):
            body = []
            for k in range(rnd.randint(0, 12)):
                body.append(rnd.choice(["text", "", f"@ {'-' * rnd.randint(1, 4)} id=n{doc}_{chunk}_{k}", "<!-- cutoff -->" if rnd.random() < 0.2 else "x"]))
            texts.append((doc, chunk * 2, "\n".join(body)))
    return texts


def test_tree_and_spans_equal_a_stack_machine(spark):
    for seed in range(3):
        texts = make(seed)
        events, ends = frames(spark, texts)
        nodes, spans = stack_machine(texts)
        got = tree.nodes(events).select("doc", "chunk", "line_no", "node_seq", "eff_depth", "parent_seq").collect()
        assert sorted(map(tuple, got)) == sorted(nodes)
        assert sorted(map(tuple, tree.content_spans(events, ends).collect())) == sorted(spans)


def test_second_batch_goes_on_with_the_leaf_and_jumps_hang_below_it(spark):
    events, ends = frames(spark, [(1, 0, "@ - id=ch1\nbody"), (1, 1, "more\n@ ---- id=deep\nend\n")])
    assert [tuple(r) for r in tree.content_spans(events, ends).orderBy("chunk", "first_line").collect()] == [(1, 0, 1, 2, 2), (1, 1, 1, 1, 1), (1, 1, 2, 3, 3)]
    nodes = tree.nodes(events)
    assert [(r.id, r.eff_depth, r.parent_seq) for r in nodes.orderBy("node_seq").collect()] == [("ch1", 1, 0), ("deep", 2, 1)]
    assert tree.active_trace(nodes).first().trace == ["ch1", "deep"]
    assert [tuple(r) for r in tree.batch_metrics(nodes, ends).orderBy("chunk").collect()] == [(1, 0, 1, 1), (1, 1, 1, 2)]


def test_a_third_node_between_declared_depths(spark):
    events, _ = frames(spark, [(1, 0, "@ - id=a\n@ ---- id=b\n@ --- id=c")])
    assert [r.parent_seq for r in tree.nodes(events).orderBy("node_seq").collect()] == [0, 1, 2]


def test_header_quirks(spark):
    text = '@ ---id="x"\n@--- id=x\n @ - data-id="q" id=z id="w"\n@ - title=t\n@ - id= a\n@ - id=p deps=["a", \'b\',,c ] proves="" title=""'
    events, _ = frames(spark, [(1, 0, text)])
    rows = {r.line_no: r for r in events.collect()}
    assert {n: r.id for n, r in rows.items()} == {2: "x", 3: "w", 6: "p"}
    assert rows[6].deps == ["a", "b", "c"] and rows[6].proves == "" and rows[2].depth == 3


def test_preview_of_one_and_of_many_roots(spark):
    events, _ = frames(spark, [(1, 0, "@ - id=a\n@ -- id=b type=theorem\n@ --- id=c type=proof proves=b\n@ -- id=d deps=[a,b]"), (2, 0, "@ - id=x\n@ - id=y\n@ -- id=z")])
    got = {r.doc: r.preview for r in preview.tree_preview(tree.nodes(events)).collect()}
    assert got[1] == "a\n    ├── b [theorem]\n    │   └── c [proof -> b]\n    └── d [deps: a, b]"
    assert got[2] == "├── x\n└── y\n    └── z"


def test_preview_cap_keeps_the_trace(spark):
    text = "\n".join(f"@ -- id=n{k}" if k else "@ - id=root" for k in range(9))
    events, _ = frames(spark, [(1, 0, text)])
    shown = preview.tree_preview(tree.nodes(events), cap=2).first().preview.split("\n")
    assert [s.strip("├└│─ ") for s in shown] == ["root", "n1", "n2", "n8"]


def test_rules_on_a_small_tree(spark):
    doc = '{"id":"r","title":"","content":[{"chunk_number":0,"first_line":5,"last_line":9}],"children":[{"id":"a","title":"","content":[{"chunk_number":0,"first_line":1,"last_line":2},{"chunk_number":1,"first_line":8,"last_line":9}]},{"id":"b","title":"","content":[{"chunk_number":1,"first_line":2,"last_line":3}]}]}'
    trees = spark.createDataFrame([(1, None, doc)], "tree_id bigint, run_id bigint, tree_json string")
    issues = {(r.node, r.issue) for r in treejson.load_issues(trees).collect()}
    assert issues == {("0.0", "rule 1"), ("0.1", "rule 2")}


def test_content_order_ignores_the_last_line(spark):
    rows = [(1, "n", 0, 1, 9, 0), (1, "n", 0, 1, 3, 1), (1, "n", 0, 2, 2, 2)]
    content = spark.createDataFrame(rows, "doc int, node string, chunk_number int, first_line int, last_line int, pos int")
    assert [r.pos for r in rules.out_of_order_content(content, "pos").collect()] == [1]
    spans = content.withColumnRenamed("pos", "ident")
    got = rules.partition_violations(spans, ["doc", "chunk_number"], "ident").collect()
    assert {(r.ident, r.issue) for r in got} == {(1, "duplicate start"), (2, "overlap")}


def test_export_and_load_round_trip(spark):
    events, ends = frames(spark, [(1, 0, '@ - id=a title="A"\nx\n@ -- id=b type=proof proves=a\ny\n@ -- id=c deps=[b]')])
    nodes = tree.nodes(events)
    spans = tree.content_spans(events, ends).withColumnRenamed("chunk", "chunk_number")
    out = treejson.export(nodes, spans).select("doc", F.lit(None).cast("bigint").alias("run_id"), "json").toDF("tree_id", "run_id", "tree_json")
    loaded, content, deps = treejson.load(out)
    assert {(r.node, r.id, r.title, r.type, r.proves_id) for r in loaded.collect()} == {("0", "a", "A", "generic", None), ("0.0", "b", "b", "proof", "a"), ("0.1", "c", "c", "generic", None)}
    assert {(r.node, r.chunk_number, r.first_line, r.last_line) for r in content.collect()} == {("0", 0, 2, 2), ("0.0", 0, 4, 4)}
    assert [(r.node, r.dep_id) for r in deps.collect()] == [("0.1", "b")]
    assert treejson.load_issues(out).count() == 0
