import json
import random

from loomtree.functions.jsondoc import _loads_deep, loads
from loomtree.operators.nested import assemble, flatten_trees, root_of, shred, shredded_columns

TREES = "tree_id bigint, run_id bigint, tree_json string, kind string, node_path string, value string"


def walk(node, path="0", pos=0):
    """Rows as the task states them, by recursion."""
    scalar = lambda x: "" if x is None or isinstance(x, (dict, list)) else str(x)
    yield "node", path, pos, scalar(node.get("id"))
    content = node.get("content")
    for k, c in enumerate(content if isinstance(content, list) else [content]):
        if isinstance(c, dict):
            yield "content", path, k, ":".join(scalar(c.get(n)) for n in ("chunk_number", "first_line", "last_line"))
    deps = node.get("dependencies")
    for k, d in enumerate([x.strip() for x in deps.split(",")] if isinstance(deps, str) else deps or []):
        if d:
            yield "dependency", path, k, scalar(d)
    for k, child in enumerate(node.get("children") or []):
        if isinstance(child, dict):
            yield from walk(child, f"{path}.{k}", k)


def make(rnd, depth=0):
    node = {"id": rnd.choice(["a", "b", "", None])} if rnd.random() < 0.9 else {}
    if rnd.random() < 0.7:
        spans = [rnd.choice([None, {"chunk_number": rnd.randint(0, 3), "first_line": rnd.choice([None, 1, "7"])}, {}]) for _ in range(rnd.randint(0, 3))]
        node["content"] = rnd.choice([spans, None, {"chunk_number": 1, "first_line": 2, "last_line": 3, "x": 1}])
    if rnd.random() < 0.6:
        node["dependencies"] = rnd.choice([["p", None, "q", ""], "p, q,,r", None, []])
    if depth < 5 and rnd.random() < 0.8:
        node["children"] = [rnd.choice([None, make(rnd, depth + 1)]) for _ in range(rnd.randint(0, 3))]
    node["meta"] = {"id": "m1", "children": 4}
    return node


def test_shred_and_assemble_equal_recursion():
    for seed in range(300):
        tree = make(random.Random(seed))
        got = [(k, p, n, v) for k, p, _, n, v, *_ in assemble(shred(tree))]
        assert sorted(got) == sorted(walk(tree))


def test_levels_of_a_small_tree():
    cols = shred({"id": "r", "children": [None, {"id": "a", "children": [{"id": "x"}]}, {}]})
    assert cols[1, ""] == ([0, 1, 1], [1, 2, 2], [None] * 3)
    assert cols[1, "id"] == ([1, 1], [3, 2], ["a", None])
    assert cols[2, ""] == ([1, 1], [4, 2], [None, None])


def test_wrapped_broken_and_repeated_documents(spark):
    tree = {"id": "r", "children": [{"id": "c", "content": {"chunk_number": "1", "first_line": 2}}]}
    docs = [json.dumps(tree), json.dumps({"version": 2, "tree": tree}), json.dumps(json.dumps(tree)), None, "", "{", "[1]", "null", '"x"', "3"]
    rows = [(i, None, t, "a", "b", "c") for i, t in enumerate(docs)]
    got = flatten_trees(spark.createDataFrame(rows + rows, TREES)).collect()
    assert len(got) == 9
    assert {(r.tree_id, r.kind, r.node_path, r.value) for r in got if r.tree_id == 2} == {(2, "node", "0", "r"), (2, "node", "0.0", "c"), (2, "content", "0.0", "1:2:")}
    assert flatten_trees(spark.createDataFrame([], TREES)).count() == 0
    assert shredded_columns(spark.createDataFrame(rows, TREES)).where("path = 'id'").count() == 6


def test_lone_surrogates_and_depth():
    assert [r[4] for r in assemble(shred(root_of('{"id": "a\\ud83d"}')))] == ["a?"]
    deep = '{"id": "n", "children": [' * 3000 + "{}" + "]}" * 3000
    assert len([r for r in assemble(shred(root_of(deep)))]) == 3001


def test_deep_reader_equals_the_library():
    rnd = random.Random(5)
    for _ in range(100):
        text = json.dumps(make(rnd), indent=rnd.choice([None, 2]))
        assert _loads_deep(text) == json.loads(text) == loads(text)
        broken = text[: rnd.randint(0, len(text) - 1)]
        for read in (_loads_deep, loads):
            try:
                read(broken)
                raise AssertionError(broken)
            except ValueError:
                pass
