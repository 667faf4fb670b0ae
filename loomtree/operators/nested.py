"""Recursive tree documents turned into flat tables, by columnar shredding with repetition and definition levels.

A document becomes one column per leaf path. The paths of a recursive schema are told apart by depth: ``children^k``
is the k-fold repeated child slot, ``children^k.id`` the id of the nodes found there, and so on. A column entry is
(repetition level, definition level, value):

* ``children^k`` has an entry per slot below each node of depth k-1: repetition k for a further slot of the same
  parent, otherwise the parent's own level (0 for the first of a document); definition 2k for a node, 2k-1 for a
  null slot, 2k-2 where the parent has no slots.
* a field of a node (``id`` ...) has an entry per node of depth k: definition 2k+1 if there is a value, else 2k.
* ``content`` and ``dependencies`` repeat below a node: repetition k+1 for a further element of the same node;
  definition 2k without elements, 2k+1 for a null element, 2k+2 for an element, 2k+3 for a number inside it.

Columns of depth k hold entries only for nodes that exist at depth k-1 or k; deeper absence is implied by the column
above, so a wide tree does not pay for the depth of its deepest branch. ``assemble`` walks the level sequences alone:
the m-th entry that does not repeat at the column's own level belongs to the m-th node of the column above.

Both directions run per document in Arrow batches beside the scan; only the removal of repeated rows shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtree.functions.jsondoc import loads
from loomtree.session import ship

NODE_FIELDS = ("id", "title", "node_type", "proves_id")
NUMBERS = ("chunk_number", "first_line", "last_line")
Column = tuple[list[int], list[int], list]
#: Rows per Arrow batch sent back to the JVM.
OUT_ROWS = 20_000


def _text(value) -> str | None:
    """A scalar as text, null for what is no scalar; lone surrogates cannot be stored and are replaced."""
    if value is None or isinstance(value, (dict, list)):
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        value = int(value)
    return str(value).encode("utf-8", "replace").decode("utf-8")


def _number(value) -> str | None:
    return None if isinstance(value, bool) else (_text(value) or "").strip() or None


def root_of(text: str | None):
    """The root object of a document: unwraps JSON stored in a JSON string and an outer object under 'tree'."""
    if text is None:
        return None
    try:
        value = loads(text)
        for _ in range(4):
            if isinstance(value, str):
                value = loads(value)
            elif isinstance(value, dict) and isinstance(value.get("tree"), (dict, str)) and "id" not in value:
                value = value["tree"]
            else:
                break
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _elements(value, split: bool = False) -> list:
    """The elements of a repeated field: a lone value is one element, a string of ids is split at commas."""
    if value is None:
        return []
    if isinstance(value, list):
        return value
    if split and isinstance(value, str):
        return [x.strip() for x in value.split(",")] if value.strip() else []
    return [value]


def shred(root: dict) -> dict[tuple[int, str], Column]:
    """The columns of one document, by (depth, path)."""
    columns: dict[tuple[int, str], Column] = {}

    def put(depth: int, path: str, r: int, d: int, value=None) -> None:
        col = columns.get((depth, path))
        if col is None:
            col = columns[depth, path] = ([], [], [])
        col[0].append(r)
        col[1].append(d)
        col[2].append(value)

    put(0, "", 0, 0)
    level = [(root, 0)]
    depth = 0
    while level:
        below = []
        for node, r in level:
            for name in NODE_FIELDS:
                value = _text(node.get(name))
                put(depth, name, r, 2 * depth + (value is not None), value)
            at = r
            spans = _elements(node.get("content"))
            for item in spans or [None]:
                held = isinstance(item, dict)
                d = 2 * depth + (bool(spans) + held)
                for name in NUMBERS:
                    value = _number(item.get(name)) if held else None
                    put(depth, f"content.{name}", at, d + (value is not None), value)
                at = depth + 1
            at = r
            ids = _elements(node.get("dependencies"), split=True)
            for item in ids or [None]:
                value = _text(item.get("id") if isinstance(item, dict) else item) or None
                put(depth, "dependencies", at, 2 * depth + (bool(ids) + (value is not None)), value)
                at = depth + 1
            at = r
            slots = _elements(node.get("children"))
            for child in slots or [None]:
                held = isinstance(child, dict)
                put(depth + 1, "", at, 2 * depth + (bool(slots) + held))
                if held:
                    below.append((child, at))
                at = depth + 1
        level, depth = below, depth + 1
    return columns


def _positions(column: Column, own: int) -> Iterator[tuple[int, int, int, object]]:
    """(index of the owner, position below it, definition level, value) of each entry, from the levels alone."""
    owner, pos = -1, 0
    for r, d, value in zip(*column):
        if r < own:
            owner, pos = owner + 1, 0
        else:
            pos += 1
        yield owner, pos, d, value


def assemble(columns: dict[tuple[int, str], Column]) -> Iterator[tuple]:
    """Rows (kind, node_path, parent_path, pos, value, title, node_type, proves_id, chunk, first, last)."""
    paths: list[tuple[str, str | None, int]] = [("0", None, 0)]
    depth = 0
    while paths:
        fields = [columns[depth, name][2] for name in NODE_FIELDS]
        for (path, parent, pos), ident, title, kind, proves in zip(paths, *fields):
            yield "node", path, parent, pos, ident or "", title, kind, proves, None, None, None
        numbers = [columns[depth, f"content.{name}"] for name in NUMBERS]
        defined = [numbers[0][1], numbers[1][1], numbers[2][1]]
        for k, (owner, pos, _, chunk) in enumerate(_positions(numbers[0], depth + 1)):
            if max(defined[0][k], defined[1][k], defined[2][k]) >= 2 * depth + 2:
                first, last = numbers[1][2][k], numbers[2][2][k]
                value = f"{chunk or ''}:{first or ''}:{last or ''}"
                path, parent, _ = paths[owner]
                yield "content", path, parent, pos, value, None, None, None, chunk, first, last
        for owner, pos, d, value in _positions(columns[depth, "dependencies"], depth + 1):
            if d == 2 * depth + 2:
                path, parent, _ = paths[owner]
                yield "dependency", path, parent, pos, value, None, None, None, None, None, None
        depth += 1
        slots = columns.get((depth, ""))
        found = _positions(slots, depth) if slots else ()
        paths = [(f"{paths[o][0]}.{pos}", paths[o][0], pos) for o, pos, d, _ in found if d == 2 * depth]


ROWS = (
    "tree_id bigint, run_id bigint, kind string, node_path string, parent_path string, pos int, value string, "
    "title string, node_type string, proves_id string, chunk_number string, first_line string, last_line string"
)
_ARROW = pa.schema(
    [(c, pa.string()) for c in ROWS.replace(" bigint", "").replace(" string", "").replace(" int", "").split(", ")]
)
for _i, _t in ((0, pa.int64()), (1, pa.int64()), (5, pa.int32())):
    _ARROW = _ARROW.set(_i, pa.field(_ARROW.names[_i], _t))


def _flatten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for ident, run, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            root = root_of(text)
            if root is None:
                continue
            rows.extend((ident, run, *row) for row in assemble(shred(root)))
            if len(rows) >= OUT_ROWS:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def flatten_trees(trees: DataFrame) -> DataFrame:
    """All rows of the three flat tables, told apart by ``kind``: see ROWS.

    Defined results: a null, empty or broken document, or one whose root is no object, gives no rows; a document
    delivered twice counts once; null elements give no row but keep their position; a field of unexpected type is
    absent if it is an object or a list, else taken as text; a lone content object or child is a list of one;
    dependencies may be one comma-separated string; empty ids name nothing; ids may be missing or repeated, as rows
    are linked by path; other columns are ignored.
    """
    ship(trees.sparkSession)
    once = trees.select("tree_id", "run_id", "tree_json").where(F.col("tree_json").isNotNull()).distinct()
    return once.mapInArrow(_flatten, ROWS)


def nodes_of(flat: DataFrame) -> DataFrame:
    """The nodes among the rows of ``flatten_trees``, each linked to its parent by path."""
    return flat.where(F.col("kind") == "node").select(
        "tree_id", "run_id", "node_path", "parent_path", "pos", F.col("value").alias("id"), "title", "node_type", "proves_id"
    )


def content_of(flat: DataFrame) -> DataFrame:
    """The content spans, each linked to its node by path; numbers that are none stay null."""
    numbers = [F.expr(f"try_cast({c} AS INT)").alias(c) for c in NUMBERS]
    return flat.where(F.col("kind") == "content").select("tree_id", "run_id", "node_path", "pos", *numbers)


def dependencies_of(flat: DataFrame) -> DataFrame:
    """The named dependencies, each linked to its node by path."""
    return flat.where(F.col("kind") == "dependency").select("tree_id", "run_id", "node_path", "pos", F.col("value").alias("dep_id"))


def tree_nodes(trees: DataFrame) -> DataFrame:
    return nodes_of(flatten_trees(trees))


def tree_content(trees: DataFrame) -> DataFrame:
    return content_of(flatten_trees(trees))


def tree_dependencies(trees: DataFrame) -> DataFrame:
    return dependencies_of(flatten_trees(trees))


LEVELS = "tree_id bigint, depth int, path string, rep array<int>, def array<int>, val array<string>"


def _columns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("tree_id", "depth", "path", "rep", "def", "val")
    types = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
    for batch in batches:
        rows = []
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root = root_of(text)
            if root is not None:
                rows += [(ident, depth, path, *col) for (depth, path), col in shred(root).items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def shredded_columns(trees: DataFrame) -> DataFrame:
    """The columns themselves, one row per document and leaf path: a columnar store of the trees."""
    ship(trees.sparkSession)
    once = trees.select("tree_id", "tree_json").where(F.col("tree_json").isNotNull()).distinct()
    return once.mapInArrow(_columns, LEVELS)
