"""Small helpers for mapInArrow functions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def schema(ddl: str) -> pa.Schema:
    """An Arrow schema from a flat DDL string of the types used here."""
    types = {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
        "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
    }
    return pa.schema([(n, types[t]) for n, t in (c.strip().split(" ") for c in ddl.split(","))])


def emit(rows: Iterable[tuple], to: pa.Schema, every: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= every:
            yield batch(held, to)
            held = []
    if held:
        yield batch(held, to)


def batch(rows: list[tuple], to: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), to)], schema=to)
