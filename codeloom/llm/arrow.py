"""Reading nested Arrow columns as plain Python lists, without a dictionary per element."""

from __future__ import annotations

import pyarrow as pa


def lists(column: pa.Array) -> list[list]:
    """The values of a list column, one Python list per row; an empty one for null."""
    offsets = column.offsets.to_pylist()
    values = column.values.to_pylist()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def struct_lists(column: pa.Array, *fields: str) -> list[list[tuple]]:
    """The values of a list-of-structs column as lists of tuples of the named fields; an empty list for null."""
    offsets = column.offsets.to_pylist()
    parts = [column.values.field(f).to_pylist() for f in fields]
    rows = list(zip(*parts))
    return [rows[a:b] for a, b in zip(offsets, offsets[1:])]
