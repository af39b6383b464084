"""Cutting oversized files and symbols into overlapping pieces at the bounds of symbols."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.keys import normal_word
from codeloom.llm.arrow import struct_lists
from codeloom.llm.cutting import cut, line_starts

SCHEMA = "item_kind string, item_id long, piece_no int, n_pieces int, start_byte long, end_byte long, start_line int, end_line int, piece string"
LIMIT, OVERLAP = 6000, 300


_ARROW = pa.schema(
    [
        ("item_kind", pa.string()), ("item_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_byte", pa.int64()),
        ("end_byte", pa.int64()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("piece", pa.string()),
    ]
)


def _splitter(limit: int, overlap: int, with_text: bool):
    def rows_of(file_id: int, content: str, listed: list[tuple]):
        data = content.encode("utf-8", "surrogatepass")
        starts = line_starts(data)
        n = len(starts) - 1
        spans = sorted({(a, z) for _, a, z in listed if a is not None and z is not None})
        items = [("file", file_id, 0, len(data))]
        for sid, a, z in listed:
            if a is None or z is None or not 1 <= a <= z or a > n:
                continue
            first, last = int(starts[a - 1]), int(starts[min(z, n)])
            if last > first and data[last - 1 : last] == b"\n":
                last -= 2 if data[last - 2 : last] == b"\r\n" and last - 2 >= first else 1
            if last - first > limit:
                items.append(("symbol", sid, first, last))
        for kind, item, first, last in items:
            pieces = cut(data, starts, spans, limit, overlap, first, last)
            for k, (s, e) in enumerate(pieces):
                lines = int(np.searchsorted(starts, s, "right")), int(np.searchsorted(starts, e, "left"))
                yield kind, item, k + 1, len(pieces), s, e, *lines, data[s:e].decode("utf-8", "replace") if with_text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                symbols = struct_lists(b.column("symbols"), "id", "start_line", "end_line")
                rows = [r for f, c, s in zip(b.column("file_id").to_pylist(), b.column("content").to_pylist(), symbols) for r in rows_of(f, c, s)]
                columns = list(zip(*rows)) if rows else [[] for _ in _ARROW]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return run


def split_oversized(contents: DataFrame, symbols: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Pieces of every file, and of every active symbol, whose text has more than `limit` bytes in UTF-8.

    contents: file_id, content; symbols: id, file_id, start_line, end_line, status. Other columns are not read. Returns
    item_kind (`file` or `symbol`), item_id, piece_no from 1, n_pieces, start_byte and end_byte in the file's content,
    start_line and end_line, and the piece's text (null if not with_text). Pieces are at most `limit` bytes, end and start at
    bounds of active symbols where those lie near an equal share, else at lines, else between characters, and share about
    `overlap` bytes, whole lines where lines are short enough; without their overlaps they are the item's text.

    A symbol's text runs from the start of start_line to the end of end_line without the last line end; an end beyond the
    file counts as the file's last line; missing or reversed lines, and a start beyond the file, make it no item. A null or
    empty content gives no pieces. Only symbols of files over the limit are shuffled to their files; a file's pieces are made
    in one task, as they need the whole file.
    """
    if overlap * 2 > limit:
        raise ValueError("overlap must be at most half the limit")
    big = contents.select("file_id", "content").where(F.octet_length("content") > limit)
    live = symbols.where(normal_word(F.col("status")) == "active").select("file_id", F.struct("id", "start_line", "end_line").alias("s")).where("file_id is not null")
    spans = live.join(big.select("file_id").distinct(), "file_id", "left_semi").groupBy("file_id").agg(F.sort_array(F.collect_list("s")).alias("symbols"))
    return big.join(spans, "file_id", "left").select("file_id", "content", "symbols").mapInArrow(_splitter(limit, overlap, with_text), SCHEMA)


def oversized_items(contents: DataFrame, symbols: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """item_kind and item_id of what split_oversized cuts."""
    return split_oversized(contents, symbols, limit, overlap, with_text=False).where("piece_no = 1").select("item_kind", "item_id")
