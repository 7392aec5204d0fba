"""Code points of whole Arrow columns of texts, for numpy work on slices instead of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in a slice, but for a single longer text.
SLICE = 1 << 22


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the row offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def code_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points end to end, row bounds) for slices of a text column."""
    data, offsets = utf8(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = min(max(int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1, first + 1), rows)
        some = data[offsets[first]:offsets[end]]
        codes = np.frombuffer(some.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        points = np.concatenate(([0], np.cumsum((some & 0xC0) != 0x80)))
        yield first, end, codes, points[offsets[first:end + 1] - offsets[first]]
        first = end
