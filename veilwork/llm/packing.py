"""Packing of tokenised documents: first-fit decreasing over a tournament tree of capacities.

Documents are tokenised where they lie; only piece lengths move. Pieces are dealt to random
groups of about GROUP pieces, and each group is packed on its own, so any number of documents
is packed by as many tasks, and only the last sequences of a group stay partly empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch
from .tokens import tokenised

#: Pieces in a group, on average.
GROUP = 4096


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: longest first, each into the first bin that has room.

    The tree's leaves are the room in each bin, its inner nodes the most room below them: a walk
    from the root finds the first bin that fits.
    """
    order = np.argsort(-lengths, kind="stable")
    size = 1 << max(len(lengths) - 1, 0).bit_length()
    tree = [capacity] * (2 * size)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for item in order.tolist():
        need, node = int(lengths[item]), 1
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[item], offsets[item] = node - size, capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return bins, offsets


def _pieces(path: str, end: int, capacity: int):
    """(id, text) -> (id, start, length, ids_crc32, doc_tokens) per piece of at most `capacity` ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j, ids, bounds in tokenised(batches, 1, path, end):
            raw = np.ascontiguousarray(ids, "<u4")
            tokens = np.diff(bounds)
            pieces = -(-tokens // capacity)
            rows = np.repeat(np.arange(j - i), pieces)
            start = (np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(tokens[rows] - start, capacity)
            first = bounds[rows] + start
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i).take(pa.array(rows)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()),
                 pa.array(tokens[rows])], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        group = table.column("group").to_numpy()
        kept = table.select(["id", "start", "length", "ids_crc32", "doc_tokens"])
        return kept.append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = 4096, end: int = 2,
                   group: int = GROUP) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    Each document is the ids of its whole text under the tokenizer file, then `end`; documents
    longer than `capacity` are cut into full pieces and a rest. Pieces fill sequences of at most
    `capacity` ids without gaps; what is left of a sequence is padding. ids_crc32 is over the
    piece's ids as little-endian unsigned 32-bit numbers.

    Null and empty texts are the end id alone. Rows without an id or with a repeated id are
    documents of their own under that id. Other columns are ignored; an empty table gives an
    empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    pieces = source.mapInArrow(_pieces(tokenizer, end, capacity), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    # Written: the tokenizer runs once, and a lost executor can't deal pieces anew.
    pieces = Scratch(docs.sparkSession, "packing").table(pieces, "pieces")
    groups = max(1, round(pieces.count() / group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    packed = dealt.groupBy("group").applyInArrow(
        _pack(capacity), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
