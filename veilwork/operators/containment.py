"""Which texts contain any of a set of known strings, by equi joins on shared pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.codes import code_slices
from ..session import Scratch

# Pieces are GRAM characters long. Of every run of WINDOW neighbouring pieces the one with the
# lowest hash is kept, so a text that contains a string of GRAM + WINDOW - 1 characters keeps
# one of the string's pieces. Shorter strings have a piece per length: the string itself.
GRAM, WINDOW = 8, 8
SHORT = GRAM + WINDOW - 1
_MULTIPLIER = 0x5851F42D4C957F2D


class _Hashes:
    """Hashes of runs of characters anywhere in texts that lie end to end, from running sums: linear at any size."""

    def __init__(self, codes: np.ndarray):
        powers = np.full(len(codes) + 1, _MULTIPLIER, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self.total[1:])
        powers[:] = pow(_MULTIPLIER, -1, 1 << 64)
        powers[0] = 1
        self.back = np.multiply.accumulate(powers, out=powers)

    def __call__(self, starts: np.ndarray, sizes) -> np.ndarray:
        value = (self.total[starts + sizes] - self.total[starts]) * self.back[starts] + np.asarray(sizes).astype(np.uint64)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        return value ^ (value >> np.uint64(32))


def _starts(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of all runs of `size` characters that lie in one text."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[rows]


def _kept(codes: np.ndarray, bounds: np.ndarray, lengths: list[int], own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash): the lowest over each run of pieces, and those of the short lengths."""
    hashes, found = _Hashes(codes), []
    if own:
        sizes = np.diff(bounds)
        short = np.flatnonzero((sizes > 0) & (sizes < SHORT))
        found.append((short, hashes(bounds[short], sizes[short])))
    for n in lengths:
        rows, starts = _starts(bounds, n)
        found.append((rows, hashes(starts, n)))
    rows, starts = _starts(bounds, SHORT)
    if len(rows):
        pieces = hashes(np.arange(len(codes) - GRAM + 1), GRAM)
        lowest = pieces[:len(pieces) - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            np.minimum(lowest, pieces[k:len(pieces) - WINDOW + 1 + k], out=lowest)
        lowest = lowest[starts]
        # Neighbouring runs mostly share their lowest piece.
        new = np.concatenate(([True], (lowest[1:] != lowest[:-1]) | (rows[1:] != rows[:-1])))
        found.append((rows[new], lowest[new]))
    rows, values = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (values[1:] != values[:-1]))) if len(rows) else np.zeros(0, bool)
    return rows[new], values[new].view(np.int64)


def _pieces(lengths: list[int], own: bool):
    """(row, text) -> (row, piece); `own`: a short string's only piece is itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, codes, bounds in code_slices(batch.column(1)):
                rows, pieces = _kept(codes, bounds, lengths, own)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).take(pa.array(rows)), pa.array(pieces)], ["row", "piece"])

    return run


def known_strings(matches: DataFrame, column: str = "match") -> DataFrame:
    """Distinct trimmed strings that are not empty, as `known`."""
    return matches.select(F.trim(column).alias("known")).filter(F.col("known") != "").distinct()


def relabel_by_containment(texts: DataFrame, matches: DataFrame, key: str, text: str = "text", match: str = "match") -> DataFrame:
    """(key, label) per text: 1 if it contains any known string as it is written, else 0.

    Each known string is looked for by the one of its pieces that the fewest texts have, so a
    line that stands in many texts is no join key unless a string consists of such lines alone;
    then Spark splits it. Candidates are confirmed by the strings themselves. One way at all sizes:
    nothing is collected but the lengths of short strings, which are less than SHORT numbers.
    """
    spark = texts.sparkSession
    scratch = Scratch(spark, "containment")
    known = scratch.table(known_strings(matches, match).withColumn("row", F.monotonically_increasing_id()), "known")
    bodies = scratch.table(texts.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text")), "texts")
    lengths = sorted(r[0] for r in known.select(F.length("known")).filter(F.length("known") < SHORT).distinct().collect())
    wanted = scratch.table(known.select("row", "known").mapInArrow(_pieces([], True), "row long, piece long"), "wanted")
    # Only pieces of known strings are kept of the texts'.
    shared = bodies.select("row", "text").mapInArrow(_pieces(lengths, False), "row long, piece long").join(
        wanted.select("piece").distinct(), "piece", "left_semi")
    shared = scratch.table(shared, "shared")
    often = shared.groupBy("piece").agg(F.count(F.lit(1)).alias("texts"))
    # A string one of whose pieces no text has is in none.
    rated = wanted.join(often, "piece", "left")
    anchors = rated.groupBy("row").agg(F.min_by("piece", F.struct(F.coalesce("texts", F.lit(0)).alias("n"), "piece")).alias("piece"),
                                       F.count_if(F.col("texts").isNull()).alias("absent")).filter("absent = 0")
    pairs = shared.join(anchors.select(F.col("row").alias("string"), "piece"), "piece").select("row", "string")
    candidates = pairs.join(known.select(F.col("row").alias("string"), "known"), "string").join(bodies.select("row", "text"), "row")
    hits = candidates.filter(F.contains("text", F.col("known"))).select("row").distinct()
    marked = bodies.select("row", "key").join(hits.withColumn("_hit", F.lit(1)), "row", "left")
    return marked.select(F.col("key").alias(key), F.coalesce("_hit", F.lit(0)).alias("label"))
