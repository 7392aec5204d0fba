"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence.

The incidence matrix has a row per class of documents with the same shingle set and a column
per shingle. Three bounds that follow from the set sizes empty most of it before any product:

1. Hash order: of its shingles in hash order a document shows the first ones, (110 - s) % of
   them for a similarity of s %. Two linked documents share s / 10 % or more of what either
   shows, so a document that shares less with all others together is out. This pass moves
   hashes, never texts.
2. Size: only columns with two or more rows count, and a row needs s % of its shingles there.
3. Rare first: over columns by rising frequency, linked rows meet in their first
   n - ceil(s n) + 1 places. Rows that meet so, directly or over others, form a candidate group.

Groups are then multiplied block by block: overlaps are accumulated for all rows of two blocks
at once, sparse columns by shifted comparison, dense ones as a matrix product, and pairs below
the size bound are discarded. A task returns a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch
from .components import components
from .kernel import list_array, local_roots, mix, parts, shingle_sets

#: Frequencies above this order by hash alone; it bounds what a task holds of a frequent column.
FREQUENT = 10_000
#: Rows and entries of a block; a task holds two blocks.
BLOCK_ROWS, BLOCK_ENTRIES = 512, 1 << 19
_DENSE = 24


def _least(n, percent: int):
    return -(-n * percent // 100)


def _profiles(k: int, percent: int, whole: bool):
    """Arrow function (id, text) -> (id, n, s1, s2, shingles): the shown ones, or all if `whole`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(1)):
                sizes, one, two, shown = [], [], [], []
                for found in shingle_sets(data, offsets, k):
                    n = len(found)
                    sizes.append(n)
                    mixed = mix(found + np.uint64(0x51ED270B))
                    one.append(int((mixed.sum(dtype=np.uint64) ^ np.uint64(n * 0x9E3779B1)).view(np.int64)))
                    two.append(int(np.bitwise_xor.reduce(mix(mixed), initial=np.uint64(0)).view(np.int64)))
                    show = n if whole else max(n - _least(n, percent) + 1, -(-n * (110 - percent) // 100)) if n else 0
                    shown.append(found[:show])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()),
                     pa.array(two, pa.int64()), list_array(shown)], ["id", "n", "s1", "s2", "shingles"])

    return run


_PROFILE = "id long, n long, s1 long, s2 long, shingles array<long>"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, class) in order -> (class, number of its h that another class has too)."""
    held_h = held_c = None
    met = False
    for batch in batches:
        h, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if held_h is not None:
            h, c = np.concatenate(([held_h], h)), np.concatenate(([held_c], c))
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        h, c = h[keep], c[keep]
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        same[0] = met
        counted = (same[:-1] | same[1:])[:-1]
        held_h, held_c, met = h[-1], c[-1], bool(same[-2])
        found, counts = np.unique(c[:-1][counted], return_counts=True)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts.astype(np.int64))], ["c", "m"])
    if held_h is not None and met:
        yield pa.RecordBatch.from_arrays([pa.array([held_c], pa.int64()), pa.array([1], pa.int64())], ["c", "m"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, class, n) in order -> (class, n, frequency of h, h) for each h of two or more classes."""
    rest, full = None, None
    for batch in batches:
        t = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        yield from _runs(t if rest is None else np.concatenate([rest, t], axis=1), full, False, state := {})
        rest, full = state["rest"], state["full"]
    if rest is not None:
        yield from _runs(rest, full, True, {})


def _runs(t: np.ndarray, full, last: bool, state: dict) -> Iterator[pa.RecordBatch]:
    keep = np.ones(t.shape[1], bool)
    keep[1:] = (t[0, 1:] != t[0, :-1]) | (t[1, 1:] != t[1, :-1])
    t = t[:, keep]
    starts = np.flatnonzero(np.concatenate(([True], t[0, 1:] != t[0, :-1]))) if t.shape[1] else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, t.shape[1]))
    counts = np.repeat(np.minimum(lengths, FREQUENT), lengths)
    if full is not None and t.shape[1] and t[0, 0] == full:
        counts[:lengths[0]] = FREQUENT
    ready = np.ones(t.shape[1], bool)
    state |= {"rest": None, "full": None}
    if not last and len(starts):
        # The last run may go on; a run known to be frequent need not wait for its end.
        if counts[-1] >= FREQUENT:
            state["full"] = t[0, -1]
            ready[-1] = False
            state["rest"] = t[:, -1:]
        else:
            ready[starts[-1]:] = False
            state["rest"] = t[:, starts[-1]:]
    ready &= counts >= 2
    if ready.any():
        yield pa.RecordBatch.from_arrays([pa.array(t[1][ready]), pa.array(t[2][ready]), pa.array(counts[ready]), pa.array(t[0][ready])],
                                         ["c", "n", "f", "h"])


def _incidence(percent: int):
    """Rows (class, n, f, h) by class, rare first -> (class, n, columns, number of meeting places)."""
    def made(t: np.ndarray, starts: np.ndarray):
        ends = np.append(starts[1:], t.shape[1])
        n = t[1][starts]
        count = ends - starts
        # n - count columns have one row and come first; what is left of the prefix is here.
        meet = n - _least(n, percent) + 1 - (n - count)
        ok = np.flatnonzero(meet > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(t[0][starts[ok]]), pa.array(n[ok]), list_array([t[3][starts[i]:ends[i]] for i in ok]), pa.array(meet[ok])],
            ["c", "n", "columns", "meet"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            t = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            if held and t[0, -1] == held[0][0, 0]:
                held.append(t)
                continue
            t = np.concatenate([*held, t], axis=1)
            starts = np.flatnonzero(np.concatenate(([True], t[0, 1:] != t[0, :-1])))
            held = [t[:, starts[-1]:]]
            if len(starts) > 1:
                yield made(t[:, :starts[-1]], starts[:-1])
        if held:
            yield made(np.concatenate(held, axis=1), np.zeros(1, np.int64))

    return run


def overlaps(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """Accumulated products: for each pair of n rows the number of columns they share."""
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    starts = np.flatnonzero(np.concatenate(([True], columns[1:] != columns[:-1]))) if len(rows) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(rows)))
    sparse = np.repeat(lengths <= _DENSE, lengths)
    total = np.zeros(n * n, np.int64)
    r, c = rows[sparse], columns[sparse]
    for shift in range(1, _DENSE):
        same = c[shift:] == c[:-shift]
        if not same.any():
            break
        total += np.bincount(r[:-shift][same] * n + r[shift:][same], minlength=n * n)
    total = total.reshape(n, n)
    total = total + total.T
    dense = np.flatnonzero(lengths > _DENSE)
    for first in range(0, len(dense), 1024):
        some = dense[first:first + 1024]
        matrix = np.zeros((n, len(some)), np.float32)
        for k, i in enumerate(some):
            matrix[rows[starts[i]:starts[i] + lengths[i]], k] = 1
        total += (matrix @ matrix.T).astype(np.int64)
    return total


def _product(percent: int):
    """Rows of two blocks -> (class, root): a spanning forest of the links between them."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("c").to_numpy()
        sizes = table.column("n").to_numpy()
        lists = table.column("columns").combine_chunks()
        rows = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        shared = overlaps(rows, lists.flatten().to_numpy(), len(ids))
        a, b = np.nonzero(np.triu(100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared), 1))
        order = np.argsort(ids)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        root = local_roots(len(ids), rank[a], rank[b])
        away = np.flatnonzero(root != np.arange(len(ids)))
        ids = ids[order]
        return pa.table({"a": ids[away], "b": ids[root[away]]})

    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) per row: near duplicates by word shingles.

    Words are what lies between ASCII white space, A-Z lower-cased. Two documents link when the
    Jaccard similarity of their sets of distinct k-word shingles is `percent` % or more; a
    document with fewer words has its whole sequence as its one shingle. component_id is the
    smallest id reachable over links. All texts are read whole, all linked documents found.

    Null and empty texts have no shingles and link with nothing; a row without an id is
    returned with a null component; rows that repeat an id are one document whose links are
    those of all its rows. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    profile = scratch.table(source.mapInArrow(_profiles(k, percent, False), _PROFILE), "profile")
    members = profile.select("id", "n", "s1", "s2")
    usable = profile.filter("id IS NOT NULL AND n > 0")
    classes = usable.groupBy("s1", "s2", "n").agg(F.min("id").alias("least"))

    shown = usable.select(F.explode("shingles").alias("h"), F.col("s1").alias("c"))
    counted = shown.repartition(F.col("h")).sortWithinPartitions("h", "c").mapInArrow(_shared, "c long, m long")
    enough = counted.groupBy("c").agg(F.sum("m").alias("m"))
    alive = classes.join(enough, classes["s1"] == enough["c"]).filter(
        F.col("m") * 1000 >= F.greatest(F.col("n") * percent, F.lit(1)))
    alive = scratch.table(alive.select("least", F.col("s1").alias("c")), "alive")
    # Sorted and merged at every size: the living documents grow with the input.
    living = source.join(alive.select(F.col("least").alias("id")).distinct().hint("merge"), "id", "left_semi")
    sets = living.select("id", "text").mapInArrow(_profiles(k, percent, True), _PROFILE)
    entries = sets.select(F.explode("shingles").alias("h"), F.col("s1").alias("c"), "n")
    frequent = entries.repartition(F.col("h")).sortWithinPartitions("h", "c").mapInArrow(
        _frequencies, "c long, n long, f long, h long")
    rows = frequent.repartition(F.col("c")).sortWithinPartitions("c", "f", "h").mapInArrow(
        _incidence(percent), "c long, n long, columns array<long>, meet long")
    rows = scratch.table(rows, "rows")

    meeting = rows.select("c", F.explode(F.slice("columns", F.lit(1), F.col("meet").cast("int"))).alias("h"))
    first = meeting.groupBy("h").agg(F.min("c").alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    groups = components(meeting.join(first, "h").select("c", "m"), scratch, "group")
    grouped = scratch.table(rows.join(groups.select(F.col("id").alias("c"), "root"), "c").drop("meet"), "grouped")
    links = _links(grouped, percent)
    joined = components(links, scratch, "link")

    named = classes.select("s1", "s2", "n", "least").join(joined.select(F.col("id").alias("s1"), "root"), "s1", "left")
    named = named.withColumn("root", F.coalesce("root", "s1"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.table(named.join(least, "root").select("s1", "s2", "n", "component_id"), "named")
    scratch.drop("alive", "rows", "grouped")
    linked = members.filter("id IS NOT NULL").join(named, ["s1", "s2", "n"], "left")
    rest = members.filter("id IS NULL").select("id", "n", F.lit(None).cast("long").alias("component_id"))
    return linked.select("id", "n", F.coalesce("component_id", "id").alias("component_id")).unionByName(rest).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _links(grouped: DataFrame, percent: int) -> DataFrame:
    """Spanning forests of all blocks: a group of several blocks is multiplied pair by pair of blocks."""
    sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.sum(F.size("columns")).alias("e")).select(
        "root", F.ceil(F.greatest(F.col("k") / BLOCK_ROWS, F.col("e") / BLOCK_ENTRIES)).cast("int").alias("blocks"))
    placed = grouped.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    other = F.expr("explode(IF(blocks = 1, array(0), filter(sequence(0, blocks - 1), x -> x <> own)))")
    pairs = placed.select("root", "c", "n", "columns", "own", other.alias("other"))
    pairs = pairs.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "c", "n", "columns")
    # Dealt by pairs of blocks: by the group alone, a large one would be one task.
    return pairs.repartition("root", "i", "j").groupBy("root", "i", "j").applyInArrow(_product(percent), "a long, b long")


def drop_near_copies(docs: DataFrame, row: str, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of ngram_join, all columns: the one of the smallest id, nulls last.

    `row` names a column that tells rows apart; documents are linked by it, so null and repeated
    ids take part like others.
    """
    groups = ngram_join(docs, row, text, k, percent).select(row, "component_id")
    ids = docs.select(row, F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("order"), F.col(row).alias("row")).alias("o"))
    members = Scratch(docs.sparkSession, "near-copies").table(groups.join(ids, row), "members")
    least = members.groupBy("component_id").agg(F.min("o").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    dropped = members.join(least, "component_id").filter(F.col("o.row") != F.col("first.row")).select(row)
    return docs.join(dropped.hint("merge"), row, "left_anti")
