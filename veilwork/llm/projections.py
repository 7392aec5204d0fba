"""Near duplicates among vectors by collision-counting projections.

Vectors are projected on many random directions. For each direction one side is sorted, and a
window around each vector of the other side finds those it collides with. Pairs that collide in
enough directions are verified by their cosine. Window and count follow from the distance at the
threshold: the count is the largest that a linked pair reaches with probability RECALL.

One more direction of length 1 routes: linked vectors differ along it by their distance at most,
so only equal or neighbouring slabs of that width meet. Slabs are cut into tiles by hash, and a
task counts one pair of tiles; it returns link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch
from .components import components
from .kernel import local_roots

#: Directions; half the window in units of the distance at the threshold; probability that a
#: pair at the threshold is verified; vectors in a tile.
DIRECTIONS, WINDOW, RECALL, TILE = 32, 1.5, 0.9999, 1024


def least_collisions(directions: int = DIRECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability `recall`."""
    p = math.erf(window / math.sqrt(2))
    reach = 0.0
    for count in range(directions, 0, -1):
        reach += math.comb(directions, count) * p ** count * (1 - p) ** (directions - count)
        if reach >= recall:
            return count
    return 0


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) -> the same; a vector that links with nothing becomes null."""
    for batch in batches:
        column = batch.column(2)
        if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
            kept = []
            labels = batch.column(1).is_valid().to_pylist()
            for i, valid in enumerate(column.is_valid().to_pylist()):
                values = column[i].values if valid and labels[i] else None
                if values is None or values.null_count or not len(values):
                    kept.append(None)
                    continue
                v = values.to_numpy(zero_copy_only=False).astype(np.float64)
                kept.append(v if np.isfinite(v).all() and v.any() else None)
            column = pa.array(kept, pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], ["id", "label", "vector"])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _slabs(width: float):
    """(vector) -> slab along the routing direction."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("vector"))
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            begins = np.cumsum(sizes) - sizes
            slab = np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                route = np.random.default_rng([7, size]).standard_normal(size)
                some = unit(flat[begins[rows][:, None] + np.arange(size)])
                slab[rows] = np.floor(some @ (route / np.linalg.norm(route)) / width)
            yield batch.append_column("slab", pa.array(slab)).append_column("dim", pa.array(sizes.astype(np.int32)))

    return run


def collisions(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """For each pair of rows of the projections a and b the number of directions they collide in."""
    total = np.zeros(len(a) * len(b), np.int64)
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k])
        line = b[order, k]
        low, high = np.searchsorted(line, a[:, k] - half, "left"), np.searchsorted(line, a[:, k] + half, "right")
        counts = high - low
        places = np.arange(counts.sum()) + np.repeat(low - (np.cumsum(counts) - counts), counts)
        total += np.bincount(np.repeat(np.arange(len(a)) * len(b), counts) + order[places], minlength=len(total))
    return total.reshape(len(a), len(b))


def _tile_pair(cosine: float, directions: int, half: float, least: int):
    """Two tiles -> (a, links, null) counts and (a, null, b) forest edges."""
    def run(table: pa.Table) -> pa.Table:
        ids, copies = table.column("class").to_numpy(), table.column("copies").to_numpy()
        first = table.column("first").to_numpy(zero_copy_only=False).astype(bool)
        same = bool(table.column("same")[0].as_py())
        size = table.column("dim")[0].as_py()
        u = unit(table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, size))
        shown = u @ np.random.default_rng([11, size]).standard_normal((size, directions))
        left = np.flatnonzero(first)
        right = left if same else np.flatnonzero(~first)
        near = collisions(shown[left], shown[right], half) >= least
        if same:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        linked = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 15):
            some = slice(at, at + (1 << 15))
            linked[some] = np.einsum("ij,ij->i", u[i[some]], u[j[some]]) >= cosine
        i, j = i[linked], j[linked]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        order = np.argsort(ids)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        root = local_roots(len(ids), rank[i], rank[j])
        away = np.flatnonzero(root != np.arange(len(ids)))
        some = np.flatnonzero(links)
        none = np.full(max(len(some), len(away)), None)
        return pa.table({"a": np.concatenate([ids[some], ids[order][away]]),
                         "links": pa.array(np.concatenate([links[some].astype(np.int64), none[:len(away)]]), pa.int64()),
                         "b": pa.array(np.concatenate([none[:len(some)], ids[order][root[away]]]), pa.int64())})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98,
                 directions: int = DIRECTIONS, window: float = WINDOW, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) per row.

    Two rows link when their labels are equal and their vectors' cosine, in double precision, is
    `cosine` or more. n_links counts the other rows that a row links with, component_id is the
    smallest id reachable over links, kept tells whether that is the row's own. A linked pair is
    missed with a probability below 1 - `recall`; none below the threshold is linked.

    Rows whose label is null or whose vector is null, empty, zero or holds a null or non-finite
    number link with nothing; vectors of different length do not link. Equal vectors are one
    class with a number of copies and never paired. A row without an id takes part in counts,
    but its component_id is null where its whole component has no id. Rows that repeat an id
    count as rows of their own. A cosine that equals the threshold links; of projections that tie
    the order does not matter. Vectors may have any number of dimensions; a task holds a tile of
    them. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "near-vectors")
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    rows = source.mapInArrow(_prepare, "id long, label string, vector array<double>")
    rows = scratch.table(rows.withColumn("s1", F.xxhash64(F.lit(1), "vector")).withColumn("s2", F.xxhash64(F.lit(2), "vector")), "rows")
    key = ["label", "s1", "s2"]
    classes = rows.filter("vector IS NOT NULL").groupBy(*key).agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    distance = math.sqrt(2 - 2 * cosine) * (1 + 1e-9)
    classes = scratch.table(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    placed = classes.select("class", "label", "copies", "vector").mapInArrow(
        _slabs(distance), "class long, label string, copies long, vector array<double>, slab long, dim int")
    placed = scratch.table(placed, "placed")

    where = ["label", "dim", "slab"]
    sizes = placed.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    before = sizes.select("label", "dim", (F.col("slab") + 1).alias("slab"), F.col("tiles").alias("before"))
    after = sizes.select("label", "dim", (F.col("slab") - 1).alias("slab"), F.col("tiles").alias("after"))
    around = scratch.table(sizes.join(before, where, "left").join(after, where, "left"), "tiles")
    tiled = placed.join(around, where).withColumn("own", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    # Pairs of tiles as (slab, tile, slab, tile), the lower first. A row goes to each pair of its tile.
    targets = F.expr("""flatten(array(
        transform(sequence(0, tiles - 1), t -> struct(slab AS s, least(own, t) AS t, slab AS s2, greatest(own, t) AS t2, own <= t AS first)),
        IF(after IS NULL, array(), transform(sequence(0, after - 1), t -> struct(slab AS s, own AS t, slab + 1 AS s2, t AS t2, true AS first))),
        IF(before IS NULL, array(), transform(sequence(0, before - 1), t -> struct(slab - 1 AS s, t AS t, slab AS s2, own AS t2, false AS first)))))""")
    pairs = tiled.select("class", "label", "copies", "vector", "dim", F.explode(targets).alias("p")).select(
        "class", "label", "copies", "vector", "dim", "p.*").withColumn("same", F.expr("s = s2 AND t = t2"))
    by = ["label", "dim", "s", "t", "s2", "t2"]
    found = pairs.repartition(*by).groupBy(*by).applyInArrow(
        _tile_pair(cosine, directions, window * distance, least_collisions(directions, window, recall)), "a long, links long, b long")
    found = scratch.table(found, "found")
    joined = components(found.filter("b IS NOT NULL").select("a", "b"), scratch, "vectors")

    links = found.filter("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    named = classes.drop("vector").join(joined.select(F.col("id").alias("class"), "root"), "class", "left").join(links, "class", "left")
    named = named.withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.table(named.join(least, "root").select(
        *key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "named")
    scratch.drop("placed", "tiles", "found")
    linked = rows.filter("vector IS NOT NULL").select("id", *key).join(named, key).select("id", "n_links", "component_id")
    alone = rows.filter("vector IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
