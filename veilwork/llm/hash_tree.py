"""Hierarchical weighted hash tree: documents descend region, rack and shard by weighted draws.

At each node every child draws -ln(u) / weight, u hashed from the document and the child's
name, and the least draw wins. A child's share is its weight; when weights change, documents
move only into children that gained and out of children that lost, so subtrees whose weights
stay keep their documents' order among themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

Tree = dict[str, dict[str, dict[int, float]]]

#: A regular tree: racks in a region, shards in a rack.
RACKS, SHARDS = 3, 4
#: Hash buckets per shard that slots are counted in.
BUCKETS = 1024


def regular_tree(shards: int, base: int = 24) -> Tree:
    """`base` shards in full racks and regions; each further shard opens a region of its own.

    A region of its own has no older shard below it, so what its weight draws can only go to
    the new shard: counts n and n + 1 >= base differ by moves into shard n alone.
    """
    tree: Tree = {}
    for shard in range(shards):
        if shard < base:
            region, rack = f"region{shard // (RACKS * SHARDS)}", f"rack{shard // SHARDS}"
        else:
            region, rack = f"region-of-{shard}", f"rack-of-{shard}"
        tree.setdefault(region, {}).setdefault(rack, {})[shard] = 1.0
    return tree


def _draw(key: Column, level: str, child: str | int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}/{child}")), 11)
    return -F.ln((bits.cast("double") + 0.5) * 2.0 ** -53) / weight


def _choose(key: Column, level: str, weights: dict) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    drawn = F.array(*[F.struct(_draw(key, level, c, w).alias("d"), F.lit(c).alias("c")) for c, w in weights.items()])
    return F.array_min(drawn)["c"]


def _case(value: Column, results: dict) -> Column:
    """results[value]; the names are the children of one node."""
    first, *rest = results.items()
    return reduce(lambda done, r: done.when(value == r[0], r[1]), rest, F.when(value == first[0], first[1]))


def tree_shard(key: Column, tree: Tree) -> Column:
    """The shard that a 64-bit key descends to. Children of weight 0 get nothing."""
    racks = {r: {k: sum(s.values()) for k, s in ks.items()} for r, ks in tree.items()}
    regions = {r: sum(ks.values()) for r, ks in racks.items()}
    some = lambda weights: {c: w for c, w in weights.items() if w > 0}
    region = _choose(key, "region", some(regions))

    def in_region(r: str) -> Column:
        rack = _choose(key, f"rack/{r}", some(racks[r]))
        return _case(rack, {k: _choose(key, f"shard/{r}/{k}", some(tree[r][k])) for k in some(racks[r])})

    return _case(region, {r: in_region(r) for r in some(regions)})


def hash_tree_shards(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) per row; law `key`.

    The id and the tree decide the shard. size is the text's bytes in UTF-8 plus 8; slots count
    0, 1, ... within a shard. grown_shard is the shard under the tree `grown`, else null.

    Null texts have no bytes and the sum of the empty text. Rows without an id descend by a
    hash of their text, so they spread as well. Rows that repeat an id share a shard and have
    slots of their own. Ties of two draws go to the smaller child; slots within a hash bucket go
    by a hash of id and text, equal rows in any order. Texts of any length are only measured and
    summed. Other columns are ignored, whatever their names; an empty table gives an empty result.
    Slots come from ranks inside hash buckets of a shard, shifted by the sizes of the buckets
    before: no shard is sorted in one task. The table of shifts has shards x BUCKETS rows.
    """
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    key = F.coalesce(F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("long"))), F.xxhash64(whole))
    placed = docs.select(F.col(id_col).alias("id"), (F.octet_length(whole) + 8).cast("long").alias("size"),
                         F.crc32(whole).alias("text_crc32"), key.alias("key"))
    shard = tree_shard(F.col("key"), tree).cast("int")
    placed = placed.select("id", "size", "text_crc32", shard.alias("shard"),
                           (tree_shard(F.col("key"), grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
                           F.pmod(F.xxhash64("key", "text_crc32"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    sizes = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    inner = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(inner))
    return ranked.join(F.broadcast(shifts), ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("shift") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
