"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

Texts are folded to lower-case letters and single spaces. Spark counts the 4-grams of each
language; lower orders follow from them as continuation counts. Nothing is left out: tasks
interpolate the orders for all n-grams with the same inner characters, by tables of hashes found
by binary search, which gives what every 4-gram of the texts costs by language. The frequent
ones' costs are broadcast, the others' joined to the texts that have them; the sums are of whole
numbers, so it is the same which are which. A text gets the language of lowest cross-entropy per character. It is rejected when that is
farther above its language's usual cross-entropy than calibration on the learning texts allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch
from .kernel import mix, parts

#: Costs (4-grams x languages) that are broadcast; those of rarer 4-grams are joined.
CELLS = 1 << 22
#: Costs are whole numbers of 1 / UNIT bits.
UNIT = 1 << 24
#: Rejection starts half-way between this quantile of the learning texts' cross-entropy and
#: what a text costs without any model.
QUANTILE = 0.999
#: Characters up to which a longer text counts as better evidence, and characters at the usual
#: cross-entropy that every text is credited with before it is rejected.
EVIDENCE, CREDIT = 256, 50
_OUTSIDE = 0xFFFF


def letter_table() -> np.ndarray:
    """16-bit code point -> its lower-case letter, or space for what is no letter."""
    table = np.full(65536, 32, np.uint64)
    for code in range(0xFFFF):
        letter = chr(code)
        if letter.isalpha():
            lower = letter.lower()
            table[code] = ord(lower) if len(lower) == 1 else ord(lower[0])
    return table


def folded_grams(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each folded character, 16 bits a character, and the row bounds.

    Before a row stand spaces. A row without letters has no characters.
    """
    lead = (data & 0xC0) != 0x80
    places = np.concatenate(([0], np.cumsum(lead)))[offsets]
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    c = table[np.minimum(codes, 0xFFFF)]
    outside = np.flatnonzero(codes > 0xFFFF)
    if len(outside):
        # Letters beyond 16 bits share one code.
        found, which = np.unique(codes[outside], return_inverse=True)
        c[outside] = np.array([_OUTSIDE if chr(x).isalpha() else 32 for x in found], np.uint64)[which]
    before = np.empty_like(c)
    before[1:] = c[:-1]
    starts = places[:-1][places[:-1] < len(c)]
    before[starts] = 32
    keep = (c != 32) | (before != 32)
    bounds = np.concatenate(([0], np.cumsum(keep)))[places]
    c = c[keep]
    gram = c.copy()
    row_start = np.repeat(bounds[:-1], np.diff(bounds))
    into = np.arange(len(c)) - row_start
    for back in (1, 2, 3):
        earlier = np.full(len(c), 32, np.uint64)
        earlier[back:] = c[:-back] if len(c) > back else c[:0]
        earlier[into < back] = 32
        gram |= earlier << np.uint64(16 * back)
    return gram, bounds


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their (summed) counts."""
    codes, found = pd.factorize(keys)
    return found, np.bincount(codes, counts, len(found)).astype(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n), each pair about once per task."""
    table = letter_table()
    held: dict[str, list] = {}

    def flush(limit: int):
        for lang, kept in held.items():
            if sum(len(k) for k, _ in kept) > limit:
                keys, counts = tally(np.concatenate([k for k, _ in kept]), np.concatenate([n for _, n in kept]))
                kept[:] = [(keys, counts)]
                if len(keys) > limit or not limit:
                    kept[:] = []
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int32))), pa.array(keys.view(np.int64)), pa.array(counts)],
                        ["lang", "gram", "n"])

    for batch in batches:
        for i, j, data, offsets in parts(batch.column(1), 1 << 21):
            grams, bounds = folded_grams(data, offsets, table)
            codes, langs = pd.factorize(batch.column(0).slice(i, j - i).to_pandas())
            at = np.repeat(codes, np.diff(bounds))
            for code, lang in enumerate(langs):
                held.setdefault(lang, []).append(tally(grams if len(langs) == 1 else grams[at == code]))
            yield from flush(1 << 20)
    yield from flush(0)


class Model:
    """Tables of adjoining orders: sorted hashes, counts (n-gram x language), contexts with sums and types."""

    def __init__(self, langs: list[str], grams: list[tuple[np.ndarray, np.ndarray]], orders: tuple[int, ...] = (1, 2, 3, 4),
                 discounts: dict[int, np.ndarray] | None = None):
        """`grams`: per language the packed n-grams of the highest order and their counts.

        They may be a part of all, if that has every n-gram with the inner characters of one of
        its n-grams; `discounts` are then those of all.
        """
        self.langs, self.orders = langs, []
        current = grams
        for order in reversed(orders):
            self.orders.insert(0, (order, self._order(current, discounts and discounts[order])))
            mask = np.uint64((1 << 16 * (order - 1)) - 1)
            current = [tally(keys & mask) for keys, _ in current]
        self.alphabet = max(len(self.orders[0][1]["hashes"]), 1) + 1

    @staticmethod
    def _order(grams, discounts: np.ndarray | None) -> dict:
        keys = np.unique(np.concatenate([k for k, _ in grams]))
        heads = keys >> np.uint64(16)
        contexts = np.unique(heads)
        counts = np.zeros((len(keys), len(grams)))
        sums = np.zeros((len(contexts), len(grams)))
        types = np.zeros_like(sums)
        for lang, (k, n) in enumerate(grams):
            counts[np.searchsorted(keys, k), lang] = n
            at = np.searchsorted(contexts, k >> np.uint64(16))
            sums[:, lang] = np.bincount(at, n, len(contexts))
            types[:, lang] = np.bincount(at, minlength=len(contexts))
        if discounts is None:
            discounts = np.array([discount(float((n == 1).sum()), float((n == 2).sum())) for _, n in grams])
        # Order 1 has one context, the empty one; all its keys shift to 0.
        hashes, places = mix(keys), mix(contexts)
        by, at = np.argsort(hashes), np.argsort(places)
        return {"hashes": hashes[by], "counts": counts[by], "places": places[at], "sums": sums[at], "types": types[at], "discounts": discounts}

    @staticmethod
    def _find(hashes: np.ndarray, keys: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Rows of `table` by key, 0 where there is none."""
        if not len(hashes):
            return np.zeros((len(keys), table.shape[1]))
        wanted = mix(keys)
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return np.where((hashes[at] == wanted)[:, None], table[at], 0)

    def chances(self, grams: np.ndarray, p: np.ndarray | float) -> np.ndarray:
        """Probability of the last character of each packed n-gram by language; `p` is that of the order below."""
        for order, t in self.orders:
            keys = grams & np.uint64((1 << 16 * order) - 1)
            heads = keys >> np.uint64(16)
            counts, sums = self._find(t["hashes"], keys, t["counts"]), self._find(t["places"], heads, t["sums"])
            mass = t["discounts"] * self._find(t["places"], heads, t["types"])
            p = np.where(sums > 0, (np.maximum(counts - t["discounts"], 0) + mass * p) / np.maximum(sums, 1), p)
        return p

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits that each language takes for the last character of each packed 4-gram."""
        return -np.log2(self.chances(grams, 1.0 / self.alphabet))


def discount(one: float, two: float) -> float:
    """What Kneser-Ney takes off each count, from how many n-grams were seen once and twice."""
    return min(max(one / (one + 2 * two) if one else 0.5, 0.1), 0.9)


def _whole_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their column `part` in pieces of about `limit` rows that split no part."""
    held, most = [], limit
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            rows = pa.Table.from_batches(held)
            part = rows.column("part").to_numpy()
            cut = int(np.searchsorted(part, part[-1]))
            if cut:
                yield from rows.slice(0, cut).combine_chunks().to_batches()
            held, most = rows.slice(cut).combine_chunks().to_batches(), max(limit, 2 * (len(part) - cut))
    if sum(b.num_rows for b in held):
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _chances(shared, top: int):
    """(part, gram, found, below) sorted by part -> (gram, p): the chance of each n-gram by language.

    top 2: bigrams, on top of the order 1 that is shared. top 4: 4-grams, on top of the
    bigrams' chances in `below`. A part has all n-grams with the same inner characters.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, letters, discounts = shared.value
        first = Model(langs, letters, (1,), discounts)
        for rows in _whole_groups(batches, max((1 << 21) // len(langs), 1)):
            keys = rows.column("gram").to_numpy().view(np.uint64)
            found = rows.column("found")
            name, n = found.flatten().flatten()
            code = pa.compute.fill_null(pa.compute.index_in(name, pa.array(langs, pa.string())), -1).to_numpy()
            row, n = np.repeat(np.arange(len(keys)), pa.compute.list_value_length(found).to_numpy()), n.to_numpy()
            grams = [(keys[row[code == k]], n[code == k]) for k in range(len(langs))]
            if top == 2:
                p = Model(langs, grams, (2,), discounts).chances(keys, first.chances(keys, 1.0 / first.alphabet))
            else:
                below = rows.column("below").flatten().to_numpy().reshape(len(keys), len(langs))
                p = Model(langs, grams, (3, 4), discounts).chances(keys, below)
            ends = pa.array(np.arange(0, p.size + 1, len(langs), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([rows.column("gram"), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], ["gram", "p"])

    return run


def _chance_table(rows: DataFrame, shared, top: int) -> DataFrame:
    """(gram, p) from (gram, found) and, for 4-grams, below."""
    part = F.shiftrightunsigned("gram", 16).bitwiseAND(F.lit((1 << 32) - 1))
    dealt = rows.withColumn("part", part).repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(_chances(shared, top), "gram long, p array<double>")


def train(source: DataFrame, learns: Column, scratch: Scratch) -> tuple[list[str], int, DataFrame] | None:
    """(languages, alphabet, costs) from the rows (text, lang) that `learns` holds for; None without languages.

    costs has every 4-gram of all texts: (gram, total, cost), where cost is what the last
    character takes by language, in whole numbers of 1 / UNIT bits. All of the model is made
    of all 4-grams in Spark; to the driver come only discounts and the counts of single letters.
    """
    # A language travels with a mark before it; no mark: a 4-gram of other texts, not counted in the model.
    rows = source.filter("text IS NOT NULL").select(F.when(learns, F.concat(F.lit("="), "lang")).otherwise("").alias("lang"), "text")
    rows = rows.mapInArrow(_count_grams, "lang string, gram long, n long")
    order = {4: scratch.table(rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")}
    for k in (3, 2, 1):
        short = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
        order[k] = order[k + 1].groupBy("lang", short.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        if k == 2:
            order[k] = scratch.table(order[k], "bigrams")
    seen = {k: {r["lang"]: r for r in t.filter("lang <> ''").groupBy("lang").agg(
        F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()} for k, t in order.items()}  # a row a language
    langs = sorted(seen[4])
    if not langs:
        return None
    discounts = {k: np.array([discount(float(r[x]["one"]), float(r[x]["two"])) for x in langs]) for k, r in seen.items()}
    letters = order[1].filter("lang <> ''").toArrow()  # at most 65,536 a language
    names = letters.column("lang").to_pandas().to_numpy()
    keys, n = letters.column("gram").to_numpy().view(np.uint64), letters.column("n").to_numpy()
    alphabet = len(np.unique(keys)) + 1
    shared = source.sparkSession.sparkContext.broadcast((langs, [(keys[names == x], n[names == x]) for x in langs], discounts))
    found = F.collect_list(F.struct("lang", "n")).alias("found")  # at most an entry a language
    pairs = _chance_table(order[2].groupBy("gram").agg(found), shared, 2).select(F.col("gram").alias("pair"), F.col("p").alias("below"))
    pair = F.col("gram").bitwiseAND(F.lit((1 << 32) - 1))
    grams = order[4].groupBy("gram").agg(found).withColumn("pair", pair).join(pairs, "pair").drop("pair")
    cost = F.transform("p", lambda p: F.round(-F.log2(p) * UNIT).cast("long")).alias("cost")
    totals = order[4].groupBy("gram").agg(F.sum("n").alias("total"))
    costs = _chance_table(grams, shared, 4).join(totals, "gram").select("gram", "total", cost)
    costs = scratch.table(costs, "costs")
    scratch.drop("grams", "bigrams")
    return [x[1:] for x in langs], alphabet, costs


def _level() -> Column:
    return F.floor(8 * F.log2("total")).cast("int")


def frequent(costs: DataFrame, langs: int) -> int:
    """The level of count from which on 4-grams are broadcast: at most CELLS costs."""
    steps = costs.groupBy(_level().alias("level")).count().collect()  # at most 512
    least, kept = max((r["level"] for r in steps), default=0) + 1, 0
    for r in sorted(steps, key=lambda r: -r["level"]):
        kept += r["count"] * langs
        if kept > CELLS:
            return least
        least = r["level"]
    return 0


def _partial(shared):
    """(id, text, lang, held) -> the same without text, a row number, characters, bits by language, 4-grams not shared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (keys, costs) = letter_table(), shared.value
        tag = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(1), 1 << 21):
                grams, bounds = folded_grams(data, offsets, table)
                codes, found = pd.factorize(grams)
                at = np.searchsorted(keys, found)
                at[at < len(keys)] = np.where(keys[at[at < len(keys)]] == found[at < len(keys)], at[at < len(keys)], len(keys))
                n = np.diff(bounds)
                rows = np.repeat(np.arange(j - i), n)
                place = at[codes]
                # The last cost of each language is 0, for all 4-grams that are not shared.
                bits = np.stack([np.bincount(rows, one[place], j - i) for one in costs], axis=1).astype(np.int64)
                apart = place == len(keys)
                pairs, times = np.unique(rows[apart] * len(found) + codes[apart], return_counts=True)
                other = pa.StructArray.from_arrays([pa.array(found[pairs % max(len(found), 1)].view(np.int64)), pa.array(times)], ["gram", "n"])
                ends = np.searchsorted(pairs, np.arange(j - i + 1) * max(len(found), 1)).astype(np.int32)
                lengths = np.arange(0, bits.size + 1, len(costs), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), batch.column(3).slice(i, j - i),
                     pa.array(tag + np.arange(j - i)), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(lengths), pa.array(bits.ravel())), pa.ListArray.from_arrays(pa.array(ends), other)],
                    ["id", "lang", "held", "tag", "chars", "bits", "other"])
                tag += j - i

    return run


def _score(source: DataFrame, langs: list[str], costs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, lang, held, pred, entropy, score, chars) of each text; costs of rare 4-grams are joined."""
    least = frequent(costs, len(langs))
    kept = costs.filter(_level() >= least).select("gram", "cost").toArrow().combine_chunks()
    keys = kept.column("gram").to_numpy().view(np.uint64)
    by, flat = np.argsort(keys), pa.compute.list_flatten(kept.column("cost")).to_numpy()
    table = np.zeros((len(langs), len(keys) + 1))
    table[:, :-1] = flat.reshape(len(keys), len(langs))[by].T
    kind = source.schema["id"].dataType.simpleString()
    texts = source.mapInArrow(_partial(source.sparkSession.sparkContext.broadcast((keys[by], table))),
                              f"id {kind}, lang string, held boolean, tag long, chars long, bits array<long>, other array<struct<gram:long,n:long>>")
    if least:
        texts = scratch.table(texts, "partial")
        other = texts.select("tag", F.explode("other").alias("o")).select("tag", "o.gram", "o.n")
        other = other.join(costs.filter(_level() < least).select("gram", "cost"), "gram").groupBy("tag").agg(
            F.array(*[F.sum(F.col("n") * F.col("cost")[k]) for k in range(len(langs))]).alias("more"))
        bits = F.when(F.col("more").isNull(), F.col("bits")).otherwise(F.zip_with("bits", "more", lambda x, y: x + y))
        texts = texts.join(other, "tag", "left").withColumn("bits", bits)
    texts = texts.withColumn("costs", F.transform("bits", lambda x: x / F.greatest("chars", F.lit(1)) / UNIT))
    texts = texts.withColumn("entropy", F.array_min("costs"))
    best = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("costs", F.col("entropy")).cast("int"))
    weight = F.least("chars", F.lit(EVIDENCE))
    odds = F.transform("costs", lambda x: F.pow(F.lit(2.0), F.greatest(weight * (F.col("entropy") - x), F.lit(-1000.0))))
    score = 1 / F.aggregate(odds, F.lit(0.0), lambda x, y: x + y)
    some = F.col("chars") > 0
    scored = scratch.table(texts.select("id", "lang", "held", F.when(some, best).alias("pred"), "entropy",
                                        F.when(some, score).otherwise(0.0).alias("score"), "chars"), "scored")
    scratch.drop("costs", *(["partial"] if least else []))
    return scored


def language_id(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", held_out: Column | None = None,
                row: str | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score, cross_entropy, rejected) per row.

    Learns from texts with a language that are not `held_out` (by default none are). score is
    the posterior of the language, 0 to 1, with a text's evidence capped at EVIDENCE characters.
    cross_entropy is in bits a character. rejected: no letters, or a cross-entropy nearer to that
    of random letters than to the QUANTILE among learning texts of the language, where a text is
    credited with CREDIT more characters at that quantile.

    Null texts and texts without letters get `und`, score 0, and are rejected. Rows without an
    id count as held out when `held_out` is null. Repeated rows are predicted alike, ties go to the
    first language by name. Texts are whole whatever their length; a task holds a slice of them, or
    one longer text. Without any language to learn, all are `und` with score 0 and only texts
    without letters are rejected. Other columns are ignored, whatever their names; an empty table
    gives an empty result. `row` names a column to
    return beside the id.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(True)) if held_out is not None else F.lit(False)
    # The text of a file may not be what Spark can decode; make it valid UTF-8 once.
    source = docs.select(F.struct(F.col(id_col).alias("id"), *([F.col(row).alias("row")] if row else [])).alias("id"),
                         F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), held.alias("held"))
    scratch = Scratch(spark, "language-id")
    model = train(source, F.expr("NOT held AND lang IS NOT NULL"), scratch)
    back = [F.col("id.id").alias(id_col), *([F.col("id.row").alias(row)] if row else [])]
    if model is None:
        scratch.drop("grams", "bigrams")
        letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
        return source.select(*back, F.col("held").alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                             F.lit(None).cast("double").alias("cross_entropy"), (~letters).alias("rejected"))
    langs, alphabet, costs = model
    scored = _score(source, langs, costs, scratch)
    sure = scored.filter("NOT held AND lang = pred")
    blind = float(np.log2(alphabet))
    usual = sure.groupBy("pred").agg(F.percentile_approx("entropy", QUANTILE, 10_000).alias("q")).collect()  # a row a language
    quantile = {r["pred"]: r["q"] for r in usual}
    above = F.create_map(*[F.lit(x) for kv in (quantile or {"": 0.0}).items() for x in kv])[F.col("pred")]
    excess = (F.col("entropy") - above) * F.col("chars") / (F.col("chars") + CREDIT)
    return scored.select(*back, F.col("held").alias("held_out"), F.coalesce("pred", F.lit("und")).alias("lang_pred"), "score",
                         F.when(F.col("pred").isNotNull(), F.col("entropy")).alias("cross_entropy"),
                         F.coalesce(excess > F.greatest(F.lit(blind) - above, F.lit(1.0)) / 2, F.col("pred").isNull()).alias("rejected"))


def drop_rejected(docs: DataFrame, row: str, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `docs` that language_id does not reject, all columns; `row` tells them apart."""
    rejected = language_id(docs, id_col, text, lang, row=row).filter("rejected").select(F.col(row))
    return docs.join(rejected.hint("merge"), row, "left_anti")
