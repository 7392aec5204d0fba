"""Alignment of two tokenizers: byte offsets at which tokens of both end cut a text into groups.

A text with a space before it is cut into units before each single space between two characters
that are no white space. Both tokenizers end a token there: the byte-level one starts a new piece,
and no entry of the piece vocabulary has its space mark behind another character (checked when
the vocabulary is read). So a text's tokens and groups are those of its units in order, and a
worker needs to tokenise and align each distinct unit about once.

A unit is aligned by end-to-index dictionaries: the cumulative ends of its tokens under either
tokenizer are the keys, the intersection of the two key sets in order is where groups end. How
often a pair of ids is linked is added up over blocks of documents; what a block's units need to
know of the whole corpus comes back to it as one row per distinct pair.
"""

from __future__ import annotations

import hashlib
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch
from .kernel import list_array, parts, range_hashes

#: Bytes of text in a block, but for a single longer text.
BLOCK = 1 << 22
#: Distinct units a worker remembers before it starts anew, about 150 bytes each.
REMEMBERED = 1 << 18
#: Distinct units tokenised as one text.
TOGETHER = 2048


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 ones stand for
    themselves, the other bytes in order for the letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_entries(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    letters = byte_letters()
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, number in vocabulary.items():
        out[number] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
    return out


def piece_entries(model) -> list[bytes]:
    """The bytes of each id of a piece vocabulary: U+2581 is a space, <0xHH> a byte."""
    out = []
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        if "▁" in piece.lstrip("▁"):
            raise ValueError("a piece has its space mark behind another character")
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(number) else piece.replace("▁", " ").encode())
    return out


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where units start in texts that lie end to end; every text starts one.

    A byte next to the space counts only if it surely is no white space: printable ASCII, a
    two-byte character beyond U+00BF, or, behind the space, the first byte of a longer character
    that Unicode has no white space under.
    """
    plain = np.zeros(256, bool)
    plain[0x21:0x7F] = True
    two = np.zeros(256, bool)
    two[0xC3:0xE0] = True
    after = plain | two
    after[0xE4:0xF5] = True
    starts = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        before = plain[data[:-2]]
        before[1:] |= two[data[:-3]] & ((data[1:-2] & 0xC0) == 0x80)
        starts[1:-2] = (data[1:-1] == 32) & before & after[data[2:]]
    starts[bounds] = True
    return np.flatnonzero(starts[:-1])


def _closed(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether units end as they do before another one; a text's last unit may end in white space."""
    last, before = data[offsets[1:] - 1], data[np.maximum(offsets[1:] - 2, 0)]
    return (last >= 0x21) & (last < 0x7F) | (last >= 0x80) & (before >= 0xC3) & (before < 0xE0) & (np.diff(offsets) > 1)


class Aligned:
    """Groups of distinct units under two tokenizers, remembered by two 64-bit hashes."""

    def __init__(self, byte_bpe: str, piece_model: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.a_bytes, self.b_bytes = byte_entries(self.a.get_vocab()), piece_entries(self.b)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in some], np.int64) for some in (self.a_bytes, self.b_bytes))
        self.numbers = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.forget()

    def forget(self) -> None:
        self.hashes, self.checks, self.row = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        # Per unit: tokens of either kind, groups (-1 if the bytes differ), and where its pairs begin.
        self.n_a, self.n_b, self.groups = (np.zeros(0, np.int32) for _ in range(3))
        self.begins, self.pairs, self.texts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)

    def align(self, units: list[bytes]) -> tuple:
        """(n_a, n_b, groups, pairs of ids that end together, groups as text) of units: counts as arrays,
        the pairs end to end, a text each. Groups are -1 where the bytes differ. All but the last unit must be closed.
        """
        whole = b"".join(units)
        text = whole.decode()
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            half = len(units) // 2
            if not half:
                return np.zeros(1, np.int32), np.zeros(1, np.int32), np.full(1, -1, np.int32), np.zeros(0, np.int64), [b""]
            return tuple(x + y if isinstance(x, list) else np.concatenate([x, y])
                         for x, y in zip(self.align(units[:half]), self.align(units[half:])))
        index_a = dict(zip(np.cumsum(self.a_sizes[a]).tolist(), range(1, len(a) + 1)))
        index_b = dict(zip(np.cumsum(self.b_sizes[b]).tolist(), range(1, len(b) + 1)))
        common = sorted(index_a.keys() & index_b.keys())
        stops_a, stops_b = [index_a[e] for e in common], [index_b[e] for e in common]
        # No token is empty, so each slice links just its last tokens.
        pairs = (np.array(a, np.int64)[np.array(stops_a) - 1] << 32) | np.array(b, np.int64)[np.array(stops_b) - 1]
        number = self.numbers.__getitem__
        a, b = list(map(number, a)), list(map(number, b))
        groups = [",".join(a[i:p]) + "|" + ",".join(b[j:q]) for i, p, j, q in zip([0, *stops_a], stops_a, [0, *stops_b], stops_b)]
        ends = np.cumsum([len(u) for u in units])
        last = np.searchsorted(common, ends)
        if not np.array_equal(np.array(common)[last], ends):
            raise AssertionError("a unit does not end with tokens of both kinds")
        bounds = [0, *(last + 1).tolist()]
        texts = [";".join(groups[i:j]).encode() for i, j in zip(bounds, bounds[1:])]
        counts = [np.diff(x, prepend=0).astype(np.int32) for x in (np.array(stops_a)[last], np.array(stops_b)[last], last + 1)]
        return *counts, pairs, texts

    def places(self, units: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The remembered rows of distinct units."""
        hashes = range_hashes(data, offsets[:-1], offsets[1:])
        checks = range_hashes(data, offsets[:-1], offsets[1:], 0xD1342543DE82EF95)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero((self.hashes[at] != hashes) | (self.checks[at] != checks)) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            # Closed units many at a time, the others one by one.
            closed = _closed(data, offsets)[new]
            new = np.concatenate((new[closed], new[~closed]))
            n, limits = int(closed.sum()), []
            limits = [*range(0, n, TOGETHER), *range(n, len(new)), len(new)]
            done = [self.align(units.take(pa.array(new[i:j])).to_pylist()) for i, j in zip(limits, limits[1:])]
            n_a, n_b, groups, pairs = (np.concatenate(x) for x in list(zip(*done))[:4])
            sizes = np.maximum(groups, 0).astype(np.int64)
            begins = len(self.pairs) + np.cumsum(sizes) - sizes
            texts = np.empty(len(new), object)
            texts[:] = [t for x in done for t in x[4]]
            rows = (np.arange(len(new)) + len(self.n_a)).astype(np.int32)
            self.n_a, self.n_b = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b])
            self.groups, self.begins = np.concatenate([self.groups, groups]), np.concatenate([self.begins, begins])
            self.pairs, self.texts = np.concatenate([self.pairs, pairs]), np.concatenate([self.texts, texts])
            merged = [np.concatenate(x) for x in ((self.hashes, hashes[new]), (self.checks, checks[new]), (self.row, rows))]
            order = np.argsort(merged[0], kind="stable")
            self.hashes, self.checks, self.row = (x[order] for x in merged)
            at = np.searchsorted(self.hashes, hashes)
            at += self.checks[at] != checks  # of two units with one hash, the second
        return self.row[at]


def worker_units(byte_bpe: str, piece_model: str) -> Aligned:
    """This Python worker's units, kept from task to task where Spark reuses the worker."""
    kept = sys.modules.setdefault("_veilwork_units", type(sys)("_veilwork_units")).__dict__
    key = f"{byte_bpe}\n{piece_model}"
    if key not in kept:
        kept.clear()
        kept[key] = Aligned(byte_bpe, piece_model)
    return kept[key]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of each run, end to end."""
    return np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)


def _blocks(byte_bpe: str, piece_model: str, texts: bool):
    """(part, id, space + text) -> a row per document with its units' numbers in the block, and a
    row per block with the pairs of its units and how often each pair is linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = worker_units(byte_bpe, piece_model), 0
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(2), BLOCK):
                block += 1
                sizes = np.diff(offsets)
                starts = unit_starts(data, offsets[:-1][sizes > 0])
                bounds = np.searchsorted(starts, offsets)
                places = np.concatenate((starts, [len(data)])).astype(np.int32)
                coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
                codes, units = coded.indices.to_numpy(), coded.dictionary
                _, where, raw = units.buffers()
                where = np.frombuffer(where, np.int32)[units.offset:units.offset + len(units) + 1].astype(np.int64)
                row = known.places(units, np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8), where)
                groups = known.groups[row]
                fit = (sizes > 1) & (_sums(groups[codes] < 0, bounds) == 0)
                lists = [codes[a:b] if ok else codes[:0] for a, b, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), fit.tolist())]
                words = known.texts[row]
                joined = [b";".join(words[some].tolist()) if ok else b"" for some, ok in zip(lists, fit.tolist())]
                digests = [hashlib.sha256(t).hexdigest() if ok else "" for t, ok in zip(joined, fit.tolist())]
                links = np.where(fit, _sums(np.maximum(groups, 0)[codes], bounds), 0)
                counts = np.maximum(groups, 0).astype(np.int64)
                pairs, inverse = np.unique(known.pairs[_spread(known.begins[row], counts)], return_inverse=True)
                used = np.bincount(codes[np.repeat(fit, np.diff(bounds))], minlength=len(units))
                times = np.bincount(inverse, np.repeat(used, counts), len(pairs)).astype(np.int64)
                n = j - i

                def only(values, empty):
                    return pa.concat_arrays([values, empty])

                columns = {
                    "part": pa.array(np.full(n + 1, batch.column(0)[0].as_py(), np.int32)), "block": pa.array(np.full(n + 1, block, np.int64)),
                    "document": pa.array([True] * n + [False]),
                    "id": only(batch.column(1).slice(i, n), pa.nulls(1, batch.column(1).type)),
                    "n_a": pa.array(np.append(np.where(fit, _sums(known.n_a[row][codes], bounds), 0), 0)),
                    "n_b": pa.array(np.append(np.where(fit, _sums(known.n_b[row][codes], bounds), 0), 0)),
                    "n_links": pa.array(np.append(links, 0)), "groups_sha256": pa.array(digests + [""]),
                    # A document's units; in the block's row the pairs of each of its units, end to end.
                    "units": list_array([x.astype(np.int32) for x in lists] + [inverse.astype(np.int32)], pa.int32()),
                    "sizes": list_array([codes[:0].astype(np.int32)] * n + [counts.astype(np.int32)], pa.int32()),
                    "pairs": list_array([pairs[:0]] * n + [pairs]), "times": list_array([times[:0]] * n + [times]),
                }
                if texts:
                    columns["groups"] = pa.array([t.decode() for t in joined] + [""])
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _scores(table: pa.Table, known: pa.Table) -> pa.Table:
    """The documents of one block with what the corpus says of the pairs they link."""
    whole = table.filter(pc.invert(table["document"])).slice(0, 1)
    rows = table.filter(table["document"])
    places = known["place"].to_numpy()
    total, best = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    total[places], best[places] = known["total"].to_numpy(), known["best"].to_numpy()
    pairs = whole["units"].combine_chunks().flatten().to_numpy()
    sizes = whole["sizes"].combine_chunks().flatten().to_numpy().astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    lists = rows["units"].combine_chunks()
    units, bounds = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    out = rows.drop_columns(["part", "block", "document", "units", "sizes", "pairs", "times"])
    for name, values in (("n_best", best), ("count_sum", total)):
        per_unit = _sums(values[pairs], ends)
        out = out.append_column(name, pa.array(_sums(per_unit[units], bounds)))
    return out


def align_tokenizers(docs: DataFrame, byte_bpe: str, piece_model: str, id_col: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document.

    A are the tokens of a space and the text under the byte-level vocabulary file, B those of the
    text under the piece model, which adds the space itself. Groups end at each byte offset at
    which both have a token's end, and the two tokens that end there are linked. The count of a
    pair of ids is the number of links that hold it in all documents; n_best are the links whose
    count is the highest of all pairs with their B id (ties included), count_sum adds the counts of
    all links. `groups=True` adds the groups themselves, `a1,a2|b1;a3|b2,b3` by ids; else only
    their SHA-256 is returned.

    Texts that are null, empty, or that either tokenizer does not give back byte by byte (such as
    texts that hold U+2581) have no tokens: zeros, and an empty string for the groups. Texts
    are whole whatever their length: a longer one than a block is a block of its own. Each row is
    a document, also with a null or repeated id, and copies count as often as they occur. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    source = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).alias("id"), F.concat(F.lit(" "), F.col(text)).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    extra = ", groups string" if groups else ""
    # Written once: blocks are numbered by the task that cuts them.
    done = scratch.table(source.mapInArrow(_blocks(byte_bpe, piece_model, groups), f"part int, block long, document boolean, id {kind}, "
                                           "n_a long, n_b long, n_links long, groups_sha256 string, units array<int>, sizes array<int>, "
                                           f"pairs array<long>, times array<long>{extra}"), "blocks")
    linked = done.filter(~F.col("document")).select("part", "block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "x"))
    linked = linked.select("part", "block", "place", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    totals = scratch.table(linked.groupBy("pair").agg(F.sum("times").alias("total")), "totals")
    low = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = totals.groupBy(low.alias("b")).agg(F.max("total").alias("highest"))
    best = totals.withColumn("b", low).join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    # A block has each pair once, so no pair has more rows than there are blocks.
    known = linked.select(F.col("part").alias("p"), F.col("block").alias("k"), "place", "pair").join(best, "pair").drop("pair")
    scored = done.groupBy("part", "block").cogroup(known.groupBy("p", "k")).applyInArrow(
        _scores, f"id {kind}, n_a long, n_b long, n_links long, groups_sha256 string{extra}, n_best long, count_sum long")
    shown = ["n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256"]
    return scored.select(F.col("id").alias(id_col), *shown, *(["groups"] if groups else []))
