"""Subword tokens: a vocabulary learned from words by counts, and longest-match pieces with offsets.

The vocabulary is a trie in arrays; all words of a slice of texts walk down it together, one
character of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codes import code_slices, utf8
from ..functions.entities import TOKEN

INNER = "##"
UNKNOWN = "[UNK]"
_CODE_BITS = 21
_KIND = "array<struct<token:string,start:int,end:int>>"


def learn_vocabulary(df: DataFrame, text: str, size: int = 30_000, longest: int = 16) -> DataFrame:
    """(piece, n): every single character of the texts' words, and the pieces that save most tokens.

    A piece of l characters that stands n times saves n * (l - 1) tokens; the `size` best are
    taken, ties by text. Pieces that don't begin a word are marked by `##`. Words are counted
    before they are taken apart.
    """
    words = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("word"))
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def from_start(s: Column) -> Column:
        lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - s + 1))
        return F.transform(lengths, lambda l: F.struct(
            F.concat(F.when(s > 1, INNER).otherwise(""), F.substring(F.col("word"), s, l)).alias("piece"), l.alias("l")))

    pieces = words.select("n", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), from_start))).alias("p"))
    counts = pieces.groupBy("p.piece", "p.l").agg(F.sum("n").alias("n"))
    best = counts.filter("l > 1").orderBy((F.col("n") * (F.col("l") - 1)).desc(), "piece").limit(size)
    return counts.filter("l = 1").unionByName(best).select("piece", "n")


@dataclass
class Trie:
    """Children by (node, character); nodes 0 and 1 are the roots of first and of inner pieces."""

    keys: np.ndarray
    children: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, pieces: list[str]) -> "Trie":
        children: dict[int, int] = {}
        ends = [False, False]
        for piece in pieces:
            # Words hold no such marks, but a mark may be a word of its own.
            inner = piece.startswith(INNER) and len(piece) > len(INNER)
            node = int(inner)
            for letter in piece[len(INNER):] if inner else piece:
                key = node << _CODE_BITS | ord(letter)
                if key not in children:
                    children[key] = len(ends)
                    ends.append(False)
                node = children[key]
            ends[node] = True
        keys = np.array(sorted(children), np.int64)
        return cls(keys, np.array([children[k] for k in keys.tolist()], np.int64), np.array(ends))

    def pieces(self, codes: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, known) of the pieces of the words at [begin, stop), in order.

        At each place the longest piece; a word with a character that begins none is one unknown piece.
        """
        at = begin.copy()
        active, found = np.flatnonzero(stop > at), []
        lost = np.zeros(len(stop), bool)
        while len(active):
            place, end = at[active], np.full(len(active), -1)
            node, alive = (place > begin[active]).astype(np.int64), np.arange(len(active))
            while len(alive):
                alive = alive[place[alive] < stop[active[alive]]]
                key = node[alive] << _CODE_BITS | codes[place[alive]]
                where = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
                hit = self.keys[where] == key if len(self.keys) else np.zeros(len(key), bool)
                alive, where = alive[hit], where[hit]
                node[alive] = self.children[where]
                place[alive] += 1
                done = alive[self.ends[node[alive]]]
                end[done] = place[done]
            good = end >= 0
            lost[active[~good]] = True
            found.append((active[good], at[active[good]], end[good]))
            at[active[good]] = end[good]
            active = active[good]
            active = active[at[active] < stop[active]]
        unknown = np.flatnonzero(lost)
        word, start, end = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        kept = ~lost[word]
        word, start, end = (np.concatenate((a[kept], b)) for a, b in ((word, unknown), (start, begin[unknown]), (end, stop[unknown])))
        order = np.lexsort((start, word))
        return word[order], start[order], end[order], ~lost[word[order]]


def words_of(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, stop) of the words and single marks of texts that lie end to end."""
    present = np.unique(codes)
    letters = [chr(c) for c in present.tolist()]
    kinds = np.array([2 if c.isalnum() or c == "_" else 0 if c.isspace() else 1 for c in letters], np.int8)
    kind = kinds[np.searchsorted(present, codes)] if len(codes) else np.zeros(0, np.int8)
    first = kind > 0
    first[1:] &= (kind[1:] == 1) | (kind[:-1] != 2)
    inner = bounds[1:-1]
    inner = inner[inner < len(codes)]
    first[inner] = kind[inner] > 0
    begin = np.flatnonzero(first)
    # A word ends where the next begins, where white space does, or where its text does.
    breaks = np.flatnonzero(np.concatenate((first | (kind == 0), [True])))
    stop = breaks[np.searchsorted(breaks, begin, "right")]
    return begin, stop


def _strings(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Byte ranges of texts as strings."""
    sizes = stop - begin
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], sizes)
    return pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])


def split_slices(trie: Trie, column: pa.Array, limit: int = 1 << 20) -> Iterator[pa.Array]:
    """Lists of (token, start, end) of the texts, for slices of about `limit` bytes or one longer text."""
    data, offsets = utf8(column)
    for first, end, codes, bounds in code_slices(column, limit):
        begin, stop = words_of(codes, bounds)
        word, start, last, known = trie.pieces(codes, begin, stop)
        some = data[offsets[first]:offsets[end]]
        places = np.append(np.flatnonzero((some & 0xC0) != 0x80), len(some))  # bytes of the code points
        names = _strings(some, places[start], places[last])
        names = pc.if_else(pa.array(start > begin[word]), pc.binary_join_element_wise(INNER, names, ""), names)
        names = pc.if_else(pa.array(known), names, UNKNOWN)
        rows = np.searchsorted(bounds, start, "right") - 1
        starts, ends = (pa.array((at - bounds[rows]).astype(np.int32)) for at in (start, last))
        limits = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=end - first))))
        yield pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.StructArray.from_arrays([names, starts, ends], ["token", "start", "end"]))


def subword_tokens(text: Column, pieces: list[str]) -> Column:
    """array<struct<token, start, end>>: words and single marks as pieces of the vocabulary, with offsets in code points.

    Pieces that don't begin a word are marked by `##`; the offsets of a word's pieces join up.
    """
    trie = Trie.of(pieces)

    # An iterator, so that a slice of texts is handed on before the next is taken apart: tokens take
    # some twenty times the room of their texts.
    @F.arrow_udf(_KIND)
    def split(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield from split_slices(trie, column)

    return split(F.coalesce(text, F.lit("")))
