"""Token ids of whole texts: each distinct word goes through the tokenizer about once per worker.

For tokenizers whose pre-tokenizer splits at white space and drops it, a text's ids are those of
its words in order. Words are further split into leading letters and trailing punctuation where
the tokenizer does so too.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .kernel import range_hashes, slices, text_bytes

SLICE = 1 << 24
#: Distinct words whose ids a worker remembers before it starts anew, about 40 bytes each.
REMEMBERED = 1 << 20
_MARK = "|"


def _spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of each run, end to end."""
    return np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)


class Words:
    """Ids by word, for a tokenizer that lower-cases and splits letters from punctuation.

    Known words are sorted arrays of two independent 64-bit hashes and places in one array of ids.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        # Latin letters, then ASCII punctuation without the apostrophe that starts contractions
        # and the angle bracket that starts special tokens.
        letters = "".join(chr(c) for c in range(0x250) if chr(c).isalpha() and c not in (0xAA, 0xBA, 0x130))
        self.simple = re.compile(f"([{letters}]+)([!-&(-/:;=>?@\\[-`{{-~]*)").fullmatch
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        assert len(self.mark) == 1

    def forget(self) -> None:
        self.hashes, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begins, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of distinct pieces: letters in long strings with a mark between, others one by one."""
        found, counts, at = [], np.zeros(len(pieces), np.int64), []
        plain = [i for i, w in enumerate(pieces) if w.isalpha()]
        for first in range(0, len(plain), 4096):
            some = plain[first:first + 4096]
            ids = np.array(self.tokenizer.encode(f" {_MARK} ".join([pieces[i] for i in some]), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark[0])
            assert len(cuts) == len(some) - 1
            counts[some] = np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1
            found.append(np.delete(ids, cuts))
            at += some
        rest = [i for i, w in enumerate(pieces) if not w.isalpha()]
        for i, done in zip(rest, self.tokenizer.encode_batch([pieces[i] for i in rest], add_special_tokens=False)):
            counts[i] = len(done.ids)
            found.append(np.array(done.ids, np.uint32))
        order = np.array(at + rest, np.int64)
        begins = np.empty(len(pieces), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
        return flat[_spread(begins, counts)], counts

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words."""
        numbers: dict[str, int] = {}
        heads, tails = np.empty(len(words), np.int64), np.full(len(words), -1, np.int64)
        number = numbers.setdefault
        for i, word in enumerate(words):
            cut = self.simple(word)
            if cut is None:
                heads[i] = number(word, len(numbers))
            else:
                head, tail = cut.groups()
                heads[i] = number(head.lower(), len(numbers))
                if tail:
                    tails[i] = number(tail, len(numbers))
        flat, counts = self._pieces(list(numbers))
        begins = np.cumsum(counts) - counts
        order = np.stack([heads, tails], axis=1).ravel()
        sizes = np.where(order >= 0, counts[order] if len(counts) else 0, 0)
        return flat[_spread(begins[order] if len(begins) else sizes, sizes)], sizes.reshape(-1, 2).sum(axis=1)

    def places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(begin, count) in `flat` of each of the distinct words."""
        data, offsets = text_bytes(words)
        hashes = range_hashes(data, offsets[:-1], offsets[1:])
        checks = range_hashes(data, offsets[:-1], offsets[1:], 0xD1342543DE82EF95)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero((self.hashes[at] != hashes) | (self.checks[at] != checks)) if len(self.hashes) else np.arange(len(hashes))
        if len(new):
            ids, counts = self.encode(words.take(pa.array(new)).to_pylist())
            begins = np.cumsum(counts) - counts + len(self.flat)
            self.flat = np.concatenate([self.flat, ids])
            merged = [np.concatenate(x) for x in ((self.hashes, hashes[new]), (self.checks, checks[new]), (self.begins, begins), (self.counts, counts))]
            order = np.argsort(merged[0], kind="stable")
            self.hashes, self.checks, self.begins, self.counts = (x[order] for x in merged)
            at = np.searchsorted(self.hashes, hashes)
            at += self.checks[at] != checks  # of two words with one hash, the second
        return self.begins[at], self.counts[at]


def worker_words(path: str) -> Words:
    """This Python worker's words, kept from task to task where Spark reuses the worker."""
    kept = sys.modules.setdefault("_veilwork_words", type(sys)("_veilwork_words")).__dict__
    if path not in kept:
        kept[path] = Words(path)
    return kept[path]


def tokenised(batches: Iterator[pa.RecordBatch], column: int, path: str, end: int | None):
    """(batch, first row, end row, ids, row bounds) slice by slice; `end` closes each row if given."""
    words = worker_words(path)
    for batch in batches:
        whole = batch.column(column)
        _, offsets = text_bytes(whole)
        for i, j in slices(offsets, SLICE):
            lists = pc.ascii_split_whitespace(whole.slice(i, j - i).fill_null(""))
            coded = lists.flatten().dictionary_encode()
            begins, counts = words.places(coded.dictionary)
            codes = coded.indices.to_numpy()
            lengths = counts[codes]
            total = np.concatenate(([0], np.cumsum(lengths)))
            ids = words.flat[_spread(begins[codes], lengths)]
            bounds = total[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            if end is not None:
                ids = np.insert(ids, bounds[1:], np.uint32(end))
                bounds = bounds + np.arange(len(bounds))
            yield batch, i, j, ids, bounds
