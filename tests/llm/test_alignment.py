"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from veilwork.llm.alignment import Aligned, _closed, align_tokenizers, byte_entries, piece_entries, unit_starts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKENS_A, TOKENS_B = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
TOKENS_A.encode_special_tokens = True
BYTES_A, BYTES_B = byte_entries(TOKENS_A.get_vocab()), piece_entries(TOKENS_B)
ODD = [None, "", " ", "  ", "a", " a", "a ", "a b", "a  b   c", "tab\tx y\n z", "Hello, world's <|endoftext|> <s> </s>x", "under▁score x", "é é ü",
       "日本語 テキスト 漢 字", "🙂 🙂🙂 ok", " nbsp  em \u0085", "a ́b", "x" * 5000, "\x00 nul\x00", "0xFF <0x0A> 12 345 678", "don't 've we'll 's",
       "a b c d e", "same words same words", "\r\n a\r\n", "\x1c a \x1d b", "l’été 1999 — «oui»"]


def plain(text):
    """(ids a, ids b, groups, links) of one text, without cutting it."""
    if not text:
        return [], [], [], []
    a, b = TOKENS_A.encode(" " + text, add_special_tokens=False).ids, TOKENS_B.encode(text)
    whole = (" " + text).encode()
    if b"".join(BYTES_A[i] for i in a) != whole or b"".join(BYTES_B[i] for i in b) != whole:
        return [], [], [], []
    ends_a, ends_b = np.cumsum([len(BYTES_A[i]) for i in a]).tolist(), np.cumsum([len(BYTES_B[i]) for i in b]).tolist()
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        links.append((a[p - 1], b[q - 1]))
        i, j = p, q
    return a, b, groups, links


def expected(texts):
    done = [plain(t) for t in texts]
    counts = Counter(x for d in done for x in d[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(len(a), len(b), len(g), len(l), sum(counts[x] == best[x[1]] for x in l), sum(counts[x] for x in l),
             hashlib.sha256(";".join(g).encode()).hexdigest() if a else "", ";".join(g)) for a, b, g, l in done]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


def test_odd_texts(spark):
    texts = ODD + ODD[9:14]
    rows = [(i if i != 3 else None, t, 7, "x") for i, t in enumerate(texts)] + [(1, "a b", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, PART int, units string").repartition(3)
    got = align_tokenizers(docs, A, B, groups=True).collect()
    want = Counter((r[0], *e) for r, e in zip(rows, expected([r[1] for r in rows])))
    assert Counter((r["doc_id"], *[r[c] for c in COLUMNS]) for r in got) == want
    assert any(e[2] == 0 for e in expected(["under▁score x"]))


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: e for r, e in zip(rows, expected([r["text"] for r in rows]))}
    got = align_tokenizers(docs, A, B).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in COLUMNS[:-1]) == want[r["doc_id"]][:-1]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align_tokenizers(empty, A, B).collect() == []


KNOWN = Aligned(A, B)


@given(st.lists(st.text(st.sampled_from(list("ab'é .,\n\t0漢🙂 ́ ")) | st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_units_are_as_good_as_whole_texts(given_texts):
    whole = [(" " + t).encode() for t in given_texts]
    data = np.frombuffer(b"".join(whole), np.uint8)
    bounds = np.cumsum([0] + [len(w) for w in whole])
    starts = unit_starts(data, bounds[:-1]).tolist() + [len(data)]
    units = [data[a:b].tobytes() for a, b in zip(starts, starts[1:])]
    counts, lists = [], []
    for unit in units:
        n_a, n_b, groups, _, texts = KNOWN.align([unit])
        counts.append((int(n_a[0]), int(n_b[0]), int(groups[0])))
        lists.append(texts[0])
    ends = np.cumsum([0] + [len(u) for u in units])
    closed = np.flatnonzero(_closed(data, ends)).tolist()
    if closed:
        n_a, n_b, groups, pairs, joint = KNOWN.align([units[i] for i in closed])
        assert joint == [lists[i] for i in closed] and len(pairs) == np.maximum(groups, 0).sum()
        assert list(zip(n_a.tolist(), n_b.tolist(), groups.tolist())) == [counts[i] for i in closed]
    at = 0
    for text, end in zip(given_texts, bounds[1:].tolist()):
        a, b, groups, _ = plain(text)
        mine = list(range(at, at := starts.index(end)))
        if text and all(counts[i][2] >= 0 for i in mine):
            assert b";".join(lists[i] for i in mine).decode() == ";".join(groups)
            assert (sum(counts[i][0] for i in mine), sum(counts[i][1] for i in mine)) == (len(a), len(b))
        elif text:
            assert not a


def test_very_long_text(spark):
    text = "word ünd " * 300_000 + "x" * 50_000
    docs = spark.createDataFrame([(1, text), (2, "word ünd")], "doc_id long, text string")
    long, short = align_tokenizers(docs, A, B).orderBy("doc_id").collect()
    a, b = TOKENS_A.encode(" " + text, add_special_tokens=False).ids, TOKENS_B.encode(text)
    assert (long["n_a"], long["n_b"]) == (len(a), len(b))
    assert short["n_best"] == short["n_links"] > 1
