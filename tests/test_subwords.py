"""Subword tokens against a plain longest match; offsets give back every text."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from veilwork.functions.codes import code_slices
from veilwork.operators.subwords import INNER, UNKNOWN, Trie, learn_vocabulary, split_slices, subword_tokens


def plain(word, pieces):
    """(start, end) by longest match, None if there is none."""
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if (INNER if at else "") + word[at:e] in pieces), None)
        if end is None:
            return None
        out.append((at, end))
        at = end
    return out


ALPHABET = st.text("abcé🙂1", min_size=1, max_size=7)


@given(st.lists(ALPHABET, max_size=12), st.sets(st.tuples(st.booleans(), ALPHABET), max_size=20))
@settings(max_examples=300, deadline=None)
def test_longest_match(words, made):
    pieces = {INNER * inner + p for inner, p in made}
    trie = Trie.of(sorted(pieces))
    for first, end, codes, bounds in code_slices(pa.array(words, pa.string())):
        word, start, stop, known = trie.pieces(codes, bounds[:-1], bounds[1:])
        for i, text in enumerate(words[first:end]):
            mine = word == i
            got = list(zip((start[mine] - bounds[i]).tolist(), (stop[mine] - bounds[i]).tolist()))
            want = plain(text, pieces)
            assert got == (want if want is not None else [(0, len(text))]) and set(known[mine].tolist()) == {want is not None}


def test_offsets_give_back_the_texts(spark):
    texts = ["Hello, wörld! 🙂🙂 x_y", "", None, "  spaced\tout ", "#5 ## a#b", "longlonglong" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    pieces = [r["piece"] for r in learn_vocabulary(df, "text", 40, 6).collect()]
    assert len(pieces) == len(set(pieces)) and "##o" in pieces and "H" in pieces
    for r in df.withColumn("t", subword_tokens(F.col("text"), pieces)).collect():
        text = r["text"] or ""
        back = [" "] * len(text)
        for token, start, end in r["t"]:
            assert text[start:end] == (token[2:] if token.startswith(INNER) and len(token) > 2 else token)
            back[start:end] = text[start:end]
        assert "".join(back) == re.sub(r"\s", " ", text)
    few = df.filter("id = 0").select(subword_tokens(F.col("text"), ["Hello", ",", "x", "##_"]).alias("t")).first()["t"]
    assert [tuple(x) for x in few] == [("Hello", 0, 5), (",", 5, 6), (UNKNOWN, 7, 12), (UNKNOWN, 12, 13), (UNKNOWN, 14, 15), (UNKNOWN, 15, 16), (UNKNOWN, 17, 20)]


def test_slices_are_handed_on():
    """Tokens of a batch never lie side by side whole: lists come slice by slice and are the same ones."""
    texts = pa.array([f"some words {i}, and {'more ' * (i % 7)}" for i in range(400)] + [None, "", "x" * 3000], pa.string())
    trie = Trie.of(["s", "w", "##o", "more"])
    parts, whole = list(split_slices(trie, texts, 1000)), list(split_slices(trie, texts, 1 << 30))
    assert len(whole) == 1 and len(parts) > 10 and max(len(p) for p in parts) < 60
    assert pa.concat_arrays(parts).to_pylist() == whole[0].to_pylist()
