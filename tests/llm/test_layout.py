"""Packing, mixing, token files and shards against plain versions, with nulls, ties and empty tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilwork.llm.hash_tree import hash_tree_shards, regular_tree
from veilwork.llm.mixing import mix_sources
from veilwork.llm.packing import first_fit_decreasing, pack_documents
from veilwork.llm.token_scan import token_counts, write_token_files
from veilwork.llm.tokens import Words

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, rate double, steps string, shard int, group string"
ODD = ["", None, " \n\t ", "Hello, WORLD!! it's <|endoftext|> <|startoftext|>x", "İstanbul ΑΣ Σ ς K ﬁ ½ ²³", "don't we'll can'T 'S",
       "e\u0301te\u0301 a\u0308 \u0308x", "日本語 テキスト، عربى", "a|b | || word| |word", "x" * 3000, "###&&& a.b,c ... A1b2", "\u00a0nbsp\u2003em\u0085",
       "tab\tnew\nline\r\x0b\x0c.", "🙂🙂 ok", "[brackets] {x} ~ ` @ \\ ^ _ - = + < > / ; :"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 0.5, "x", 1, "g") for i, t, s in rows], SCHEMA)


def documents(n=120):
    random.seed(2)
    words = [f"w{i}orth" for i in range(50)] + ["the", "of", "Éclair", "x."]
    return [(i, " ".join(random.choices(words, k=random.choice([1, 5, 40, 300]))), f"s{min(i % 9, 3)}") for i in range(n)]


def plain(t):
    return TOKENIZER.encode(t or "", add_special_tokens=False).ids


TOKENIZER = Tokenizer.from_file(PATH)


@given(st.lists(st.text(max_size=12), max_size=12))
@settings(max_examples=150, deadline=None)
def test_words_are_the_tokenizers(words):
    words = [x for w in words for x in w.encode("utf-8", "replace").decode().split()]
    if words:
        got, counts = WORDS.encode(words)
        assert [a.tolist() for a in np.split(got, np.cumsum(counts)[:-1])] == [plain(w) for w in words]


WORDS = Words(PATH)


def test_words_are_remembered():
    words = Words(PATH)
    for some in (["a", "bc.", "don't", ""], ["bc.", "x|y", "a", "É!"], ["", "zz", "bc"]):
        begins, counts = words.places(pa.array(some))
        assert [words.flat[b:b + n].tolist() for b, n in zip(begins, counts)] == [plain(w) for w in some]


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=100, deadline=None)
def test_first_fit_decreasing(lengths):
    bins, offsets = first_fit_decreasing(np.array(lengths, np.int64), 50)
    room, expected = [], {}
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((b for b, r in enumerate(room) if r >= lengths[item]), None)
        if at is None:
            at = len(room)
            room.append(50)
        expected[item] = (at, 50 - room[at])
        room[at] -= lengths[item]
    assert [tuple(x) for x in zip(bins.tolist(), offsets.tolist())] == [expected[i] for i in range(len(lengths))]


def test_pack_documents(spark):
    rows = documents() + [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(None, "no id", "s"), (5, "again", "s"), (5, "again", "s"), (2000, "long " * 3000, "s")]
    got = pack_documents(frame(spark, rows).repartition(4), PATH, capacity=256, group=40).collect()
    expected = Counter()
    for i, t, _ in rows:
        ids = np.array(plain(t) + [2], "<u4")
        for at in range(0, len(ids), 256):
            expected[i, at, len(ids[at:at + 256]), zlib.crc32(ids[at:at + 256].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.concatenate([[0], np.cumsum([n for _, n in pieces])[:-1]]).tolist()
        assert sum(n for _, n in pieces) <= 256
    assert sum(r.length for r in got) / (256 * len(sequences)) > 0.85
    assert pack_documents(frame(spark, []), PATH).collect() == []


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_token_files(spark, tmp_path, block):
    rows = documents(60) + [(900 + i, t, None) for i, t in enumerate(ODD)]
    folder = f"file://{tmp_path}/tokens"
    write_token_files(frame(spark, rows).repartition(3), folder, PATH)
    got = token_counts(spark, folder, block=block).collect()
    assert Counter(r.n_tokens for r in got) == Counter(len(plain(t)) for _, t, _ in rows) and all(r.ended for r in got)
    files = {}
    for r in got:
        files.setdefault(r.file, []).append(r)
    for found in files.values():
        found.sort(key=lambda r: r.doc_index)
        assert [r.doc_index for r in found] == list(range(len(found)))
        assert [r.start for r in found] == np.concatenate([[0], np.cumsum([r.n_tokens + 1 for r in found])[:-1]]).tolist()
        raw = np.fromfile(tmp_path / "tokens" / found[0].file, "<u2")
        assert np.flatnonzero(raw == 0).tolist() == [r.start + r.n_tokens for r in found]


def test_token_files_of_others(spark, tmp_path):
    """Any separator and width; no separator at the end, none at all, doubled ones, and an empty file."""
    for name, ids in {"a": [7, 7, 3, 9, 9, 9, 7], "b": [1, 2, 3], "c": [], "d": [9] * 40 + [7, 5] + [8] * 30}.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u4").tobytes() + (b"xx" if name == "d" else b""))
    got = sorted((r.file, r.doc_index, r.start, r.n_tokens, r.ended) for r in token_counts(spark, f"file://{tmp_path}", 7, 4, 16).collect())
    assert got == [("a", 0, 0, 0, True), ("a", 1, 1, 0, True), ("a", 2, 2, 4, True), ("b", 0, 0, 3, False), ("d", 0, 0, 40, True), ("d", 1, 41, 31, False)]


def counts_of(mean, u):
    term = total = math.exp(-mean)
    k = 0
    while total < u:
        k += 1
        term *= mean / k
        total += term
    return k


def test_mix_sources(spark):
    import hashlib

    rows = documents(400) + [(None, "a", None), (None, "b", None), (7, "twice", "s1")]
    got = mix_sources(frame(spark, rows).repartition(3), temperature=0.5).collect()
    n = Counter(s for _, _, s in rows)
    mass = sum(math.sqrt(x) for x in n.values())
    for i, t, s in rows:
        if i is not None and i != 7:
            u = (int(hashlib.md5(f"20|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            copies = sorted(r._copy for r in got if r.doc_id == i)
            assert copies == list(range(counts_of(len(rows) * math.sqrt(n[s]) / mass / n[s], u)))
    assert 0.7 * len(rows) < len(got) < 1.3 * len(rows)
    assert [c for c in got[0].asDict()] == [*SCHEMA.replace(",", "").split()[::2], "_copy", "_order"]
    given_weights = mix_sources(frame(spark, rows), weights={"s1": 1.0, None: 1.0}, total=3000).groupBy("source").count().collect()
    shares = {r["source"]: r["count"] for r in given_weights}
    assert set(shares) <= {"s1", None} and 1300 < shares["s1"] < 1700
    assert mix_sources(frame(spark, [])).collect() == []


def test_mixing_rates_hold_over_seeds(spark):
    rows = frame(spark, [(i, "t", "big" if i % 4 else "small") for i in range(2000)])
    found = Counter(r.source for r in mix_sources(rows, weights={"big": 1, "small": 3}, total=4000).collect())
    assert abs(found["big"] - 1000) < 130 and abs(found["small"] - 3000) < 230


def test_mixing_at_high_rates(spark):
    """No rate is special: counts at 20, 700 and 5000 are the Poisson distribution inverted at each document's number."""
    import hashlib

    for rate, n in ((20.0, 40), (700.0, 300), (5000.0, 20)):
        rows = spark.createDataFrame([(i, "t", "s", 3, "x") for i in range(n)], "doc_id long, text string, source string, _copy int, _ORDER string")
        found = Counter(r.doc_id for r in mix_sources(rows, total=rate * n).select("doc_id").collect())
        terms = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(int(2 * rate + 200))]
        for i in range(n):
            u, k, total = (int(hashlib.md5(f"20|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52, 0, terms[0]
            while total < u:
                k += 1
                total += terms[k]
            assert found[i] == k
        if n == 300:
            values = np.array([found[i] for i in range(n)])
            assert abs(values.mean() - rate) < 6 and 500 < values.var() < 900


def test_hash_tree(spark):
    rows = [(i, f"t{i}", "s") for i in range(6000)] + [(None, None, "s"), (None, "é", "s"), (3, "t3", "s")]
    got = hash_tree_shards(frame(spark, rows), regular_tree(24), regular_tree(25)).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
    assert sorted(shards) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert all(170 < len(s) < 330 for s in shards.values())
    assert 150 < sum(r.grown_shard == 24 for r in got) < 330
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[11].size == 8 + 3 and by_id[11].text_crc32 == zlib.crc32(b"t11")
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(8, 0), (10, zlib.crc32("é".encode()))}
    assert hash_tree_shards(frame(spark, []), regular_tree(24)).collect() == []


def test_movement_stays_in_changed_subtrees(spark):
    old = regular_tree(24)
    new = {r: {k: dict(s) for k, s in ks.items()} for r, ks in old.items()}
    rack = next(k for k in new["region1"] if 16 in new["region1"][k])
    new["region1"][rack][16] = 3.0
    got = hash_tree_shards(frame(spark, [(i, "x", "s") for i in range(4000)]), old, new).collect()
    moved = [(r.shard, r.grown_shard) for r in got if r.shard != r.grown_shard]
    regions = lambda s: s // 12
    assert moved and not any(regions(a) == regions(b) == 0 for a, b in moved)
    assert all(regions(b) == 1 for _, b in moved)


def test_token_files_of_an_empty_table_and_clashing_names(spark, tmp_path):
    write_token_files(frame(spark, []), str(tmp_path / "none"), PATH)
    assert token_counts(spark, str(tmp_path / "none")).collect() == []
    docs = spark.createDataFrame([("a b", "x", 1), ("a b", "x", 1), (None, "x", 1)], "text string, ids string, VALUE int")
    write_token_files(docs.coalesce(1), str(tmp_path / "some"), PATH)
    assert sorted(r.n_tokens for r in token_counts(spark, str(tmp_path / "some")).collect()) == [0, 2, 2]


def test_shards_of_very_long_texts(spark):
    rows = [(i, "é" * 200_000 + str(i), "s") for i in range(4)] * 2
    got = hash_tree_shards(frame(spark, rows), regular_tree(24)).collect()
    assert len(got) == 8 and {r.size for r in got} == {400_009}
    assert len({(r.shard, r.slot) for r in got}) == 8 and len({(r.doc_id, r.shard) for r in got}) == 4
