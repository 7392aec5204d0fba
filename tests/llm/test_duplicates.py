"""Exact and near duplicates against plain versions, with hot groups, nulls, ties and long texts."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from veilwork.llm.exact_dedup import drop_exact_copies, exact_dedup
from veilwork.llm.kernel import local_roots
from veilwork.llm.ngram_join import drop_near_copies, ngram_join, overlaps
from veilwork.llm.projections import collisions, least_collisions, near_vectors
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n long, h long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "r", 1, 2) for i, t in rows], SCHEMA)


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@given(st.integers(1, 40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 39)), max_size=60))
@settings(max_examples=60, deadline=None)
def test_local_roots(n, links):
    links = [(a % n, b % n) for a, b in links]
    a, b = (np.array(x, np.int64) for x in (zip(*links) if links else ([], [])))
    assert local_roots(n, a, b).tolist() == roots(n, links)


def exact_rows():
    long = "x " * 60_000
    rows = [(5, "a b"), (3, "a  b"), (9, "a\tb"), (1, "a b "), (2, None), (4, ""), (None, "a b"), (None, "only null"),
            (None, "only null"), (7, "é" * 30), (8, "e" * 60), (10, long), (11, long), (12, long + "y"), (13, long[:-2] + "z "),
            (14, "a" * 24), (15, "a" * 24), (16, "a" * 25), (17, "a" * 23 + "b"), (6, "tie"), (6, "tie"), (6, "other")]
    return rows + [(100 + i, "hot copy of a text that is rather longer than the first digit") for i in range(300)]


def test_exact_dedup(spark):
    rows = exact_rows()
    got = exact_dedup(frame(spark, rows).repartition(5)).collect()
    normal = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, normal):
        groups.setdefault(t, []).append(i)
    expected = []
    for (i, _), t in zip(rows, normal):
        ids = [x for x in groups[t] if x is not None]
        expected.append((i, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(expected, key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and len({r.text_sha256 for r in kept}) == len(groups)
    assert all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup(frame(spark, [])).collect() == []


def test_drop_exact_copies(spark, tmp_path):
    frame(spark, exact_rows()).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t").withColumn("_r", F.monotonically_increasing_id())
    left = drop_exact_copies(docs, "_r").collect()
    texts = [re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in left]
    assert len(texts) == len(set(texts)) == len({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in exact_rows()})


def near_rows(seed=1):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(random.choices(vocabulary, k=80))
    rows, i = [], 0

    def add(t):
        nonlocal i
        rows.append((i, t))
        i += 1

    for _ in range(40):
        base = random.choices(vocabulary, k=random.choice([3, 4, 6, 30, 120]))
        for _ in range(random.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(random.randrange(3)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            add(" ".join(copy))
    for _ in range(30):
        add(passage + " " + " ".join(random.choices(vocabulary, k=200)))
    hot = random.choices(vocabulary, k=100)
    for _ in range(700):
        copy = list(hot)
        copy[random.randrange(100)] = random.choice(vocabulary)
        copy[random.randrange(100)] = random.choice(vocabulary)
        add(" ".join(copy))
    for t in (None, "", " \n", "One", "one", "a b", "A B", "ÄB c d e"):
        add(t)
    add("tail " * 3000)
    add("tail " * 2999)
    return rows


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, k, percent):
    rows = near_rows(k)
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    expected = {i: (len(sets[i]), r) for i, r in enumerate(roots(len(rows), links))}
    got = ngram_join(frame(spark, rows).repartition(4), k=k, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected and len(got) == len(rows)


def test_ngram_join_edges(spark):
    got = ngram_join(frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "p q r s t u"), (2, "p q r s t u"), (9, None)]), k=4, percent=85).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got if r.doc_id) == [(2, 2), (4, 2), (4, 4), (9, 9)] or \
        sorted((r.doc_id or -1, r.component_id) for r in got if r.doc_id) == [(2, 2), (4, 2), (4, 2), (9, 9)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert ngram_join(frame(spark, [])).collect() == []


def test_drop_near_copies(spark, tmp_path):
    rows = near_rows(5) + [(None, "w1 w2 w3 w4 w5 w6 w7 unique"), (None, "w1 w2 w3 w4 w5 w6 w7 unique")]
    frame(spark, rows).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t").withColumn("_r", F.monotonically_increasing_id())
    left = {r.doc_id for r in drop_near_copies(docs, "_r").collect()}
    groups = {r.doc_id: r.component_id for r in ngram_join(docs).collect() if r.doc_id is not None}
    assert left - {None} == set(groups.values()) and None in left


@given(st.integers(1, 12), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 60)), max_size=200))
@settings(max_examples=60, deadline=None)
def test_overlaps(n, entries):
    entries = {(r % n, c) for r, c in entries} | {(r, 99) for r in range(n)}
    rows, columns = (np.array(x, np.int64) for x in zip(*sorted(entries)))
    got = overlaps(rows, columns, n)
    for a in range(n):
        for b in range(n):
            if a != b:
                assert got[a, b] == len({c for r, c in entries if r == a} & {c for r, c in entries if r == b})


def test_overlaps_dense():
    random.seed(3)
    sets = [set(random.sample(range(50), 40)) for _ in range(60)]
    entries = [(r, c) for r, s in enumerate(sets) for c in s]
    got = overlaps(*(np.array(x, np.int64) for x in zip(*entries)), 60)
    assert all(got[a, b] == len(sets[a] & sets[b]) for a in range(60) for b in range(60) if a != b)


def test_collisions_and_count():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((30, 5)), rng.standard_normal((40, 5))
    assert (collisions(a, b, 0.4) == (np.abs(a[:, None] - b[None]) <= 0.4).sum(axis=2)).all()
    assert 0 < least_collisions() < 32 and least_collisions(recall=0.5) > least_collisions(recall=0.99)


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            centre = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 8))):
                rows.append((i, (centre + rng.standard_normal(16) * 0.12).astype("f4").tolist(), label))
                i += 1
    hot = rng.standard_normal(16)
    for _ in range(120):
        rows.append((i, (hot + rng.standard_normal(16) * 0.1).astype("f4").tolist(), 1))
        i += 1
    for v in (rows[3][1], rows[3][1], [x * 2 for x in rows[3][1]], None, [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [], rows[3][1][:8], rows[3][1][:8]):
        rows.append((i, v, 0))
        i += 1
    data = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, class string")
    got = {r.vec_id: r for r in near_vectors(data.repartition(3), tile=50).collect()}
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and l is not None for _, v, l in rows]
    unit = [np.array(v, "f4").astype("f8") / np.linalg.norm(np.array(v, "f4").astype("f8")) if g else None for g, (_, v, _) in zip(good, rows)]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if good[a] and good[b] and rows[a][2] == rows[b][2]
             and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    degree = np.bincount([x for l in links for x in l], minlength=len(rows))
    expected = roots(len(rows), links)
    assert len(got) == len(rows) and len(links) > 300
    for k in range(len(rows)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (degree[k], expected[k], expected[k] == k)
    assert near_vectors(data.limit(0)).collect() == []


def test_vectors_without_ids_and_with_many_dimensions(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 3000))
    rows = [(None, a, 1), (7, a, 1), (7, a * 2, 1), (3, a + 0.01 * b, 1), (None, b, 1), (9, b, 2), (None, b + 0.01 * a, 1)]
    data = spark.createDataFrame([(i, [float(x) for x in v], l, 5) for i, v, l in rows], "vec_id long, embedding array<float>, label int, KEPT int")
    got = near_vectors(data.repartition(3)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [
        (0, 1, 0), (0, 1, 0), (0, 3, 3), (3, 3, 3), (7, 3, 3), (7, 3, 3), (9, 0, 9)]
