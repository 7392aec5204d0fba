"""The pipeline's stages on a small table with planted cases, and every registered query."""

import random
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.oracle import compare, connect
from veilwork.llm import queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, n long, component_id long"


def rows():
    random.seed(6)
    syllables = {"en": "th er on an re he in ed nd".split(), "fr": "ou é ai eau que les tion ê".split()}
    word = lambda lang: "".join(random.choices(syllables[lang], k=random.randint(1, 4)))
    out = []
    for i in range(200):
        lang = ("en", "fr")[i % 2]
        out.append((i, " ".join(word(lang) for _ in range(random.choice([12, 60, 200]))), lang, f"s{i % 5 and 1}"))
    out += [(1000 + i, out[3][1].replace(" ", "  "), "fr", "s1") for i in range(40)]
    for i in range(30):
        w = out[7][1].split() + ["plus"] * 40
        w[i] = word("fr")
        out.append((2000 + i, " ".join(w), "fr", "s0"))
    out += [(3000, None, "en", "s0"), (3001, "", None, None), (3002, "12 34", None, "s0"), (None, out[9][1], "fr", None), (5, out[5][1], "fr", "s1"),
            (3003, "les eau " * 15_000, None, "s1")]
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(i, t, l, s, len(t or ""), 1, 2, 3) for i, t, l, s in rows()], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    return folder, {k: ([r.asDict() for r in a.collect()], [r.asDict() for r in b.collect()]) for k, (a, b) in out.items()}


def test_language_stage(stages):
    before, after = stages[1]["language_id"]
    letters = [r for r in before if any(c.isalpha() for c in r["text"] or "")]
    assert sorted(map(str, after)) == sorted(map(str, letters)) and len(before) - len(after) == 3


def normal(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_exact_stage(stages):
    before, after = stages[1]["exact_dedup"]
    texts = [normal(r["text"]) for r in after]
    assert len(texts) == len(set(texts)) and set(texts) == {normal(r["text"]) for r in before}
    for r in after:
        ids = [b["doc_id"] for b in before if normal(b["text"]) == normal(r["text"]) and b["doc_id"] is not None]
        assert r["doc_id"] == min(ids)


def test_near_stage(stages):
    before, after = stages[1]["near_dedup"]
    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))

    sets = [shingles(r["text"]) for r in before]
    root = list(range(len(before)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k, r in enumerate(before):
        groups.setdefault(find(k), []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(min(g) for g in groups.values()) and len(after) < len(before)


def test_mix_stage(stages):
    before, after = stages[1]["mix_sources"]
    assert {str(r) for r in after} <= {str(r) for r in before} and 0.6 * len(before) < len(after) < 1.5 * len(before)


def test_pack_stage(stages):
    before, after = stages[1]["packing"]
    assert sum(r["start"] == 0 for r in after) == len(before)
    used = {}
    for r in after:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 4096


def test_run_is_the_stages(spark, stages):
    folder, found = stages
    key = lambda r: (str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"])
    assert sorted(key(r.asDict()) for r in corpus_pipeline.run(spark, str(folder)).collect()) == sorted(map(key, found["packing"][1]))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", [k for k in queries.QUERIES if k in queries.ORACLES])
def test_query(spark, con, key):
    ok, message, _ = compare(spark, con, FOLDER, key, queries.QUERIES[key], queries.ORACLES[key])
    assert ok, message


def test_queries_are_registered():
    assert set(queries.QUERIES) <= set(entry.queries())
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k != "pipeline")
    assert numbers == list(range(1, 11))


def test_mixing_query_moves_whole_documents(spark, monkeypatch):
    seen, mixed = [], queries.mix_sources
    monkeypatch.setattr(queries, "mix_sources", lambda docs: seen.append(docs.columns) or mixed(docs))
    docs = spark.createDataFrame([(1, "a text", "s"), (2, None, None)], "doc_id long, text string, source string")
    monkeypatch.setattr(queries, "documents", lambda spark, folder: docs)
    assert queries.op5(spark, "").columns == ["doc_id", "source", "copy", "shuffle_key"]
    assert seen == [["doc_id", "text", "source"]]
