"""Language-model scores, language ID and URL filters: plain versions, held-out quality, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilwork.llm import language_id as lang_module, lm_scoring as lm
from veilwork.llm.kernel import text_bytes, word_hashes
from veilwork.llm.language_id import Model, drop_rejected, folded_grams, language_id, letter_table
from veilwork.llm.lm_scoring import lm_scores
from veilwork.session import fresh_dir
from veilwork.llm.url_filter import url_verdicts

SCHEMA = "doc_id long, text string, lang string, row string, held string, score int, pred string"
SYLLABLES = {"en": "th er on an re he in ed nd ha at en".split(), "de": "ch ei un ie sch ge be ung ver zu ä ö".split(),
             "fr": "ou é ai eau que les tion ê è au eux re".split()}


def texts(n, seed=1):
    random.seed(seed)
    out = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        words = ["".join(random.choices(SYLLABLES[lang], k=random.randint(1, 4))) for _ in range(random.choice([4, 30, 120]))]
        out.append((i, " ".join(words).capitalize() + random.choice([".", "\n", "", "  "]), lang))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, "r", "h", 3, "p") for i, t, l in rows], SCHEMA)


def held(k, m):
    return F.crc32(F.col("doc_id").cast("string")) % k == m


def words_of(t):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_lm_scores(spark):
    rows = texts(400) + [(1000, None, "en"), (1001, "", "en"), (1002, " \t", "en"), (1003, "Wholly NEW wörds 🙂", None), (1004, "x" * 50_000, "en"),
                         (None, "then on an", "en"), (7, "repeated id", "en")]
    got = lm_scores(frame(spark, rows).repartition(3), held_out=held(7, 2)).collect()
    learn = [t for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in learn for w in words_of(t))
    n, v = sum(counts.values()) + len(learn), len(counts) + 1
    expected = {}
    for i, t, _ in rows:
        w = words_of(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(learn) + 1) / (n + v + 1))
        out = i is None or zlib.crc32(str(i).encode()) % 7 == 2
        expected.setdefault(i, []).append((out, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(base, 5)))
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)))
        assert r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0
    assert {k: sorted(x) for k, x in found.items()} == {k: sorted(x) for k, x in expected.items()}
    away = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.score for r in away) > sum(r.base_score for r in away)
    scores = {r.doc_id: r.score for r in got}
    assert scores[1000] == scores[1001] == scores[1002]


def test_lm_scores_without_learning(spark):
    got = lm_scores(frame(spark, [(1, "ab", "en"), (2, None, "en")]), held_out=F.lit(True)).collect()
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {1: (2, 0, 0, 0.0), 2: (1, 0, 0, 0.0)}
    assert lm_scores(frame(spark, []), held_out=held(7, 2)).collect() == []


def test_mixer_is_a_distribution():
    """After any bytes the probabilities of all next bytes add up to one, also after online learning."""
    rng = np.random.default_rng(1)
    grams, prefixes = rng.integers(0, 1 << 48, 500).astype(np.uint64), rng.integers(0, 1 << 60, 500).astype(np.uint64)
    online = lm.Online(step=64)
    online.mixer.tables = [rng.integers(0, 30, 2 << b).astype(np.uint32) for b in lm.TABLE_BITS]
    online.learn(grams, prefixes, rng.integers(1, 9, 500))
    assert online.seen > 0
    tables = [t.astype(np.uint16).view(np.uint32) for t in online.mixer.tables]
    weights, refined = lm._averaged(zip(*(x.tolist() for x in online.learned())))
    mixer = lm.Mixer(tables, weights, refined)
    for k in range(5):
        nexts = (grams[k] & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** -mixer.costs(nexts, np.full(256, prefixes[k]))).sum() - 1) < 1e-4


def units_of(rows):
    stream, bounds, _, _ = lm.byte_stream(*text_bytes(pa.array(rows)))
    return lm.byte_units(stream, bounds, lm.Powers())


def test_online_learning_lowers_the_cost():
    tallies = lm.Tallies(1)
    grams, prefixes = units_of([t for _, t, _ in texts(150)])
    tallies.add(lm.unit_keys(grams, prefixes), grams, prefixes)
    (_, n, grams, prefixes), = tallies.flush(True)
    online = lm.Online(step=128)
    order = np.random.default_rng(1).permutation(len(n))
    online.learn(grams[order], prefixes[order], n[order])
    tables = [t.astype(np.uint16).view(np.uint32) for t in online.mixer.tables]
    assert sum(int(t.sum()) for t in online.mixer.tables) == 8 * len(lm.TABLE_BITS) * n.sum()
    others = units_of([t for _, t, _ in texts(60, 9)])
    assert lm.Mixer(tables, online.mixer.weights).costs(*others).sum() < 0.95 * lm.Mixer(tables).costs(*others).sum()


def test_long_contexts_have_whole_tables():
    assert min(lm.TABLE_BITS[2:]) >= 22


def test_large_counts_are_scaled_not_wrapped():
    counts = np.zeros(2 << lm.PART_BITS, np.uint32)
    counts[:8] = [3_000_000, 1, 70_001, 70_001, 65_535, 0, 200_003, 5]
    rows = [pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array([1, 1], pa.int32()), pa.array([lm.zlib.compress(counts.tobytes(), 1)] * 2)],
                                       ["order", "part", "counts"])]
    (row,) = lm._add_up(iter(rows))
    pairs = np.frombuffer(lm.zlib.decompress(row.column(2)[0].as_py()), "<u2")[:8].tolist()
    assert pairs[0] == 65_535 and pairs[1] == 1 and pairs[2] == pairs[3] == 65_535 and pairs[4] == 65_535 and pairs[6] == 65_535 and pairs[7] == 2


def test_units_look_back_within_their_row():
    rows = ["Ab c", None, "xyz uvwxyz", ""]
    grams, _ = units_of(rows)
    stream = [b for t in rows for b in (" ".join(words_of(t)) + "\n").encode()]
    expected = []
    for t in rows:
        text = b"\n" * 5 + (" ".join(words_of(t)) + "\n").encode()
        expected += [int.from_bytes(text[k:k + 6], "big") for k in range(len(text) - 5)]
    assert grams.tolist() == expected and len(stream) == len(expected)


def test_runs_and_tallies():
    rng = np.random.default_rng(3)
    keys = lm.mix(rng.integers(0, 500, 5000).astype(np.uint64))
    tallies = lm.Tallies(10)
    counts = Counter()
    for some in np.split(keys, 10):
        tallies.add(some, some + np.uint64(1))
        for found, n, more in tallies.flush():
            counts.update(dict(zip(found.tolist(), n.tolist())))
            assert (more == found + np.uint64(1)).all()
    for found, n, _ in tallies.flush(True):
        counts.update(dict(zip(found.tolist(), n.tolist())))
    assert counts == Counter(keys.tolist())


def test_word_hashes_follow_the_words():
    rows = ["a b", None, "", " a\tb ", "A  B c", "ab", "a", "é É", "\x0ba\x0c"]
    data, offsets = text_bytes(pa.array(rows))
    hashes, bounds = word_hashes(data, offsets)
    names = [words_of(t) for t in rows]
    assert np.diff(bounds).tolist() == [len(w) for w in names]
    flat = [x for w in names for x in w]
    assert len(set(hashes.tolist())) == len(set(flat)) == len(set(zip(flat, hashes.tolist())))


def plain_kneser_ney(grams_by_lang, gram, lang, alphabet):
    """Interpolated Kneser-Ney probability of the last character, straight from its definition."""
    tables = [grams_by_lang[lang]]
    for _ in range(3):
        tables.append(Counter(g[1:] for g in tables[-1]))
    p = 1 / alphabet
    for order in range(1, 5):
        t, g = tables[4 - order], gram[4 - order:]
        ones, twos = sum(n == 1 for n in t.values()), sum(n == 2 for n in t.values())
        d = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
        follow = {k: n for k, n in t.items() if k[:-1] == g[:-1]}
        if follow:
            p = (max(t.get(g, 0) - d, 0) + d * len(follow) * p) / sum(follow.values())
    return p


def test_model_is_kneser_ney():
    tables = {}
    for lang in ("en", "fr"):
        some = [t for _, t, l in texts(30, 3) if l == lang]
        data, offsets = text_bytes(pa.array(some))
        grams, _ = folded_grams(data, offsets, letter_table())
        tables[lang] = Counter(grams.tolist())
    model = Model(["en", "fr"], [(np.array(list(tables[l]), np.uint64), np.array(list(tables[l].values()))) for l in ("en", "fr")])
    text = lambda g: "".join(chr(g >> s & 0xFFFF) for s in (48, 32, 16, 0))
    plain = {l: Counter({text(g): n for g, n in t.items()}) for l, t in tables.items()}
    probes = [*list(tables["en"])[:25], *list(tables["fr"])[:25], sum(ord(c) << s for c, s in zip("qzxj", (48, 32, 16, 0)))]
    costs = model.costs(np.array(probes, np.uint64))
    for g, row in zip(probes, costs):
        for k, lang in enumerate(("en", "fr")):
            assert abs(2 ** -row[k] - plain_kneser_ney(plain, text(g), lang, model.alphabet)) < 1e-6


def test_folded_grams():
    rows = ["Ab  c1d", None, "", "12 !", "É🙂x", "𝒜b"]
    grams, bounds = folded_grams(*text_bytes(pa.array(rows)), letter_table())
    text = ["".join(chr(int(g) & 0xFFFF) for g in grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    assert text == ["ab c d", "", "", "", "é x", "\uffffb"]


def test_language_id(spark):
    rows = texts(360) + [(1000, None, "en"), (1001, "", "fr"), (1002, "12 34 !", "de"), (1003, "the on and", None), (None, "ou les eau", "fr"),
                         (1004, "qxzjk wvpq " * 40, None), (5, "again ei un", "de"), (1005, "ou é " * 40_000, None)]
    got = language_id(frame(spark, rows).repartition(3), held_out=held(3, 1)).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r for r in got}
    away = [(found[i].lang_pred, l) for i, t, l in rows if i is not None and i != 5 and i < 360 and found[i].held_out]
    assert len(away) > 80 and sum(a == b for a, b in away) / len(away) > 0.97
    assert [found[i].lang_pred for i in (1000, 1001, 1002, 1003, 1005)] == ["und", "und", "und", "en", "fr"] and found[None].held_out
    assert all(0 <= r.score <= 1 for r in got) and [found[i].score for i in (1000, 1002)] == [0, 0]
    assert [found[i].rejected for i in (1000, 1001, 1002, 1004)] == [True] * 4
    assert not any(found[i].rejected for i in range(360))


def test_language_id_keeps_every_gram(spark, monkeypatch):
    """Many languages and many rare 4-grams: the model is that of all of them, whatever is broadcast."""
    random.seed(7)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyzäöß", k=random.randint(2, 7)))
    rows = [(i, " ".join(word() for _ in range(900 if i % 50 < 2 else 15)), f"l{i % 50:02}") for i in range(100)]
    rows += [(200 + i, " ".join(word() for _ in range(20)), None) for i in range(20)] + [(300, "日本 語 𝒜b", None), (301, "", "l03")]
    langs, counts = sorted({l for _, _, l in rows if l}), {}
    folded = {i: folded_grams(*text_bytes(pa.array([t])), letter_table())[0] for i, t, _ in rows}
    for i, _, l in rows:
        counts.setdefault(l, Counter()).update(folded[i].tolist())
    model = Model(langs, [(np.array(list(counts[l]), np.uint64), np.array(list(counts[l].values()))) for l in langs])
    want = {i: model.costs(g).mean(axis=0) for i, g in folded.items() if len(g)}
    folder = fresh_dir(spark, "documents")
    frame(spark, rows).repartition(3).write.parquet(folder)
    docs = spark.read.parquet(folder)
    seen = []
    for cells in (lang_module.CELLS, 40_000, 0):
        monkeypatch.setattr(lang_module, "CELLS", cells)
        got = {r.doc_id: r for r in language_id(docs, held_out=F.col("lang").isNull()).collect()}
        for i, costs in want.items():
            assert abs(got[i].cross_entropy - costs.min()) < 1e-5 and costs[langs.index(got[i].lang_pred)] < costs.min() + 1e-5
        assert got[301].lang_pred == "und"
        seen.append(got)
    assert seen[0] == seen[1] == seen[2]


def test_language_id_without_languages(spark):
    got = language_id(frame(spark, [(1, "abc", None), (2, None, None)])).collect()
    assert sorted((r.doc_id, r.lang_pred, r.score, r.rejected) for r in got) == [(1, "und", 0.0, False), (2, "und", 0.0, True)]
    assert language_id(frame(spark, [])).collect() == []


def test_drop_rejected(spark, tmp_path):
    rows = texts(90) + [(100, "!!", "en"), (101, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t").withColumn("_r", F.monotonically_increasing_id())
    assert {r.doc_id for r in drop_rejected(docs, "_r").collect()} == set(range(90))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def plain_rule(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_url_verdicts(spark):
    random.seed(1)
    urls = [f"http://{random.choice(['a', 'www.b', 'X.Y'])}.example.{random.choice(['org', 'com', 'net'])}/{random.choice(['fr', 'de', 'es', 'en'])}/{random.randrange(300)}"
            f"{random.choice(['', '?q=/de/', '#x', '/', '.html'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "http://org", "http://ORG/", "https://notorg/", "http://xorg/a", "a://b://c.org/x", "http://com/de/?", "http://e.com/DE/",
             "http://é.org/ü", "http://a.com" + "/de" * 2000, urls[0], "http://a.org?x/es/", "http://.org/", "javascript:alert(1)://u.example.org/es/\n1"]
    data = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, _grams string")
    got = {r.page_id: r for r in url_verdicts(data.repartition(2), RULES).collect()}
    for i, u in enumerate(urls):
        host, path, (rule, verdict) = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert url_verdicts(data.limit(0), RULES).collect() == []


def test_url_model_learns(spark):
    random.seed(2)
    rows = [(i, f"http://{random.choice(['casino', 'winbig', 'poker'] if i % 2 else ['library', 'school', 'museum'])}{random.randrange(50)}.net/{random.randrange(99)}") for i in range(300)]
    labelled = spark.createDataFrame([(u.split("/")[2], "/" + u.split("/")[3], i % 2 == 1) for i, u in rows[:200]], "host string, path string, block boolean")
    got = url_verdicts(spark.createDataFrame(rows[200:], "page_id long, url string"), [], labelled=labelled).collect()
    assert sum((r.verdict == "block") == (r.page_id % 2 == 1) for r in got) >= 98
    one = url_verdicts(spark.createDataFrame(rows[:5], "page_id long, url string"), [], labelled=labelled.filter("block"))
    assert {r.verdict for r in one.collect()} == {"block"}


def test_urls_with_null_ids_and_very_long_ones(spark):
    long = "http://a.example.net/" + "xy/" * 40_000
    rows = [(None, "http://x.org/a", "r"), (None, "http://x.org/a", "r"), (1, long, "r"), (2, "http://b.com/de/1", "r")]
    got = url_verdicts(spark.createDataFrame(rows, "page_id long, url string, rule string"), [("allow", "org", "/"), ("block", "com", "/de/")]).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got if r.rule) == [(0, "allow"), (0, "allow"), (2, "block")]
    assert [r.path for r in got if r.page_id == 1] == ["/" + "xy/" * 40_000]
