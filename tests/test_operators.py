"""Operators against brute force on small, skewed inputs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilwork.functions.entities import bio_to_entities, spans_to_bio, tokens
from veilwork.functions.text_features import entropy
from veilwork.functions.textnorm import parse_epoch, parse_time, strip, strip_accents, strip_accents_exact, word_count
from veilwork.operators import metrics as M
from veilwork.operators.cleaning import label_encode
from veilwork.operators.containment import relabel_by_containment
from veilwork.operators.features import align_width, term_counts, tfidf_fit
from veilwork.operators.logs import session_activity
from veilwork.operators.ranking import hash_bucket, hash_order, running_rank
from veilwork.operators.sampling import COPIES_PER_TASK, oversample, stratified_split
from veilwork.session import fresh_dir
from veilwork.sources.chat_log import read_chat_log
from veilwork.sources.policy import Policy, load_policy


def test_running_rank_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, k string")
    got = {r.id: r["rank"] for r in running_rank(df, ["k"], [F.col("id")], F.floor(F.col("id") / 100)).collect()}
    seen = Counter()
    for i, k in rows:
        seen[k] += 1
        assert got[i] == seen[k]
    everything = running_rank(df.withColumn("h", hash_order(7, F.col("id"))), [], [F.col("h")], hash_bucket(F.col("h")))
    assert sorted(r["rank"] for r in everything.collect()) == list(range(1, 3001))


def test_containment_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdé😀 ") for _ in range(n))
    texts = [(i, word(rng.randint(0, 200))) for i in range(300)] + [(300, None), (301, "")]
    known = [t[1][5:5 + n] for t in texts[:60] for n in (3, 9, 14, 15, 16, 40) if t[1]] + [word(n) for n in (7, 20, 30)] + ["", " "]
    got = relabel_by_containment(
        spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(k,) for k in known], "match string"),
        "id").collect()
    trimmed = {k.strip(" ") for k in known} - {""}
    assert {r.id: r.label for r in got} == {i: int(any(k in (t or "") for k in trimmed)) for i, t in texts}


def test_one_row_class_is_copied_in_chunks(spark):
    rows = [(i, "safe") for i in range(3 * COPIES_PER_TASK)] + [(-1, "unsafe"), (-2, "unsafe")]
    got = oversample(spark.createDataFrame(rows, "id int, label string"), "label", "id").collect()
    assert Counter(r.label for r in got) == {"safe": 3 * COPIES_PER_TASK, "unsafe": 3 * COPIES_PER_TASK}
    assert len({(r.id, r["copy"]) for r in got}) == len(got)


def test_stratified_shares_are_exact(spark):
    rows = [(i, "a" if i % 10 else "b") for i in range(1003)]
    got = stratified_split(spark.createDataFrame(rows, "id int, label string"), "label", "id").collect()
    sizes, train = Counter(r[1] for r in rows), Counter(r.label for r in got if r.split == "train")
    assert train == {k: n * 4 // 5 for k, n in sizes.items()}


def test_curves_with_ties(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.3), round(rng.random() ** 4, 2)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert M.roc_auc(df, "y", "p").first()[0] == pytest.approx(want)
    ap, last = 0.0, 0.0
    for s in sorted({p for _, p in rows}, reverse=True):
        tp, fp = sum(p >= s for p in pos), sum(p >= s for p in neg)
        ap, last = ap + (tp / len(pos) - last) * tp / (tp + fp), tp / len(pos)
    assert M.average_precision(df, "y", "p").first()[0] == pytest.approx(ap)


def test_sessions_equal_brute_force(spark):
    rng = random.Random(9)
    rows = sorted((rng.randint(0, 3), rng.randint(0, 400) * 1800) for _ in range(600))
    df = spark.createDataFrame(rows, "u int, s bigint").select("u", F.timestamp_seconds("s").alias("ts"))
    got = Counter((r.u, r.events) for r in session_activity(df, "u", "ts").collect())
    want, last = Counter(), {}
    sizes = []
    for u, s in rows:
        if u in last and s < last[u] + 8 * 3600:
            sizes[-1][1] += 1
        else:
            sizes.append([u, 1])
        last[u] = s
    for u, n in sizes:
        want[(u, n)] += 1
    assert got == want


def test_entropy_small_and_large_alphabet(spark):
    wide = "".join(chr(0x4E00 + i % 400) for i in range(1000))
    texts = ["", "a", "aab", "é😀é\n", wide]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(entropy(F.col("t"))).collect()]
    for t, value in zip(texts, got):
        want = -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0.0
        assert value == pytest.approx(want)


def test_white_space_is_pythons(spark):
    texts = ["  a\x1cb　c\x85", "\x1f", "", "a​b c"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(
        strip(F.col("t")).alias("s"), word_count(F.col("t")).alias("n")).collect()
    assert [(r.s, r.n) for r in got] == [(t.strip(), len(t.split())) for t in texts]


def test_accents(spark):
    row = spark.createDataFrame([("Ünïcode é é ñ ß ﬁ",)], "t string").select(
        strip_accents(F.col("t")).alias("a"), strip_accents_exact(F.col("t")).alias("b")).first()
    assert (row.a, row.b) == ("Unicode e e n ß ﬁ", "Unicode e e n ß fi")


def test_times(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.5+0200", "2024-01-02", "2024-01-02 03", "", "x", None, "2024-02-30"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(
        F.date_format(parse_time(F.col("t")), "yyyy-MM-dd HH:mm:ss.S")).collect()]
    assert got == ["2024-01-02 03:04:05.0", "2024-01-02 01:04:05.5", "2024-01-02 00:00:00.0", "2024-01-02 03:00:00.0",
                   None, None, None, None]
    epochs = spark.createDataFrame([(0.0,), (1.5,)], "s double").select(parse_epoch(F.col("s")).cast("double")).collect()
    assert [r[0] for r in epochs] == [None, 1.5]


def test_tokens_and_labels(spark):
    spans = [(0, 8, "NAME"), (0, 3, "FIRST"), (9, 10, "X")]
    row = spark.createDataFrame([("Ann Bold, hi", spans)], "text string, spans array<struct<start:int,end:int,label:string>>")
    toks = tokens(F.col("text"))
    assert [tuple(x) for x in row.select(toks).first()[0]] == [("Ann", 0, 3), ("Bold", 4, 8), (",", 8, 9), ("hi", 10, 12)]
    known = ["NAME", "FIRST"]
    ref = row.select(spans_to_bio(toks, F.col("spans"), known)).first()[0]
    assert [x.label for x in ref] == ["I-FIRST", "B-NAME", "O", "O"]
    std = row.select(spans_to_bio(toks, F.col("spans"), known, "standard").alias("b"))
    assert [x.label for x in std.first().b] == ["B-NAME", "I-NAME", "O", "O"]
    assert [tuple(x) for x in std.select(bio_to_entities(F.col("b"))).first()[0]] == [("NAME", 0, 8)]


def test_term_counts_and_limits(spark):
    row = spark.createDataFrame([(["b", "a", "b"],), ([],)], "t array<string>").select(term_counts(F.col("t"))).collect()
    assert [[tuple(x) for x in r[0]] for r in row] == [[("a", 1), ("b", 2)], []]
    docs = spark.createDataFrame([(i, "red blue" if i < 5 else "green") for i in range(10)], "id int, text string")
    fitted = {r.term: r.df for r in tfidf_fit(docs, "id", "text", first_rows=6, min_df=1).collect()}
    assert fitted == {"red": 5, "blue": 5, "red blue": 5, "green": 1}


def test_wrong_width_and_label_stop_the_job(spark):
    with pytest.raises(Exception, match="expected 3 features"):
        spark.createDataFrame([([1.0],)], "v array<double>").select(align_width(F.col("v"), 3)).collect()
    with pytest.raises(Exception, match="unexpected label"):
        label_encode(spark.createDataFrame([("odd",)], "label string")).collect()


def test_unreadable_policy_is_empty(spark):
    policy = load_policy(spark, fresh_dir(spark, "nothing"))
    assert (policy.block, policy.mask, policy.entity) == (frozenset(), frozenset(), ())
    assert policy.threshold("ml_unsafe") == 0.65 and Policy().threshold("ml_unsafe") == 0.80


def test_log_file(spark):
    path = fresh_dir(spark, "log")
    text = "2025-01-01T00:00:00+00:00 | user=guest | allow | a | b\nmore\n2025-01-01T00:00:01+00:00 | user=7 | block | [X]\n"
    lines = [(line,) for line in text.rstrip("\n").split("\n")]
    spark.createDataFrame(lines, "v string").coalesce(1).write.text(path)
    got = [(r.user, r.action, r.text) for r in read_chat_log(spark, path).orderBy("record_no").collect()]
    assert got == [(None, "allow", "a | b\nmore"), ("7", "block", "[X]")]


def test_null_keys_are_a_group(spark):
    from veilwork.operators.logs import guest_quota

    rows = [(i, None if i % 3 == 0 else "u", None if i % 5 == 0 else f"2024-01-0{i % 7 + 1} 10:00:00") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, user string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = guest_quota(df, "user", "at", "id").collect()
    for user in (None, "u"):
        assert sorted(r.message_no for r in got if r.user == user) == list(range(1, sum(u == user for _, u, _ in rows) + 1))
    labelled = spark.createDataFrame([(i, None if i % 4 == 0 else "a") for i in range(103)], "id int, label string")
    assert Counter(r.split for r in stratified_split(labelled, "label", "id").collect() if r.label is None) == {"train": 20, "test": 6}
    assert Counter(r.label for r in oversample(labelled, "label", "id").collect()) == {None: 77, "a": 77}


def test_headers_in_two_spellings(spark):
    from veilwork.sources.sinks import client_agent, client_ip

    maps = ["map('X-Real-IP', '1.1.1.1', 'x-real-ip', '2.2.2.2', 'User-Agent', 'a', 'user-agent', 'b')", "map('x', 'y')", "CAST(NULL AS MAP<STRING, STRING>)"]
    rows = spark.sql(" UNION ALL ".join(f"SELECT {m} AS h" for m in maps))
    got = rows.select(client_ip(F.col("h")).alias("ip"), client_agent(F.col("h")).alias("agent")).collect()
    assert sorted(map(tuple, got)) == [("2.2.2.2", "b"), ("unknown", "unknown"), ("unknown", "unknown")]


def test_json_text(spark):
    from veilwork.operators.cleaning import json_text

    rows = ['"a\\nb"', '"q\\"x"', "12", "1, 2", "plain", "", None, "null", "'x'"]
    got = spark.createDataFrame([(r,) for r in rows], "v string").select(json_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == ["a\nb", 'q"x', "12", None, None, None, None, None, None]


def test_registered_models_have_real_sizes(spark):
    from veilwork.catalog import models
    assert (models.SIZES.boost_rounds, models.SIZES.boost_depth, models.SIZES.trees, models.SIZES.tree_depth) == (250, 7, 160, 16)


def test_daily_findings_add_up(spark):
    from veilwork.operators.summaries import daily_findings, over_days

    kind = "array<struct<name:string,category:string,severity:string,match:string,start:int,end:int>>"
    found = lambda *names: [(n, "c" + n[0], "high", f"{n}{i}", 0, 1) for i, n in enumerate(names)]
    rows = [("d1", "mask", found("ax", "ay", "ax")), ("d1", "allow", []), ("d2", "mask", found("ax", "b")), (None, "allow", []),
            *[("d3", "block", [("s", "cs", "low", f"m{i % 5000}", 0, 1)]) for i in range(20_000)]]
    df = spark.createDataFrame(rows, f"day string, action string, findings {kind}").repartition(4)
    daily = daily_findings(df, "day", "action")
    got = {(r["day"], r["level"], r["value"]): (r["findings"], r["texts"]) for r in daily.collect()}
    assert got["d1", "name", "ax"] == (2, 1) and got["d1", "category", "ca"] == (3, 1) and got["d1", "all", ""] == (3, 2)
    assert got["d1", "action", "allow"] == (0, 1) and got[None, "all", ""] == (0, 1) and got["d2", "severity", "high"] == (2, 1)
    whole = {(r["level"], r["value"]): r for r in over_days(daily).collect()}
    assert (whole["all", ""]["findings"], whole["all", ""]["texts"]) == (20_005, 20_004) and whole["name", "ax"]["texts"] == 2
    assert abs(whole["name", "s"]["distinct_matches"] - 5000) < 250 and whole["name", "ax"]["distinct_matches"] == 2


@pytest.mark.parametrize("n", [0, 1, 7, 300, 501, 5000, 100_000])
def test_sample_takes_the_lowest_hashes(spark, n):
    import hashlib

    from veilwork.operators.sampling import sample_n

    ids = [*range(500), *[3] * 500]
    got = [r["id"] for r in sample_n(spark.createDataFrame([(i, "t") for i in ids], "id long, text string").repartition(3), "id", n).collect()]
    key = lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest()
    assert sorted(got) == sorted(sorted(ids, key=key)[:n])


def test_clean_up(spark, monkeypatch):
    from veilwork import session

    monkeypatch.setattr(session, "_made", {})
    kept = session.materialize(spark.range(5), "left")
    assert kept.count() == 5 and session.clean_up(spark) == 1 and session.clean_up(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(*kept.inputFiles()).count()
