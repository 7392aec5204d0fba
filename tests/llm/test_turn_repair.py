"""Conversation repair against a plain search over edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from veilwork.llm import turn_repair
from veilwork.llm.queries import QUERIES
from veilwork.llm.turn_repair import Paths, Units, _behind, damage, repair_conversations

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, copies string, KEY int"


def damaged(rows):
    """The rows after damage, per conversation in order."""
    out = {}
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        mine += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def repaired(rows):
    """The result's columns for the rows of one conversation, by trying all edits."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]

    def after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @lru_cache(None)
    def best(i, state, inserted=0):
        """(cost, audit) of the rest; lines follow from the audit."""
        options = [(0, "")] if i == len(rows) and state in ("", "a") else []
        add = "a" if state == "u" else "u"
        if inserted < 3:
            c, a = best(i, add, inserted + 1)
            options.append((c + 3, "I" + a))
        if i < len(rows):
            c, a = best(i + 1, state)
            options.append((c + 4, "D" + a))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                to = after(state, initials[i])
                if to:
                    c, a = best(i + 1, to)
                    options.append((c + more, "K" + a))
                c, a = best(i + 1, add)
                options.append((c + more + 3, "R" + a))
        return min(options, default=(10 ** 9, "~"))

    for i in range(len(rows), 0, -1):
        for state in ("", "s", "u", "a"):
            best(i, state)
    cost, audit = best(0, "")
    lines, i, state = [], 0, ""
    for letter in audit:
        add = "a" if state == "u" else "u"
        if letter == "I":
            lines.append(("user" if add == "u" else "assistant", ""))
            state = add
        elif letter == "D":
            i += 1
        else:
            role = rows[i][1] if letter == "K" else "user" if add == "u" else "assistant"
            lines.append((role, rows[i][2]))
            state, i = role[0], i + 1
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)


def conversations(seed, convs, most):
    rnd, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "tool", "", None, "User", "uncle"]
    texts = ["Hello.", "What? ", "no end", " \n", "", None, "é🙂!", "Again\t.", "x" * 300 + "?"]
    for conv in [None, *range(convs)]:
        turn = 0
        for _ in range(rnd.randrange(1, most)):
            turn += rnd.choice([0, 1, 1, 1, 2])
            role = rnd.choice(roles[:2]) if rnd.random() < 0.7 else rnd.choice(roles)
            text = f"{rnd.random()}." if rnd.random() < 0.6 else rnd.choice(texts)
            rows += [(conv, None if rnd.random() < 0.05 else turn, role, text)] * rnd.choice([1, 1, 1, 1, 2, 30])
    rnd.shuffle(rows)
    return rows


def check(spark, tmp_path, rows):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3).write.parquet(path)
    got = QUERIES["op11_turn_repair"](spark, str(tmp_path)).collect()
    want = {conv: repaired(mine) for conv, mine in damaged(rows).items()}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]


def test_small_conversations(spark, tmp_path):
    check(spark, tmp_path, conversations(1, 300, 12))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(turn_repair, "CHUNK", 3)
    monkeypatch.setattr(turn_repair, "SLICE", 7)


def test_conversations_over_many_chunks(spark, tmp_path, small):
    check(spark, tmp_path, conversations(2, 8, 120) + [(99, t, "user" if t % 3 else "assistant", f"text {t}" + "." * (t % 2)) for t in range(700)])


def test_all_rows_gone(spark, tmp_path):
    gone = [(c, 0, "user", "Hi.") for c in range(200)]
    check(spark, tmp_path, [r for r in gone if zlib.crc32(f"{r[0]}:0".encode()) % 20 == 0])


def test_hot_conversation_and_repeats(spark, tmp_path):
    rows = [(7, t, ["user", "assistant"][t % 2], f"line {t // 3}.") for t in range(3000)] + [(8, 1, "user", "Same.")] * 3000 + [(9, None, None, None)] * 50
    check(spark, tmp_path, rows)


def test_turns(spark):
    rows = [(1, 0, "system", "Be."), (1, 1, "user", "Hi."), (1, 2, "tool", "Out."), (2, 5, "assistant", "So."), (2, 5, "user", "And?")]
    done = repair_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = [(r["conv"], r["position"], r["edit"], r["role"], r["text"]) for r in done.turns.orderBy("conv", "position").collect()]
    assert got == [(1, 0, "K", "system", "Be."), (1, 1, "K", "user", "Hi."), (1, 2, "R", "assistant", "Out."),
                   (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "So."), (2, 2, "K", "user", "And?"), (2, 3, "I", "assistant", "")]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert QUERIES["op11_turn_repair"](spark, str(tmp_path)).collect() == []


@given(st.lists(st.tuples(st.sampled_from([0, 1, 2, 3]), st.booleans(), st.booleans(), st.integers(0, 3)), max_size=14))
@settings(max_examples=300, deadline=None)
def test_least_paths(rows):
    """Whole paths from every state, against a search over edits."""
    rows = [r for r in rows if r[1] or r[3]]
    kind = np.array([i + 4 * t + 8 * f for i, f, t, _ in rows], np.int64)
    forced = np.array([n for *_, n in rows], np.int64)
    units = Units(kind, forced, np.array([0, len(rows)]))
    paths = Paths(units, np.array([[0, 6, 3, 0]]), np.array([True]))

    @lru_cache(None)
    def best(i, q, inserted=0):
        options = [(0, "")] if i == len(units.row) and q in (0, 3) else []
        add = 3 if q == 2 else 2
        if inserted < 3:
            c, a = best(i, add, inserted + 1)
            options.append((c + 3, "I" + a))
        if i < len(units.row):
            c, a = best(i + 1, q)
            n = int(units.times[i])
            options.append((c + 4 * n, "D" * n + a))
            if units.free[i]:
                more = int(units.bad[i])
                to = [[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]][q][units.initial[i]]
                if to >= 0:
                    c, a = best(i + 1, to)
                    options.append((c + more, "K" + a))
                c, a = best(i + 1, add)
                options.append((c + more + 3, "R" + a))
        return min(options, default=(10 ** 9, "~"))

    nodes, bounds, _ = paths.walk(np.arange(4))
    for q in range(4):
        audit = ""
        for node in nodes[bounds[q]:bounds[q + 1]]:
            letter, unit = paths.letter[node], paths.unit[node // 4]
            audit += "-DIKR"[letter] * (int(units.times[unit]) if letter == 1 else 1)
        assert (paths.cost[0, q], audit) == best(0, q)
