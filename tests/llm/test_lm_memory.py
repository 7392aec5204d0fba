"""What a learning task of the language model holds at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from veilwork.llm import lm_scoring as lm


def peak(work) -> int:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_merging_tallies_needs_little_beside_them():
    rng = np.random.default_rng(4)
    pieces = [rng.integers(0, 1 << 60, 20_000).astype(np.uint64) for _ in range(20)]
    tallies, merged = lm.Tallies(1 << 10), []

    def work():
        tallies.held.extend((k, np.ones(len(k), np.int64), k + np.uint64(1)) for k in pieces)
        merged.extend(tallies.flush(True))

    most = peak(work)
    keys, n, more = merged[0]
    assert n.sum() == 400_000 and (more == keys + np.uint64(1)).all()
    assert most < 2.7 * 400_000 * 24


def test_a_learning_task_is_bounded_by_its_tables_and_blocks(monkeypatch):
    """Distinct units, so nothing merges away: tables and a block of units, not several copies of the block."""
    monkeypatch.setattr(lm, "TABLE_BITS", (16,) * 6)
    monkeypatch.setattr(lm, "BLOCK", 1 << 17)
    monkeypatch.setattr(lm, "SLICE", 1 << 16)
    letters = np.random.default_rng(5).integers(97, 123, (2_000, 400)).astype(np.uint8)
    texts = pa.RecordBatch.from_arrays([pa.array([bytes(row).decode() for row in letters])], ["text"])
    held = []
    most = peak(lambda: held.extend(r.num_rows for r in lm._learn(iter([texts]))))
    assert held and most < 61_000_000


def test_words_are_looked_up_once_each():
    names = np.sort(lm.mix(np.arange(1000, dtype=np.uint64)))
    keys = lm.mix(np.random.default_rng(6).integers(0, 2000, 5000).astype(np.uint64))
    values = np.arange(1000) / 7
    known = dict(zip(names.tolist(), values.tolist()))
    for some in (names, names[:0]):
        hit, value = lm.looked_up(some, values[:len(some)], keys)
        want = known if len(some) else {}
        assert hit.tolist() == [k in want for k in keys.tolist()]
        assert value.tolist() == [want.get(k, 0.0) for k in keys.tolist()]
    assert [len(x) for x in lm.looked_up(names, values, keys[:0])] == [0, 0]
