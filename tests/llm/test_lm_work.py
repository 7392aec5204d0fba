"""The language model does a step once for all that share it, and gets what it would get one by one."""

from collections import Counter

import numpy as np
import pyarrow as pa

from veilwork.llm import lm_scoring as lm
from veilwork.llm.kernel import text_bytes

ROWS = ["the cat sat on the mat", "The cat sat on the mats", None, "on the other mat a cat sat", "x" * 40, "the cat sat on the mat"] * 3


def units():
    stream, bounds, _, _ = lm.byte_stream(*text_bytes(pa.array(ROWS)))
    return lm.byte_units(stream, bounds, lm.Powers())


def test_each_context_is_predicted_once_with_its_byte():
    grams, prefixes = units()
    n = np.arange(len(grams)) % 5 + 1
    mixer = lm.Mixer([np.zeros(2 << b, np.uint32) for b in lm.TABLE_BITS])
    found = mixer.predictions(grams, prefixes, n)
    for order, (logits, parts, row) in enumerate(found):
        seen = list(zip(lm.contexts(order, grams, prefixes).tolist(), (grams & np.uint64(255)).tolist()))
        assert len(logits) == len(parts) == len(set(seen)) < len(seen) / 3
        assert len(set(zip(seen, row.tolist()))) == len(set(seen)) == len(set(row.tolist()))
        # Tables this empty have no foreign counts: what follows a context and the bits so far, without one occurrence.
        times = Counter()
        for (context, byte), many in zip(seen, n.tolist()):
            for depth in range(8):
                times[context, depth, byte >> (7 - depth)] += many
        for k in range(0, len(seen), 7):
            context, byte = seen[k]
            for depth in range(8):
                own, other = times[context, depth, byte >> (7 - depth)] - 1, times[context, depth, byte >> (7 - depth) ^ 1]
                sign = 1 if byte >> (7 - depth) & 1 else -1
                assert abs(logits[row[k], depth] - sign * np.log((own + 0.3) / (other + 0.3))) < 1e-4
    assert sum(int(t.sum()) for t in mixer.tables) == 8 * len(lm.TABLE_BITS) * n.sum()


def test_costs_are_kept_from_slice_to_slice(monkeypatch):
    grams, prefixes = units()
    rng = np.random.default_rng(2)
    mixer = lm.Mixer([rng.integers(0, 1 << 20, 1 << b).astype(np.uint32) for b in lm.TABLE_BITS])
    plain, asked = mixer.costs(grams, prefixes), []
    costs = mixer.costs
    monkeypatch.setattr(mixer, "costs", lambda g, p: (asked.append(len(g)), costs(g, p))[1])
    known = lm.Known(mixer)
    for _ in range(2):
        assert np.allclose(known.costs(grams, prefixes), plain, rtol=1e-6)
    assert asked == [len(set(lm.unit_keys(grams, prefixes).tolist())), 0]
    # With places for few, units drive each other out and are only worked out again.
    monkeypatch.setattr(lm, "REMEMBERED", 8)
    few = lm.Known(mixer)
    for _ in range(3):
        assert np.allclose(few.costs(grams, prefixes), plain, rtol=1e-6)


def test_counted_units_lose_nothing_where_places_are_taken():
    rng = np.random.default_rng(3)
    keys = lm.mix(rng.integers(1, 3000, 20_000).astype(np.uint64))
    counted, got, blocks = lm.Counted(500), Counter(), 0
    for some in np.split(keys, 40):
        counted.add(some, some + np.uint64(1))
        for found, n, grams in counted.flush():
            assert 500 < len(found) == len(set(found.tolist())) and (grams == found + np.uint64(1)).all()
            got.update(dict(zip(found.tolist(), n.tolist())))
            blocks += 1
    for found, n, _ in counted.flush(True):
        got.update(dict(zip(found.tolist(), n.tolist())))
    assert got == Counter(keys.tolist()) and blocks > 2
