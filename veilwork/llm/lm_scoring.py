"""Language-model scores by online logistic context mixing.

A text is read as the bytes of its lower-cased words, a space after each word and a line feed
at the end. Every bit is predicted by one predictor per context: the last 1 to 5 bytes,
and the word so far. A predictor is a table of bit counts by hashed context. Their predictions, as
logits, are added with weights; a gate chooses the weight set by the longest contexts met, how
often and how surely. An adaptive map refines the sum.

Training is one pass in Spark. Each task counts the bits of its texts per slot and learns weights
online, block by block of units - a byte, the five before it, the word so far - each predicted as
if one occurrence had not been seen. Tasks that own a range of slots then add up what all others
counted, which grows with the corpus, and the weights are averaged. A text's score needs each
distinct unit of a slice once; most of those met before are remembered.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch
from .kernel import list_array, lower_table, mix, parts, range_hashes, words

#: Slots of each context's table, as powers of two: the model's fixed size, 71 MB. The last is
#: that of the word so far. A context has a run of 16 slots from a hashed place on for a byte's
#: first half and one for its second half, so a byte's eight bits touch two places in memory.
TABLE_BITS = (16, 20, 22, 22, 22, 22)
CONTEXT_BYTES = (1, 2, 3, 4, 5)
#: Slots that one task of the filling step owns, as a power of two.
PART_BITS = 14
#: Words whose counts are broadcast; the counts of rarer ones are joined.
FREQUENT_WORDS = 1 << 20
_ORDERS = len(TABLE_BITS)
_BYTES = _ORDERS - 1
_BACK = max(CONTEXT_BYTES)
#: Bytes of text that a task works on at a time, and units that it counts before it learns from them.
SLICE, BLOCK = 3 << 18, 1 << 20
#: Units that are counted and predicted together, each distinct context with its byte once.
CHUNK = 1 << 16
#: Numbers that are worked on at a time where each step is short, so that they stay in a near cache.
NEAR = 1 << 14
#: Units whose costs a task remembers from slice to slice.
REMEMBERED = 1 << 22
_GATES = (_BYTES + 1) * 5 * 2 * 5 * 8
_STEPS, _REACH = 33, 8.0
_MIDDLE, _COST, _NAMED = np.uint64(255 << 20), np.uint64((1 << 32) - 1), np.uint64(1 << 32)
_PART, _WORD, _TEXT, _WEIGHT = 0, 1, 2, 3


def byte_stream(data: np.ndarray, offsets: np.ndarray):
    """(bytes, row bounds, word hashes, row bounds of the words) of the texts as the model reads them."""
    lowered = lower_table()[data]
    starts, ends, bounds = words(lowered, offsets)
    hashes = range_hashes(lowered, starts, ends)
    empty = np.flatnonzero(np.diff(bounds) == 0)
    starts, ends = np.insert(starts, bounds[empty], 0), np.insert(ends, bounds[empty], 0)
    pieces = np.maximum(np.diff(bounds), 1)
    last = np.cumsum(pieces) - 1
    lengths = ends - starts + 1
    stops = np.cumsum(lengths)
    source = np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - (stops - lengths), lengths)
    stream = lowered[np.minimum(source, max(len(lowered) - 1, 0))] if len(lowered) else np.zeros(len(source), np.uint8)
    stream[stops - 1] = 32
    stream[stops[last] - 1] = 10
    return stream, np.concatenate(([0], stops[last])), hashes, bounds


class Powers:
    """Powers of a multiplier and of its inverse modulo 2 ** 64, kept for the next slice."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            base = 0x9E3779B97F4A7C15
            for name, factor in (("up", base), ("down", pow(base, -1, 1 << 64))):
                powers = np.full(size, factor, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up[:size], self.down[:size]


def byte_units(stream: np.ndarray, bounds: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Per byte the 6-gram that ends there (line feeds stand before a row) and a hash of its word so far."""
    # Eight bytes up to each place at once, the last one lowest.
    wide = np.ndarray(len(stream), ">u8", np.concatenate((np.full(7, 10, np.uint8), stream)).data, strides=(1,))
    grams = wide.astype(np.uint64)
    grams &= np.uint64((1 << 8 * (_BACK + 1)) - 1)
    # The first bytes of a row look back to what is not theirs.
    at = (bounds[:-1, None] + np.arange(_BACK))[np.arange(_BACK) < np.diff(bounds)[:, None]]
    into = at - bounds[np.searchsorted(bounds, at, "right") - 1]
    early = stream[at].astype(np.uint64)
    for back in range(1, _BACK + 1):
        early |= np.where(into < back, np.uint64(10), stream[np.maximum(at - back, 0)]) << np.uint64(8 * back)
    grams[at] = early
    stops = np.flatnonzero((stream == 32) | (stream == 10)) + 1
    starts = np.concatenate(([0], stops[:-1]))
    up, down = powers(len(stream))
    total = np.zeros(len(stream) + 1, np.uint64)
    hashed = stream.astype(np.uint64)
    hashed += np.uint64(1)
    hashed *= up
    np.cumsum(hashed, out=total[1:])
    prefixes = total[:-1]
    prefixes -= np.repeat(total[starts], stops - starts)
    prefixes *= np.repeat(down[starts], stops - starts)
    return grams, mixed_in_place(prefixes)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): an order that puts equal keys side by side, and where each run begins.

    Sorted by the keys' upper bits with the place in the lower ones, which is much faster than
    an argsort. Keys alike in those bits may make a run of a key come in pieces, no more.
    """
    size = np.uint64(max(len(keys) - 1, 1).bit_length())
    low = (np.uint64(1) << size) - np.uint64(1)
    order = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order = (order & low).astype(np.int64)
    found = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(keys) else np.zeros(0, np.int64)


def mixed_in_place(hashes: np.ndarray) -> np.ndarray:
    """mix(), over pieces that stay in a near cache."""
    for first in range(0, len(hashes), NEAR):
        hashes[first:first + NEAR] = mix(hashes[first:first + NEAR])
    return hashes


def unit_keys(grams: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    keys = mixed_in_place(grams.copy())
    keys ^= prefixes
    return keys


class Tallies:
    """Counts by key with more that goes with a key, merged now and then and given up in blocks."""

    def __init__(self, limit: int):
        self.limit, self.held = limit, []

    def add(self, keys: np.ndarray, *more: np.ndarray) -> None:
        order, starts = runs(keys)
        first = order[starts]
        self.held.append((keys[first], np.diff(np.append(starts, len(keys))), *(m[first] for m in more)))

    def _merged(self):
        """All that is held, put together column by column; a column's pieces go before the next one's are joined."""
        keys, counts, *more = ([h[k] for h in self.held] for k in range(len(self.held[0])))
        self.held = []

        def joined(pieces):
            whole = np.concatenate(pieces)
            pieces.clear()
            return whole

        keys = joined(keys)
        order, starts = runs(keys)
        first = order[starts]
        keys = keys[first]
        counts = joined(counts)[order]
        del order
        counts = np.add.reduceat(counts, starts) if len(starts) else counts
        return keys, counts, *(joined(m)[first] for m in more)

    def flush(self, last: bool = False):
        """(keys, counts, *more) of about `limit` keys or more, or what there is at last."""
        if self.held and (last or sum(len(h[0]) for h in self.held) > 2 * self.limit):
            merged = self._merged()
            if last or len(merged[0]) > self.limit:
                yield merged
            else:
                self.held = [merged]


class Counted:
    """Counts of units by key with their grams, given up in blocks of about `limit`.

    A key has one place in a table, by its upper bits, and the first to come has it until the
    block is given up. What finds its place taken is tallied beside the table.
    """

    def __init__(self, limit: int):
        self.limit, self.size, self.rest = limit, (2 * limit - 1).bit_length(), Tallies(limit)
        self.held = self.grams = None

    def add(self, keys: np.ndarray, grams: np.ndarray) -> None:
        if self.held is None:
            # Key and count side by side: both come with one fetch.
            self.held, self.grams = np.zeros(2 << self.size, np.uint64), np.zeros(1 << self.size, np.uint64)
        missed = []
        for begin in range(0, len(keys), NEAR):
            some = keys[begin:begin + NEAR]
            place = (some >> np.uint64(64 - self.size)).astype(np.int64)
            at = place + place
            there = self.held.take(at)
            # Of several keys that come to a free place one has it.
            free = np.flatnonzero(there == 0)
            self.held[at[free]] = some[free]
            there[free] = self.held.take(at[free])
            has = there == some
            free = free[has[free]]
            self.grams[place[free]] = grams[begin + free]
            at += 1
            if not has.all():
                missed.append(np.flatnonzero(~has) + begin)
                at = at[has]
            np.add.at(self.held, at, np.uint64(1))
        if missed:
            missed = np.concatenate(missed)
            self.rest.add(keys[missed], grams[missed])

    def flush(self, last: bool = False):
        """(keys, counts, grams) of more than `limit` keys, or what there is at last."""
        if self.held is not None and (last or np.count_nonzero(self.held[1::2]) + sum(len(h[0]) for h in self.rest.held) > self.limit):
            at = np.flatnonzero(self.held[1::2])
            block = [[self.held[2 * at]], [self.held[2 * at + 1].view(np.int64)], [self.grams[at]]]
            self.held = self.grams = at = None
            for rest in self.rest.flush(True):
                for pieces, more in zip(block, rest):
                    pieces.append(more)
            yield tuple(np.concatenate(pieces) for pieces in block)


def contexts(order: int, grams: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    return prefixes if order == _BYTES else (grams >> np.uint64(8)) & np.uint64((1 << 8 * CONTEXT_BYTES[order]) - 1)


def byte_tables() -> dict[str, np.ndarray]:
    """For each byte its eight bits, the nodes of its bit tree, and where its bits are counted in the runs of its two halves."""
    byte, depth = np.arange(256)[:, None], np.arange(8)
    bits, nodes = byte >> (7 - depth) & 1, 1 << depth | byte >> (8 - depth)
    half, within = np.where(depth < 4, byte >> 4, byte & 15), depth % 4
    counters = 2 * (1 << within | half >> (4 - within)) + bits
    return {"nodes": nodes, "counters": counters, "ones": bits.astype(np.float32), "signs": (2 * bits - 1).astype(np.float32)}


def counters(order: int, first: np.ndarray, byte: np.ndarray, within: np.ndarray) -> np.ndarray:
    """For hashes of contexts and their bytes where the eight bits are counted: twice the slot, and the bit."""
    bits = np.uint64(64 - TABLE_BITS[order])
    starts = np.empty((len(first), 2), np.int64)
    starts[:, 0] = first >> bits
    starts[:, 1] = mix(first + (byte >> 4).astype(np.uint64) + np.uint64(1)) >> bits
    starts += starts
    at = within.take(byte, axis=0)
    at += np.repeat(starts.ravel(), 4).reshape(-1, 8)
    at &= np.int64((2 << TABLE_BITS[order]) - 1)
    return at


_LEARNED = "kind int, at int, part int, key long, n long, value double, mass double, counts binary"


def _rows(kind: int, at=None, part=None, key=None, n=None, value=None, mass=None, counts=None) -> pa.RecordBatch:
    given = {"at": (at, pa.int32()), "part": (part, pa.int32()), "key": (key, pa.int64()), "n": (n, pa.int64()),
             "value": (value, pa.float64()), "mass": (mass, pa.float64()), "counts": (counts, pa.binary())}
    size = next(len(x) for x, _ in given.values() if x is not None)
    columns = [pa.nulls(size, t) if x is None else pa.array(x, t) for x, t in given.values()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *columns], ["kind", *given])


def squeezed(counts: np.ndarray) -> bytes:
    """What zlib.decompress() reads; runs of zeros are most of a table, and to look for nothing else is fast."""
    small = zlib.compressobj(1, zlib.DEFLATED, zlib.MAX_WBITS, 9, zlib.Z_RLE)
    return small.compress(counts.tobytes()) + small.flush()


def _tidy(work):
    """The same work; what it held is given back once it has ended."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> words, texts, this task's bit counts by part, and the weights it learned."""
    powers, units, names, texts = Powers(), Counted(BLOCK), Tallies(BLOCK), 0
    online, rng = Online(), np.random.default_rng(5)

    def take(last=False):
        for keys, n, grams in units.flush(last):
            give_back()
            online.learn_keys(keys, grams, n, rng.permutation(len(n)))  # counted units come in the order of their hashes

    for batch in batches:
        texts += batch.num_rows
        for _, _, data, offsets in parts(batch.column(0), SLICE):
            stream, bounds, hashes, _ = byte_stream(data, offsets)
            grams, prefixes = byte_units(stream, bounds, powers)
            units.add(unit_keys(grams, prefixes), grams)
            names.add(hashes)
            del stream, bounds, hashes, grams, prefixes
            take()
            for keys, n in names.flush():
                yield _rows(_WORD, key=keys.view(np.int64), n=n)
    take(True)
    for keys, n in names.flush(True):
        yield _rows(_WORD, key=keys.view(np.int64), n=n)
    if texts:
        yield _rows(_TEXT, key=[0], n=[texts])
        at, values, masses = online.learned()
        yield _rows(_WEIGHT, at=at, value=values, mass=masses)
    tables = online.mixer.tables
    online = units = names = None
    for order in range(_ORDERS):
        table, tables[order] = tables[order], None
        found = [(k, squeezed(piece)) for k, piece in enumerate(table.reshape(-1, 2 << PART_BITS)) if piece.any()]
        for first in range(0, len(found), 64):
            some = found[first:first + 64]
            yield _rows(_PART, at=[order] * len(some), part=[k for k, _ in some], counts=[c for _, c in some])
        del found, table


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (order, part, counts) in order -> one row per part: the sums, two 16-bit numbers a slot."""
    at, total = None, None

    def done():
        # Counts of a slot are scaled down together to fit 16 bits.
        pairs = total.reshape(-1, 2)
        most = np.maximum(pairs.max(axis=1, keepdims=True), 1)
        small = np.where(most > 65535, np.minimum(np.ceil(pairs * (65535 / most)), 65535), pairs).astype("<u2")
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()),
                                           pa.array([squeezed(small)], pa.binary())], ["order", "part", "counts"])

    for batch in batches:
        for order, part, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if (order, part) != at:
                if at is not None:
                    yield done()
                at, total = (order, part), 0
            total = total + np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
    if at is not None:
        yield done()


def load_tables(rows) -> list[np.ndarray]:
    """Per context an array over slots: the count of zeros in the low 16 bits, of ones in the high."""
    tables = [np.zeros(1 << bits, np.uint32) for bits in TABLE_BITS]
    for order, part, counts in rows:
        first = part << PART_BITS
        piece = np.frombuffer(zlib.decompress(counts), "<u4")
        size = min(len(piece), len(tables[order]) - first)
        tables[order][first:first + size] = piece[:size]
    return tables


class Packed:
    """Bytes that travel compressed (each executor keeps a copy on disk) and are plain bytes where they arrive."""

    def __init__(self, raw: bytes):
        self.small = zlib.compress(raw, 1)

    def __reduce__(self):
        return zlib.decompress, (self.small,)


def give_back() -> None:
    """Hand freed memory back to the system: workers wait for their next task with all they ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def roomy(tables: list) -> list[np.ndarray]:
    """Plain bytes as arrays, in place: numpy asks for large pages, which fetches from all over a table need."""
    for k, table in enumerate(tables):
        if isinstance(table, bytes):
            tables[k] = np.array(np.frombuffer(table, np.uint32))
        del table
    return tables


class Mixer:
    """Gated weights over the predictors' logits, and the map that refines the sum."""

    def __init__(self, tables: list[np.ndarray], weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.tables = tables
        self.weights = np.full((_GATES, _ORDERS + 1), 0.3, np.float32) if weights is None else weights
        self.weights[:, _ORDERS] = 0 if weights is None else self.weights[:, _ORDERS]
        self.refined, self.of_byte = refined, byte_tables()

    @staticmethod
    def distinct(grams: np.ndarray, prefixes: np.ndarray):
        """Per order one unit of each distinct context with its byte, and for each unit which of them is its own."""
        # The byte first and what stands before it after it: one sort does for all numbers of bytes.
        backward = grams.byteswap()
        backward |= np.arange(len(grams), dtype=np.uint64)
        backward.sort()
        by = (backward & np.uint64(CHUNK - 1)).astype(np.int64)
        apart = backward[1:] ^ backward[:-1]
        for order in range(_ORDERS):
            if order < _BYTES:
                new = np.concatenate(([True], apart >= np.uint64(1 << 64 - 8 * (CONTEXT_BYTES[order] + 1))))
            else:
                by, starts = runs((prefixes & ~_MIDDLE) | (grams & np.uint64(255)) << np.uint64(20))
                new = np.zeros(len(by), bool)
                new[starts] = True
            row = np.empty(len(by), np.int64)
            row[by] = np.cumsum(new) - 1
            yield by[new], row

    def predictions(self, grams: np.ndarray, prefixes: np.ndarray, n: np.ndarray | None = None) -> list[tuple]:
        """Per order (logits, parts of the gate, row of each unit): a row for each distinct context with its byte.

        For CHUNK units at most. With `n`, how often each unit occurs, the units' bits are counted
        first and then predicted without one occurrence.
        """
        byte, out = (grams & np.uint64(255)).astype(np.int64), []
        for order, (each, row) in enumerate(self.distinct(grams, prefixes) if len(grams) else ()):
            first = mix(contexts(order, grams[each], prefixes[each]) + np.uint64(order << 56))
            own = byte[each]
            at = counters(order, first, own, self.of_byte["counters"])
            # Two 32-bit counts a slot while learning, two 16-bit ones after.
            table = self.tables[order].view(np.uint16 if n is None else np.uint32)
            if n is not None:
                np.add.at(table, at.ravel(), np.repeat(np.bincount(row, n, len(each)).astype(np.uint32), 8))
            logits, parts = np.empty(at.shape, np.float32), np.empty(at.shape, np.uint8)
            for k in range(0, len(each), 1 << 12):
                some = slice(k, k + (1 << 12))
                place = at[some]
                taken = table.take(place).astype(np.float32)
                place ^= 1
                other = table.take(place).astype(np.float32)
                if n is not None:
                    taken -= 1
                total, one_sided = taken + other, (np.minimum(taken, other) == 0).view(np.uint8)
                met = (total > 0).view(np.uint8)
                if order == _BYTES:
                    part = one_sided + met + (total > 1).view(np.uint8) * 2
                else:
                    part = (met + (total > 1) + (total > 3) + (total > 15)) * 2 + one_sided + 10 * (order + 1)
                np.multiply(part, met, out=parts[some])
                taken += np.float32(0.3)
                other += np.float32(0.3)
                taken /= other
                np.log(taken, out=taken)
                np.multiply(taken, self.of_byte["signs"].take(own[some], axis=0), out=logits[some])
            out.append((logits, parts, row))
        return out

    def inputs(self, grams: np.ndarray, found: list[tuple], some: slice):
        """(logits, gates, nodes, bits) of all bits of `some` units, from their predictions()."""
        byte = (grams[some] & np.uint64(255)).astype(np.int64)
        x, longest = np.empty((_ORDERS, len(byte), 8), np.float32), np.zeros((len(byte), 8), np.uint8)
        for order, (logits, parts, row) in enumerate(found):
            at = row[some]
            logits.take(at, axis=0, out=x[order], mode="clip")
            if order < _BYTES:
                # Parts of a longer context are larger.
                np.maximum(longest, parts.take(at, axis=0), out=longest)
            else:
                word = parts.take(at, axis=0)
        gates = longest.astype(np.int64)
        gates *= 5
        gates += word
        gates *= 8
        gates = gates.ravel()
        gates += np.tile(np.arange(8), len(byte))
        return x.reshape(_ORDERS, -1), gates, self.of_byte["nodes"].take(byte, axis=0).ravel(), self.of_byte["ones"].take(byte, axis=0).ravel()

    def mixed(self, x: np.ndarray, gates: np.ndarray) -> np.ndarray:
        weights = np.ascontiguousarray(self.weights.T)
        total = weights[_ORDERS].take(gates)
        for k in range(_ORDERS):
            term = weights[k].take(gates)
            term *= x[k]
            total += term
        return np.clip(total, -20, 20, out=total)

    @staticmethod
    def places(logits: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lower of the two map cells around a logit, and the share of the upper one."""
        at = (np.clip(logits, -_REACH, _REACH) + _REACH) * np.float32((_STEPS - 1) / (2 * _REACH))
        low = np.minimum(np.floor(at), np.float32(_STEPS - 2))
        return nodes * _STEPS + low.astype(np.int64), at - low

    def costs(self, grams: np.ndarray, prefixes: np.ndarray, block: int = 1 << 12) -> np.ndarray:
        """-log10 of the probability of each unit's byte after the bytes before it."""
        out = np.empty(len(grams))
        for begin in range(0, len(grams), CHUNK):
            unit, costs = grams[begin:begin + CHUNK], out[begin:begin + CHUNK]
            found = self.predictions(unit, prefixes[begin:begin + CHUNK])
            for first in range(0, len(unit), block):
                some = slice(first, first + block)
                x, gates, nodes, ones = self.inputs(unit, found, some)
                logits = self.mixed(x, gates)
                p = 1 / (1 + np.exp(-logits))
                if self.refined is not None:
                    cell, share = self.places(logits, nodes)
                    p = (p + self.refined.take(cell) * (1 - share) + self.refined.take(cell + 1) * share) / 2
                p = np.clip(np.where(ones == 1, p, 1 - p), 1e-9, 1)
                # Eight such factors are far from the least number.
                costs[some] = -np.log10(p.reshape(-1, 8).prod(axis=1, dtype=np.float64))
        return out


class Known:
    """Costs of units, kept from slice to slice: each has one place, by its key, and the last to come has it.

    A place holds 32 further bits of the key and the cost, so that one fetch tells both.
    """

    def __init__(self, mixer: Mixer):
        self.mixer, self.shift = mixer, np.uint64(64 - (REMEMBERED - 1).bit_length())
        self.held = np.zeros(REMEMBERED, np.uint64)

    @staticmethod
    def named(keys: np.ndarray) -> np.ndarray:
        return (keys << np.uint64(24) | _NAMED) & ~_COST

    def costs(self, grams: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
        keys, out, new = unit_keys(grams, prefixes), np.empty(len(grams), np.float32), []
        for begin in range(0, len(keys), NEAR):
            some = keys[begin:begin + NEAR]
            held = self.held.take((some >> self.shift).astype(np.int64))
            out[begin:begin + NEAR] = held.astype(np.uint32).view(np.float32)
            held ^= self.named(some)
            new.append(np.flatnonzero(held > _COST) + begin)
        new = np.concatenate(new)
        order, starts = runs(keys[new])
        first, times = new[order[starts]], np.diff(np.append(starts, len(new)))
        found = self.mixer.costs(grams[first], prefixes[first]).astype(np.float32)
        out[new[order]] = np.repeat(found, times)
        first = keys[first]
        self.held[(first >> self.shift).astype(np.int64)] = self.named(first) | found.view(np.uint32)
        return out


class Online:
    """Descent over units in steps; each unit weighs as often as it occurs."""

    def __init__(self, step: int = 4096, rate: float = 0.2):
        self.mixer, self.step, self.rate = Mixer([np.zeros(2 << bits, np.uint32) for bits in TABLE_BITS]), step, rate
        self.squares, self.mass = np.full(self.mixer.weights.shape, 1e-2), np.zeros(_GATES)
        self.cells, self.seen, self.forget = np.zeros((256 * _STEPS, 2)), 0.0, 1e4

    def learn(self, grams: np.ndarray, prefixes: np.ndarray, n: np.ndarray) -> None:
        """Count the units' bits, then predict each as if one occurrence had not been seen, and learn from it."""
        self.learn_keys(unit_keys(grams, prefixes), grams, n, np.arange(len(n)))

    def learn_keys(self, keys: np.ndarray, grams: np.ndarray, n: np.ndarray, order: np.ndarray) -> None:
        """The same for units in `order` by their unit_keys(), from which the words so far come back."""
        for first in range(0, len(order), CHUNK):
            some = order[first:first + CHUNK]
            unit = grams[some]
            self._learn(unit, n[some], keys[some] ^ mix(unit))

    def _learn(self, grams: np.ndarray, n: np.ndarray, prefixes: np.ndarray) -> None:
        mixer = self.mixer
        found, often = mixer.predictions(grams, prefixes, n), np.repeat(n.astype(np.float32), 8)
        for first in range(0, len(grams), self.step):
            x, gates, nodes, ones = mixer.inputs(grams, found, slice(first, first + self.step))
            weight = often[8 * first:8 * (first + self.step)]
            logits = mixer.mixed(x, gates)
            error = (ones - 1 / (1 + np.exp(-logits))) * weight
            here = np.bincount(gates, weight, _GATES)
            slopes = [np.bincount(gates, error * x[k], _GATES) for k in range(_ORDERS)] + [np.bincount(gates, error, _GATES)]
            slopes = np.stack(slopes, axis=1) / np.maximum(here, 1)[:, None]
            self.squares += slopes ** 2
            mixer.weights += (self.rate * slopes / np.sqrt(self.squares)).astype(np.float32)
            self.mass += here
            cell, share = mixer.places(logits, nodes)
            cell += cell
            cell += ones.astype(np.int64)
            upper = weight * share
            for beyond, part in ((0, weight - upper), (2, upper)):
                both = np.bincount(cell + beyond, part, 2 * len(self.cells)).reshape(-1, 2)
                self.cells[:, 0] += both[:, 1]
                self.cells[:, 1] += both.sum(axis=1)
            self.seen += weight.sum(dtype=np.float64)
            if self.seen > self.forget:
                # What early weights mapped counts less and less.
                self.forget, self.cells = self.forget * 2, self.cells * 0.25

    def learned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at, value, mass): weights times mass, then the map's sums; both add up over tasks."""
        values = np.concatenate([(self.mixer.weights * self.mass[:, None]).ravel(), self.cells[:, 0]])
        masses = np.concatenate([np.repeat(self.mass, _ORDERS + 1), self.cells[:, 1]])
        some = np.flatnonzero(masses > 0)
        return some, values[some], masses[some]


def _averaged(rows) -> tuple[np.ndarray, np.ndarray]:
    """Weights and map of all tasks, each by the mass it was learned from."""
    size = _GATES * (_ORDERS + 1)
    weights = Mixer([]).weights.ravel().astype(np.float64)
    logits = np.linspace(-_REACH, _REACH, _STEPS)
    refined = np.tile(1 / (1 + np.exp(-logits)), 256)
    for at, value, mass in rows:
        if at < size:
            weights[at] = value / mass
        else:
            cell = at - size
            refined[cell] = (value + 20 * refined[cell]) / (mass + 20)
    return weights.reshape(_GATES, _ORDERS + 1).astype(np.float32), refined


def looked_up(names: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per key whether it is among the sorted names, and its value or 0. Each distinct key is sought once, in order."""
    hit, value = np.zeros(len(keys), bool), np.zeros(len(keys))
    if len(names) and len(keys):
        order, starts = runs(keys)
        found, times = keys[order[starts]], np.diff(np.append(starts, len(keys)))
        at = np.minimum(np.searchsorted(names, found), len(names) - 1)
        met = names[at] == found
        hit[order], value[order] = np.repeat(met, times), np.repeat(np.where(met, values[at], 0), times)
    return hit, value


def _score(tables, rest):
    """(id, held, text) -> sums per row, and the words that the broadcast counts don't hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, refined, names, counts = rest.value
        mixer, gains = Mixer(roomy(tables.value), weights, refined), np.log10(counts + 1.0)
        known, powers = Known(mixer), Powers()
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(2), SLICE):
                stream, bounds, hashes, word_bounds = byte_stream(data, offsets)
                # A row has one byte at least, its end.
                total = np.add.reduceat(known.costs(*byte_units(stream, bounds, powers)), bounds[:-1], dtype=np.float64)
                rows = np.repeat(np.arange(j - i), np.diff(word_bounds))
                hit, gain = looked_up(names, gains, hashes)
                rare = np.concatenate(([0], np.cumsum(~hit)))[word_bounds]
                other = hashes[~hit]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(word_bounds) + 1),
                    pa.array(np.bincount(rows[hit], minlength=j - i)), pa.array(np.bincount(rows, gain, j - i).astype(np.float64)), pa.array(-total, pa.float64()),
                    pa.array(np.diff(bounds)), list_array([other[a:b] for a, b in zip(rare[:-1], rare[1:])])],
                    ["id", "held", "tokens", "known", "gain", "score", "bytes", "rare"])

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per row.

    The model learns from texts that are not `held_out` (default: from all). Tokens are the
    lower-cased words between ASCII white space, then one end. score is the model's log10
    probability of the words and the end, bits_per_byte the same by the bytes it reads.
    base_score is that of a unigram model with one added to each count.

    Null and empty texts are the end alone. A row whose `held_out` is null (a null id) is held
    out. Repeated rows and ties score alike. Texts are whole whatever their length; a task works on
    slices of them, or on one longer text. Without learning texts each bit has probability 1/2 and
    base_score is 0. Other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm-scoring")
    held = F.coalesce(held_out, F.lit(True)) if held_out is not None else F.lit(False)
    source = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text).alias("text"))
    learned = source.filter("NOT held").select("text").mapInArrow(_tidy(_learn), _LEARNED)
    learned = scratch.table(learned, "learned")
    of = lambda kind: learned.filter(F.col("kind") == kind)
    filled = of(_PART).select(F.col("at").alias("order"), "part", "counts").repartition("order", "part").sortWithinPartitions(
        "order", "part").mapInArrow(_tidy(_add_up), "order int, part int, counts binary")
    # Fixed size: a row for each part of the tables.
    rows = filled.toArrow()
    tables = load_tables(zip(*[rows.column(c).to_pylist() for c in ("order", "part", "counts")]))
    del rows
    tables = spark.sparkContext.broadcast([Packed(t.tobytes()) for t in tables])
    sums = of(_WEIGHT).groupBy("at").agg(F.sum("value"), F.sum("mass"))
    weights, refined = _averaged(sorted(map(tuple, sums.collect())))

    texts = of(_TEXT).agg(F.sum("n")).first()[0] or 0
    vocabulary = scratch.table(of(_WORD).groupBy("key").agg(F.sum("n").alias("n")), "words")
    scratch.drop("learned")
    level = F.floor(F.log2("n") * 8).cast("int")
    steps = {r["level"]: r["k"] for r in vocabulary.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()}  # at most 512
    least, room = max(steps, default=0) + 1, FREQUENT_WORDS
    for step in sorted(steps, reverse=True):
        room -= steps[step]
        if room < 0:
            break
        least = step
    frequent = vocabulary.filter(level >= least).select("key", "n").toArrow()
    names, n = frequent.column("key").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    order = np.argsort(names)
    rest = spark.sparkContext.broadcast((weights, refined, names[order], n[order]))
    tokens, distinct = vocabulary.agg(F.sum("n"), F.count(F.lit(1))).first()
    train_tokens, distinct = texts + (tokens or 0), distinct + (1 if texts else 0)

    kind = source.schema["id"].dataType.simpleString()
    scored = scratch.table(source.mapInArrow(
        _tidy(_score(tables, rest)), f"id {kind}, held boolean, tokens long, known long, gain double, score double, bytes long, rare array<long>"), "scored")
    scored = scored.withColumn("row", F.monotonically_increasing_id())
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("m"))
    others = vocabulary.filter(level < least).select("key", "n")
    met = rare.join(others, "key").groupBy("row").agg(F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("extra"))
    base = F.col("gain") + F.coalesce("extra", F.lit(0.0)) + F.log10(F.lit(texts + 1.0)) - F.col("tokens") * F.log10(F.lit(train_tokens + distinct + 1.0))
    return scored.drop("rare").join(met, "row", "left").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(1 if texts else 0)).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.col("bytes")).alias("bits_per_byte"))
