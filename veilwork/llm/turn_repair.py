"""Repair of conversations by cheapest edits, the ASCII-least audit of them chosen by prefix doubling.

A conversation's rows are kept, reroled, deleted or inserted to so that its role initials become
`(s?(ua)+)?`. What may follow depends only on the last initial kept (none, s, u or a), so the
costs of a row are a 4 x 4 matrix in the min-plus sense, and the costs from every place to the
end are suffix products, taken by doubling over all rows of a batch at once.

An arc is optimal if its cost leads exactly from the cost before it to the one behind it. Nodes
(place, state) are ranked by the least audits of 1, 2, 4, ... letters that optimal arcs spell
from them: the rank for 2n letters is the order of (rank for n, rank for n of the node n letters
on). Of a node's arcs the one with the least letter and the least ranked node behind it is taken;
doubled pointers over these give every node of the least path.

Rows are sorted by range, so a conversation of any size is cut into chunks over many tasks. Only
conversations that are cut pass through two scans over one small row per chunk: the matrices from
the back give each chunk the costs behind it, the states it leaves from the front its first state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch
from .kernel import text_bytes

#: Distinct rows of a conversation in a chunk, at most.
CHUNK = 2048
#: Distinct rows worked on at once.
SLICE = 1 << 16
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LETTERS = b"DIKR"  # in order, so that the least letter is the first
INITIALS = "sua"
NONE, S, U, A = range(4)
#: The state after keeping an initial (s, u, a, other), -1 if it may not follow.
KEPT = np.array([[S, U, -1, -1], [-1, U, -1, -1], [-1, -1, A, -1], [-1, U, -1, -1]])
#: The state after a row that was inserted or reroled.
ADDED = np.array([U, U, A, U])
FAR = 1 << 40
#: Costs of inserting from state to state, and from each state to the end.
CLOSURE = np.array([[0, FAR, 3, 6], [FAR, 0, 3, 6], [FAR, FAR, 0, 3], [FAR, FAR, 3, 0]], np.int64)
END = np.array([0, 6, 3, 0], np.int64)
#: Pairs of adjacent initials that are legal as they stand: su, ua, au.
LEGAL = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]], bool)
#: Bits of a row's kind above its initial.
IS_TRUNCATED, IS_FREE, IS_BLANK = 4, 8, 16


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): rows damaged by crc32(`conv:turn`) % 20, nulls read as one space.

    0 drops the row (copies 0), 1 empties its text, 2 removes its `[.!?]`, 3 repeats it (copies 2),
    4 sets role user.
    """
    def given(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat_ws(":", given(conv), given(turn))) % 20
    marked = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), given(role).alias("role"), given(text).alias("text"), code.alias("code"))
    return marked.select(
        "conv", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus products of matrices, or of matrices and columns."""
    out = a[:, :, :1] + b[:, :1]
    for k in range(1, 4):
        np.minimum(out, a[:, :, k:k + 1] + b[:, k:k + 1], out=out)
    return out


class Units:
    """What is decided of the rows of several chunks: each free row, then its forced deletions."""

    def __init__(self, kind: np.ndarray, forced: np.ndarray, bounds: np.ndarray):
        free = (kind & IS_FREE) > 0
        sizes = free.astype(np.int64) + (forced > 0)
        self.row = np.repeat(np.arange(len(kind)), sizes)
        first = np.concatenate(([True], self.row[1:] != self.row[:-1])) if len(self.row) else np.zeros(0, bool)
        self.free = first & free[self.row]
        self.times = np.where(self.free, 1, forced[self.row])
        self.initial = np.where(self.free, kind[self.row] & 3, 3)
        self.bad = np.where(self.free & ((kind[self.row] & IS_TRUNCATED) > 0), TRUNCATED, 0)
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))[bounds]
        self.chunk = np.repeat(np.arange(len(bounds) - 1), np.diff(self.bounds))

    def steps(self) -> np.ndarray:
        """Min-plus matrix of each unit, insertions before it included."""
        n, states = len(self.row), np.arange(4)
        cost = np.full((n, 4, 4), FAR, np.int64)
        cost[:, states, states] = (DELETE * self.times)[:, None]
        free = np.flatnonzero(self.free)
        for q in range(4):
            at = free, q, ADDED[q]
            cost[at] = np.minimum(cost[at], REROLE + self.bad[free])
            to = KEPT[q][self.initial[free]]
            keep = free[to >= 0]
            at = keep, q, to[to >= 0]
            cost[at] = np.minimum(cost[at], KEEP + self.bad[keep])
        return _times(np.broadcast_to(CLOSURE, (n, 4, 4)), cost)

    def suffixes(self) -> np.ndarray:
        """Products of the matrices from each unit to its chunk's end, by doubling."""
        total, end, reach = self.steps(), self.bounds[1:][self.chunk], 1
        longest = int(np.diff(self.bounds).max(initial=0))
        while reach < longest:
            at = np.flatnonzero(np.arange(len(end)) + reach < end)
            total[at] = _times(total[at], total[at + reach])
            reach *= 2
        return np.minimum(total, FAR)

    def products(self) -> np.ndarray:
        """One matrix per chunk; without units, the one that changes nothing."""
        out = np.full((len(self.bounds) - 1, 4, 4), FAR, np.int64)
        out[:, np.arange(4), np.arange(4)] = 0
        some = np.flatnonzero(np.diff(self.bounds))
        out[some] = self.suffixes()[self.bounds[some]]
        return out


class Paths:
    """Least optimal paths through chunks, given the costs behind each and whether it is a conversation's last."""

    def __init__(self, units: Units, behind: np.ndarray, closes: np.ndarray):
        self.units = units
        n, chunks = len(units.row), len(closes)
        # Places: one before each unit, one behind each chunk's last.
        self.first = units.bounds[:-1] + np.arange(chunks)
        last = units.bounds[1:] + np.arange(chunks)
        place = np.arange(n) + units.chunk
        cost = np.zeros((n + chunks, 4), np.int64)
        cost[last] = behind
        cost[place] = _times(units.suffixes(), behind[units.chunk][:, :, None])[:, :, 0]
        self.cost = cost
        self.unit = np.full(n + chunks, -1)
        self.unit[place] = np.arange(n)
        # Arcs by letter: the node each leads to, -1 where it is not optimal.
        arcs = np.full((4, n + chunks, 4), -1, np.int64)
        ending = last[closes]
        for q in range(4):
            def arc(letter: int, at: np.ndarray, step: int, to, price) -> None:
                to = np.broadcast_to(to, at.shape)
                fits = to >= 0
                fits[fits] = cost[at[fits], q] == np.broadcast_to(price, at.shape)[fits] + cost[at[fits] + step, to[fits]]
                arcs[letter, at[fits], q] = 4 * (at[fits] + step) + to[fits]

            arc(0, place, 1, q, DELETE * units.times)
            arc(1, np.concatenate((place, ending)), 0, ADDED[q], INSERT)
            free = np.flatnonzero(units.free)
            arc(2, place[free], 1, KEPT[q][units.initial[free]], KEEP + units.bad[free])
            arc(3, place[free], 1, ADDED[q], REROLE + units.bad[free])
        self._rank(arcs.reshape(4, -1))

    def _rank(self, arcs: np.ndarray) -> None:
        """Ranks by audits of doubled lengths, then the arc, the pointers and the path length of each node."""
        nodes = np.arange(arcs.shape[1])
        stops = (arcs < 0).all(axis=0)

        def chosen(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys = np.where(arcs < 0, np.iinfo(np.int64).max, np.arange(1, 5)[:, None] * (len(nodes) + 1) + rank[arcs])
            letter = keys.argmin(axis=0)
            return np.where(stops, 0, letter + 1), np.where(stops, nodes, arcs[letter, nodes])

        rank, jump = chosen(np.zeros(len(nodes), np.int64))
        while not stops[jump].all():
            rank = np.unique(rank * (len(nodes) + 5) + rank[jump], return_inverse=True)[1]
            jump = jump[jump]
        # Every whole audit is ranked: what lies behind an arc is compared to its end.
        self.letter, to = chosen(rank)
        self.jumps, length = [to], (~stops).astype(np.int64)
        while not stops[self.jumps[-1]].all():
            length = length + length[self.jumps[-1]]
            self.jumps.append(self.jumps[-1][self.jumps[-1]])
        self.length = length

    def walk(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes of the paths from `starts` end to end, their bounds, the nodes where they stop)."""
        sizes = self.length[starts]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        step = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
        nodes, ends = np.repeat(starts, sizes), starts
        for k, jump in enumerate(self.jumps):
            on = (step >> k & 1) > 0
            nodes[on] = jump[nodes[on]]
            ends = np.where(sizes >> k & 1, jump[ends], ends)
        return nodes, bounds, ends


def _lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _same(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct rows -> one row per chunk: part, seq, conv, cut, and lists of its rows' columns.

    `cut` is said of every chunk whose conversation may go on in another one.
    """
    seq, before, batch = 0, None, None

    def emit(batch: pa.RecordBatch, before, after) -> Iterator[pa.RecordBatch]:
        nonlocal seq
        conv, ends = batch.column("conv"), np.zeros(0, np.int64)
        ends = pc.run_end_encode(conv).run_ends.to_numpy().astype(np.int64)
        begins = np.concatenate(([0], ends[:-1]))
        pieces = -(-(ends - begins) // CHUNK)
        starts = np.repeat(begins, pieces) + CHUNK * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        bounds = np.concatenate((starts, [len(batch)]))
        cut = np.repeat(pieces > 1, pieces)
        # Unknown at the ends of a partition, else whether the neighbouring batch goes on.
        first, last = before is None or _same(before, conv[0]), after is None or _same(after, conv[-1])
        cut[0] |= first
        cut[-1] |= last
        offsets = bounds
        yield pa.RecordBatch.from_pydict({
            "part": batch.column("part").take(pa.array(starts)), "seq": pa.array(seq + np.arange(len(starts))), "conv": conv.take(pa.array(starts)),
            "cut": pa.array(cut), **{c: _lists(batch.column(c), offsets) for c in ("kind", "forced", "turn", "role", "digest")}})
        seq += len(starts)

    for following in batches:
        if not len(following):
            continue
        if batch is not None:
            yield from emit(batch, before, following.column("conv")[0])
            before = batch.column("conv")[-1]
        batch = following
    if batch is not None:
        yield from emit(batch, before, None)


def _pieces(batch: pa.RecordBatch):
    """(first chunk, end chunk, kind, forced, row bounds) for slices of a batch of chunks."""
    kinds, forced = batch.column("kind"), batch.column("forced")
    offsets = np.concatenate(([0], np.cumsum(kinds.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    kinds, forced = (x.flatten().to_numpy(zero_copy_only=False) for x in (kinds, forced))
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield i, j, kinds[offsets[i]:offsets[j]].astype(np.int64), forced[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def _border(kind: np.ndarray, forced: np.ndarray, bounds: np.ndarray, turn: np.ndarray, known: np.ndarray) -> dict[str, pa.Array]:
    """Counts of each chunk, with its first and last initial and turn."""
    chunks = len(bounds) - 1
    chunk = np.repeat(np.arange(chunks), np.diff(bounds))
    free, blank, initial = (kind & IS_FREE) > 0, (kind & IS_BLANK) > 0, kind & 3
    copies = forced + free

    def per(values: np.ndarray) -> np.ndarray:
        return np.bincount(chunk, values, chunks).astype(np.int64)

    def edges(at: np.ndarray, values: np.ndarray) -> tuple[pa.Array, pa.Array]:
        first, last = np.full(chunks, -1), np.full(chunks, -1)
        last[chunk[at]] = at
        first[chunk[at[::-1]]] = at[::-1]
        return tuple(pa.array(values[np.maximum(x, 0)] if len(values) else np.zeros(chunks, np.int64), mask=x < 0) for x in (first, last))

    real = np.flatnonzero(copies > 0)
    a, b = real[:-1], real[1:]
    clash = (chunk[a] == chunk[b]) & ~LEGAL[initial[a], initial[b]]
    illegal = per(np.maximum(copies - 1, 0)) + np.bincount(chunk[a[clash]], minlength=chunks)
    timed = np.flatnonzero((copies > 0) & known)
    a, b = timed[:-1], timed[1:]
    new = np.concatenate((timed[:1], b[(chunk[a] != chunk[b]) | (turn[a] != turn[b])]))
    first_turn, last_turn = edges(timed, turn)
    first_initial, last_initial = edges(real, initial)
    return {"blank": pa.array(per(forced * blank)), "duplicate": pa.array(per(forced * ~blank)),
            "truncated": pa.array(per(free & ((kind & IS_TRUNCATED) > 0))), "illegal": pa.array(illegal),
            "turns": pa.array(np.bincount(chunk[new], minlength=chunks)), "first_turn": first_turn, "last_turn": last_turn,
            "first_initial": first_initial, "last_initial": last_initial}


BORDER = "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial long, last_initial long"


def _turns(batch: pa.RecordBatch, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    values = batch.column("turn").slice(i, j - i).flatten()
    return values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), values.is_valid().to_numpy(zero_copy_only=False)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut chunks -> conv, part, seq, their matrix, first and last initial and turn."""
    for batch in batches:
        for i, j, kind, forced, bounds in _pieces(batch):
            matrix = Units(kind, forced, bounds).products().reshape(-1)
            border = _border(kind, forced, bounds, *_turns(batch, i, j))
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c).slice(i, j - i) for c in ("conv", "part", "seq")}, "matrix": _lists(pa.array(matrix), 16 * np.arange(j - i + 1)),
                **{c: border[c] for c in ("first_turn", "last_turn", "first_initial", "last_initial")}})


def _backwards(table: pa.Table) -> pa.Table:
    """The chunks of one conversation: costs behind each, and what its border to the chunk before adds."""
    table = table.sort_by([("part", "ascending"), ("seq", "ascending")])
    matrices = np.stack(table["matrix"].to_pylist()).reshape(-1, 4, 4)
    behind = np.zeros((len(matrices), 4), np.int64)
    behind[-1] = END
    for k in range(len(matrices) - 1, 0, -1):
        behind[k - 1] = (matrices[k] + behind[k]).min(axis=1)
    again, clash, turn, initial = [], [], None, None
    for t0, t1, i0, i1 in zip(*(table[c].to_pylist() for c in ("first_turn", "last_turn", "first_initial", "last_initial"))):
        again.append(int(turn is not None and t0 == turn))
        clash.append(int(initial is not None and i0 is not None and not LEGAL[initial, i0]))
        turn, initial = (turn if t1 is None else t1), (initial if i1 is None else i1)
    n = len(matrices)
    return pa.table({"part": table["part"], "seq": table["seq"], "behind": _lists(pa.array(behind.reshape(-1)), 4 * np.arange(n + 1)),
                     "opens": pa.array(np.arange(n) == 0), "closes": pa.array(np.arange(n) == n - 1), "again": pa.array(again, pa.int64()),
                     "clash": pa.array(clash, pa.int64())})


def _kept(paths: Paths, nodes: np.ndarray) -> np.ndarray:
    """Whether a path's node leads to a row that stays: all letters but D."""
    return paths.letter[nodes] > 1


def _behind(batch: pa.RecordBatch, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """(costs behind, whether it closes its conversation) of chunks; whole conversations have no own figures."""
    closes = batch.column("closes").slice(i, j - i).fill_null(True).to_numpy(zero_copy_only=False)
    lists = batch.column("behind").slice(i, j - i)
    out = np.broadcast_to(END, (j - i, 4)).copy()
    out[lists.is_valid().to_numpy(zero_copy_only=False)] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
    return out, closes


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut chunks -> conv, part, seq and, per first state, the state behind and the number of rows that stay."""
    for batch in batches:
        for i, j, kind, forced, bounds in _pieces(batch):
            paths = Paths(Units(kind, forced, bounds), *_behind(batch, i, j))
            nodes, limits, ends = paths.walk((4 * paths.first[:, None] + np.arange(4)).reshape(-1))
            stay = np.concatenate(([0], np.cumsum(_kept(paths, nodes))))
            by = 4 * np.arange(j - i + 1)
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c).slice(i, j - i) for c in ("conv", "part", "seq")}, "to": _lists(pa.array(ends % 4), by),
                "stay": _lists(pa.array(stay[limits[1:]] - stay[limits[:-1]]), by)})


def _forwards(table: pa.Table) -> pa.Table:
    """The chunks of one conversation: the state each starts in and the rows that stay before it."""
    table = table.sort_by([("part", "ascending"), ("seq", "ascending")])
    state, offset, states, offsets = NONE, 0, [], []
    for to, stay in zip(table["to"].to_pylist(), table["stay"].to_pylist()):
        states.append(state)
        offsets.append(offset)
        state, offset = to[state], offset + stay[state]
    return pa.table({"part": table["part"], "seq": table["seq"], "state": pa.array(states, pa.int64()), "offset": pa.array(offsets, pa.int64())})


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with all that is known of them -> their counts, cost, part of the audit and rows that stay."""
    for batch in batches:
        for i, j, kind, forced, bounds in _pieces(batch):
            units = Units(kind, forced, bounds)
            paths = Paths(units, *_behind(batch, i, j))
            state = batch.column("state").slice(i, j - i).fill_null(NONE).to_numpy(zero_copy_only=False)
            offset = batch.column("offset").slice(i, j - i).fill_null(0).to_numpy(zero_copy_only=False)
            opens = batch.column("opens").slice(i, j - i).fill_null(True).to_numpy(zero_copy_only=False)
            nodes, limits, _ = paths.walk(4 * paths.first + state)
            letter, unit = paths.letter[nodes], paths.unit[nodes // 4]
            times = np.where(letter == 1, units.times[np.maximum(unit, 0)] if len(units.times) else 1, 1)
            audit = np.repeat(np.frombuffer(LETTERS, np.uint8)[letter - 1], times)
            cuts = np.concatenate(([0], np.cumsum(times)))[limits].astype(np.int32)
            stay = letter > 1
            kept = nodes[stay]
            totals = np.concatenate(([0], np.cumsum(stay)))[limits]
            own = letter[stay] > 2  # K and R have a row, I has none
            row = np.where(own, units.row[unit[stay]] if len(units.row) else 0, 0)
            place = np.arange(len(kept)) - np.repeat(totals[:-1], np.diff(totals)) + np.repeat(offset, np.diff(totals))
            added = np.where(paths.jumps[0][kept] % 4 == U, "user", "assistant")
            columns = {c: batch.column(c).slice(i, j - i).flatten() for c in ("turn", "role", "digest")}
            mine = {c: v.take(pa.array(row, mask=~own)) for c, v in columns.items()}
            fields = [pa.array(place), pa.array(np.array(list("DIKR"))[letter[stay] - 1]), pa.array(added), mine["turn"], mine["role"], mine["digest"]]
            rows = pa.StructArray.from_arrays(fields, ["position", "edit", "added", "turn", "role", "digest"])
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c).slice(i, j - i) for c in ("conv", "part", "seq", "again", "clash")},
                **_border(kind, forced, bounds, *_turns(batch, i, j)),
                "cost": pa.array(np.where(opens, paths.cost[paths.first, NONE], 0)),
                "audit": pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(cuts), pa.py_buffer(audit)]),
                "rows": _lists(rows, totals)})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, line) sorted by conversation and position -> conv and the SHA-256 of its lines, joined by newlines.

    A line ends in a newline; the last one of a conversation is held back. Only the running digest is kept.
    """
    running, held, conv = hashlib.sha256(), None, None

    def done(conv):
        return pa.RecordBatch.from_arrays([conv, pa.array([running.hexdigest()])], ["conv", "repaired_sha256"])

    for batch in batches:
        if not len(batch):
            continue
        data, offsets = text_bytes(batch.column("line"))
        begin = 0
        for end in pc.run_end_encode(batch.column("conv")).run_ends.to_pylist():
            mine = batch.column("conv").slice(begin, 1)
            if held is not None and not _same(mine[0], conv[0]):
                yield done(conv)
                running, held = hashlib.sha256(), None
            if held is not None:
                running.update(held)
            running.update(data[offsets[begin]:offsets[end] - 1].data)
            held, conv, begin = b"\n", mine, end
    if held is not None:
        yield done(conv)


class Repaired:
    """What came of a repair: `audits`, a row per conversation, and `turns`, the rows that stay."""

    def __init__(self, audits: DataFrame, turns: DataFrame):
        self.audits, self.turns = audits, turns

    def digests(self) -> DataFrame:
        """(conv, repaired_sha256) of each conversation with rows: SHA-256 of its `role:text` lines, joined by newlines.

        A digest is a chain, so one task streams the rows of a conversation, whatever their number.
        """
        kind = self.turns.schema["conv"].dataType.simpleString()
        lines = self.turns.select("conv", "position", F.concat("role", F.lit(":"), "text", F.lit("\n")).alias("line"))
        return lines.repartition("conv").sortWithinPartitions("conv", "position").select("conv", "line").mapInArrow(
            _digests, f"conv {kind}, repaired_sha256 string")


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         copies: str | None = None) -> Repaired:
    """Cheapest edits that give each conversation role initials `(s?(ua)+)?`.

    Rows are taken by turn (nulls first), those of one turn by role, then by the SHA-256 of their
    text; `copies` names a column that says how often a row stands there (0: only its conversation
    counts). A row's first fault counts: blank (no character but white space), duplicate (role and
    text seen earlier), truncated (the last other character is none of .!?). Keeping costs 0,
    reroling to user or assistant 3, deleting 4 (forced for blank and duplicate rows), inserting an
    empty user or assistant row 3; a truncated row that is not deleted costs 3 more. Of the
    cheapest edits those whose initials K, R, D, I read ASCII-least are taken. A role's initial is
    its first character; an empty role, like any but s, u and a, can't be kept.

    `audits`: conv, gaps (last turn - first turn + 1 - distinct turns, nulls aside; 0 if all are
    null), blank, duplicate, truncated, illegal (adjacent initials other than su, ua, au, before
    the repair), cost, audit. Conversations whose rows are all gone have zeros and an empty audit.
    `turns`: conv, position (gapless from 0), edit (K, R or I), role, text.

    Null ids are a conversation of their own; null roles and texts count as one space; texts are
    whole whatever their length, and of them only a digest and two flags take part in the search.
    Repeated rows are one row with a count, so neither a conversation nor a row that holds most of
    the table is read by one task; an audit is one string, as long as its conversation has rows.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    scratch = Scratch(rows.sparkSession, "turn-repair")
    shown = F.coalesce(F.col(text), F.lit(" "))
    source = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                         shown.alias("text"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"))
    kind = source.schema["conv"].dataType.simpleString()
    gone = F.col("copies") <= 0
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    # A row that is gone leaves its conversation alone.
    key = F.struct("conv", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").otherwise(F.col("role")).alias("role"),
                   F.when(~gone, F.unhex(F.sha2("text", 256))).alias("digest")).alias("key")
    marked = source.select(key, F.greatest("copies", F.lit(0)).alias("copies"), (bare == "").alias("blank"),
                           (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    distinct = marked.groupBy("key").agg(F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))
    distinct = scratch.table(distinct, "distinct")
    seen = F.struct("key.conv", "key.role", "key.digest")
    # False sorts before true, so a null turn comes first.
    order = F.struct(F.col("key.turn").isNotNull().alias("a"), F.col("key.turn").alias("b"))
    firsts = distinct.filter("copies > 0").groupBy(seen.alias("seen")).agg(F.min(order).alias("order"))
    firsts = firsts.select(F.struct("seen.conv", F.col("order.b").alias("turn"), "seen.role", "seen.digest").alias("key"), F.lit(True).alias("first"))
    faults = distinct.join(firsts, "key", "left")
    free = ((F.col("copies") > 0) & F.col("first").isNotNull() & ~F.col("blank")).cast("int")
    initial = F.lit(len(INITIALS))
    for number, letter in enumerate(INITIALS):
        initial = F.when(F.substring("key.role", 1, 1) == letter, number).otherwise(initial)
    state = initial + F.col("truncated").cast("int") * IS_TRUNCATED + free * IS_FREE + F.col("blank").cast("int") * IS_BLANK
    faults = faults.select("key.*", state.cast("tinyint").alias("kind"), (F.col("copies") - free).alias("forced"))
    by = ["conv", "turn", "role", "digest"]
    placed = faults.repartitionByRange(*by).sortWithinPartitions(*by)
    chunks = scratch.table(placed.select(F.spark_partition_id().alias("part"), *by, "kind", "forced").mapInArrow(
        _chunks, f"part int, seq long, conv {kind}, cut boolean, kind array<tinyint>, forced array<long>, turn array<long>, "
                 "role array<string>, digest array<binary>"), "chunks")

    cut = chunks.filter("cut").select("conv", "part", "seq", "kind", "forced", "turn")
    place = "part int, seq long"
    matrices = cut.mapInArrow(_matrices, f"conv {kind}, {place}, matrix array<long>, first_turn long, last_turn long, first_initial long, last_initial long")
    behind = scratch.table(matrices.groupBy("conv").applyInArrow(
        _backwards, f"{place}, behind array<long>, opens boolean, closes boolean, again long, clash long"), "behind")
    passages = cut.join(behind, ["part", "seq"]).mapInArrow(_passages, f"conv {kind}, {place}, to array<long>, stay array<long>")
    ahead = passages.groupBy("conv").applyInArrow(_forwards, f"{place}, state long, offset long")
    known = chunks.join(behind, ["part", "seq"], "left").join(ahead, ["part", "seq"], "left")
    edits = scratch.table(known.mapInArrow(
        _edits, f"conv {kind}, {place}, again long, clash long, {BORDER}, cost long, audit string, "
                "rows array<struct<position:long,edit:string,added:string,turn:long,role:string,digest:binary>>"), "edits")
    scratch.drop("distinct", "chunks", "behind")

    def total(name: str, *more: str) -> Column:
        return sum((F.sum(F.coalesce(m, F.lit(0))) for m in more), F.sum(name))

    span = F.max("last_turn") - F.min("first_turn") + 1 - (F.sum("turns") - F.sum(F.coalesce("again", F.lit(0))))
    pieces = F.array_sort(F.collect_list(F.struct("part", "seq", "audit")))
    audits = edits.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        total("illegal", "clash").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"))

    stay = edits.select("conv", F.explode("rows").alias("r")).select("conv", "r.*")
    key = F.struct("conv", "turn", "role", "digest")
    # Grouped and joined by one key, so texts move once.
    texts = source.filter("copies > 0").select(F.struct("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest")).alias("key"), "text")
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    own = stay.filter("edit <> 'I'").select(key.alias("key"), "position", "edit", "added").join(texts, "key")
    new_role = F.when(F.col("edit") == "R", F.col("added")).otherwise(F.col("key.role"))
    turns = own.select("key.conv", "position", "edit", new_role.alias("role"), "text").unionByName(
        stay.filter("edit = 'I'").select("conv", "position", "edit", F.col("added").alias("role"), F.lit("").alias("text")))
    return Repaired(audits, turns)
