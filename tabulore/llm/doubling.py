"""Distributed prefix doubling over chosen positions: which windows of LENGTH bytes start earlier too.

The rank of a position at length n names the class of positions whose next n bytes are equal. A first rank is the XXH64
of the next START bytes. In each round Spark sorts pairs (rank of a position, rank one offset further on), gives equal
pairs one new rank, and drops the positions whose pair is unique; offsets grow (STEPS) until a rank is past the
threshold, LENGTH. In the last round all but the first position of equal pairs are repeats.

Positions are kept in blocks of at most AT_ONCE windows, whose rows stand in the shared folder from round to round. A block
sends each pair once and hears of it once, so a pair that a third of all positions have is a row a block, and
no task holds more than a block. Windows with a dropped position leave the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tabulore.llm.common import written

LENGTH, START = 100, 32
#: Windows of a block; a block has less than 2 ** PLACE_BITS positions, and a task less than 2 ** BLOCK_BITS blocks.
AT_ONCE, PLACE_BITS, BLOCK_BITS = 1 << 18, 20, 18
#: The primes of XXH64.
_P1, _P2, _P3, _P4 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579))


def steps(start: int = START, length: int = LENGTH) -> list[int]:
    """The offsets of the rounds."""
    out = []
    while start < length:
        out.append(min(start, length - start))
        start += out[-1]
    return out


STEPS = steps()


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the 32 bytes from each place. words: at every byte the 8 bytes from there, little-endian."""
    with np.errstate(over="ignore"):
        lanes = [_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1]
        lanes = [_turned(seed + words[at + 8 * i] * _P2, 31) * _P1 for i, seed in enumerate(lanes)]
        out = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
        for lane in lanes:
            out = (out ^ (_turned(lane * _P2, 31) * _P1)) * _P1 + _P4
        out += np.uint64(32)
        out = (out ^ (out >> np.uint64(33))) * _P2
        out = (out ^ (out >> np.uint64(29))) * _P3
        return out ^ (out >> np.uint64(32))


def offsets(level: int) -> list[int]:
    """Where a window needs ranks after `level` rounds, from its start."""
    found = {0}
    for step in reversed(STEPS[level:]):
        found |= {x + step for x in found}
    return sorted(found)


def needed(at: np.ndarray, level: int) -> np.ndarray:
    return np.unique(np.concatenate([at + x for x in offsets(level)]))


def classes(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each pair, numbered by first sight, and the place at which each class is first seen."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(order)]
    first = order[new]  # lexsort is stable
    by_sight = np.argsort(first)
    number = np.empty(len(first), dtype=np.int64)
    number[by_sight] = np.arange(len(first))
    of = np.empty(len(order), dtype=np.int64)
    of[order] = number[np.cumsum(new) - 1]
    return of, first[by_sight]


#: at: windows; of: the classes of the pairs at needed(at, level), both as differences; one, two: the pair of each class.
STATE = "block long, at binary, of binary, one binary, two binary"
STATE_ARROW = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("at", "of", "one", "two"))])


def state_row(block: int, at: np.ndarray, one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    """at: windows, ascending; one and two: the pairs at the positions that they need."""
    of, first = classes(one, two)
    held = [np.diff(at, prepend=0).astype("<i8"), np.diff(of, prepend=0).astype("<i4"), one[first].astype("<u8"), two[first].astype("<u8")]
    return pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([x.tobytes()], pa.binary()) for x in held)], schema=STATE_ARROW)


def array_of(value: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=kind)


def blocks(bits: int):
    """Rows (doc, text, runs of windows) to the state before the first round. bits: of a byte's place in a position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << BLOCK_BITS if TaskContext.get() else 0
        for batch in batches:
            for state in of_batch(batch):
                yield state_row(block, *state)
                block += 1

    def of_batch(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, text, lists = batch.column(0).to_numpy().astype(np.int64), batch.column(1), batch.column(2)
        begins = np.frombuffer(text.buffers()[1], dtype="<i8" if pa.types.is_large_string(text.type) else "<i4")[text.offset : text.offset + len(text)].astype(np.int64)
        data = text.buffers()[2]
        if not len(ids) or data is None or data.size < START:
            return
        words = np.ndarray(shape=(data.size - 7,), dtype="<u8", buffer=data, strides=(1,))
        ends = lists.offsets.to_numpy().astype(np.int64)
        runs = lists.values.slice(ends[0], ends[-1] - ends[0])
        doc = np.repeat(np.arange(len(ids)), np.diff(ends))
        first, n = begins[doc] + runs.field("at").to_numpy(), runs.field("n").to_numpy().astype(np.int64)
        order = np.argsort(first, kind="stable")
        first, stop = first[order], (first + n)[order]
        first = np.maximum(first, np.append(0, np.maximum.accumulate(stop)[:-1]))  # where runs overlap, windows count once
        n = np.maximum(stop - first, 0)
        upto = np.cumsum(n)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + AT_ONCE, side="right")))
            some = n[lo:hi]
            at = np.repeat(first[lo:hi] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))
            if len(at):
                every, pairs = needed(at, 0), needed(at, 1)
                hashed = xxh64(words, every)
                one, two = (hashed[np.searchsorted(every, x)] for x in (pairs, pairs + STEPS[0]))
                at, pairs = (place(x, begins, ids) for x in (at, pairs))
                by_place = np.argsort(pairs, kind="stable")
                yield np.sort(at), one[by_place], two[by_place]
            lo = hi

    def place(at: np.ndarray, begins: np.ndarray, ids: np.ndarray) -> np.ndarray:
        doc = np.searchsorted(begins, at, side="right") - 1
        return (ids[doc] << bits) + at - begins[doc]

    return run


def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every block each class once: its pair and id, which holds the block, the class, and whether the block has it twice."""
    for batch in batches:
        for block, of, one, two in zip(*batch.columns):
            one, two = array_of(one, "<i8"), array_of(two, "<i8")
            twice = np.bincount(np.cumsum(array_of(of, "<i4"), dtype=np.int64), minlength=len(one)) > 1
            ids = (block.as_py() << PLACE_BITS + 1) + (np.arange(len(one)) << 1) + twice
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(ids)], names=["one", "two", "id"])


RANKED = pa.schema([("block", pa.int64()), ("which", pa.binary()), ("rank", pa.binary())])


def ranked(batches: Iterator[pa.RecordBatch], at_once: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pair and id to the new ranks of pairs that aren't unique: for each block, its classes and their ranks.

    A rank is the id of the first of its class. A pair that may be alone waits for the next batch."""
    pending: tuple[int, int, int] | None = None  # a pair's first row
    begun: tuple[int, int, int] | None = None  # a pair whose rank is out already
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two, ids = (c.to_numpy() for c in batch.columns)
        if pending is not None:
            one, two, ids = (np.append(np.int64(p), x) for p, x in zip(pending, (one, two, ids)))
        elif begun is not None:
            one, two, ids = (np.append(np.int64(p), x) for p, x in zip(begun, (one, two, ids)))
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        number = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(ids)))
        alive = (size[number] > 1) | (ids & 1 > 0)
        if begun is not None:
            alive[number == 0] = True
        rank = (ids[starts] >> 1)[number] + 1
        last = int(starts[-1])
        waits = size[-1] == 1 and not alive[last]
        out = alive.copy()
        if begun is not None:
            out[0] = False  # it was given before
        held.append((ids[out] >> 1, rank[out]))
        first = (one[last], two[last], ids[last])
        pending, begun = (first, None) if waits else (None, first)
        if sum(len(x) for x, _ in held) >= at_once:
            yield by_block(held)
            held = []
    if held:
        yield by_block(held)


def by_block(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ids, rank = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(ids >> PLACE_BITS, kind="stable")
    ids, rank = ids[order], rank[order]
    block = ids >> PLACE_BITS
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, dtype=np.int64)
    which = (ids & (1 << PLACE_BITS) - 1).astype("<i4")
    bounds = list(zip(starts.tolist(), [*starts[1:].tolist(), len(block)]))
    columns = [pa.array(block[starts])] + [pa.array([x[lo:hi].tobytes() for lo, hi in bounds], pa.binary()) for x in (which, rank.astype("<i8"))]
    return pa.RecordBatch.from_arrays(columns, schema=RANKED)


def paired(level: int):
    """A block's state and its new ranks, of `level` rounds, to its state before the next round."""

    def run(state: pa.Table, ranks: pa.Table) -> pa.Table:
        if not state.num_rows or not ranks.num_rows:
            return STATE_ARROW.empty_table()
        block, at, of = (state.column(c)[0] for c in ("block", "at", "of"))
        at, of = np.cumsum(array_of(at, "<i8")), np.cumsum(array_of(of, "<i4"), dtype=np.int64)
        rank = np.zeros(int(of.max()) + 1, dtype=np.int64)
        for which, given in zip(ranks.column("which"), ranks.column("rank")):
            rank[array_of(which, "<i4")] = array_of(given, "<i8")
        places, known = needed(at, level), rank[of]
        ranks_at = lambda x: known[np.searchsorted(places, x)]
        at = at[np.logical_and.reduce([ranks_at(at + x) > 0 for x in offsets(level)])]
        if not len(at):
            return STATE_ARROW.empty_table()
        pairs = needed(at, level + 1)
        return pa.Table.from_batches([state_row(block.as_py(), at, ranks_at(pairs), ranks_at(pairs + STEPS[level]))])

    return run


def last_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every class of a block its first window; the others, which are repeats, as -1 - position under keys of their own."""
    for batch in batches:
        for at, of, one, two in zip(*batch.columns):
            at, of = np.cumsum(array_of(at, "<i8")), np.cumsum(array_of(of, "<i4"), dtype=np.int64)
            one, two = array_of(one, "<i8"), array_of(two, "<i8")
            first = np.append(True, of[1:] > np.maximum.accumulate(of)[:-1])  # classes are numbered by first sight
            columns = [np.where(first, one[of], at * -7046029254386353131), np.where(first, two[of], 0), np.where(first, at, -1 - at)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["one", "two", "pos"])


def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pair and position to the repeats among them, as runs of one window."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two, pos = (c.to_numpy() for c in batch.columns)
        same = np.append(last == (one[0], two[0]), (one[1:] == one[:-1]) & (two[1:] == two[:-1]))
        last = (one[-1], two[-1])
        found = np.where(pos < 0, -1 - pos, pos)[same | (pos < 0)]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.ones(len(found), dtype=np.int32))], names=["pos", "n"])


def repeats(opened: DataFrame, bits: int) -> DataFrame:
    """pos, n: windows that start earlier too. opened: doc, text, and runs (at, n) of windows, for each class that repeats its
    first window and any number of the others."""
    state = written(opened.select("doc", "text", "runs").mapInArrow(blocks(bits), STATE))
    for level in range(1, len(STEPS)):
        pairs = state.select("block", "of", "one", "two").mapInArrow(sent, "one long, two long, id long")
        ranks = pairs.repartition("one", "two").sortWithinPartitions("one", "two", "id").mapInArrow(ranked, "block long, which binary, rank binary")
        state = written(state.select("block", "at", "of").groupBy("block").cogroup(ranks.groupBy("block")).applyInArrow(paired(level), STATE))
    rows = state.select("at", "of", "one", "two").mapInArrow(last_sent, "one long, two long, pos long")
    return rows.repartition("one", "two").sortWithinPartitions("one", "two", "pos").mapInArrow(later, "pos long, n int")
