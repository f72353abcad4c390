"""Cost-balanced packing of token ids into sequences of bounded length.

A piece of n tokens is estimated to cost `n + n * n / (6 * hidden)`: the linear layers, and attention inside the
piece. A task packs what it reads in windows of about `window` tokens, without a shuffle. In a window, every full
sequence's worth of a document is a sequence of its own. The shorter rests are taken in descending order, each into
the sequence of lowest cost among those with enough capacity left; where none has, the rest is cut to fill the one of
lowest cost. There are as many sequences as the rests fill exactly, so a window leaves less than a sequence of tokens,
which goes on to the next window. A task's last tokens fill sequences of powers of two, which need no padding; so
nothing is padded.

Defined results: a null text counts as empty and is one piece, its end id. Null or repeated ids are packed like any
others. An empty table gives no pieces. Only the id column is kept. A window holds its texts' ids, and a document at
least, so memory is bounded by the window and the longest document.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulore.llm.common import release
from tabulore.llm.tokens import encoded, encoder, without_gc


def cost(n: int, hidden: int) -> float:
    return n + n * n / (6 * hidden)


def full_and_rest(lengths: np.ndarray, size: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Pieces (document, start, length): those of a full sequence, and what is left of each document."""
    full = [(d, s, size) for d, n in enumerate(lengths.tolist()) for s in range(0, n - size + 1, size)]
    rest = [(d, n - n % size, n % size) for d, n in enumerate(lengths.tolist()) if n % size]
    return full, rest


def balance(rests: list[tuple[int, int, int]], size: int, hidden: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Sequences filled exactly, and the pieces, of less than a sequence in all, that are left."""
    todo = [(-n, i, s, d) for i, (d, s, n) in enumerate(rests)]
    heapq.heapify(todo)
    count = sum(n for _, _, n in rests) // size
    filled: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    free, costs, made, left = np.full(count, size), np.zeros(count), len(rests), []
    while todo:
        n, _, start, doc = heapq.heappop(todo)
        n = -n
        fits = np.flatnonzero(free >= n)
        if not len(fits):
            fits = np.flatnonzero(free)
            if not len(fits):
                left.append((doc, start, n))
                continue
        at = fits[costs[fits].argmin()]
        took = min(n, int(free[at]))
        filled[at].append((doc, start, took))
        free[at] -= took
        costs[at] += cost(took, hidden)
        if took < n:
            heapq.heappush(todo, (took - n, made, start + took, doc))
            made += 1
    return filled, left


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into sequences whose lengths are the powers of two that their sum is made of."""
    out, todo, total = [], list(reversed(pieces)), sum(n for _, _, n in pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        room, held = total & (1 << bit), []
        while room:
            doc, start, n = todo.pop()
            took = min(n, room)
            held.append((doc, start, took))
            room -= took
            if took < n:
                todo.append((doc, start + took, n - took))
        if held:
            out.append(held)
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, hidden: int = 1024, window: int = 1 << 20) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], list[np.ndarray], list[np.ndarray]]]:
        keys, ids, lengths, held = [], [], [], 0
        with without_gc():
            for batch in batches:
                for key, got, n in encoded(tokenizer_path, batch, end_id):
                    keys, ids, lengths, held = [*keys, key], [*ids, got], [*lengths, n], held + len(got)
                    if held >= window:
                        yield keys, ids, lengths
                        keys, ids, lengths, held = [], [], [], 0
            encoder(tokenizer_path).forget()
            release()
        if keys:
            yield keys, ids, lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 40
        carried: list[tuple[pa.Array, np.ndarray, int, int]] = []  # id, ids of the piece, start, document's tokens
        for keys, parts, counts in windows(batches):
            key, ids, lengths = pa.concat_arrays([*(k for k, _, _, _ in carried), *keys]), np.concatenate([*(i for _, i, _, _ in carried), *parts]), np.concatenate(counts)
            # what the window before left comes first, as if documents of their own
            before = np.array([[len(i), s, t] for _, i, s, t in carried], dtype=np.int64).reshape(-1, 3)
            held = np.concatenate([before[:, 0], lengths])
            shift = np.concatenate([before[:, 1], np.zeros(len(lengths), dtype=np.int64)])
            tokens = np.concatenate([before[:, 2], lengths])
            first = np.cumsum(held) - held
            full, rest = full_and_rest(held, size)
            filled, left = balance(rest, size, hidden)
            carried = [(key.slice(d, 1), ids[first[d] + s : first[d] + s + n].copy(), int(shift[d]) + s, int(tokens[d])) for d, s, n in left]
            sequences = [[p] for p in full] + filled
            if sequences:
                yield rows(sequences, next_id, key, ids, first, shift, tokens)
                next_id += len(sequences)
        if carried:
            n = np.array([len(i) for _, i, _, _ in carried], dtype=np.int64)
            sequences = powers_of_two([(d, 0, int(x)) for d, x in enumerate(n)])
            yield rows(sequences, next_id, pa.concat_arrays([k for k, _, _, _ in carried]), np.concatenate([i for _, i, _, _ in carried]), np.cumsum(n) - n, np.array([s for _, _, s, _ in carried]), np.array([t for _, _, _, t in carried]))

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, {schema}").withColumnRenamed("doc_id", id_col)


def rows(sequences: list[list[tuple[int, int, int]]], next_id: int, key: pa.Array, ids: np.ndarray, first: np.ndarray, shift: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
    doc, start, length = np.array([p for s in sequences for p in s], dtype=np.int64).T
    n = np.array([len(s) for s in sequences])
    sequence = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(length)
    offset = ends - length - np.repeat((ends - length)[np.cumsum(n) - n], n)
    at = first[doc] + start
    words = ids.astype("<u4", copy=False)
    crc = np.fromiter((zlib.crc32(words[a : a + m]) for a, m in zip(at.tolist(), length.tolist())), dtype=np.int64, count=len(at))
    columns = [shift[doc] + start, length, crc, tokens[doc], next_id + sequence, offset]
    return pa.RecordBatch.from_arrays([key.take(pa.array(doc)), *map(pa.array, columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
