"""Suffix-array dedup: bytes covered by a LENGTH-byte string that also starts earlier, by prefix doubling.

Positions are (document, byte), ordered by document id and then by byte; a match lies in one document. Prefix doubling of
all positions would shuffle many times the text, so two steps first settle the positions that can be told by runs:

1. Anchors. The k-mer with the least hash in a window of LENGTH bytes is the window's anchor, wherever the window
   stands; neighbouring windows share one, which so owns a run of windows. An anchor's own stretch, from the first byte of
   its first window to the last of its last, is named by a hash, and Spark sorts (k-mer, stretch, position). Of equal
   stretches all but the first are repeats. What is left are the first stretches of each kind. Besides the k-mer a window
   holds three quarters of the rest for sure, how much of it before the k-mer depends on the quarter in which the window
   begins. Where no other kind of stretch of the k-mer shares those bytes, the quarter's windows occur nowhere else. So
   windows stay open only where repeats begin and end.
2. Doubling (doubling.py). Spark sorts the open windows' pairs of ranks at growing offsets, reranks, and drops unique ones, until
   ranks are past the threshold; all but the first of equal windows are repeats.
3. The repeats of a document meet its text, and are cut out of it.

A task combines what it reads before a shuffle, so what very many documents share leaves it once for each AT_ONCE
anchors; a k-mer with more than SALT_FROM kinds of stretches in a task is dealt out by stretch, with a mark that keeps the
rest of its rows from being taken for unique. Of a k-mer with over CROWD rows all kinds stay open, so no task holds more. Names
are 64-bit hashes: a false repeat needs equal k-mer hashes and equal stretch hashes, or four equal hashes in doubling.

Ids: integers without repeats, from 0 and below 2 ** (63 - bits), are used as they are, with as many bits as the longest
text needs for its bytes; any other ids are numbered in their order first (nulls first, then rows that repeat an id by a hash
of their text). Documents times the next power of two above the longest text may not exceed 2 ** 63. Defined results: a null
text is empty, and an empty text keeps nothing. Repeated rows are separate documents. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulore.llm.common import shared_dir, written
from tabulore.llm.doubling import LENGTH, repeats

KMER = 32
QUARTER = (LENGTH - KMER) // 4
SALT_FROM, SALTS, AT_ONCE, CROWD = 64, 1024, 1 << 18, 1 << 17
#: Windows of a text that are looked at in one go; positions fit into the low bits that the least k-mer is found by.
REACH = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def kmers(data: bytes) -> np.ndarray:
    """A hash of the KMER bytes from every place."""
    n = len(data) - KMER + 1
    words = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    held = np.zeros(n, dtype=np.uint64)
    for i in range(KMER // 8):
        held ^= words[8 * i : 8 * i + n]
        held *= _MIX[i % 4]
        held ^= held >> np.uint64(31)
    return held


def stretches(data: bytes) -> tuple[np.ndarray, ...]:
    """Of each anchor's run of windows: the first, their number, the k-mer, and its distance from the first; and by
    quarter 32 bits of a hash of the bytes that its windows hold for sure, 0 where none of the run begins in it."""
    windows = len(data) - LENGTH + 1
    parts = []
    for lo in range(0, max(0, windows), REACH):
        n = min(REACH, windows - lo)
        hashed = kmers(data[lo : lo + n + LENGTH - 1])
        least = (hashed & ~_LOW) | np.arange(len(hashed), dtype=np.uint64)
        span = 1
        while 2 * span <= LENGTH - KMER + 1:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = LENGTH - KMER + 1 - span
        least = np.minimum(least[: len(least) - rest], least[rest:])
        at = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        count, anchor = np.diff(np.append(first, n)), at[first]
        lead = anchor - first
        names = []
        for q in range(4):
            # the k-mer, q quarters before it and 3 - q behind it, as three k-mers that overlap
            begin = np.clip(anchor - q * QUARTER, 0, len(hashed) - 1 - 3 * QUARTER if len(hashed) > 3 * QUARTER else 0)
            held = (hashed[begin] * _MIX[1]) ^ (hashed[begin + KMER] * _MIX[2]) ^ (hashed[begin + 3 * QUARTER] * _MIX[3])
            held ^= held >> np.uint64(29)
            some = (lead >= q * QUARTER) & ((lead - count + 1 < (q + 1) * QUARTER) | (q == 3))
            names.append(np.where(some, ((held * _MIX[0]) >> np.uint64(32)).astype(np.int64) | 1, 0))
        parts.append((first + lo, count, hashed[anchor], lead, names[0] | (names[1] << 32), names[2] | (names[3] << 32)))
    if not parts:
        parts = [(np.zeros(0, dtype=np.int64),) * 6]
    return tuple(np.concatenate(x) for x in zip(*parts))


#: group: a k-mer, or one with a salt. about: windows, lead, and the flags below.
COLUMNS = ["group", "stretch", "pos", "about", "first_half", "last_half"]
SHUFFLED = pa.schema([(c, pa.int64()) for c in COLUMNS])
SHUFFLED_SQL = ", ".join(f"`{c}` long" for c in COLUMNS)
#: A repeat that a task has found; a row of a salted k-mer; a mark in the group of a k-mer of which salted rows exist.
RESOLVED, SALTED, MARK = 1 << 16, 1 << 17, 1 << 18


def combined(kmer: np.ndarray, stretch: np.ndarray, pos: np.ndarray, about: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
    """A task's rows: the first of equal stretches to be sorted, the others resolved; k-mers of many kinds salted."""
    order = np.lexsort((pos, stretch, kmer))
    kmer, stretch, pos, about, *rest = (x[order] for x in (kmer, stretch, pos, about, *rest))
    other = np.append(True, kmer[1:] != kmer[:-1])[: len(kmer)]
    first = other | np.append(True, stretch[1:] != stretch[:-1])[: len(kmer)]
    many = (np.bincount(np.cumsum(other) - 1, weights=first) > SALT_FROM)[np.cumsum(other) - 1]
    salted = (kmer + np.uint64(1) + stretch % np.uint64(SALTS)) * _MIX[3]
    # what is resolved goes along evenly
    group = np.where(first, np.where(many, salted, kmer), pos.astype(np.uint64) * _MIX[0])
    about = about | np.where(first, np.where(many, SALTED, 0), RESOLVED)
    marks = kmer[other & many]
    zeros = np.zeros(len(marks), dtype=np.int64)
    columns = [group, stretch, pos, about, *rest]
    columns = [np.append(c, marks if i == 0 else (zeros + MARK if i == 3 else zeros).astype(c.dtype)) for i, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], schema=SHUFFLED)


def anchored(bits: int):
    """Rows (doc, text) to COLUMNS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_buffer().to_pybytes()
                start, n, kmer, lead, *names = stretches(data)
                if not len(start):
                    continue
                name = np.fromiter((xxhash.xxh3_64_intdigest(data[a : a + m]) for a, m in zip(start.tolist(), (n + LENGTH - 1).tolist())), dtype=np.uint64, count=len(start))
                held.append((kmer, name, (doc << bits) + start, (n << 8) | lead, *names))
                size += len(start)
                if size >= AT_ONCE:
                    yield combined(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if held:
            yield combined(*(np.concatenate(x) for x in zip(*held)))

    return run


def shared(group: np.ndarray, name: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of the rows `of` have a name that another of them has in the same group."""
    out = np.zeros(len(name), dtype=bool)
    _, which, times = np.unique(group[of] << 32 | name[of], return_inverse=True, return_counts=True)
    out[of] = times[which] > 1
    return out


def judged(table: pa.Table, crowd: tuple[int, int | None] | None = None) -> pa.RecordBatch:
    """Groups, sorted by group, stretch and position, to runs of windows. crowd: a group that isn't whole, and its last stretch before."""
    key, stretch, pos, about, *halves = (c.to_numpy() for c in table.columns)
    n, lead = (about >> 8) & 255, about & 255
    other = np.append(True, key[1:] != key[:-1])
    kind = other | np.append(True, stretch[1:] != stretch[:-1])
    crowded = key == crowd[0] if crowd else np.zeros(len(key), dtype=bool)
    if crowd and crowded[0]:
        kind[0] = stretch[0] != crowd[1]
    group = np.cumsum(other) - 1
    mark, resolved = about & MARK > 0, about & RESOLVED > 0
    # a mark sorts among stretches named 0; the first row of a kind stands behind it
    first = ~mark & ~resolved & (kind | np.append(False, mark[:-1]))
    repeat = ~mark & ~first
    # with a salt or a mark, other kinds are elsewhere
    unsure = crowded | (about & SALTED > 0) | (np.bincount(group, weights=mark) > 0)[group]
    runs = [(pos[repeat], n[repeat], True)]
    for q in range(4):
        name = (halves[q // 2] >> (32 * (q % 2))) & 0xFFFFFFFF
        open_ = first & (name != 0)
        open_ &= shared(group, name, open_) | unsure
        # the windows whose distance from the k-mer is in the quarter
        far = np.where(q == 3, lead, np.minimum(lead, (q + 1) * QUARTER - 1))[open_]
        near = np.maximum(lead - n + 1, q * QUARTER)[open_]
        runs.append((pos[open_] + lead[open_] - far, far - near + 1, False))
    columns = [np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]).astype(np.int32), np.repeat([r[2] for r in runs], [len(r[0]) for r in runs])]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["pos", "n", "repeat"])


def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, stretch and position to runs of windows (pos, n, repeat): those of repeats, and open ones."""
    held: list[pa.RecordBatch] = []
    crowd: tuple[int, int | None] | None = None  # the group that is held, if part of it is out already
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        ahead = np.flatnonzero(key != key[-1])
        to = int(ahead[-1]) + 1 if len(ahead) else 0
        if to or held and held[-1].column(0)[-1].as_py() != key[-1] or crowd and crowd[0] != key[0]:
            if held or to:
                yield judged(pa.Table.from_batches([*held, batch.slice(0, to)] if to else held), crowd)
            held, crowd = [], None
        held.append(batch.slice(to))
        if sum(b.num_rows for b in held) > CROWD:
            yield judged(pa.Table.from_batches(held), crowd or (int(key[-1]), None))
            held, crowd = [], (int(key[-1]), int(batch.column(1)[-1].as_py()))
    if held:
        yield judged(pa.Table.from_batches(held), crowd)


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (id, text) with doc, a number in the ids' order, and the bits of a byte's place; ids that serve as such are kept."""
    kind = docs.schema["id"].dataType.simpleString()
    whole = kind in ("int", "bigint", "smallint", "tinyint")
    longest, rows, *ids = docs.agg(F.max(F.octet_length("text")), F.count("*"), *([F.min("id"), F.max("id"), F.count("id")] if whole else [])).first()
    bits = int(longest or 1).bit_length()
    if rows > 1 << (63 - bits):
        raise ValueError(f"{rows} documents of up to {longest} bytes are more positions than 63 bits can number")
    if whole and (not rows or ids[2] == rows and ids[0] >= 0 and ids[1] < 1 << (63 - bits) and docs.groupBy("id").count().filter("count > 1").isEmpty()):
        return docs.withColumn("doc", F.col("id").cast("long")), bits
    tie = F.xxhash64("text")
    path = f"{shared_dir(docs.sparkSession)}/numbered-{uuid.uuid4().hex}"
    docs.repartitionByRange("id", tie).sortWithinPartitions("id", tie).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    held = docs.sparkSession.read.parquet(path)
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r[0], r[1]) for r in held.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    first = docs.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part long, _first long")
    return held.join(F.broadcast(first), part == F.col("_part")).select("id", "text", (F.col("_first") + row).alias("doc")), bits


def by_document(runs: DataFrame, bits: int) -> DataFrame:
    """doc, runs: an array of (first window, windows)."""
    byte = F.col("pos").bitwiseAND(F.lit((1 << bits) - 1))
    return runs.groupBy(F.shiftright("pos", bits).alias("doc")).agg(F.collect_list(F.struct(byte.cast("int").alias("at"), F.col("n").alias("n"))).alias("runs"))


def with_runs(batch: pa.RecordBatch) -> Iterator[tuple[Any, bytes, np.ndarray, np.ndarray]]:
    """Of rows (id, text, runs): id, text, and the runs' first windows and their numbers. One text at a time leaves Arrow."""
    lists = batch.column(2)
    bounds, runs = lists.offsets.to_numpy().tolist(), lists.values
    at, n = runs.field("at").to_numpy().astype(np.int64), runs.field("n").to_numpy().astype(np.int64)
    for i in range(batch.num_rows):
        lo, hi = bounds[i], bounds[i + 1]
        yield batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer().to_pybytes(), at[lo:hi], n[lo:hi]


def cut_out(data: bytes, at: np.ndarray, n: np.ndarray) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans, kept_sha256."""
    if not len(at):
        return len(data), 0, 0, hashlib.sha256(data).hexdigest()
    order = np.argsort(at, kind="stable")
    at, upto = at[order], np.maximum.accumulate((at + n + LENGTH - 1)[order])
    new = np.append(True, at[1:] > upto[:-1])  # runs that touch are one
    begins, ends = at[new].tolist(), upto[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)].tolist()
    kept, view, done = hashlib.sha256(), memoryview(data), 0
    for lo, hi in zip(begins, ends):
        kept.update(view[done:lo])
        done = hi
    kept.update(view[done:])
    return len(data), sum(ends) - sum(begins), len(begins), kept.hexdigest()


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts, bits = numbered(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    runs = written(repeat_runs(texts.select("doc", "text"), bits))
    joined = texts.join(by_document(runs, bits), "doc", "left").select("id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut_out(data, at, n) for _, data, at, n in with_runs(batch)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int64(), pa.string()])] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = joined.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeat_runs(texts: DataFrame, bits: int) -> DataFrame:
    """pos, n: runs of windows that start earlier too. texts: doc, text."""
    rows = texts.mapInArrow(anchored(bits), SHUFFLED_SQL)
    runs = written(rows.repartition("group").sortWithinPartitions("group", "stretch", "pos").mapInArrow(sorted_out, "pos long, n int, repeat boolean"))
    opened = texts.join(by_document(runs.filter("not repeat"), bits), "doc")
    return runs.filter("repeat").select("pos", "n").unionByName(repeats(opened, bits))
