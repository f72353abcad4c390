"""Media columns: chroma fingerprints of audio, and the alignment of recordings by them.

A recording is a column of 8-bit unsigned PCM (bytes, or text as its UTF-8 bytes). Frames of FRAME samples, HOP apart,
give the energy of 12 pitch classes, smoothed over three frames and scaled to length one. On that image 16 filters
compare sums of rectangles, which an integral image gives in four look-ups; each comparison is quantised to two
Gray-coded bits, so every place of the WIDTH frames that all filters see has a packed 32-bit integer.

Alignment: all places at which a recording and a query hold the same integer vote for their offset; the most voted
offset aligns them, and the bit errors are counted over their whole overlap. Recordings of equal integers are one class, and
classes meet. Queries are dealt into blocks of about `block_codes` integers; a join on the distinct integers says
which classes share one with which blocks, and only there they go. A block that many classes go to is copied, one copy for
each `nodes_a_task` of them, so neither the number of recordings nor an integer that a third of them share is
limited, nothing is collected, and a task holds one block.

align_all() gives every query that has a vote. Queries of equal integers are one class, named by its smallest id, so a
group of equal recordings gives a row for each, not one for each pair: class_id says of which class a recording
is (null if no query has its integers), match_id which class it aligns with, and pairs() spells out the pairs. A row
leaves out the recording's own class only if no other id is in it. align() gives each recording's best query.

Defined results: a null recording is empty. A recording of fewer than WIDTH frames has no integers and aligns with
nothing (match_id null, votes 0). A recording doesn't align with itself (the same id); null ids are never queries.
Equal votes go to the smaller query id, then to the smaller offset. Repeated rows get equal results. Passages that begin off
the grid of HOP samples may share no integer, and are then missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulore.llm.common import cut

RATE, FRAME, HOP, CLASSES, WIDTH = 8000, 256, 64, 12, 8


def pitch_classes() -> np.ndarray:
    """Bins of a frame's spectrum by pitch class; A is 0. Bins below 60 Hz or over 3,600 Hz count nowhere."""
    hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(hertz), CLASSES), dtype=np.float32)
    for k, f in enumerate(hertz):
        if 60 <= f <= 3600:
            out[k, round(12 * np.log2(f / 440)) % CLASSES] = 1
    return out


FOLD, WINDOW = pitch_classes(), np.hanning(FRAME).astype(np.float32)
#: (kind, first pitch class, pitch classes, frames) of each filter: every kind with several places and sizes.
FILTERS = [(i % 6, (5 * i) % 7, 3 + (i * 2) % 4, (8, 4, 6)[i % 3]) for i in range(16)]
#: Samples of the noise on which the filters' levels are set.
NOISE = 1 << 17


def chroma(samples: np.ndarray, at_once: int = 1 << 13) -> np.ndarray:
    """frames x pitch classes, each frame of length one or zero."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES), dtype=np.float64)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), CLASSES))
    for lo in range(0, len(frames), at_once):
        spectrum = np.fft.rfft((frames[lo : lo + at_once].astype(np.float32) - 128) * WINDOW, axis=1)
        out[lo : lo + at_once] = (spectrum.real**2 + spectrum.imag**2) @ FOLD
    smooth = out.copy()
    smooth[1:] += out[:-1]
    smooth[:-1] += out[1:]
    norm = np.sqrt((smooth**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-3, smooth / np.maximum(norm, 1e-3), 0.0)


def compared(area, kind: int, y: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The two sums that a filter compares. area(t, y, w, h): the image's sum from frame t past each place."""
    if kind == 0:
        return area(0, y, w, h), 0 * area(0, y, w, h)
    if kind == 1:
        return area(0, y, w, h // 2), area(0, y + h // 2, w, h - h // 2)
    if kind == 2:
        return area(0, y, w // 2, h), area(w // 2, y, w - w // 2, h)
    if kind == 3:
        a, b = w // 2, h // 2
        return area(0, y, a, b) + area(a, y + b, w - a, h - b), area(a, y, w - a, b) + area(0, y + b, a, h - b)
    if kind == 4:
        third = max(1, h // 3)
        return area(0, y + third, w, h - 2 * third), area(0, y, w, third) + area(0, y + h - third, w, third)
    third = max(1, w // 3)
    return area(third, y, w - 2 * third, h), area(0, y, third, h) + area(w - third, y, third, h)


def responses(samples: np.ndarray) -> np.ndarray:
    """filters x places: what each filter says."""
    image = chroma(samples)
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros((len(FILTERS), 0))
    total = np.zeros((len(image) + 1, CLASSES + 1))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)

    def area(t: int, y: int, w: int, h: int) -> np.ndarray:
        top, low = total[t : t + n], total[t + w : t + w + n]
        return low[:, y + h] - low[:, y] - top[:, y + h] + top[:, y]

    pairs = (compared(area, *f) for f in FILTERS)
    # rounded, so that where a sum began doesn't show in it
    return np.array([np.round(np.log((1 + a) / (1 + b)), 6) for a, b in pairs])


@cache
def levels() -> np.ndarray:
    """The quartiles of each filter's responses to white noise, so that its two bits are balanced."""
    return np.quantile(responses(np.random.default_rng(0).integers(64, 192, NOISE, dtype=np.uint8)), [0.25, 0.5, 0.75], axis=1).T


def codes(samples: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
    """The packed integers of a recording, in stretches of places that overlap by what filters and smoothing see."""
    frames = (len(samples) - FRAME) // HOP + 1 if len(samples) >= FRAME else 0
    places = max(0, frames - WIDTH + 1)
    out = np.zeros(places, dtype=np.uint32)
    for lo in range(0, places, at_once):
        hi = min(places, lo + at_once)
        first, last = max(0, lo - 1), min(frames, hi + WIDTH)
        found = responses(samples[first * HOP : (last - 1) * HOP + FRAME])[:, lo - first : hi - first]
        for value, bounds in zip(found, levels()):
            level = np.searchsorted(bounds, value).astype(np.uint32)
            out[lo:hi] = (out[lo:hi] << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def fingerprinted(recordings: DataFrame, id_col: str, media: Column) -> DataFrame:
    """id, codes (packed integers, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [codes(np.frombuffer(m or b"", dtype=np.uint8)).astype("<u4").tobytes() for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "codes"])

    kept = recordings.select(F.col(id_col).alias("id"), media.cast("binary").alias("media"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, codes binary")


def by_code(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers, ascending, and their places."""
    order = np.argsort(held, kind="stable")
    return held[order], order


def votes(mine: tuple[np.ndarray, np.ndarray], theirs: tuple[np.ndarray, np.ndarray], at_once: int = 1 << 22) -> np.ndarray:
    """How many pairs of places with equal integers there are for each offset, from 1 - (number of theirs) on."""
    (a, place), (b, other) = mine, theirs
    size, shift = len(a) + len(b) - 1, len(b) - 1
    lo, hi = np.searchsorted(b, a), np.searchsorted(b, a, side="right")
    n, out = hi - lo, np.zeros(size, dtype=np.int64)
    if int(n.sum()) > 64 * size:
        # integers that repeat a lot: all offsets of one at a time, as the correlation of the places that have it
        for code in np.unique(a[n > 4096]):
            at, to = (np.zeros(2 * size) for _ in range(2))
            own = a == code
            at[place[own]], to[other[np.searchsorted(b, code) : np.searchsorted(b, code, side="right")]] = 1, 1
            found = np.rint(np.fft.irfft(np.fft.rfft(at) * np.conj(np.fft.rfft(to)))).astype(np.int64)
            out += np.concatenate([found[len(found) - shift :], found[: len(a)]])
            n[own] = 0
    ends = np.cumsum(n)
    start = 0
    while start < len(n) and ends[-1] > (ends[start - 1] if start else 0):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + at_once, side="right")))
        some = n[start:stop]
        at = np.repeat(lo[start:stop] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))
        out += np.bincount(np.repeat(place[start:stop], some) - other[at] + shift, minlength=size)
        start = stop
    return out


@dataclass
class Index:
    first: np.ndarray  # the smallest and the largest id of each class of queries, ascending by the smallest
    last: np.ndarray
    held: list[np.ndarray]  # their integers
    sorted: list[tuple[np.ndarray, np.ndarray]]
    key: np.ndarray  # their distinct integers, ascending
    query: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, int, bytes]]) -> Index:
        rows = sorted(rows)
        held = [np.frombuffer(c, dtype="<u4") for _, _, c in rows]
        marks = [np.unique(h) for h in held]
        key = np.concatenate(marks)
        order = np.argsort(key, kind="stable")
        query = np.repeat(np.arange(len(rows)), list(map(len, marks)))[order]
        return cls(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), held, list(map(by_code, held)), key[order], query)

    def every(self, held: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """Of each class that shares an integer: its ids, the most voted offset, its votes, and the share of wrong bits there."""
        mine = by_code(held)
        key = np.unique(held)
        lo, hi = np.searchsorted(self.key, key), np.searchsorted(self.key, key, side="right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out = []
        for q in np.unique(self.query[at]).tolist():
            found = votes(mine, self.sorted[q])
            top = int(found.argmax())  # the first of equals: the smallest offset
            shift = top - (len(self.held[q]) - 1)
            x, y = held[max(0, shift) :], self.held[q][max(0, -shift) :]
            m = min(len(x), len(y))
            out.append((int(self.first[q]), int(self.last[q]), shift, int(found[top]), float(np.bitwise_count(x[:m] ^ y[:m]).sum() / (32 * m))))
        return out


MATCH = "match_id long, match_last long, offset long, votes long, bit_error double"


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by task, its queries (guest 0) before its guests, to node and MATCH."""
    task, home, index = None, [], None
    for batch in batches:
        out = []
        for block, salt, guest, node, first, last, held in zip(*(c.to_pylist() for c in batch.columns)):
            if (block, salt) != task:
                task, home, index = (block, salt), [], None
            if not guest:
                home.append((first, last, held))
                continue
            index = Index.of(home) if index is None else index
            out += [(node, *found) for found in index.every(np.frombuffer(held, dtype="<u4"))]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "match_id", "match_last", "offset", "votes", "bit_error"])


def distinct_codes(name: str):
    """Rows (codes, name) to (code, name), each integer once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.frombuffer(c.as_buffer(), dtype="<u4")) for c in batch.column(0)]
            if found:
                which = np.repeat(np.arange(len(found)), list(map(len, found)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int32)), batch.column(1).take(pa.array(which))], names=["code", name])

    return run


def matches(classes: DataFrame, block_codes: int, nodes_a_task: int) -> DataFrame:
    """node and MATCH: each class and every class of queries that it shares an integer with. classes: node, codes, first, last."""
    queries = classes.filter("first is not null")
    n_codes = queries.agg(F.sum(F.length("codes"))).first()[0] or 0
    blocks = max(1, -(-n_codes // (4 * block_codes)))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)))
    sought = queries.select("codes", "block").mapInArrow(distinct_codes("block"), "code int, block long").distinct()
    hits = cut(classes.select("codes", "node").mapInArrow(distinct_codes("node"), "code int, node binary").join(sought, "code").select("node", "block").distinct())
    # a row for each block, that is for each block_codes integers of queries
    copies = F.broadcast(cut(hits.groupBy("block").agg(F.ceil(F.count("*") / nodes_a_task).alias("copies"))))
    nothing = {"node": F.lit(None).cast("binary"), "first": F.lit(None).cast("long"), "last": F.lit(None).cast("long")}
    columns = ["block", "salt", "guest", "node", "first", "last", "codes"]
    home = queries.join(copies, "block").withColumns({"salt": F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)), "guest": F.lit(0), "node": nothing["node"]})
    guests = hits.join(classes.select("node", "codes"), "node").join(copies, "block")
    guests = guests.withColumns({"salt": F.pmod(F.xxhash64("node"), F.col("copies")), "guest": F.lit(1), "first": nothing["first"], "last": nothing["last"]})
    dealt = home.select(*columns).unionByName(guests.select(*columns))
    return dealt.repartition("block", "salt").sortWithinPartitions("block", "salt", "guest").mapInArrow(searched, f"node binary, {MATCH}")


def rows_and_matches(recordings: DataFrame, is_query: Column, id_col: str, media: Column | None, block_codes: int, nodes_a_task: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, codes, node), and of each node with integers class_id, n (its matches) and its MATCHes, one row each, or one of nulls."""
    prints = cut(fingerprinted(recordings, id_col, F.col("text") if media is None else media).withColumn("node", F.unhex(F.md5("codes"))))
    asked = F.when(F.col("id").isNotNull() & is_query, F.col("id")).cast("long")
    classes = cut(prints.filter(F.length("codes") > 0).groupBy("codes", "node").agg(F.min(asked).alias("first"), F.max(asked).alias("last")))
    found = cut(matches(classes, block_codes, nodes_a_task))
    some = classes.select("node", F.col("first").alias("class_id")).join(found.groupBy("node").agg(F.count("*").alias("n")), "node", "left")
    # kept, so that its join with the rows shuffles both sides, and AQE can split a class that many rows are of
    return prints, cut(some.join(found, "node", "left"))


def is_own() -> Column:
    """Whether a match is that of a recording with itself alone."""
    return F.coalesce((F.col("match_id") == F.col("match_last")) & (F.col("match_id") == F.col("id")), F.lit(False))


def align_all(recordings: DataFrame, is_query: Column, id_col: str = "doc_id", media: Column | None = None, block_codes: int = 2_000_000, nodes_a_task: int = 40_000) -> DataFrame:
    """id, n_codes, codes_crc32, class_id, match_id, offset, votes, bit_error: a row for each recording and each class of
    queries that it aligns with, or one with match_id null."""
    prints, found = rows_and_matches(recordings, is_query, id_col, media, block_codes, nodes_a_task)
    met = prints.join(found, "node", "left").withColumn("own", is_own()).filter("not own or n = 1")
    shown = [F.when(~F.col("own"), F.col(c)).alias(c) for c in ("match_id", "offset")]
    vote = F.coalesce(F.when(~F.col("own"), F.col("votes")), F.lit(0)).cast("long").alias("votes")
    return met.select(F.col("id").alias(id_col), (F.length("codes") / 4).cast("long").alias("n_codes"), F.crc32("codes").alias("codes_crc32"), "class_id", *shown, vote, F.when(~F.col("own"), F.col("bit_error")).alias("bit_error"))


def align(recordings: DataFrame, is_query: Column, id_col: str = "doc_id", media: Column | None = None, block_codes: int = 2_000_000, nodes_a_task: int = 40_000) -> DataFrame:
    """id, n_codes, codes_crc32, match_id, offset, votes, bit_error of every recording: the query that it aligns with best."""
    prints, found = rows_and_matches(recordings, is_query, id_col, media, block_codes, nodes_a_task)
    # the second id of a class stands for it where the recording itself is its first
    first = found.select("node", "class_id").distinct()
    second = prints.filter(F.col("id").isNotNull() & is_query).join(first, "node").filter(F.col("id") > F.col("class_id")).groupBy(F.col("class_id").alias("match_id")).agg(F.min("id").cast("long").alias("second"))
    met = prints.select("id", "node").distinct().join(found, "node").join(second, "match_id", "left").filter(~is_own() & F.col("match_id").isNotNull())
    named = met.withColumn("match_id", F.when(F.col("match_id") == F.col("id"), F.col("second")).otherwise(F.col("match_id")))
    best = F.struct((-F.col("votes")).alias("fewer"), "match_id", "offset", "votes", "bit_error")
    top = named.groupBy("node", F.col("id").alias("_id")).agg(F.min(best).alias("best")).withColumnRenamed("node", "_node")
    out = prints.join(top, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    return out.select(F.col("id").alias(id_col), (F.length("codes") / 4).cast("long").alias("n_codes"), F.crc32("codes").alias("codes_crc32"), "best.match_id", "best.offset", F.coalesce("best.votes", F.lit(0)).cast("long").alias("votes"), "best.bit_error")


def pairs(aligned: DataFrame, is_query: Column, id_col: str = "doc_id") -> DataFrame:
    """query_id, id, offset, votes, bit_error of every pair that align_all's rows stand for; is_query is of the column id."""
    queries = aligned.select(F.col(id_col).alias("id"), "class_id").filter(is_query & F.col("id").isNotNull()).distinct()
    met = aligned.filter("match_id is not null").join(queries.select(F.col("id").alias("query_id"), F.col("class_id").alias("match_id")), "match_id")
    return met.filter(~F.col("query_id").eqNullSafe(F.col(id_col))).select("query_id", id_col, "offset", "votes", "bit_error")
