"""SimHash near-dedup: fingerprints of word shingles, and their exact comparison by tiles.

A bit of a fingerprint is 1 if it is set in over half of the XXH64 hashes (seed 42) of all word shingles. The distinct
fingerprints are dealt into cells by the population counts of their PARTS parts; a cell is cut into tiles of about
TILE fingerprints. The bits in which two fingerprints differ are at least the sum of the differences of their parts'
population counts, so tile pairs for which that sum is beyond the radius are skipped, and no link is lost. The other
pairs are compared whole in numpy: exclusive-or and bit counts. A tile is sent to those that it must meet, so work is
shared out by tiles, however large a cell is. Of the links that a comparison finds only a spanning forest leaves it.

There are at most (64 / PARTS + 1) ** PARTS cells, 83,521, so the table of their sizes is small enough to broadcast.

Defined results: a text without words (or null) has fingerprint zero, which links like any other; a text with fewer
words than a shingle has one shingle, all its words. Rows that share a text share fingerprint and component. The
component's id is the smallest id in it, nulls aside; it is null if they all are. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulore.llm.common import cut, lookup, release, releasing
from tabulore.llm.components import components

PARTS, TILE, SEED = 4, 4096, 42
WIDTH = 64 // PARTS


def fingerprint(text: str, words: int = 3, at_once: int = 1 << 15) -> int:
    found = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only, as \x20\x09-\x0D and A-Z are
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ones, hashed = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, at_once):
        hi = min(lo + at_once, n)
        shingles = zip(*(found[lo + k : hi + k] for k in range(words))) if len(found) >= words else [found]
        h = np.array([hashed(b" ".join(s), SEED) for s in shingles], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(text: Column, words: int = 3) -> Column:
    """As a signed 64-bit number."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        found = np.array([0 if t is None else fingerprint(t, words) for t in texts], dtype=np.uint64)
        release()
        return pd.Series(found.view(np.int64))

    return prints(text)


def cell(fp: Column) -> Column:
    """The population counts of a fingerprint's parts, 8 bits for each."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1))).cast("long") for i in range(PARTS)]
    return sum((F.shiftleft(c, 8 * i) for i, c in enumerate(counts[1:], 1)), counts[0])


def steps(radius: int) -> list[int]:
    """Differences of cells that are within the radius, one of each pair of opposites, without zero."""
    found = (d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius)
    return sorted(s for d in found if (s := sum(x << (8 * i) for i, x in enumerate(d))) > 0)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) with the same components as the links (a, b)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            break
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def near(a: np.ndarray, b: np.ndarray, radius: int, same: bool = False, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs within the radius between two tiles, or inside one."""
    left, right = [], []
    for lo in range(0, len(a), rows):
        other = b[lo:] if same else b
        i, j = np.nonzero(np.bitwise_count(a[lo : lo + rows, None] ^ other[None, :]) <= radius)
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            x, y = forest(a[lo + i], other[j])
            left.append(x)
            right.append(y)
    none = np.zeros(0, dtype=a.dtype)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """src, dst: fingerprints whose components are those of all pairs within the radius. distinct: fp, without repeats."""
    dealt = cut(distinct.select("fp", cell(F.col("fp")).alias("cell")))
    sizes = cut(dealt.groupBy("cell").count().select("cell", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    own = dealt.join(F.broadcast(sizes), "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    at_home = own.select("fp", "cell", F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("meets"), F.col("tile"))
    at_home = at_home.select("fp", "cell", "meets", (F.col("meets") != F.col("tile")).cast("int").alias("guest"))
    away = dealt.select("fp", F.explode(F.array(*(F.col("cell") - F.lit(s) for s in steps(radius)))).alias("cell"))
    away = away.join(F.broadcast(sizes), "cell").select("fp", "cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("meets"), F.lit(1).alias("guest"))
    meeting = at_home.unionByName(away).select("fp", "guest", (F.shiftleft("cell", 24) + F.col("meets")).alias("tile"))
    return meeting.repartition("tile").sortWithinPartitions("tile", "guest").mapInPandas(releasing(lambda batches: compared(batches, radius)), "src long, dst long")


def compared(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows come by tile, its own fingerprints before its guests; the guests stream past them."""
    tile, home, closed = None, [], False
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def close() -> None:
        nonlocal closed, home
        if not closed:
            home = np.concatenate(home) if home else np.zeros(0, dtype=np.uint64)
            out.append(near(home, home, radius, same=True))
            closed = True

    for batch in batches:
        if not len(batch):
            continue
        fp = batch["fp"].to_numpy().astype(np.int64).view(np.uint64)
        key, guest = batch["tile"].to_numpy(), batch["guest"].to_numpy()
        bounds = np.flatnonzero((key[1:] != key[:-1]) | (guest[1:] != guest[:-1])) + 1
        for lo, hi in zip([0, *bounds.tolist()], [*bounds.tolist(), len(batch)]):
            if key[lo] != tile:
                if tile is not None:
                    close()
                tile, home, closed = key[lo], [], False
            if not guest[lo]:
                home.append(fp[lo:hi])
            else:
                close()
                out.append(near(home, fp[lo:hi], radius))
        yield as_links(out)
        out = []
    if tile is not None:
        close()
        yield as_links(out)


def as_links(out: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    src, dst = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, dtype=np.uint64) for i in (0, 1))
    return pd.DataFrame({"src": src.view(np.int64), "dst": dst.view(np.int64)})


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """id, fingerprint (signed), component_id of every row."""
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), words).alias("fp")))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("rows")))
    found = components(links(distinct.select("fp"), radius))
    met = found.join(distinct, found["node"] == distinct["fp"]).select("fp", "label", "first")
    least = met.groupBy("label").agg(F.min("first").alias("least"))
    least = met.select("fp", "label").join(least, "label").select("fp", "least")
    by_print = cut(distinct.join(least, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), "rows"))
    return lookup(prints, by_print, "fp", "rows").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")
