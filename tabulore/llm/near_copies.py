"""Near copies by exact similarity: texts whose sets of word shingles have a Jaccard similarity of SHARE or more.

Pairs come from two sides. SimHash (simhash.py, of shingles of WORDS words) links fingerprints that differ in few bits, by
tiles; fingerprints promise no similarity, so such a pair is a link only once it is counted. What fingerprints miss is found
by prefixes: two sets of a and b shingles are that similar only if they share 4/5 of the larger one. So in any one order of all
shingles, each set's first n - ceil(4n/5) + 1, its prefix, hold a shingle of the other's prefix: no pair is lost. The
order is that of the hashes, with shingles that a bounded sample shows to be common last, so that few texts meet at
one; the sample decides only how much is compared. Texts that meet are candidates if their sizes, and the places at
which they hold the shingle, allow the similarity. Then bitmaps are compared, of about half a byte a shingle: the bits in which
they differ are differing shingles, so they bound what is shared. What they allow is counted whole. Of more than CROWD
texts at a shingle, each first meets the one with the fewest rarer shingles; then only texts of components still apart meet.

Defined results: words are lowered and split as in simhash; shingles are 64-bit hashes. A text without words (or
null) equals every other; one with fewer words than a shingle has one shingle, all its words. Of each component the
row with the smallest id stays (null last; of one id's texts, that with the smallest hash), and of rows that repeat
both one. Columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulore.llm.common import cut, releasing, written
from tabulore.llm.components import components
from tabulore.llm.simhash import fingerprints, links

WORDS, CROWD = 5, 64
#: SHARE = PART / WHOLE, so that comparisons are of whole numbers.
PART, WHOLE = 4, 5
#: Texts of the sample, in how many of them a shingle is common, and how many common ones are told apart.
SAMPLE, COMMON, MOST = 50_000, 3, 1 << 17
#: Rows of numbers that may be broadcast.
FEW = 1 << 20
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashed shingles, ascending."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(1, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    n, width = max(1, len(h) - WORDS + 1), min(WORDS, len(h))
    out = np.full(n, len(h) if len(h) < WORDS else 0, dtype=np.uint64)
    for k in range(width):
        out += h[k : k + n] * MIX[k]
    out ^= out >> np.uint64(32)
    return np.unique(out * MIX[0])


def node(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def ranked(tokens: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The tokens in the order of all: those that are not common by hash, then the common ones by rank."""
    if not len(common):
        return tokens
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    return tokens[np.argsort(np.where(common[at] == tokens, rank[at], 0), kind="stable")]


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a bounded sample, ascending, and their ranks from 1; the most common last."""
    every = max(1, texts.count() // SAMPLE)
    taken = texts.filter(F.pmod("node", F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], names=["token"])

    counted = taken.select("text").mapInArrow(releasing(run), "token long").groupBy("token").count().filter(F.col("count") >= COMMON)
    rows = counted.orderBy(F.desc("count"), "token").limit(MOST).select("token").toArrow()
    tokens = rows.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (len(tokens) - np.arange(len(tokens)))[order]


def prefixes(texts: DataFrame) -> DataFrame:
    """token, node, n (shingles of the node), place."""
    held = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, out = batch.column(0).to_numpy(), []
            sizes = []
            for text in batch.column(1).to_pylist():
                tokens = shingles(text)
                n = len(tokens)
                out.append(ranked(tokens, *held.value)[: n - -(-PART * n // WHOLE) + 1])
                sizes.append(n)
            if out:
                some = np.array([len(x) for x in out])
                places = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
                columns = [np.concatenate(out).view(np.int64), np.repeat(nodes, some), np.repeat(sizes, some).astype(np.int32), places.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "n", "place"])

    return texts.select("node", "text").mapInArrow(releasing(run), "token long, node long, n int, place int")


def may_link(n: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes and places allow the similarity, if this is the first shingle that both hold. At that one, they do."""
    most = np.minimum(n[i] - place[i], n[j] - place[j])
    sizes = WHOLE * np.minimum(n[i], n[j]) >= PART * np.maximum(n[i], n[j])
    return sizes & ((PART + WHOLE) * most >= PART * (n[i] + n[j]))


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key; batches of whole groups of two rows or more leave."""
    held: list[pd.DataFrame] = []

    def repeated(df: pd.DataFrame) -> pd.DataFrame:
        k = df[key].to_numpy()
        same = k[1:] == k[:-1]
        return df[np.concatenate([[False], same]) | np.concatenate([same, [False]])]

    for batch in batches:
        if not len(batch):
            continue
        k = batch[key].to_numpy()
        last = int(np.searchsorted(k, k[-1]))
        if last or held and held[-1][key].iloc[-1] != k[-1]:
            yield repeated(pd.concat([*held, batch.iloc[:last]]))
            held = []
        held.append(batch.iloc[last:])
    if held:
        yield repeated(pd.concat(held))


def bounds(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return starts, np.append(starts[1:], len(key))


def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (token null, node, other): candidates. Rows with a token: crowds, of which only candidates with one text are out."""
    for df in whole_groups(batches, "token"):
        node, n, place = df["node"].to_numpy(), df["n"].to_numpy().astype(np.int64), df["place"].to_numpy().astype(np.int64)
        lo, hi = bounds(df["token"].to_numpy())
        left, right, crowds = [], [], []
        for size in np.unique(hi - lo).tolist():
            starts = lo[hi - lo == size]
            if size <= CROWD:
                i, j = np.triu_indices(size, 1)
                left.append((starts[:, None] + i).ravel())
                right.append((starts[:, None] + j).ravel())
            else:
                for s in starts.tolist():
                    rows = np.arange(s, s + size)
                    first = s + int(np.lexsort((node[rows], place[rows]))[0])
                    left.append(np.full(size, first))
                    right.append(rows)
                    crowds.append(df.iloc[s : s + size])
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            kept = may_link(n, place, i, j) & (node[i] != node[j])
            a, b = node[i[kept]], node[j[kept]]
            pairs = pd.DataFrame({"node": np.minimum(a, b), "other": np.maximum(a, b)}).drop_duplicates()
            yield pairs.assign(token=pd.array([None] * len(pairs), dtype="Int64"), n=0, place=0)[["token", "node", "n", "place", "other"]]
        for crowd in crowds:
            yield crowd.assign(other=0)[["token", "node", "n", "place", "other"]]


def apart(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Candidates of the crowds whose labels differ."""
    for df in whole_groups(batches, "token"):
        node, label, n, place = (df[c].to_numpy().astype(np.int64) for c in ("node", "label", "n", "place"))
        for lo, hi in zip(*bounds(df["token"].to_numpy())):
            for s in range(lo, hi, rows):
                i, j = np.nonzero(label[s : min(s + rows, hi), None] != label[None, s:hi])
                i, j = i + s, j + s
                kept = (i < j) & may_link(n, place, i, j)
                a, b = node[i[kept]], node[j[kept]]
                if len(a):
                    yield pd.DataFrame({"node": np.minimum(a, b), "other": np.maximum(a, b)})


def few(keys: DataFrame) -> DataFrame:
    """keys, broadcast if they are at most FEW; so texts are shuffled only to meet more."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= FEW else keys


def bitmap(tokens: np.ndarray) -> bytes:
    """A power of two of bits, four a shingle at least, of which each shingle sets one."""
    bits = max(64, 1 << (4 * len(tokens) - 1).bit_length())
    held = np.zeros(bits, dtype=np.uint8)
    held[(tokens >> np.uint64(17)) & np.uint64(bits - 1)] = 1
    return np.packbits(held, bitorder="little").tobytes()


def may_share(n: int, a: np.ndarray, m: int, b: np.ndarray) -> bool:
    """Whether bitmaps of n and m shingles allow the similarity."""
    while len(a) != len(b):
        a, b = (a, b) if len(a) < len(b) else (b, a)
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    most = (n + m - int(np.bitwise_count(a ^ b).sum())) // 2
    return WHOLE * most >= PART * (n + m - most)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def met_with(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """node, other, with what is held of each as mine_ and theirs_. A node with very many pairs is a skewed join, which AQE splits."""
    for side, prefix in (("node", "mine_"), ("other", "theirs_")):
        pairs = pairs.join(held.select(F.col("node").alias(side), *(F.col(c).alias(prefix + c) for c in held.columns if c != "node")), side)
    return pairs


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """src, dst: the pairs (node, other) whose similarity, counted whole, is SHARE or more."""
    pairs = cut(pairs.select("node", "other").filter("node != other").distinct())

    def of_texts(pairs: DataFrame, run: Callable, schema: str) -> DataFrame:
        nodes = few(pairs.select("node").union(pairs.select("other")).distinct())
        return cut(texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(releasing(run), schema).dropDuplicates(["node"]))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = map(shingles, batch.column(1).to_pylist())
            rows = [(len(x), bitmap(x)) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["node", "n", "bits"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "held"])

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst, n, a, m, b = batch.columns
            kept = [may_share(i, np.frombuffer(x.as_buffer(), np.uint8), j, np.frombuffer(y.as_buffer(), np.uint8)) for i, x, j, y in zip(n.to_pylist(), a, m.to_pylist(), b)]
            yield pa.RecordBatch.from_arrays([src, dst], names=["node", "other"]).filter(pa.array(kept, pa.bool_()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst, a, b = batch.columns
            links = []
            for x, y in zip(a, b):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = shared(x, y)
                links.append(WHOLE * both >= PART * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([src, dst], names=["src", "dst"]).filter(pa.array(links, pa.bool_()))

    first = met_with(pairs, of_texts(pairs, sketches, "node long, n long, bits binary"))
    rest = cut(first.select("node", "other", "mine_n", "mine_bits", "theirs_n", "theirs_bits").mapInArrow(releasing(allowed), "node long, other long"))
    both = met_with(rest, of_texts(rest, sets, "node long, held binary"))
    return cut(both.select("node", "other", "mine_held", "theirs_held").mapInArrow(releasing(counted), "src long, dst long"))


def by_fingerprint(texts: DataFrame, radius: int = 2) -> DataFrame:
    """node, other: texts of one fingerprint, each with the first of them, and the first ones of fingerprints that SimHash links."""
    prints = cut(texts.select("node", fingerprints(F.col("text"), WORDS).alias("fp")).distinct())
    first = cut(prints.groupBy("fp").agg(F.min("node").alias("first")))
    linked = links(first.select("fp"), radius)
    for side in ("src", "dst"):
        linked = linked.join(first.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_node")), side)
    same = prints.join(first, "fp").select("node", F.col("first").alias("other"))
    return same.unionByName(linked.select(F.col("src_node").alias("node"), F.col("dst_node").alias("other")))


def near_links(texts: DataFrame) -> DataFrame:
    """src, dst: nodes whose components are those of all pairs of texts as similar as SHARE. texts: node, text."""
    dealt = prefixes(texts).repartition("token").sortWithinPartitions("token", "node")
    found = written(dealt.mapInPandas(releasing(met), "token long, node long, n int, place int, other long"))
    near = similar(found.filter("token is null").select("node", "other").unionByName(by_fingerprint(texts)), texts)
    crowds = found.filter("token is not null").select("token", "node", "n", "place")
    if crowds.isEmpty():
        return near
    labelled = crowds.join(components(near), "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = labelled.repartition("token").sortWithinPartitions("token", "node").mapInPandas(releasing(apart), "node long, other long")
    return near.unionByName(similar(rest, texts))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component."""
    texts = docs.select(node(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    repeated = texts.groupBy("node").count().filter("count > 1").select(F.col("node").alias("src"), F.col("node").alias("dst"))
    labels = few(components(near_links(texts).unionByName(repeated)).select(F.col("node").alias("_node"), F.col("label").alias("_label")))
    rows = docs.withColumn("_node", node(F.col(text_col)))
    rank = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("_node").alias("node"))
    least = few(rows.select(id_col, "_node").join(labels, "_node").groupBy("_label").agg(F.min(rank).alias("_least")).select(F.col("_least.node").alias("_node"), F.col("_least.id").alias("_least")))
    won = rows.join(least, "_node").filter(F.col(id_col).eqNullSafe(F.col("_least")))
    won = won.withColumn("_row", F.row_number().over(Window.partitionBy("_node").orderBy(id_col))).filter("_row = 1")
    alone = rows.join(labels, "_node", "left_anti")
    return alone.select(docs.columns).unionByName(won.select(docs.columns))
