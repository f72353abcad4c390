import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tabulore.llm import doubling
from tabulore.llm import suffix_dedup as module
from tabulore.llm.suffix_dedup import suffix_dedup


def brute_force(rows, length=100):
    """rows in the order of documents."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = [True] * length
            seen.add(window)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def corpus(seed, docs=60):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(draw.randrange(15, 60)) for _ in range(4)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            kind = draw.randrange(6)
            if kind < 2:
                parts.append(prose(draw.randrange(3, 60)))
            elif kind == 2:
                parts.append(draw.choice(shared))
            elif kind == 3:
                whole = draw.choice(shared)
                lo = draw.randrange(len(whole) // 2)
                parts.append(whole[lo : lo + draw.randrange(80, 200)])
            elif kind == 4 and rows:
                parts.append(draw.choice(rows)[1] or "")
            else:
                parts.append(draw.choice(["ab ", "x", "und "]) * draw.randrange(1, 130))
        rows.append((i * 3, draw.choice(["", " ", "\n"]).join(parts)))
    return rows + [(1000, None), (1001, ""), (1002, "z" * 100), (1003, "z" * 99), (1004, "z" * 101)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter(tuple(r) for r in suffix_dedup(docs).collect())
    assert got == brute_force(rows)


@pytest.mark.parametrize("crowd", [5, 1000])
def test_small_steps_and_salted_anchors(monkeypatch, crowd):
    """Where texts are looked at in short reaches, tasks combine little, and most k-mers are salted."""
    rows = corpus(3, 25)
    for name, value in (("REACH", 64), ("AT_ONCE", 40), ("SALT_FROM", 1), ("SALTS", 3), ("CROWD", crowd)):
        monkeypatch.setattr(module, name, value)
    batches = lambda f, given: list(f(iter(given)))
    texts = pa.RecordBatch.from_pydict({"doc": [d for d, _ in rows], "text": [t or "" for _, t in rows]})
    table = pa.Table.from_batches(batches(module.anchored(28), [texts.slice(0, 10), texts.slice(10)])).sort_by([(c, "ascending") for c in ("group", "stretch", "pos")])
    runs = pa.Table.from_batches(batches(module.sorted_out, table.to_batches(max_chunksize=17))).to_pylist()
    data = {d: (t or "").encode() for d, t in rows}
    windows = lambda rs: [(r["pos"] >> 28, (r["pos"] & (1 << 28) - 1) + k) for r in rs for k in range(r["n"])]
    at = lambda w: data[w[0]][w[1] : w[1] + 100]
    closed, opened = windows([r for r in runs if r["repeat"]]), windows([r for r in runs if not r["repeat"]])
    first, every = {}, Counter()
    for d in sorted(data):
        for p in range(len(data[d]) - 99):
            first.setdefault(at((d, p)), (d, p))
            every[at((d, p))] += 1
    assert all(first[at(w)] < w for w in closed)
    repeats = {(d, p) for d in data for p in range(len(data[d]) - 99) if first[data[d][p : p + 100]] < (d, p)}
    assert repeats <= set(closed) | set(opened)
    assert {first[at(w)] for w in repeats - set(closed)} <= set(opened)


def test_ids_that_must_be_numbered(spark):
    rows = corpus(4, 20)
    odd = [(None, rows[0][1]), (-5, rows[1][1]), *((d << 40, t) for d, t in rows)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in suffix_dedup(docs).collect()) == brute_force(odd)
    twice = [(7, "q" * 150 + "w"), (7, "q" * 150 + "w"), (8, "other")]
    got = sorted(r.n_removed for r in suffix_dedup(spark.createDataFrame(twice, "doc_id long, text string")).collect())
    assert got[0] == 0 and got[2] == 151
    names = spark.createDataFrame([("b", "k" * 100), ("a", "k" * 100), (None, "n")], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in suffix_dedup(names).collect()} == {"a": 0, "b": 100, None: 0}
    assert suffix_dedup(docs.limit(0)).count() == 0
    assert suffix_dedup(docs.withColumn("doc", F.lit(1)).withColumn("runs", F.lit(2))).count() == len(odd)


def test_first_ranks_are_xxh64():
    data = random.Random(5).randbytes(500)
    words = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    at = np.arange(len(data) - 31)
    assert doubling.xxh64(words, at).tolist() == [xxhash.xxh64_intdigest(data[p : p + 32]) for p in at]


def test_offsets_grow_to_the_threshold():
    assert doubling.steps(32, 100) == [32, 36] and doubling.steps(13, 100) == [13, 26, 48]
    assert doubling.offsets(0) == [0, 32, 36, 68] and doubling.offsets(1) == [0, 36] and doubling.offsets(2) == [0]


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_reranking_over_batches(size):
    """Each class of equal pairs gets one rank, unless it is alone."""
    draw = random.Random(size)
    rows = sorted((draw.randrange(4), draw.randrange(6), (draw.randrange(3) << 21) + (i << 1) + (draw.random() < 0.1)) for i in range(60))
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("one", "two", "id"))})
    got = {}
    for batch in doubling.ranked(iter(table.to_batches(max_chunksize=size)), 7):
        for row in batch.to_pylist():
            which, rank = np.frombuffer(row["which"], "<i4"), np.frombuffer(row["rank"], "<i8")
            got |= {(row["block"] << 20) + int(w): int(r) for w, r in zip(which, rank)}
    seen = Counter((a, b) for a, b, _ in rows)
    alive = [r for r in rows if seen[r[:2]] > 1 or r[2] & 1]
    assert set(got) == {i >> 1 for _, _, i in alive}
    assert len({got[i >> 1] for _, _, i in alive}) == len({r[:2] for r in alive})
    assert len({(got[r[2] >> 1], r[:2]) for r in alive}) == len({r[:2] for r in alive})


def test_hot_passage_over_many_partitions(spark, monkeypatch):
    """A passage that a third of all documents hold, in small blocks and with other bytes at its ends."""
    draw = random.Random(9)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(240))
    text = lambda i: f"{draw.random()}" + (passage[draw.randrange(60) : 180 + draw.randrange(60)] if i % 3 == 0 else "".join(draw.choice("xyz ") for _ in range(150))) + f"{draw.random()}"
    rows = [(i, text(i)) for i in range(600)]
    monkeypatch.setattr(module, "SALT_FROM", 4)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
        assert Counter(tuple(r) for r in suffix_dedup(docs).collect()) == brute_force(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_text_that_is_cut_into_blocks():
    """Blocks of few windows know as much of one another as whole texts do."""
    text = "".join(random.Random(2).choice("ab") * 9 for _ in range(60))
    texts = pa.RecordBatch.from_arrays([pa.array([3, 5]), pa.array([text, "x" + text]), pa.array([[{"at": 0, "n": 300}, {"at": 100, "n": 250}], [{"at": 1, "n": 400}]], pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))], names=["doc", "text", "runs"])
    states = list(doubling.blocks(20)(iter([texts])))
    at = np.concatenate([np.cumsum(np.frombuffer(s.column(1)[0].as_buffer(), "<i8")) for s in states])
    assert at.tolist() == [(3 << 20) + p for p in range(350)] + [(5 << 20) + p for p in range(1, 401)]
