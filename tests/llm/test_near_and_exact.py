import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabulore.llm import common, simhash
from tabulore.llm.common import lookup
from tabulore.llm.components import components
from tabulore.llm.exact_dedup import drop_copies, exact_dedup
from tabulore.llm.simhash import simhash_groups

SPACE = " \t\n\x0b\x0c\r"


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(nodes, near):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in near:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints():
    for text in [None, "", " \n", "one", "One TWO", "a b c", "a b c a b c a b c", "É é\x85x \x1c y z \x0b q", "w " * 500]:
        assert simhash.fingerprint(text or "") == slow_fingerprint(text)
    text = " ".join(str(i % 97) for i in range(1000))
    assert simhash.fingerprint(text, at_once=7) == slow_fingerprint(text)


@pytest.mark.parametrize("tile", [4096, 8])
def test_links_match_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    draw = random.Random(5)
    prints = {0, 1, 3, 2**64 - 1}
    for _ in range(150):
        fp = draw.getrandbits(64)
        prints.add(fp)
        for _ in range(draw.choice([0, 0, 1, 6])):
            for b in draw.sample(range(64), draw.choice([1, 2, 2, 3])):
                fp ^= 1 << b
            prints.add(fp)
    prints = sorted(prints)
    near = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 2]
    want = least_reachable([p - (1 << 64) if p >> 63 else p for p in prints], [(a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b) for a, b in near])
    distinct = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    got = {r.node: r.label for r in components(simhash.links(distinct, 2)).collect()}
    assert {n: got.get(n, n) for n in want} == want
    assert len(near) > 150


def test_groups(spark):
    draw = random.Random(1)
    rows, base = [], [" ".join(draw.choice("abcdefghij") + str(draw.randrange(50)) for _ in range(300)) for _ in range(12)]
    for i, text in enumerate(base):
        for k in range(draw.choice([1, 3])):
            words = text.split()
            if k:
                words[draw.randrange(len(words))] = "changed"
            rows.append((len(rows) * 7 % 101, " ".join(words), "x"))
    rows += [(200, None, None), (201, "", "y"), (None, "  ", "z"), (203, "two words", "z"), (203, "two words", "z"), (None, "alone here today", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash_groups(docs).collect()
    assert Counter((r.doc_id, r.fingerprint % 2**64) for r in got) == Counter((d, slow_fingerprint(t)) for d, t, _ in rows)
    fps = {slow_fingerprint(t) for _, t, _ in rows}
    root = least_reachable(fps, [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 2])
    least = defaultdict(list)
    for d, t, _ in rows:
        if d is not None:
            least[root[slow_fingerprint(t)]].append(d)
    for r in got:
        assert r.component_id == min(least[root[r.fingerprint % 2**64]], default=None)
    assert simhash_groups(docs.limit(0)).count() == 0


def test_components_of_a_path_a_star_and_a_loop(spark):
    path = list(range(100, 160))
    random.Random(3).shuffle(path)
    links = list(zip(path, path[1:])) + [(5, i) for i in range(6, 40)] + [(70, 70), (3, 4), (4, 3), (3, 4)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert all(got[n] == 100 for n in path) and all(got[i] == 5 for i in range(5, 40)) and got[70] == 70 and got[3] == got[4] == 3
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_lookup_splits_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_FREQUENT", 4)
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)] + [(99, "none")], "i long, k string")
    small = big.filter("k <> 'none'").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("v"))
    got = lookup(big, small, "k", "n").collect()
    assert len(got) == 61 and {r.i: r.v for r in got}[99] is None and {r.v for r in got if r.k == "hot"} == {1}


def exact_brute_force(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups["".join(c for c in t or "" if c not in SPACE)].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: m[:3])
        sha = hashlib.sha256(text.encode()).digest()
        out += [(m[3], members[0][3], len(members), i == 0, sha) for i, m in enumerate(members)]
    return Counter(out)


@pytest.mark.parametrize("one_in", [512, 4])
def test_exact_dedup(spark, one_in, monkeypatch):
    import tabulore.llm.exact_dedup as module

    monkeypatch.setattr(common, "LEAST_FREQUENT", one_in)
    rows = [(i, "hot te xt" + " " * (i % 5)) for i in range(40)] + [(100, None), (101, ""), (102, " \x0b"), (103, "\x1c"), (104, "é  a"), (105, "éa"), (None, "é a"), (None, "alone")]
    rows += [(200, "same"), (200, "same"), (4, "hot te xt    "), (4, "hot te xt    "), (201, "x" * 100_000), (202, "x" * 100_000 + "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = exact_dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in got) == exact_brute_force(rows)
    heavy = {bytes(r.digest): r.group_size for r in module.heavy_winners(docs.select(F.unhex(F.sha2(module.normalised(F.col("text")), 256)).alias("digest"), F.struct(F.lit(0)).alias("rank"))).collect()}
    assert max(heavy.values()) == 42
    clash = docs.withColumns({"kept": F.lit("mine"), "digest": F.lit(1), "other": F.col("doc_id") * 2, "_id": F.lit(3)})
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in exact_dedup(clash).collect()) == exact_brute_force(rows)
    assert exact_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_copies_are_dropped_by_row(spark, few, monkeypatch):
    """Rows that share an id are judged by their own texts; of rows that repeat everything one stays."""
    import tabulore.llm.exact_dedup as module

    monkeypatch.setattr(module, "FEW", few)
    rows = [(3, "A"), (7, " A"), (7, "other text"), (8, "A"), (9, "twice"), (9, "twice"), (9, "twi ce"), (10, "twice"), (None, "no id"), (None, "no id"), (11, None), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit("x")).repartition(4)
    got = drop_copies(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(7, " A"), (7, "other text"), (9, "twi ce"), (None, "no id"), (11, None)])
    assert drop_copies(docs.limit(0)).count() == 0


def test_what_is_frequent_follows_the_rows():
    assert [common.frequent_one_in(n) for n in (0, 10**6, 10**9, 5 * 10**10)] == [512, 512, 1000, 10_000]
