import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulore.llm import near_copies


def slow_sets(texts):
    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return out


def kept_by_brute_force(rows):
    """Every pair of rows that share a shingle is compared."""
    sets, root, held = slow_sets(t for _, t in rows), list(range(len(rows))), defaultdict(list)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for shared in s:
            held[shared].append(i)
    seen = set()
    for group in held.values():
        for n, i in enumerate(group):
            for j in group[:n]:
                if (j, i) not in seen and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    root[top(i)] = top(j)
                seen.add((j, i))
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[top(i)].append((d is None, d))
    return Counter(min(g)[1] for g in groups.values())


@pytest.mark.parametrize("crowd", [64, 2])
def test_near_copies_match_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    draw = random.Random(4)
    texts = [None, "", " ", "two words", "Two  WORDS", "other words", "a b c d e", "a b c d e f"]
    licence = " ".join(f"common{k}" for k in range(30))
    for _ in range(25):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([12, 60, 200]))]
        for _ in range(draw.choice([1, 2, 7])):
            words = list(words)
            for _ in range(draw.randrange(4)):
                words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
            texts.append(" ".join(words + [licence] * draw.choice([0, 1])))
    rows = [(d, t) for d, t in zip(draw.sample(range(1000), len(texts)), texts)]
    rows += [(None, rows[20][1]), (None, "only here without an id"), (2001, "said twice"), (2001, "said twice")]
    want = kept_by_brute_force(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == want
    assert 30 < len(want) < len(rows) - 15


def test_stage_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(kept_by_brute_force(rows)) and not {56, 255} & kept
