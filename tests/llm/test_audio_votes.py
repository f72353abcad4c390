"""Votes of all places, and recall of planted excerpts."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulore.llm import audio_fingerprint as audio


def noise(seed, n):
    return np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8)


def slow_votes(a, b):
    return Counter(i - j for i, x in enumerate(a) for j, y in enumerate(b) if x == y)


@pytest.mark.parametrize("at_once", [3, 1 << 22])
def test_all_places_vote(at_once):
    draw = np.random.default_rng(1)
    for kinds, n, m in ((5, 40, 30), (50, 40, 60), (2, 9, 1), (1, 200, 300), (10**6, 20, 20)):
        a, b = (draw.integers(0, kinds, k).astype(np.uint32) for k in (n, m))
        got = audio.votes(audio.by_code(a), audio.by_code(b), at_once)
        want = slow_votes(a.tolist(), b.tolist())
        assert len(got) == n + m - 1 and {k - m + 1: int(v) for k, v in enumerate(got) if v} == want


def test_votes_of_integers_that_repeat_a_lot():
    a = np.array([7] * 9000 + [1, 2, 3] + [7] * 3000, dtype=np.uint32)
    b = np.array([5] + [7] * 6000 + [1, 2, 3], dtype=np.uint32)
    got = audio.votes(audio.by_code(a), audio.by_code(b))
    seen = lambda x, y, k: sum(int(((a[max(0, k) :][: min(len(a) - max(0, k), len(b) - max(0, -k))]) == (b[max(0, -k) :][: min(len(a) - max(0, k), len(b) - max(0, -k))])).sum()) for _ in (0,))
    for k in (-6000, -1, 0, 1, 2999, 8999, 12_002):
        assert got[k + len(b) - 1] == seen(a, b, k)


def test_stretches_give_what_the_whole_gives():
    samples = noise(4, 20_000)
    assert (audio.codes(samples, 17) == audio.codes(samples)).all() and len(audio.codes(samples)) == 302


def test_periodic_recordings_align_where_most_agrees(spark):
    """The integers of the excerpt occur before it too, so first places alone would vote for another offset."""
    loop = np.tile(noise(1, 640), 10)
    recording = np.concatenate([loop, noise(2, 6400), loop, noise(3, 6400)])
    query = np.concatenate([loop, noise(3, 6400)])
    rows = [(1, recording.tobytes()), (50, query.tobytes())]
    got = {r.doc_id: r for r in audio.align(spark.createDataFrame(rows, "doc_id long, media binary"), F.col("id") == 50, media=F.col("media")).collect()}
    assert (got[1].match_id, got[1].offset) == (50, (6400 + 6400) // 64) and got[1].bit_error < 0.02


def test_recall_of_planted_excerpts(spark):
    """Excerpts on the grid, with noise in a tenth of their samples or none, among other recordings."""
    rows, planted = [], set()
    for i in range(40):
        base = noise(100 + i, 12_000)
        rows.append((50 * i, base.tobytes()))
        cut = base[64 * (3 + i % 40) :][: 5000 + 50 * i].copy()
        if i % 2:
            at = np.random.default_rng(i).choice(len(cut), len(cut) // 400, replace=False)
            cut[at] = 128
        rows.append((50 * i + 7, np.concatenate([noise(900 + i, 64 * (i % 9)), cut]).tobytes()))
        planted.add((50 * i, 50 * i + 7, i % 9 - (3 + i % 40)))
    recordings = spark.createDataFrame(rows, "doc_id long, media binary").repartition(3)
    is_query = F.col("id") % 50 == 0
    for block_codes, nodes in ((2_000_000, 40_000), (500, 5)):
        aligned = audio.align_all(recordings, is_query, media=F.col("media"), block_codes=block_codes, nodes_a_task=nodes)
        found = {(r.query_id, r.doc_id, r.offset) for r in audio.pairs(aligned, is_query).collect()}
        print(f"{len(planted & found)} of {len(planted)} planted excerpts")
        assert len(planted & found) >= 0.9 * len(planted)
