import numpy as np
from pyspark.sql import functions as F

from tabulore.llm import audio_fingerprint as audio
from tabulore.llm.queries import op2_audio_fingerprint


def noise(seed, n):
    return np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8).tobytes()


def pairs_by_brute_force(rows, is_query):
    """Every query against every recording with another id: those that share an integer."""
    codes = [(d, set(audio.codes(np.frombuffer(m or b"", dtype=np.uint8)).tolist())) for d, m in rows]
    return {(q, d) for q, a in codes if q is not None and is_query(q) for d, b in codes if d != q and a & b}


def test_every_pair_is_reported(spark):
    one, two = noise(1, 9000), noise(2, 9000)
    rows = [(50, one), (100, two), (1, one[:6400] + two), (150, one), (200, one), (3, one), (4, two[640:]), (5, noise(5, 9000)), (6, None), (None, two), (3, one), (250, noise(7, 9000)), (300, one[:4480] + two[:4480])]
    recordings = spark.createDataFrame(rows, "doc_id long, media binary").repartition(3)
    is_query = F.col("id") % 50 == 0
    want = pairs_by_brute_force(rows, lambda q: q % 50 == 0)
    assert {(50, 1), (100, 1), (150, 3), (200, 3), (150, 50), (50, 150), (300, 1), (1, 50)} - want == {(1, 50)}
    for block_codes in (2_000_000, 200):
        got = audio.align_all(recordings, is_query, media=F.col("media"), block_codes=block_codes)
        found = audio.pairs(got, is_query).collect()
        assert {(r.query_id, r.doc_id) for r in found} == want
        shift = {(r.query_id, r.doc_id): r.offset for r in found}
        assert (shift[50, 1], shift[100, 1], shift[100, 4], shift[150, 50]) == (0, 100, -10, 0)
        alone = {r.doc_id: r for r in got.filter("match_id is null").collect()}
        assert set(alone) == {5, 6, 250} and alone[250].class_id == 250 and alone[5].class_id is None and alone[6].votes == 0
    assert audio.align_all(recordings.limit(0), is_query, media=F.col("media")).count() == 0


def test_rows_of_equal_recordings_are_not_squared(spark):
    recordings = spark.createDataFrame([(i, noise(1, 2000)) for i in range(400)], "doc_id long, media binary")
    got = audio.align_all(recordings, F.col("id") % 50 == 0, media=F.col("media"))
    assert got.count() == 400 and audio.pairs(got, F.col("id") % 50 == 0).count() == 8 * 399


def test_query_gives_every_pair(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("text").cast("binary"))
    want = pairs_by_brute_force([tuple(r) for r in docs.collect()], lambda q: q % 50 == 0)
    got = audio.pairs(op2_audio_fingerprint(spark, "/root/testdata/sf0.01"), F.col("id") % 50 == 0)
    assert {(r.query_id, r.doc_id) for r in got.collect()} == want and len(want) >= 8
