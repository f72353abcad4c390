import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tabulore.llm import audio_fingerprint as audio
from tabulore.llm.queries import TOKENIZER
from tests.llm.test_near_copies import kept_by_brute_force

SF = "/root/testdata/sf0.001"


def noise(seed, n):
    return np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8)


def slow_codes(samples):
    frames = [samples[i : i + audio.FRAME] for i in range(0, len(samples) - audio.FRAME + 1, audio.HOP)]
    raw = [(np.abs(np.fft.rfft((f.astype(np.float32) - 128) * audio.WINDOW)) ** 2) @ audio.FOLD for f in frames]
    image = []
    for i in range(len(raw)):
        row = sum(raw[j] for j in (i - 1, i, i + 1) if 0 <= j < len(raw)).astype(float)
        norm = np.sqrt((row**2).sum())
        image.append(row / norm if norm > 1e-3 else row * 0)
    out = []
    for p in range(len(image) - audio.WIDTH + 1):
        code = 0
        for bounds, (kind, y, h, w) in zip(audio.levels(), audio.FILTERS):
            a, b = audio.compared(lambda t, y, w, h: sum(image[p + i][j] for i in range(t, t + w) for j in range(y, y + h)), kind, y, h, w)
            v = round(float(np.log((1 + a) / (1 + b))), 6)
            code = code << 2 | {0: 0, 1: 1, 2: 3, 3: 2}[sum(v > x for x in bounds)]
        out.append(code)
    return out


def test_codes_match_brute_force():
    for n in (0, 100, 256, 703, 704, 3000):
        got, want = audio.codes(noise(n, n)), slow_codes(noise(n, n))
        assert len(got) == len(want)
        assert sum(bin(int(a) ^ b).count("1") for a, b in zip(got, want)) <= 0.01 * 32 * max(1, len(want))
    assert len(audio.codes(noise(1, 704))) == 1
    long = noise(3, 9000)
    assert (audio.codes(long[64 * 20 :])[2:] == audio.codes(long)[22:]).all()


def test_align(spark):
    base = noise(1, 20_000).tobytes()
    rows = [(50, base), (1, base), (2, base[64 * 50 : 12_000]), (3, noise(2, 200).tobytes() * 3 + base[:9000]), (4, noise(9, 9000).tobytes()), (100, noise(9, 9000).tobytes()), (5, None), (6, b""), (None, base), (7, b"\0" * 9000), (1, base), (150, base)]
    recordings = spark.createDataFrame(rows, "doc_id long, media binary")
    for block_codes in (2_000_000, 200):
        got = audio.align(recordings, F.col("id") % 50 == 0, media=F.col("media"), block_codes=block_codes).collect()
        by = defaultdict(list)
        for r in got:
            by[r.doc_id].append(r)
        assert len(got) == len(rows) and len(by[1]) == 2 and by[1][0] == by[1][1]
        assert (by[1][0].match_id, by[1][0].offset, by[1][0].bit_error) == (50, 0, 0.0) == (by[None][0].match_id, by[None][0].offset, by[None][0].bit_error)
        assert (by[2][0].match_id, by[2][0].offset) == (50, -50) and by[2][0].bit_error < 0.05
        assert by[4][0].match_id == 100 and by[100][0].votes == 0 and by[50][0].match_id == 150 and by[150][0].match_id == 50
        assert by[5][0].n_codes == by[6][0].n_codes == 0 and by[5][0].match_id is None
    assert audio.align(recordings.limit(0), F.col("id") % 50 == 0, media=F.col("media")).count() == 0


def test_recall_of_alignments(spark):
    """Brute force: every query against every recording at every offset; pairs that agree on 8 places or more."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("media"))
    rows = {r.doc_id: audio.codes(np.frombuffer(r.media, dtype=np.uint8)) for r in docs.collect()}
    every = F.col("id") % 5 == 0  # more queries than in production, for more cases
    got = {r.doc_id: r for r in audio.align(docs, every, media=F.col("media")).collect()}
    close = found = 0
    for d, mine in rows.items():
        best = 1.0
        for q, theirs in rows.items():
            if q % 5 or q == d:
                continue
            for shift in range(8 - len(theirs), len(mine) - 7):
                a, b = mine[max(0, shift) :], theirs[max(0, -shift) :]
                m = min(len(a), len(b))
                if m >= 8:
                    best = min(best, np.bitwise_count(a[:m] ^ b[:m]).sum() / (32 * m))
        if best <= 0.1:
            close += 1
            found += got[d].match_id is not None and got[d].bit_error <= 0.1
    assert close >= 2 and found >= 0.9 * close


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9001, None, "en", None, 0), (9002, "123 !!", "en", "src1", 6), (9003, "", None, None, 0), (9004, "The end of the tion, and the ther.", None, None, 5), (9004, "The end of the tion, and the ther.", None, None, 5)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs.write.parquet(str(tmp_path / "0"))
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k + 1)))
        kept.append(spark.read.parquet(str(tmp_path / str(k + 1))).cache())
    before = spark.read.parquet(str(tmp_path / "0")).collect()
    language, exact, near, mixed, packed = kept
    gone = {r.doc_id for r in before} - {r.doc_id for r in language.collect()}
    assert {9001, 9002, 9003} <= gone and len(gone) <= 0.02 * len(before) + 3
    said = {r.doc_id: r.lang for r in before}
    assert sum(r.lang == said[r.doc_id] for r in language.collect() if said[r.doc_id]) >= 0.97 * language.count()
    best = {}
    for r in language.collect():
        key, rank = re.sub(r"[\x20\x09-\x0D]+", "", r.text), (-len(r.text), r.doc_id)
        best[key] = min(best.get(key, rank), rank)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(d for _, d in best.values())
    assert Counter(r.doc_id for r in near.collect()) == kept_by_brute_force([(r.doc_id, r.text) for r in exact.collect()])
    rows = {r.doc_id: r for r in near.collect()}
    n = Counter(r.doc_id for r in mixed.collect())
    assert max(n.values()) <= 3 and len(n) > 0.5 * near.count()
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    sources = sorted({r.source for r in rows.values()}, key=lambda s: (s is None, s))
    sizes = [sum(size(r) for r in rows.values() if r.source == s) for s in sources]
    total, aims, free = sum(sizes), {}, set(range(len(sources)))
    while free:  # shares by weight; what is over three times a source is shared again
        rest = total - sum(aims.values())
        share = {i: rest * (5, 2, 1)[i % 3] / sum((5, 2, 1)[j % 3] for j in free) for i in free}
        over = {i for i in free if share[i] > 3 * sizes[i]}
        aims |= {i: 3 * sizes[i] for i in over} if over else share
        free = free - over if over else set()
    for i, s in enumerate(sources):
        taken = sum(size(rows[d]) * k for d, k in n.items() if rows[d].source == s)
        assert taken == pytest.approx(aims[i], rel=0.05, abs=100)  # of ten documents each
    library, pieces = Tokenizer.from_file(TOKENIZER), defaultdict(list)
    for r in packed.collect():
        ids = np.array([*library.encode(rows[r.doc_id].text, add_special_tokens=False).ids, 0], dtype="<u4")
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces[r.doc_id] += range(r.start, r.start + r.length)
    assert {d: Counter(p) for d, p in pieces.items()} == {d: Counter(dict.fromkeys(range(len(set(pieces[d]))), k)) for d, k in n.items()}
    assert {d: t for d, t in packed.groupBy("doc_id").agg(F.count(F.when(F.col("start") == 0, 1))).collect()} == dict(n)


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, SF).count() == 0


def test_mixing_goes_by_row(spark):
    """Rows that share an id have copies of their own; rows that repeat id and text share theirs."""
    rows = [(1, "a b c", "s"), (1, "other words here and there", "s"), (2, "x", "t"), (2, "x", "t"), (2, "x", "t"), (None, "no id", None), (3, None, "s")]
    rows += [(i, "w " * (i % 9), "s") for i in range(10, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    total, size = Counter(), Counter()
    for d, t, s in rows:
        total[s] += len((t or "").split())
    for r in got:
        size[r.source] += len((r.text or "").split())
    assert max(Counter((r.doc_id, r.text) for r in got if r.doc_id == 1).values()) <= 3 and size["t"] == 3 * 3 and size[None] == 3 * 2
    assert abs(size["s"] - (sum(total.values()) - 9 - 6)) <= 9


def test_run_leaves_only_what_its_result_reads(spark, tmp_path):
    got = corpus_pipeline.run(spark, SF)
    folder = got.select("doc_id").inputFiles()[0].rsplit("/", 2)[0].replace("file://", "")
    assert got.count() > 0 and sorted(p.name for p in __import__("pathlib").Path(folder).iterdir()) == ["mixing"]
