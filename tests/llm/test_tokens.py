import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabulore.llm import token_file
from tabulore.llm.packing import balance, pack, powers_of_two
from tabulore.llm.tokens import Encoder, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "a  b \n c\n\nd  ", " \n x", "don't  stop's\t\tx", "　 y \x1c z\x1c w\n é", "tab\t x\n\n  y", "THE!! a*** $$$ 12 345", "word " * 3000, "wörter ça ñ " * 300, "\n \n  \n", "x\n", "<|endoftext|> at the start", "in <|endoftext|> the middle", "at the end <|endoftext|>", "<|endoftext|><|endoftext|>", "<| endoftext|>"]


def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\r\x0b\x1c\x85  aébZ'stve12,.!|_²"), max_size=40), max_size=8))
def test_encoder_equals_library(texts):
    ids, lengths = encoder(PATH).encode(texts)
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [x for w in want for x in w]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "  ", "\n", "\u2003", "\u00a0", "\u3000", "\x85", "word", "Ünï", "don't", "x,y", "end.", '")', "!?", "7", "<|endoftext|>", "it's.", "\u0300", "日本", "\U0001f600"]), max_size=12).map("".join), max_size=8))
def test_encoder_equals_library_on_words(texts):
    ids, lengths = encoder(PATH).encode(texts)
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [x for w in want for x in w]


def test_encoder_equals_library_on_documents(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    ids, lengths = Encoder(PATH, most_pretokens=500).encode(texts)
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_encoder_forgets_within_bounds():
    small, texts = Encoder(PATH, most_pretokens=3), [t or "" for t in TEXTS]
    for _ in range(3):
        ids, _ = small.encode(texts)
        assert ids.tolist() == [x for e in library().encode_batch(texts, add_special_tokens=False) for x in e.ids]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 50256), st.integers(0, 2**60 - 1), st.integers(2**60, 2**64 - 1)), max_size=3000), st.integers(0, 3))
def test_words_round_trip(ids, times):
    ids = np.array(ids * (times + 1), dtype=np.uint64)
    words, first, count, escaped = token_file.encode(ids)
    assert token_file.decode(words, first, count, escaped).tolist() == ids.tolist()


def test_words_of_small_ids_are_dense():
    assert len(token_file.encode(np.zeros(1024, dtype=np.uint64))[0]) <= 9
    assert len(token_file.encode(np.ones(1020, dtype=np.uint64))[0]) <= 17


@pytest.fixture
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "again", "y"), (3, "again", "y"), (None, "no id", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


def expected(rows):
    out = []
    for doc_id, text, *_ in rows:
        ids = np.array([*library().encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((doc_id, text, ids))
    return out


def test_files_round_trip(spark, docs, tmp_path):
    manifest = token_file.write_tokens(docs, PATH, f"file://{tmp_path}/t")
    got = token_file.read_tokens(spark, manifest).collect()
    want = expected(docs.collect())
    assert sorted((r.doc_id is not None, r.doc_id, len_, crc) for r in got for len_, crc in [(r.n_tokens, r.ids_crc32)]) == sorted((d is not None, d, len(i), zlib.crc32(i.tobytes())) for d, _, i in want)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)


def test_no_files_of_no_documents(spark, docs, tmp_path):
    manifest = token_file.write_tokens(docs.limit(0), PATH, f"file://{tmp_path}/e")
    assert manifest == [] and token_file.read_tokens(spark, manifest).count() == 0


@pytest.mark.parametrize("window", [50, 3000, 1 << 22])
def test_pack(docs, window):
    got = pack(docs, PATH, window=window).collect()
    want = {}
    for d, _, i in expected(docs.collect()):
        want.setdefault((d, len(i)), []).append(i)
    cover, sequences = {}, {}
    for r in got:
        assert any(zlib.crc32(i[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for i in want[(r.doc_id, r.doc_tokens)])
        cover.setdefault((r.doc_id, r.doc_tokens), []).extend(range(r.start, r.start + r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key, i in want.items():
        assert sorted(cover[key]) == sorted(list(range(key[1])) * len(i))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    assert pack(docs.limit(0), PATH).count() == 0


def test_balance_takes_the_cheapest_that_fits():
    rests = [(0, 0, 900), (1, 0, 600), (2, 0, 424), (3, 0, 124)]
    filled, left = balance(rests, 1024, 1024)
    assert sorted(sum(n for _, _, n in s) for s in filled) == [1024, 1024] and left == []
    assert [(0, 0, 900), (3, 0, 124)] in filled
    assert [sum(n for _, _, n in s) for s in powers_of_two([(0, 0, 500), (1, 0, 200)])] == [512, 128, 32, 16, 8, 4]
