r"""Whole texts to token ids, in numpy and Arrow.

A byte-level tokenizer cuts a text into pretokens by one fixed pattern and encodes each by itself; no pretoken joins
a blank with what stands before it. So a text may be cut before any blank that follows something other than white
space, and the ids of the pieces follow one another as the whole text's would. The pieces of a batch are offsets into its
text, whose distinct ones Arrow numbers. A piece is a word, a word with marks behind it, or is cut into pretokens by the
pattern; each distinct pretoken that the bounded cache lacks is encoded once by the tokenizers library's model. A tokenizer of
another kind, and a text with the string of an added token, such as <|endoftext|>, goes to the library whole.
"""

from __future__ import annotations

import gc
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, compress, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Fixed value: the pattern of byte-level pre-tokenizers.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
END = "\n"
#: Marks that are one pretoken behind a word, as many as stand there.
MARKS = ".,;:!?\")]"
#: Bytes that are white space, and bytes that end such a character of several bytes, behind the byte before.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
MAY_BE_SPACE_BEHIND = np.isin(np.arange(256), [0xC2, 0x80, 0x81, 0x9A])
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if it is a visible Latin-1 one, else the next from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in visible else chr(next(others)) for b in range(256)}


class Ids:
    """A growing array of ids with the place of each entry."""

    def __init__(self) -> None:
        self.ids, self.n_ids, self.n = np.empty(1 << 18, dtype=np.uint32), 0, 0
        self.start, self.length = np.empty(1 << 16, dtype=np.int64), np.empty(1 << 16, dtype=np.int64)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        at, size = self.n, self.n_ids + len(flat)
        if size > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.empty(2 * size - self.n_ids, dtype=np.uint32)])
        if at + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate([x[:at], np.empty(at + 2 * len(lengths), dtype=np.int64)]) for x in (self.start, self.length))
        self.ids[self.n_ids : size] = flat
        self.length[at : at + len(lengths)] = lengths
        self.start[at : at + len(lengths)] = self.n_ids + np.cumsum(lengths) - lengths
        self.n_ids, self.n = size, at + len(lengths)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these entries one after the other, and how many each has."""
        return gathered(self.ids, self.start[codes], self.length[codes])


def gathered(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(start - (ends - length), length) + np.arange(total)], length


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    def __init__(self, path: str, most_pretokens: int = 350_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        pre = parts.get("pre_tokenizer") or {}
        self.by_piece = parts.get("normalizer") is None and parts["model"]["type"] == "BPE" and all(pre.get(k) == v for k, v in PRE_TOKENIZER.items())
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.most_pretokens = most_pretokens
        characters = byte_characters()
        self.character = np.array([ord(characters[b]) for b in range(256)], dtype="<u2")
        self.forget()

    def forget(self) -> None:
        """Empty the cache; a task does so at its end, for what its worker runs next."""
        self.pretoken_at: dict[str, int] = {"": 0, END: 1}
        self.pretokens = Ids()
        if self.by_piece:
            end = [t.id for t in self.library.model.tokenize(*self._spelled([END]))]
            self.pretokens.add(np.array(end, dtype=np.uint32), np.array([0, len(end)]))

    def _spelled(self, pretokens: list[str]) -> list[str]:
        """With a character for each byte."""
        between = chr(self.character[0xFF])  # no byte of UTF-8; the escape below stands for it
        data = np.frombuffer("\udcff".join(pretokens).encode("utf-8", "surrogateescape"), dtype=np.uint8)
        return self.character[data].tobytes().decode("utf-16-le").split(between)

    def _codes(self, found: list[str], at_once: int = 4096) -> np.ndarray:
        """The entries of pretokens."""
        codes = np.array(list(map(self.pretoken_at.get, found, repeat(-1))), dtype=np.int64)
        missed = np.flatnonzero(codes < 0).tolist()
        if missed:
            again = [found[i] for i in missed]
            new, tokenize, id_of = list(dict.fromkeys(again)), self.library.model.tokenize, attrgetter("id")
            self.pretoken_at.update(zip(new, range(self.pretokens.n, self.pretokens.n + len(new))))
            for lo in range(0, len(new), at_once):
                tokens = list(map(tokenize, self._spelled(new[lo : lo + at_once])))
                lengths = np.array(list(map(len, tokens)), dtype=np.int64)
                self.pretokens.add(np.array(list(map(id_of, chain.from_iterable(tokens))), dtype=np.uint32), lengths)
            codes[missed] = list(map(self.pretoken_at.__getitem__, again))
        return codes

    def _by_pattern(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The entries of the pretokens of all pieces, and the number of each piece's."""
        # END between something and one blank is a pretoken by itself, so it can stand between such pieces
        plain = np.array([k[:1] == " " < k[1:2] and k[1].isprintable() and END not in k and not k[-1:].isspace() for k in pieces], dtype=bool)
        joined = END.join(compress(pieces, plain.tolist()))
        codes = self._codes(PRETOKEN.findall(joined)) if joined else np.zeros(0, dtype=np.int64)
        between = np.append(np.flatnonzero(codes == 1), len(codes))
        found = [PRETOKEN.findall(k) for k in compress(pieces, (~plain).tolist())]
        counts = np.empty(len(pieces), dtype=np.int64)
        counts[plain] = (np.diff(between, prepend=-1) - 1) if plain.any() else 0
        counts[~plain] = list(map(len, found))
        out = np.empty(int(counts.sum()), dtype=np.int64)
        mine = np.repeat(plain, counts)
        out[mine] = np.delete(codes, between[:-1])
        out[~mine] = self._codes(list(chain.from_iterable(found)))
        return out, counts

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces one after the other, and how many each has."""
        core = pc.utf8_rtrim(pieces, characters=MARKS)
        bare = pc.utf8_ltrim(core, characters=" ")
        sizes, cut, letters = (pc.binary_length(x).to_numpy() for x in (pieces, core, bare))
        plain = pc.utf8_is_alpha(bare).to_numpy(zero_copy_only=False) & (cut - letters <= 1)
        marked = plain & (cut < sizes)
        other, by_pattern = self._by_pattern(strings(pieces.filter(pa.array(~plain))))
        counts = 1 + marked.astype(np.int64)
        counts[~plain] = by_pattern
        ends = np.cumsum(counts)
        codes = np.empty(int(ends[-1]), dtype=np.int64)
        words = core.filter(pa.array(plain)).dictionary_encode()
        at = (ends - counts)[plain]
        codes[at] = self._codes(strings(words.dictionary))[words.indices.to_numpy()]
        mask = pa.array(marked)
        tails = [k[-n:] for k, n in zip(strings(pieces.filter(mask)), (sizes - cut)[marked].tolist())]
        codes[ends[marked] - 1] = self._codes(tails)
        codes[np.repeat(~plain, counts)] = other
        flat, lengths = self.pretokens.of(codes)
        upto = np.append(0, np.cumsum(lengths))
        return flat, np.diff(upto[np.append(0, ends)])

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of each text's ids."""
        texts = pa.array(texts, type=pa.large_string()) if isinstance(texts, list) else texts
        whole = np.full(len(texts), not self.by_piece)
        for content in self.added if self.by_piece else []:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._encode(texts)
        own = [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(strings(texts.filter(pa.array(whole))), add_special_tokens=False)]
        ids, lengths = self._encode(texts.filter(pa.array(~whole)))
        rest, own = iter(np.split(ids, np.cumsum(lengths)[:-1])), iter(own)
        parts = [next(own if w else rest) for w in whole.tolist()]
        return np.concatenate(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        if len(self.pretoken_at) > self.most_pretokens:
            self.forget()
        buffer = texts.buffers()[2]
        begins = np.frombuffer(texts.buffers()[1], dtype="<i8")[texts.offset : texts.offset + len(texts) + 1]
        lo, hi = int(begins[0]), int(begins[-1])
        if lo == hi:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        data = np.frombuffer(buffer, dtype=np.uint8)
        cuts = np.flatnonzero(data[lo:hi] == 32) + lo
        before = data[np.maximum(cuts - 1, lo)]
        # not to cut is never wrong: behind the end of what may be white space of several bytes, the pattern decides
        cuts = cuts[~(SPACES[before] | (before >= 0x80) & MAY_BE_SPACE_BEHIND[data[np.maximum(cuts - 2, lo)]])]
        first = np.searchsorted(cuts, begins)
        own = first[:-1][(first[:-1] < len(cuts)) & (cuts[np.minimum(first[:-1], len(cuts) - 1)] == begins[:-1])] if len(cuts) else first[:0]
        if len(own):  # a text that begins with a blank begins a piece anyway
            cuts = np.delete(cuts, own)
            first = np.searchsorted(cuts, begins)
        bounds = np.append(np.sort(np.concatenate([begins[:-1], cuts]), kind="stable"), hi)
        pieces = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), buffer)
        coded = pieces.dictionary_encode()
        ids, lengths = self._pieces(coded.dictionary)
        at = coded.indices.to_numpy()
        ids, lengths = gathered(ids, (np.cumsum(lengths) - lengths)[at], lengths[at])
        return ids, np.add.reduceat(lengths, first[:-1] + np.arange(len(texts)))


@contextmanager
def without_gc() -> Iterator[None]:
    """Millions of small lists, none of them in a cycle, would be searched again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encoded(path: str, batch: pa.RecordBatch, end_id: int, size: int = 1 << 21) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of a batch (id, text), in parts of about so many bytes: ids of documents, token ids with end_id after each
    text, and the number of each text's."""
    texts = batch.column(1).cast(pa.large_string())
    for lo, hi in batched(pc.binary_length(texts).to_numpy(), size):
        yield batch.column(0).slice(lo, hi - lo), *ended(*encoder(path).encode(texts.slice(lo, hi - lo)), end_id)


def batched(lengths: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs whose lengths sum up to about size at most, one text at least."""
    lo = total = 0
    for i, n in enumerate(lengths.tolist()):
        if i > lo and total + n > size:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def ended(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    out = np.full(len(ids) + len(lengths), end_id, dtype=ids.dtype)
    inside = np.ones(len(out), dtype=bool)
    inside[np.cumsum(lengths + 1) - 1] = False
    out[inside] = ids
    return out, lengths + 1
