"""Token ids in files of Simple-8b words, written and read on the executors.

A 64-bit word holds a selector in its top 4 bits and in the other 60 as many ids as fit: SELECTORS gives how many of
how many bits. Selector 0 is an escape: the next word is one id as it is, for ids that need over 60 bits. Ids are cut
into blocks of BLOCK; a block begins a new word, and its last word may be filled up with zeros. The words of a block
are found through its offset, so all blocks of a file, or any of them, are decoded at once in numpy; only blocks
with escapes are decoded word by word.

A file, all numbers little-endian: MAGIC; the words; the footer; the footer's length as 8 bytes; MAGIC. The footer is
an Arrow stream of two tables, each before its length: documents (id, number of ids) and blocks (word offset, ids,
whether it has escapes). Files are named by the range of ids that they hold; a task that runs again writes a file of
another name, and only the manifest's files count.

Defined results: a null text counts as empty, its ids are the end id alone. Null ids sort first; rows that repeat an
id follow by their texts' hashes. An empty table has no files and no rows.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulore.llm.common import release, shared_dir
from tabulore.llm.tokens import encoded, encoder, without_gc

MAGIC, BLOCK = b"S8BT\x01\0\0\0", 1024
#: Ids that are encoded at once; whole blocks, and few enough for a processor's cache.
AT_ONCE = 256 * BLOCK
#: Fixed values of the code: ids in a word and bits of each, by selector. 0 is the escape, 1 a run of zeros.
SELECTORS = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNT, BITS = (np.array(x, dtype=np.int64) for x in zip(*SELECTORS))
_small = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.uint8)


def widths(ids: np.ndarray) -> np.ndarray:
    """The bits that each id needs."""
    out, rest = np.zeros(len(ids), dtype=np.uint8), ids.astype(np.uint64, copy=False)
    if len(ids) and int(rest.max()) < 1 << 16:
        return _small[rest]
    for shift in (0, 16, 32, 48):
        part = ((rest >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
        out = np.where(part > 0, _small[part] + np.uint8(shift), out)
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words; and for each block its first word, its ids and whether it has escapes."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint64)
    padded[:n] = ids
    width = widths(padded).reshape(blocks, BLOCK)
    # the widest of the next 2**k ids, then of any number of them; beyond the block's end there are zeros
    best = np.zeros((blocks, BLOCK), dtype=np.uint8)
    spans = {1: width}
    while (k := max(spans)) < 64:
        spans[2 * k] = np.maximum(spans[k], np.pad(spans[k][:, k:], ((0, 0), (0, k))))
    for selector in range(len(SELECTORS) - 1, 0, -1):
        count, bits = SELECTORS[selector]
        k = 1 << (count.bit_length() - 1)
        widest = spans[k] if k == count else np.maximum(spans[k], np.pad(spans[k][:, count - k :], ((0, 0), (0, count - k))))
        best[widest <= bits] = selector
    # follow the words of all blocks side by side
    best = best.ravel()
    step, begins = COUNT[best].astype(np.int32), np.zeros(len(best), dtype=bool)
    at = np.arange(blocks, dtype=np.int32) * BLOCK
    stop = at + BLOCK
    while len(at):
        begins[at] = True
        at = at + step[at]
        more = at < stop
        if not more.all():
            at, stop = at[more], stop[more]
    starts = np.flatnonzero(begins[:n])
    chosen = best[starts].astype(np.int64)
    size = np.where(chosen == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), dtype=np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    within = BLOCK - starts % BLOCK  # ids from here to the block's end
    longer = np.concatenate([padded, np.zeros(128, dtype=np.uint64)])
    for selector in np.unique(chosen).tolist():
        own = np.flatnonzero(chosen == selector)
        count, bits = SELECTORS[selector]
        if selector == 0:
            words[place[own] + 1] = padded[starts[own]]
            continue
        for part, cut in ((own[within[own] >= count], False), (own[within[own] < count], True)):
            from_, held = starts[part], words[place[part]]
            for j in range(count if bits and len(part) else 0):
                ids_j = longer[from_ + j]
                held |= (np.where(within[part] > j, ids_j, np.uint64(0)) if cut else ids_j) << np.uint64(bits * j)
            words[place[part]] = held
    block = starts // BLOCK
    first = np.searchsorted(block, np.arange(blocks))
    count = np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    escaped = np.bincount(block, weights=chosen == 0, minlength=blocks) > 0
    return words, place[first] if n else np.zeros(0, dtype=np.int64), count, escaped


def decode(words: np.ndarray, first: np.ndarray, count: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks; words begins with the first block's."""
    out = np.zeros(int(count.sum()), dtype=np.uint64)
    base, stop = np.cumsum(count) - count, np.append(first[1:], len(words))
    for b in np.flatnonzero(escaped).tolist():
        at, to = int(first[b]), int(base[b])
        while at < stop[b]:
            selector, word = int(words[at]) >> 60, int(words[at])
            if selector == 0:
                out[to], at, to = words[at + 1], at + 2, to + 1
                continue
            n, bits = SELECTORS[selector]
            for j in range(min(n, int(base[b] + count[b]) - to)):
                out[to + j] = (word >> (bits * j)) & ((1 << bits) - 1)
            at, to = at + 1, to + n
    block = np.repeat(np.arange(len(first)), stop - first)
    plain = ~escaped[block]
    selectors = (words >> np.uint64(60)).astype(np.int64)
    n = np.where(plain, COUNT[selectors], 0)
    ends = np.cumsum(n)
    to = base[block] + ends - n - (np.concatenate([[0], ends])[first])[block]
    room = (base + count)[block] - to  # ids from here to the block's end
    for selector in np.unique(selectors[plain]).tolist():
        own = np.flatnonzero(plain & (selectors == selector))
        many, bits = SELECTORS[selector]
        mask = np.uint64((1 << bits) - 1) if bits < 64 else np.uint64(2**64 - 1)
        whole, last = own[room[own] >= many], own[room[own] < many]
        for j in range(many if bits else 0):
            out[to[whole] + j] = (words[whole] >> np.uint64(bits * j)) & mask
            if len(last := last[room[last] > j]):
                out[to[last] + j] = (words[last] >> np.uint64(bits * j)) & mask
    return out


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as to:
        to.write_batch(batch)
    held = sink.getvalue().to_pybytes()
    return struct.pack("<Q", len(held)) + held


def write_file(uri: str, documents: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[int, int]:
    """One file of (ids of documents, token ids, numbers of token ids); how many documents and token ids it has."""
    fs, path = _store(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    keys, lengths, index, n_words = [], [], [], 0
    with fs.open_output_stream(path) as out:
        out.write(MAGIC)
        held = np.zeros(0, dtype=np.uint32)

        def put(ids: np.ndarray) -> None:
            nonlocal n_words
            for lo in range(0, len(ids), AT_ONCE):
                words, first, count, escaped = encode(ids[lo : lo + AT_ONCE])
                out.write(words.astype("<u8", copy=False).tobytes())
                index.append((first + n_words, count, escaped))
                n_words += len(words)

        for key, ids, n in documents:
            keys.append(key)
            lengths.append(n)
            held = np.concatenate([held, ids]) if len(held) else ids
            if full := len(held) // BLOCK * BLOCK:
                put(held[:full])
                held = held[full:]
        if len(held):
            put(held)
        n = np.concatenate(lengths)
        docs = pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(n)], names=["doc_id", "n_tokens"])
        first, count, escaped = (np.concatenate(x) for x in zip(*index)) if index else ([], [], [])
        blocks = pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(count, pa.int64()), pa.array(escaped, pa.bool_())], names=["word", "ids", "escaped"])
        footer = _stream(docs) + _stream(blocks)
        out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
    return len(n), int(n.sum())


def read_file(uri: str, blocks_at_once: int = 2048) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids of documents, token ids, numbers of token ids), in runs that hold whole documents."""
    fs, path = _store(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        tail = len(MAGIC) + 8
        if f.read_at(len(MAGIC), 0) != MAGIC or f.read_at(len(MAGIC), size - len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is not a file of token ids")
        (length,) = struct.unpack("<Q", f.read_at(8, size - tail))
        footer, tables = f.read_at(length, size - tail - length), []
        while footer:
            (n,) = struct.unpack("<Q", footer[:8])
            tables.append(pa.ipc.open_stream(footer[8 : 8 + n]).read_all().combine_chunks())
            footer = footer[8 + n :]
        docs, blocks = tables
        n_words = (size - tail - length - len(MAGIC)) // 8
        first, count, escaped = (np.asarray(blocks.column(c).to_numpy()) for c in ("word", "ids", "escaped"))
        lengths, keys = docs.column("n_tokens").to_numpy(), pa.concat_arrays(docs.column("doc_id").chunks)
        held, done = np.zeros(0, dtype=np.uint64), 0
        ends = np.cumsum(lengths)
        passed = 0  # ids of documents that have been given
        for lo in range(0, len(first), blocks_at_once):
            hi = min(lo + blocks_at_once, len(first))
            stop = int(first[hi]) if hi < len(first) else n_words
            words = np.frombuffer(f.read_at((stop - int(first[lo])) * 8, len(MAGIC) + int(first[lo]) * 8), dtype="<u8")
            held = np.concatenate([held, decode(words, first[lo:hi] - first[lo], count[lo:hi], escaped[lo:hi])])
            to = int(np.searchsorted(ends, passed + len(held), side="right"))
            if to > done:
                own = int(ends[to - 1]) - passed
                yield keys.slice(done, to - done), held[:own], lengths[done:to]
                held, passed, done = held[own:], passed + own, to


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> list[dict]:
    """Token files of all docs in ascending order of ids in folder out, and their manifest, which is also written."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    parts = kept.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        with without_gc():
            for batch in batches:
                yield from encoded(tokenizer_path, batch, end_id)
        encoder(tokenizer_path).forget()
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = next((b for b in batches if b.num_rows), None)
        if some is None:
            return
        part = TaskContext.get().partitionId()
        uri = f"{out}/tokens-{part:06d}-{uuid.uuid4().hex}.s8b"

        def all_of() -> Iterator[pa.RecordBatch]:
            yield some
            yield from batches

        n, ids = write_file(uri, documents(all_of()))
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "documents": [n], "ids": [ids]}, schema=pa.schema([("part", pa.int64()), ("uri", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    found = [r.asDict() for r in parts.mapInArrow(run, "part long, uri string, documents long, ids long").collect()]
    before = 0
    for row in sorted(found, key=lambda r: r["part"]):
        row["start"], before = before, before + row["ids"]
    manifest = sorted(found, key=lambda r: r["part"])
    fs, path = _store(out)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_tokens(spark: SparkSession, manifest: list[dict], id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """A row for each document of the files: id, start, n_tokens, ids_crc32."""
    rows = [(r["uri"], r["start"]) for r in manifest]
    files = spark.createDataFrame(rows, "uri string, start long")
    files = files.repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism * 4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for keys, ids, n in read_file(uri):
                    ends = np.cumsum(n)
                    words = ids.astype("<u4")
                    crc = [zlib.crc32(words[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([keys, pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])

    return files.mapInArrow(run, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
