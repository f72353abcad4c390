"""Language ID: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased code point by code point, everything else is one blank; the n-grams of 1 to MAX_N code
points of the whole text are hashed to DIMS buckets. Training counts buckets by language over a bounded sample of
labelled rows (`max_docs_per_lang`, taken by a hash of the id, all rows of rarer languages) and collects a matrix of
languages by buckets, whose size doesn't grow with the data. Log probabilities are broadcast; a batch is scored by
gathering the rows of its n-grams and summing them by document in numpy. Long texts are cut into overlapping
segments, so memory is bounded and every n-gram counts once.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if nothing was learned.
Null labels teach nothing. Ties go to the language that sorts first. Repeated rows get equal results. The table's
other columns are kept; an input column with the name of an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulore.llm.common import release, releasing

MAX_N, DIMS, SEGMENT = 3, 1 << 16, 1 << 19
UNDETERMINED = "und"
_lut: np.ndarray | None = None


def letters() -> np.ndarray:
    """By code point: its lower case, or a blank if it is no letter."""
    global _lut
    if _lut is None:
        points = map(chr, range(0x110000))
        _lut = np.fromiter((ord(c.lower()[0]) if c.isalpha() else 32 for c in points), dtype=np.uint32, count=0x110000)
    return _lut


def segments(texts: list[str], size: int = SEGMENT) -> Iterator[list[tuple[int, str, int]]]:
    """Lists of (index, piece, n-grams that start in it), each of about `size` code points at most."""
    held: list[tuple[int, str, int]] = []
    total = 0
    for i, text in enumerate(texts):
        for lo in range(0, len(text), size):
            own = min(size, len(text) - lo)
            if total + own > size and held:
                yield held
                held, total = [], 0
            held.append((i, text[lo : lo + own + MAX_N - 1], own))
            total += own
    if held:
        yield held


def buckets(pieces: list[tuple[int, str, int]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Whether each piece has a letter, and for each n the bucket at every position with the pieces' bounds."""
    lengths = np.array([len(p) for _, p, _ in pieces], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    own = np.array([n for _, _, n in pieces], dtype=np.int64)
    points = letters()[np.frombuffer("".join(p for _, p, _ in pieces).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    has = np.add.reduceat((points != 32).astype(np.int64), starts) > 0
    out, held = [], np.full(len(points), 2166136261, dtype=np.uint32)
    for n in range(1, MAX_N + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        held = (held[:size] ^ points[n - 1 : n - 1 + size]) * np.uint32(0x9E3779B1)
        held ^= held >> np.uint32(15)
        stops = np.minimum(starts + own, starts + lengths - n + 1)
        out.append((((held * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int64), starts, stops))
    return has, out, starts


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray  # log, by language
    weights: np.ndarray  # log probability, buckets x languages

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        k = len(self.langs)
        total = np.tile(self.prior, (len(texts), 1)) if k else np.zeros((len(texts), 0))
        lettered = np.zeros(len(texts), dtype=bool)
        for pieces in segments(texts, max(1 << 12, SEGMENT * 4 // max(k, 4))):
            which = np.array([i for i, _, _ in pieces])
            has, by_n, _ = buckets(pieces)
            np.logical_or.at(lettered, which, has)
            for bucket, lo, hi in by_n if k else []:
                some = hi > lo
                bounds = np.stack([lo[some], hi[some]], axis=1).ravel()
                if len(bounds):
                    summed = np.add.reduceat(np.vstack([self.weights[bucket], np.zeros((1, k))]), bounds, axis=0)[::2]
                    np.add.at(total, which[some], summed)
        lettered &= k > 0
        out, sure = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        rows = np.flatnonzero(lettered)
        if len(rows):
            best = total[rows].argmax(axis=1)
            top = total[rows, best][:, None]
            sure[rows] = 1 / np.exp(total[rows] - top).sum(axis=1)
            for r, b in zip(rows.tolist(), best.tolist()):
                out[r] = self.langs[b]
        return out, sure


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs_per_lang: int = 5_000, max_langs: int = 512, smoothing: float = 0.5) -> Model:
    """A model of at most about max_docs_per_lang whole texts of each language, chosen by a hash of the id."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = sorted((r[0], r[1]) for r in rows.groupBy(F.col(lang_col)).count().limit(max_langs + 1).collect())
    if len(found) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs")
    langs, k = [lang for lang, _ in found], len(found)
    if not k:
        return Model([], np.zeros(0), np.zeros((DIMS, 0)))
    share = F.element_at(F.create_map(*(x for lang, n in found for x in (F.lit(lang), F.lit(min(1.0, max_docs_per_lang / n))))), F.col(lang_col))
    chosen = rows.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 30)) < share * float(1 << 30))
    place = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((k, DIMS), dtype=np.int64)
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for pieces in segments(texts.tolist()):
                    for bucket, lo, hi in buckets(pieces)[1]:
                        for a, b in zip(lo.tolist(), hi.tolist()):
                            if b > a:
                                seen[place[lang]] += np.bincount(bucket[a:b], minlength=DIMS) if b - a > DIMS else 0
                                if b - a <= DIMS:
                                    np.add.at(seen[place[lang]], bucket[a:b], 1)
        lang, bucket = np.nonzero(seen)
        yield pd.DataFrame({"lang": lang.astype(np.int32), "bucket": bucket.astype(np.int32), "n": seen[lang, bucket]})

    counted = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(releasing(count), "lang int, bucket int, n long")
    seen = np.zeros((DIMS, k))
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    seen[got["bucket"].to_numpy(), got["lang"].to_numpy()] = got["n"].to_numpy()
    seen += smoothing
    prior = np.array([float(n) for _, n in found])
    return Model(langs, np.log(prior / prior.sum()), np.log(seen / seen.sum(axis=0)))


def predicted(model: Model, text: Column, spark) -> Column:
    """A struct of lang_pred and score."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def classify(texts: pd.Series) -> pd.DataFrame:
        langs, score = held.value.score(["" if t is None else t for t in texts])
        release()
        return pd.DataFrame({"lang_pred": langs, "score": score})

    # else a filter on the result would have every text classified once more
    return classify.asNondeterministic()(text)


def language_id(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    out = df.drop("lang_pred", "score").withColumn("_language", predicted(model, F.col(text_col), df.sparkSession))
    return out.withColumns({"lang_pred": F.col("_language.lang_pred"), "score": F.col("_language.score")}).drop("_language")
