"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A document's score is linear in the features of its whole text. Pairs of a good and a bad document teach the weights
by logistic loss on the difference of their features, with a small ridge. Documents for the pairs are a bounded sample
of labelled rows (`max_per_class`, by a hash of the id); their features, and nothing larger, come to the driver.
The threshold is the quantile of the learned documents' scores that leaves below it the share of bad ones; there the
score, mapped to 0..1 by the logistic function, is CUT.

Defined results: a null text scores like an empty one. Rows of labels with a null in id or label, and ids with
conflicting labels, teach nothing; repeated labels count once. Without labels of both kinds every score is 0.5.
Repeated rows get equal scores; other columns are kept, and one named `score` is replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT = 0.7
_class = np.full(256, 5, dtype=np.uint8)  # other symbols
_class[[*range(97, 123)]] = 0
_class[[*range(65, 91)]] = 1
_class[[*range(48, 58)]] = 2
_class[[9, 10, 11, 12, 13, 32]] = 3
_class[[ord(c) for c in ".,;:'\"()-"]] = 4
_class[[*range(128, 256)]] = 6


def features(text: str) -> list[float]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    low, up, digit, space, mark, symbol, high = (np.bincount(_class[data], minlength=7)[:7]).tolist()
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, seen = max(1, len(words)), max(1, len(data) - space)
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if words else 0
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    same = sum(a == b for a, b in zip(words, words[1:]))
    ratios = [
        up / max(1, low + up),
        digit / seen,
        mark / seen,
        symbol / seen,
        high / seen,
        top / n,
        same / n,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(counts) / n,
        float((lengths <= 3).mean()),
        float((lengths > 15).mean()),
        symbol / n,
        text.count(".") / n,
        len(lines) / n,
    ]
    scales = [np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), len(counts) / n**0.8, np.log1p(len(text) / max(1, len(lines)))]
    return [*ratios, *(r**0.5 for r in ratios), *scales, float(not words)]


N_FEATURES = len(features(""))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), 0.5)
        raw = ((np.array([features(t) for t in texts]).reshape(-1, N_FEATURES) - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold + np.log(CUT / (1 - CUT)), -50, 50)))


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = 100_000, ridge: float = 1e-3, seed: int = 0) -> Model:
    """Newton's method on the mean logistic loss of random pairs of the two kinds."""
    every = np.vstack([good, bad])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-6
    draw = np.random.default_rng(seed)
    difference = (good[draw.integers(len(good), size=pairs)] - bad[draw.integers(len(bad), size=pairs)]) / scale
    w = np.zeros(N_FEATURES)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(difference @ w, -30, 30)))
        step = np.linalg.solve((difference * (p * (1 - p))[:, None]).T @ difference / pairs + ridge * np.eye(len(w)), difference.T @ (1 - p) / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = ((every - mean) / scale) @ w
    return Model(mean, scale, w, float(np.quantile(raw, len(bad) / len(every))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_per_class: int = 4_000, seed: int = 0) -> Model:
    """A model of about max_per_class documents of either label at most."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("least"), F.max(label_col).alias("label"))
    known = known.filter(F.col("least") == F.col("label")).select(id_col, (F.col("label") > 0).alias("good"))
    n = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    empty = Model(np.zeros(0), np.zeros(0), np.zeros(0), 0.0)
    if len(n) < 2:
        return empty
    share = F.when(F.col("good"), F.lit(min(1.0, max_per_class / n[True]))).otherwise(F.lit(min(1.0, max_per_class / n[False])))
    sample = known.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("quality")), F.lit(1 << 30)) < share * float(1 << 30))

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t or "") for t in texts])

    # the sample is bounded by max_per_class, so it may be broadcast
    rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col).select(id_col, "good", measured(F.col(text_col)).alias("x")).orderBy(id_col).toPandas()
    x, good = np.array(rows["x"].tolist()).reshape(-1, N_FEATURES), rows["good"].to_numpy(dtype=bool)
    if good.all() or not good.any():
        return empty
    # classes were sampled at different rates; the threshold is that of all labelled rows
    model = bradley_terry(x[good], x[~good], seed=seed)
    raw = ((x - model.mean) / model.scale) @ model.weights
    weight = np.where(good, n[True] / good.sum(), n[False] / (~good).sum())
    order = raw.argsort(kind="stable")
    below = np.cumsum(weight[order]) / weight.sum()
    model.threshold = float(raw[order][min(len(raw) - 1, int(np.searchsorted(below, n[False] / (n[True] + n[False]))))])
    return model


def quality(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with score."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score([t or "" for t in texts]))

    # else a filter on the score would have every text scored once more
    return df.drop("score").withColumn("score", scored.asNondeterministic()(F.col(text_col)))
