"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and
skip-grams.

Features are the words of a text, the pairs of neighbours and the pairs with
one word between (runs of ``[0-9a-z]`` and non-ASCII after lower-casing A-Z),
hashed into ``2 ** BITS`` coordinates, each counted once for a text.  Every
coordinate has its own rate, and the L1 term keeps most weights at 0; only the
others are broadcast (at most ``2 ** BITS`` of them, whatever the corpus).

The model is fitted on a sample of at most ``max_rows`` labelled rows outside
the held-out fold (see ``training.labelled_sample``).  Scoring reads every
text whole.

Defined results: null and empty texts have no features and get the score of the
bias; repeated rows are scored alike; without labelled rows of both kinds the
score is the share of label 1 (0 without any); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.tokenizer_files import release_memos
from trendloom.llm.training import held_out, labelled_sample

BITS = 20
MAX_ROWS = 12_000
EPOCHS = 10
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.02
THRESHOLD = 0.5
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)


def hashed_features(text: str | None) -> np.ndarray:
    """Coordinates of a text, with repeats."""
    words = WORD.findall((text or "").encode().lower())
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    two, skip = np.uint32(0x9E3779B1), np.uint32(0x7FEB352D)
    grams = np.concatenate([h, h[:-1] * two + h[1:], h[:-2] * skip + h[2:]])
    return _mix(grams) >> np.uint32(32 - BITS)


@dataclass(frozen=True)
class Model:
    """The weights that are not 0."""
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.places] = self.weights
        return out


def packed(at: np.ndarray) -> bytes:
    """Distinct coordinates as their compressed steps, about two bytes each."""
    return zlib.compress(np.diff(np.unique(at).astype("<u4"), prepend=np.uint32(0)).tobytes(), 1)


def unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(x), "<u4"), dtype=np.uint32)


def fit(rows: list[tuple[int, bytes, float]], epochs: int = EPOCHS, seed: int = 3,
        decode=lambda x: np.unique(np.frombuffer(x, np.uint32))) -> Model:
    """FTRL-proximal, one text after the other.  ``decode`` makes the distinct
    coordinates of a text from its bytes; only one text is unpacked at a time."""
    n_one = sum(y for _, _, y in rows)
    if not 0 < n_one < len(rows):
        share = min(max(n_one / len(rows), 1e-6), 1 - 1e-6) if rows else 1e-6
        return Model(np.zeros(0, np.uint32), np.zeros(0, np.float32), float(np.log(share / (1 - share))))
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last place is the bias, without L1

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == size, 0.0, L1)
        short = np.abs(z[at]) <= l1
        return np.where(short, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = np.append(decode(rows[i][1]), np.uint32(size))
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - rows[i][2]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    places = np.flatnonzero(w[:size]).astype(np.uint32)
    return Model(places, w[places].astype(np.float32), float(w[size]))


def score_text(text: str | None, dense: np.ndarray, bias: float) -> float:
    at = hashed_features(text)
    at = np.unique(at[dense[at] != 0])
    total = bias + float(np.sum(dense[at], dtype=np.float64))
    return 1 / (1 + float(np.exp(-np.clip(total, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, folds: int = 5,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    @F.pandas_udf("binary")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: packed(hashed_features(t)))
    return fit(labelled_sample(docs, labels, label, features(F.coalesce(F.col(text_col), F.lit(""))), max_rows, folds, id_col), decode=unpacked)


def score(docs: DataFrame, model: Model, text: Column) -> Column:
    """The score of every text, as a column of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release_memos()
        dense, bias = sent.value.dense(), sent.value.bias
        for texts in batches:
            yield pd.Series([score_text(t, dense, bias) for t in texts], dtype="float64")
    return scores(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, max_rows=max_rows, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       score(docs, model, F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
