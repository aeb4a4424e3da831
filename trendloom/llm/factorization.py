"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

A text's features are its distinct words (hashed into ``2 ** WORD_BITS`` places,
scaled to length 1), one place for the bin of each structure statistic (shares
of kinds of characters, word and line lengths, repeats; all from the text) and one
for the bin of ``n_chars``, the only metadata.  Labels, languages, sources and
ids are never features.  The score is a logistic of

    w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2),

whose last term is all pairwise interactions of rank ``RANK`` in linear time.

The model is fitted on a sample of at most ``max_rows`` labelled rows outside
the held-out fold (see ``training.labelled_sample``); its size is fixed, so it is
broadcast.  Scoring reads every text whole.

Defined results: null and empty texts have the bins of an empty text and a null
``n_chars`` a bin of its own, so both get a score; repeated rows are scored alike;
without labelled rows of both kinds the score is the share of label 1 (1 without
any); an empty table gives an empty result; other columns are not read.
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

from trendloom.llm.training import held_out, labelled_sample

WORD_BITS = 15
BINS = 16
RANK = 8
MAX_ROWS = 8000
EPOCHS = 4
RATE, SHRINK = 0.05, 2e-4
THRESHOLD = 0.3
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_KINDS = [np.frombuffer(chars, np.uint8) for chars in (
    b"#*$%&<>", b"|", b"!?", b".,;:", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)),
    bytes(range(128, 256)), b" \t\r\x0b\x0c", b"\n", b"{}[]()=+/\\_@~^`\"'-")]
STATISTICS = len(_KINDS) + 7
SIZE = (1 << WORD_BITS) + (STATISTICS + 1) * BINS


def structure(raw: bytes, words: list[bytes]) -> list[float]:
    """Statistics of a text, each from 0 to 1."""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, m = max(len(raw), 1), max(len(words), 1)
    shares = [float(np.sqrt(counts[k].sum() / n)) for k in _KINDS]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = len(set(zip(words, words[1:], words[2:])))
    log = lambda x, top: min(1.0, float(np.log1p(x)) / float(np.log1p(top)))
    return shares + [
        log(len(words), 20_000), log(sum(map(len, words)) / m, 50), len(set(words)) / m,
        log(len(lines), 1000), 1 - len(set(lines)) / max(len(lines), 1),
        1 - windows / max(len(words) - 2, 1) if len(words) > 2 else 0.0, log(max(map(len, words), default=0), 1000)]


def hashed_features(text: str, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features."""
    raw = text.encode()
    words = WORD.findall(raw)
    stats = structure(raw, words)
    bins = [int(min(BINS - 1, s * BINS)) for s in stats]
    bins.append(BINS - 1 if n_chars is None or n_chars != n_chars else
                min(BINS - 2, int(np.log2(max(float(n_chars), 0.0) + 1) * 0.75)))
    known = set(words)
    hashed = np.unique(np.fromiter(map(zlib.crc32, known), np.uint32, len(known)) >> np.uint32(32 - WORD_BITS))
    places = np.concatenate([hashed.astype(np.int64), (1 << WORD_BITS) + np.arange(len(bins)) * BINS + np.array(bins)])
    values = np.ones(len(places), np.float32)
    values[:len(hashed)] = 1 / np.sqrt(max(len(hashed), 1))
    return places, values


@dataclass(frozen=True)
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        scaled = self.factors[places] * values[:, None]
        pairs = 0.5 * float((scaled.sum(0) ** 2 - (scaled ** 2).sum(0)).sum())
        total = self.bias + float(self.linear[places] @ values) + pairs
        return 1 / (1 + float(np.exp(-np.clip(total, -30, 30))))


def fit(rows: list[tuple[int, bytes, float]], epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Adagrad on the logistic loss, one text after the other."""
    rng = np.random.default_rng(seed)
    n_one = sum(y for _, _, y in rows)
    share = min(max(n_one / len(rows), 1e-6), 1 - 1e-6) if rows else 1 - 1e-6
    bias, linear = float(np.log(share / (1 - share))), np.zeros(SIZE, np.float32)
    factors = rng.normal(0, 0.02, (SIZE, RANK)).astype(np.float32)
    if not 0 < n_one < len(rows):
        return Model(bias, linear, np.zeros_like(factors))
    texts = []
    for _, x, _ in rows:
        half = len(x) // 12
        texts.append((np.frombuffer(x, np.int64, half), np.frombuffer(x, np.float32, half, 8 * half)))
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-2, np.float32), np.full((SIZE, RANK), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = texts[i]
            v = factors[at]
            total = (v * x[:, None]).sum(0)
            out = bias + float(linear[at] @ x) + 0.5 * float((total ** 2 - ((v * x[:, None]) ** 2).sum(0)).sum())
            g = 1 / (1 + np.exp(-np.clip(out, -30, 30))) - rows[i][2]
            gw = g * x + SHRINK * linear[at]
            gv = g * x[:, None] * (total - v * x[:, None]) + SHRINK * v
            seen_b += g * g
            seen_w[at] += gw ** 2
            seen_v[at] += gv ** 2
            bias -= RATE * g / seen_b ** 0.5
            linear[at] -= RATE * gw / np.sqrt(seen_w[at])
            factors[at] -= RATE * gv / np.sqrt(seen_v[at])
    return Model(float(bias), linear, factors)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, folds: int = 5,
          id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> Model:
    @F.pandas_udf("binary")
    def features(texts: pd.Series, chars: pd.Series) -> pd.Series:
        both = (hashed_features(t, c) for t, c in zip(texts, chars, strict=True))
        return pd.Series([p.tobytes() + x.tobytes() for p, x in both])
    column = features(F.coalesce(F.col(text_col), F.lit("")), F.col(chars_col).cast("double"))
    return fit(labelled_sample(docs, labels, label, column, max_rows, folds, id_col))


def score(docs: DataFrame, model: Model, text: Column, chars: Column) -> Column:
    """The score of every text, as a column of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, counts in batches:
            yield pd.Series([sent.value.score(*hashed_features(t, c)) for t, c in zip(texts, counts, strict=True)],
                            dtype="float64")
    return scores(F.coalesce(text, F.lit("")), chars.cast("double"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             chars_col: str = "n_chars", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, max_rows=max_rows, id_col=id_col, text_col=text_col, chars_col=chars_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       score(docs, model, F.col(text_col), F.col(chars_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
