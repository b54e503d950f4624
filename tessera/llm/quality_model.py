"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds cut its score: P(grade > k) = sigmoid(w x - t_k), t_1 < t_2 < ... The
thresholds are kept ordered by learning the logarithms of their gaps. The model
gives an expected grade and the probability of reaching a grade, by which
documents are selected. With two grades this is logistic regression.

Features are counts per word of hashed tokens: the word, its ending, its shape;
and tokens that describe the text as a whole (length, repetition, symbols).

Edge cases: null and empty texts have the whole-text tokens only; null ratings are
not learnt from, of different ones of one document the lowest counts; with fewer than two grades rated, every expected grade is that
grade (or 0) and nothing is rejected; rows that repeat are scored alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rated rows that training reads at most, chosen by a hash of their id.
MAX_TRAINING_ROWS = 8000
BUCKETS = 1 << 18
EPOCHS = 200
#: Rated documents that must have a hashed feature for it to get a weight.
LEAST_SEEN = 2
#: Mean slope at which fitting ends.
FLAT = 1e-5
CACHE_ENTRIES = 200_000


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) & (BUCKETS - 1)


def word_features(word: str) -> tuple[int, int, int]:
    """The word in lower case, its last two characters, its shape."""
    if word.isalpha():
        shape = "l" if word.islower() else "t" if word.istitle() else "u" if word.isupper() else "m"
    else:
        letters = sum(map(str.isalpha, word))
        digits = sum(map(str.isdigit, word))
        upper = "u" if letters > 1 and word.isupper() else ""
        shape = f"{upper}{min(letters, 2)}{min(digits, 2)}{min(len(word) - letters - digits, 3)}"
    return _bucket("w:" + word.lower()), _bucket("e:" + word[-2:]), _bucket("s:" + shape)


def text_features(text: str, words: list[str]) -> list[int]:
    """Tokens that describe the whole text, in coarse steps."""
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]

    def step(name: str, share: float) -> int:
        return _bucket(f"{name}={min(int(share * 10), 10)}")

    letters = sum(map(len, words)) or 1
    return [
        _bucket(f"n={int(math.log2(n))}"),
        step("distinct words", len(set(words)) / n),
        step("distinct lines", len(set(lines)) / max(len(lines), 1)),
        step("marks", sum(text.count(c) for c in "#*$%&|<>!") / letters),
        step("short", letters / n / 12),
    ]


class Words(dict):
    """Summed weight of a word's features, by word."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        out = float(self.weights[list(word_features(word))].sum())
        if len(word) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = out
        return out


@dataclass(frozen=True)
class Model:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def position(self, words: Words, text: str | None) -> float:
        found = (text or "").split()
        z = sum(map(words.__getitem__, found)) / len(found) if found else 0.0
        return z + float(self.weights[text_features(text or "", found)].sum())

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each but the last grade."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -30, 30)))


def fit_ordinal(
    rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, ridge: float = 1e-4
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds for grades ``y`` in 0 .. K-1, by Adam on the mean likelihood.

    Only buckets that occur in ``LEAST_SEEN`` rows are fitted; all others keep weight zero.
    """
    n, k = len(y), int(y.max())
    # A row has a bucket more than once where features collide.
    often = np.bincount(cols, minlength=BUCKETS) >= LEAST_SEEN
    used = np.flatnonzero(often)
    rows, values, cols = (x[often[cols]] for x in (rows, values, cols))
    place = np.zeros(BUCKETS, np.int64)
    place[used] = np.arange(len(used))
    cols, size = place[cols], len(used)
    share = np.array([(y <= g).mean() for g in range(k)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    w = np.zeros(size)
    # t_1, then logarithms of the gaps.
    raw = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    moments = [np.zeros(size + k) for _ in range(2)]
    theta = np.concatenate((w, raw))
    for step in range(1, epochs + 1):
        w, raw = theta[:size], theta[size:]
        gaps = np.exp(raw[1:])
        t = np.concatenate((raw[:1], raw[0] + np.cumsum(gaps)))
        z = np.bincount(rows, values * w[cols], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -30, 30)))
        # P(y) = P(> y-1) - P(> y); its logarithm's slopes in z and in each threshold.
        upper = np.concatenate((np.ones((n, 1)), p), 1)[np.arange(n), y]
        lower = np.concatenate((p, np.zeros((n, 1))), 1)[np.arange(n), y]
        mass = np.maximum(upper - lower, 1e-12)
        slope_u, slope_l = upper * (1 - upper) / mass, lower * (1 - lower) / mass
        g_z = -(slope_u - slope_l) / n
        g_t = np.zeros(k)
        np.add.at(g_t, np.maximum(y - 1, 0), np.where(y > 0, slope_u, 0) / n)
        np.add.at(g_t, np.minimum(y, k - 1), np.where(y < k, -slope_l, 0) / n)
        tail = np.cumsum(g_t[::-1])[::-1]
        g_raw = np.concatenate((tail[:1], tail[1:] * gaps))
        g = np.concatenate((np.bincount(cols, values * g_z[rows], minlength=size) + ridge * w, g_raw))
        if np.abs(g).max() < FLAT:
            break
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        theta = theta - 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
    raw = theta[size:]
    weights = np.zeros(BUCKETS)
    weights[used] = theta[:size]
    return weights, np.concatenate((raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))))


def fit(docs: DataFrame, ratings: DataFrame, rating: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Fit on at most ``max_rows`` rated documents whose id's checksum is not held out."""
    marked = (
        ratings.select(F.col("doc_id").cast("long"), F.col(rating).cast("int").alias("rating"))
        .filter("doc_id is not null and rating is not null")
        .filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .groupBy("doc_id")
        .agg(F.min("rating").alias("rating"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, values = [], []
            for text in batch.column(0):
                words = (text.as_py() or "").split()
                ids = np.array([word_features(w) for w in words], np.int32).ravel()
                found, n = np.unique(ids, return_counts=True)
                whole = np.array(text_features(text.as_py() or "", words), np.int32)
                cols.append(np.concatenate((found.astype(np.int32), whole)).tobytes())
                share = np.concatenate((n / max(len(words), 1), np.ones(len(whole)))).astype(np.float32)
                values.append(share.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols, pa.binary()), pa.array(values, pa.binary()), batch.column(1)], ["cols", "shares", "rating"]
            )

    # At most max_rows rows are broadcast.
    rows = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .join(F.broadcast(marked), "doc_id")
        .select("text", "rating")
        .mapInArrow(run, "cols binary, shares binary, rating int")
        .toPandas()
        .sort_values(["cols", "rating"])
    )
    grades = sorted(set(rows["rating"].tolist()))
    if len(grades) < 2:
        return Model(grades or [0], np.zeros(BUCKETS), np.zeros(0))
    cols = [np.frombuffer(x, np.int32) for x in rows["cols"]]
    values = np.concatenate([np.frombuffer(x, np.float32) for x in rows["shares"]]).astype(np.float64)
    at = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    y = np.searchsorted(grades, rows["rating"].to_numpy())
    weights, thresholds = fit_ordinal(at, np.concatenate(cols), values, y)
    return Model(grades, weights, thresholds)


def classify(docs: DataFrame, model: Model, least_grade: int | None = None, least_tail: float = 0.5) -> DataFrame:
    """``(doc_id, expected_grade, tail_prob, kept)``; the tail is P(grade >= ``least_grade``), by default above the lowest."""
    grades = np.array(model.grades, float)
    first = grades[min(1, len(grades) - 1)] if least_grade is None else least_grade
    cut = int(np.searchsorted(grades, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model.weights)
        for batch in batches:
            z = np.array([model.position(words, t.as_py()) for t in batch.column(1)], float)
            above = model.above(z)
            expected = grades[0] + (above * np.diff(grades)[None, :]).sum(1)
            tail = np.ones(len(z)) if cut == 0 else np.zeros(len(z)) if cut == len(grades) else above[:, cut - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= least_tail)],
                ["doc_id", "expected_grade", "tail_prob", "kept"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, expected_grade double, tail_prob double, kept boolean"
    )
