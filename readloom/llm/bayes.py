"""Multinomial naive Bayes over hashed features, fitted and scored in numpy."""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
TRAIN_BYTES = 64 << 20  # most bytes of texts that a classifier is fitted on


def ngrams(word: str, longest: int = 4) -> list[int]:
    """Buckets of the character n-grams of a word with its borders, and of the word itself."""
    w = f" {word} "
    raw = [w[i : i + n] for n in range(2, longest + 1) for i in range(len(w) - n + 1)]
    return [crc32(g.encode()) % BUCKETS for g in (*raw, w)]


def word_bucket(word: str) -> list[int]:
    return [crc32(word.encode()) % BUCKETS]


class Features:
    """Sparse features of words, by a function that gives the buckets of one."""

    def __init__(self, of):
        self.of = of

    def sparse(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, row) of all features of all words."""
        lists = [self.of(w) for w in words]
        row = np.repeat(np.arange(len(words)), [len(x) for x in lists])
        return np.fromiter((b for x in lists for b in x), np.int64, len(row)), row


def fit(counts: np.ndarray, common: float = 0.05) -> np.ndarray:
    """Log probabilities (classes x buckets) of feature counts of the same shape.

    Each class is mixed with the distribution over all classes in the share ``common``: what
    no class has seen tells nothing, and classes of little text are at no disadvantage.
    """
    overall = counts.sum(axis=0) + 0.01
    overall = overall / overall.sum()
    size = counts.sum(axis=1, keepdims=True)
    own = np.where(size > 0, counts / np.maximum(size, 1), overall)
    return np.log((1 - common) * own + common * overall).astype(np.float32)


def score(matrix: np.ndarray, bucket: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums of log probabilities (rows x classes)."""
    return np.stack([np.bincount(row, weights=m[bucket], minlength=rows) for m in matrix], axis=1) if rows else np.zeros((0, len(matrix)))


def bounded_sample(df: DataFrame, hash_column: str, text: str, most: int, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """The rows with the least hashes, at most ``most`` of them and of texts of ``most_bytes`` in all.

    Hashes and sizes of so many rows come to the driver first, which finds where the sample ends; texts are read after that.
    """
    n = df.count()
    sizes = df.select(hash_column, F.octet_length(text))
    rows = []
    if n > most:
        # hashes are spread evenly over the long integers: cut where about 1.2 x most rows lie, and some
        share = min(1.0, (1.2 * most + 1000) / n)
        rows = sizes.where(F.col(hash_column) < F.lit(int(-(2**63) + share * (2**64 - 1)))).orderBy(hash_column).limit(most).collect()
    if len(rows) < min(n, most):
        rows = sizes.orderBy(hash_column).limit(most).collect()
    inside = int(np.searchsorted(np.cumsum([r[1] or 0 for r in rows]), most_bytes, "right"))
    if not inside:
        return df.limit(0)
    return df.where(F.col(hash_column) <= F.lit(rows[inside - 1][0])).orderBy(hash_column).limit(inside)
