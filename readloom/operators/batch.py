"""Reads of an Arrow batch as matrices, on which a whole chain works without copying a read.

Every step keeps a part of its read, so the state of a chain is where that part begins and
how long it is. Qualities and sequences are laid out once for all steps of the chain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ROWS = 1024  # reads that are laid out at a time: their matrices fit in a core's cache


def letters(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Character codes in rows padded with 0, and the lengths; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = column.fill_null("").cast(pa.large_string())
    data = texts.buffers()[2]
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    n = np.diff(ends) if len(texts) else np.zeros(0, np.int64)
    if len(flat) and flat.max() >= 128:
        # not ASCII: by code points
        listed = texts.to_pylist()
        n = np.fromiter(map(len, listed), np.int64, len(listed))
        flat = np.frombuffer("".join(listed).encode("utf-32-le"), np.uint32)
    w = int(n.max(initial=0)) if width is None else width
    out = np.zeros((len(n), w), flat.dtype)
    if w and len(flat):
        if n.max() > w:
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            flat, n = flat[place < w], np.minimum(n, w)
        out[np.arange(w) < n[:, None]] = flat
    return out, n.astype(np.int64)


class Batch:
    """Reads with the part of each that is kept: ``start``, ``n`` and whether it is ``alive``."""

    def __init__(self, sequence: pa.Array, quality: pa.Array, offset: pa.Array):
        self.chars, self.n = letters(sequence)
        self.rows, self.width = self.chars.shape
        codes, _ = letters(quality, self.width)
        known = offset.fill_null(33).to_numpy(zero_copy_only=False).astype(np.int32)
        q = codes.astype(np.int32) - known[:, None]
        q[(self.chars == ord("N")) | (np.arange(self.width) >= self.n[:, None])] = 0
        self.q = q
        self.start = np.zeros(self.rows, np.int64)
        self.offset = known.copy()
        self.alive = sequence.is_valid().to_numpy(zero_copy_only=False) & quality.is_valid().to_numpy(zero_copy_only=False)
        self._sums: np.ndarray | None = None

    @property
    def end(self) -> np.ndarray:
        return self.start + self.n

    @property
    def inside(self) -> np.ndarray:
        at = np.arange(self.width)
        return (at >= self.start[:, None]) & (at < self.end[:, None])

    @property
    def sums(self) -> np.ndarray:
        """Sums of the qualities before each place."""
        if self._sums is None:
            self._sums = np.zeros((self.rows, self.width + 1), np.int64)
            np.cumsum(self.q, axis=1, out=self._sums[:, 1:])
        return self._sums

    def drop(self, where: np.ndarray) -> None:
        self.alive &= ~where

    def narrow(self, start: np.ndarray, n: np.ndarray) -> None:
        """Keep ``n`` bases from ``start``; what is dropped is of no length, so that later steps may look at it."""
        self.start, self.n = np.where(self.alive, start, 0), np.where(self.alive, n, 0)

    def aligned(self, matrix: np.ndarray, pad: int = 0) -> np.ndarray:
        """The kept parts moved to the left, padded with 0."""
        w = int(self.n.max(initial=0))
        at = self.start[:, None] + np.arange(w)
        out = np.zeros((self.rows, w + pad), matrix.dtype)
        if w:
            moved = np.take_along_axis(matrix, np.minimum(at, self.width - 1), axis=1)
            out[:, :w] = np.where(np.arange(w) < self.n[:, None], moved, 0)
        return out


def first_true(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first true column of each row, and whether there is one."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = x.argmax(axis=1)
    return at, x[np.arange(len(x)), at]


def last_true(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, there = first_true(x[:, ::-1])
    return x.shape[1] - 1 - at, there
