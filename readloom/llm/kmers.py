"""Vectorised 2-bit coding of sequences for the operators that work on substrings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASES = 4_000_000  # bases that are read at a time

_CODES = np.full(256, 4, np.uint8)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = [0, 1, 2, 3]


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes 0..3 (4: anything else) of all texts in a row, each followed by one 4; starts and lengths."""
    joined = "N".join(texts) + "N"
    raw = joined.encode("ascii", "replace")  # a character for a character
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    return _CODES[np.frombuffer(raw, np.uint8)], np.cumsum(length + 1) - length - 1, length


def windows(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers at all positions as integers, first base highest, and which of them hold only ACGT."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    kind = np.uint16 if k <= 8 else np.uint32 if k <= 16 else np.uint64
    two = (codes & 3).astype(kind)
    # doubling: a window of 2m bases is two windows of m
    done, out = 1, two
    built = {1: two}
    while done * 2 <= k:
        out = (out[: len(out) - done] << kind(2 * done)) | out[done:]
        done *= 2
        built[done] = out
    at, value, left = done, out, k - done
    while left:
        step = 1 << (left.bit_length() - 1)
        part = built[step]
        m = min(len(value), len(part) - at)
        value = (value[:m] << kind(2 * step)) | part[at : at + m]
        at += step
        left -= step
    bad = np.concatenate([np.zeros(1, np.int64), np.cumsum(codes == 4)])
    return value[:n], bad[k:] == bad[:-k]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch that hold a bounded number of bases, or one record: Arrow batches are bounded in rows."""
    if not batch.num_rows:
        return
    group = np.cumsum(np.fromiter(map(len, batch.column("seq").to_pylist()), np.int64, batch.num_rows)) // BASES
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for a, b in zip(cut, np.append(cut[1:], len(group))):
        yield batch.slice(a, b - a)
