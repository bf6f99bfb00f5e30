"""Adapter clipping: simple matches anywhere, palindrome matches of read-through pairs.

Seeds compare 16 bases at once: each base is one of four bits, anything else is 0, so the
bits that differ count a mismatch as 2 and a base against N or padding as 1. Seeds are part
of the semantics: an offset without a seed is never scored.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from readloom.operators.batch import Batch, letters
from readloom.operators.steps import BatchStep, register
from readloom.sources.fasta import find_adapters, read_fasta

log = logging.getLogger("readloom")

MATCH = np.float32(0.60206)  # what a matching base scores: log10 of 4
SEED = 16
STRIDE = 4  # only every fourth seed of a long sequence is looked for
SHORT, MEDIUM = 16, 24  # lengths from which a sequence is medium, long
PREFIX_QUALITY = 100

# fixed values: the bit of each base
_BITS = np.zeros(256, np.uint64)
_BITS[np.frombuffer(b"ACGT", np.uint8)] = [1, 4, 8, 2]
_OTHER = np.full(256, ord("N"), np.uint32)
_OTHER[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)


def _bits(chars: np.ndarray) -> np.ndarray:
    return _BITS[np.where(chars < 256, chars, 0)]


def _complement(chars: np.ndarray) -> np.ndarray:
    return _OTHER[np.where(chars < 256, chars, 0)]


def _words(bits: np.ndarray, reverse: bool = False) -> np.ndarray:
    """The 16 bases from each column on as one integer; columns past the end are padding.

    ``reverse`` reads them the other way round, the first base lowest.
    """
    out, done = bits, 1
    while done < SEED:
        later = np.zeros_like(out)
        later[:, : out.shape[1] - done] = out[:, done:]
        shift = np.uint64(4 * done)
        out = out | (later << shift) if reverse else (out << shift) | later
        done *= 2
    return out


def _mask(bases: np.ndarray) -> np.ndarray:
    """The bits of the first ``bases`` of 16; no mask has fewer bits than for one base."""
    gone = np.clip(SEED - bases, 0, SEED - 1).astype(np.uint64) * np.uint64(4)
    return np.uint64(0xFFFFFFFFFFFFFFFF) << gone


@dataclass(frozen=True)
class Adapters:
    """Sequences to clip by side, and the pairs of prefixes that read-through leaves."""

    pairs: tuple[tuple[str, str], ...] = ()
    forward: tuple[str, ...] = ()
    reverse: tuple[str, ...] = ()
    common: tuple[str, ...] = ()


def sort_adapters(records: list[tuple[str, str]]) -> Adapters:
    """Sides by name: ``/1`` forward, ``/2`` reverse, else both; ``Prefix`` with both suffixes is a pair.

    A later record replaces one of the same name; within a side each sequence counts once.
    """
    sides: dict[str, dict[str, str]] = {"/1": {}, "/2": {}, "": {}}
    for name, sequence in records:
        sides[name[-2:] if name[-2:] in ("/1", "/2") else ""][name] = sequence
    both = [n[:-2] for n in sides["/1"] if n.startswith("Prefix") and n[:-2] + "/2" in sides["/2"]]
    pairs = []
    for n in both:
        one, two = sides["/1"].pop(n + "/1"), sides["/2"].pop(n + "/2")
        m = min(len(one), len(two))
        pairs.append((one[len(one) - m :], two[len(two) - m :]))
    unique = lambda s: tuple(dict.fromkeys(sides[s].values()))
    return Adapters(tuple(pairs), unique("/1"), unique("/2"), unique(""))


@dataclass
class AdapterClip(BatchStep):
    """ILLUMINACLIP: keep what lies before the leftmost adapter; nothing before it drops the read."""

    adapters: Adapters
    seed_mismatches: int
    palindrome: int
    simple: int
    least_prefix: int = 8
    keep_both: bool = False

    def __post_init__(self):
        self.least_overlap = min(15, int(np.float32(self.simple) / MATCH))

    def run(self, reads: list[Batch]) -> None:
        far = np.iinfo(np.int32).max
        laid = [_Reads(b) for b in reads]
        keep = [np.full(b.rows, far, np.int64) for b in reads]
        if len(reads) == 2:
            both = np.flatnonzero(reads[0].alive & reads[1].alive)
            for pair in self.adapters.pairs:
                at, kept = self._palindromes(laid[0].take(both), laid[1].take(both), *pair)
                hit = both[at]
                keep[0][hit] = np.minimum(keep[0][hit], kept)
                keep[1][hit] = np.minimum(keep[1][hit], kept) if self.keep_both else 0
        for b, r, k, mine in zip(reads, laid, keep, (self.adapters.forward, self.adapters.reverse)):
            for seq in dict.fromkeys(mine + self.adapters.common):
                self._simple(r, seq, k)
            b.drop(k <= 0)
            b.narrow(b.start, np.minimum(k, b.n))

    def _simple(self, reads: _Reads, clip: str, keep: np.ndarray) -> None:
        """Lower ``keep`` to the leftmost offset at which the sequence matches."""
        over = self.least_overlap
        chars, _ = letters(pa.array([clip]))
        chars = chars[0]
        size = len(chars)
        words = _words(_bits(np.append(chars, np.zeros(SEED, chars.dtype)))[None, :])[0]
        if size < SHORT:
            seeds = [(j, words[j], _mask(np.array([size]))[0]) for j in range(size - over)]
        elif size < MEDIUM:
            seeds = [(j, words[j], _mask(np.array([SEED]))[0]) for j in range(size - SEED + 1)]
        else:
            seeds = [(j, words[j], _mask(np.array([SEED]))[0]) for j in range(0, size - SEED + 1, STRIDE)]
        row, col, read_words, read_mask = reads.places(over)
        if not len(row) or not seeds:
            return
        found = []
        for j, word, mask in seeds:
            near = np.flatnonzero(np.bitwise_count((read_words ^ word) & (read_mask & mask)) <= 2 * self.seed_mismatches)
            found.append(row[near] * (1 << 32) + (col[near] - j) + (1 << 31))
        candidates = np.unique(np.concatenate(found))
        r = candidates >> 32
        off = (candidates & 0xFFFFFFFF) - (1 << 31)
        overlap = np.minimum(reads.n[r] - np.maximum(off, 0), size - np.maximum(-off, 0))
        fit = overlap > over
        r, off, overlap = r[fit], off[fit], overlap[fit]
        if not len(r):
            return
        good = self._run_scores(reads, r, off, overlap, chars) >= np.float32(self.simple)
        np.minimum.at(keep, r[good], off[good])

    def _run_scores(self, reads: _Reads, r: np.ndarray, off: np.ndarray, overlap: np.ndarray, clip: np.ndarray) -> np.ndarray:
        """The greatest sum of scores between mismatches, added base by base in 32-bit floats."""
        at, cat = np.maximum(off, 0), np.maximum(-off, 0)
        best = np.zeros(len(r), np.float32)
        run = np.zeros(len(r), np.float32)
        for i in range(int(overlap.max())):
            on = i < overlap
            x = reads.chars[r, np.minimum(at + i, reads.width - 1)]
            y = clip[np.minimum(cat + i, len(clip) - 1)]
            q = reads.quality[r, np.minimum(at + i, reads.width - 1)]
            value = np.where((x == ord("N")) | (y == ord("N")), np.float32(0), np.where(x == y, MATCH, (-q).astype(np.float32) / np.float32(10)))
            run = np.where(on, np.where(value < 0, np.float32(0), run + value), run)
            best = np.maximum(best, run)
        return best

    def _palindromes(self, a: _Reads, b: _Reads, one: str, two: str) -> tuple[np.ndarray, np.ndarray]:
        """(pair, bases kept) of the pairs that read through into the prefixes; the shortest insert wins.

        The forward read behind its prefix is compared with the reverse complement of the
        reverse read behind its own, from the diagonal of no insert on.
        """
        p = len(one)
        x, y = a.behind(one), b.behind(two)
        words_x, words_y = x.words, _words(_bits(_complement(y.chars)) * (y.inside), reverse=True)
        words_x2 = x.words
        # both reads need a whole seed behind the prefix
        places_x, places_y = x.n - SEED + 1, y.n - SEED + 1
        on = np.flatnonzero((places_x > p) & (places_y > p))
        step = max(p - SEED, 0)
        ref = np.full(len(on), p)
        test = np.full(len(on), step)
        last = np.maximum(x.n, y.n)[on] - (SEED - 1) - self.least_prefix
        hits, kept = [], []
        most = 2 * self.seed_mismatches
        while len(on):
            go = step < last
            on, ref, test, last = on[go], ref[go], test[go], last[go]
            if not len(on):
                break
            in_y, in_x = test < places_y[on], test < places_x[on]
            seed = in_y & (np.bitwise_count(words_x[on, ref] ^ words_y[on, np.where(in_y, test, 0)]) <= most)
            seed |= in_x & (np.bitwise_count(words_y[on, ref] ^ words_x2[on, np.where(in_x, test, 0)]) <= most)
            near = np.flatnonzero(seed)
            done = np.zeros(len(on), bool)
            if len(near):
                total = step + p + SEED
                good = self._palindrome_scores(x, y, on[near], total, p) >= np.float32(self.palindrome)
                done[near[good]] = True
                hits.append(on[done])
                kept.append(np.full(int(done.sum()), total - 2 * p))
            step += 1
            up = (step % 2 == 0) & (ref + 1 < places_x[on]) & (ref + 1 < places_y[on])
            ref, test = np.where(up, ref + 1, ref), np.where(up, test, test + 1)
            on, ref, test, last = on[~done], ref[~done], test[~done], last[~done]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(hits), np.concatenate(kept)

    def _palindrome_scores(self, x: _Reads, y: _Reads, r: np.ndarray, total: int, p: int) -> np.ndarray:
        skip_y = np.maximum(total - x.n[r], 0)
        skip_x = np.maximum(total - y.n[r], 0)
        overlap = total - skip_x - skip_y
        i = np.arange(int(overlap.max(initial=0)))
        on = i < overlap[:, None]
        at = np.where(on, i + skip_x[:, None], 0)
        back = np.where(on, (skip_y + overlap - 1)[:, None] - i, 0)
        rows = r[:, None]
        c, d = x.chars[rows, at], _complement(y.chars[rows, back])
        q = np.minimum(x.quality[rows, at], y.quality[rows, back])
        value = np.where(c == d, MATCH, np.trunc(-q / 10).astype(np.float32))
        value = np.where(on & (c != ord("N")) & (d != ord("N")), value, np.float32(0)).astype(np.float32)
        # cumsum adds in order, which a plain sum of floats does not
        return np.cumsum(value, axis=1, dtype=np.float32)[:, -1] if value.shape[1] else np.zeros(len(r), np.float32)


class _Reads:
    """A batch of reads as padded matrices."""

    def __init__(self, batch: Batch | None = None, chars=None, n=None, quality=None):
        if batch is not None:
            chars, quality, n = batch.aligned(batch.chars, SEED), batch.aligned(batch.q, SEED), batch.n
        self.chars, self.n, self.quality = chars, n, quality
        self.count, self.width = chars.shape
        self._words = self._places = None

    @property
    def inside(self) -> np.ndarray:
        return (np.arange(self.width) < self.n[:, None]).astype(np.uint64)

    @property
    def words(self) -> np.ndarray:
        if self._words is None:
            self._words = _words(_bits(self.chars))
        return self._words

    def take(self, rows: np.ndarray) -> _Reads:
        return _Reads(chars=self.chars[rows], n=self.n[rows], quality=self.quality[rows])

    def behind(self, prefix: str) -> _Reads:
        """The reads with a prefix of full quality before them."""
        head = letters(pa.array([prefix]))[0]
        chars = np.concatenate([np.repeat(head, self.count, axis=0), self.chars], axis=1)
        quality = np.concatenate([np.full((self.count, len(prefix)), PREFIX_QUALITY, np.int32), self.quality], axis=1)
        return _Reads(chars=chars, n=self.n + len(prefix), quality=quality)

    def places(self, over: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, word, mask) of all places with more than ``over`` bases from there to the end; the same for all sequences."""
        if self._places is None or self._places[0] != over:
            row, col = np.nonzero(np.arange(self.width) < (self.n - over)[:, None])
            self._places = over, (row, col, self.words[row, col], _mask(self.n[row] - col))
        return self._places[1]


def make_clip(adapters: Adapters, args: list[str]) -> AdapterClip:
    mismatches, palindrome, simple = (int(x) for x in args[:3])
    least_prefix = int(args[3]) if len(args) > 3 else 8
    keep_both = len(args) > 4 and args[4].lower() == "true"
    return AdapterClip(adapters, mismatches, palindrome, simple, least_prefix, keep_both)


def _clip(args: str) -> AdapterClip:
    """``fasta:seedMismatches:palindromeThreshold:simpleThreshold[:minPrefix[:keepBoth]]``; the path may hold colons."""
    v = args.split(":")
    tail = 0
    while tail < len(v) and (v[-1 - tail].lstrip("-").isdigit() or v[-1 - tail].lower() in ("true", "false")):
        tail += 1
    # at most five numbers and words belong to the step, the rest to the path
    tail = min(tail, 5, len(v) - 1)
    path, rest = ":".join(v[: len(v) - tail]), v[len(v) - tail :]
    if len(rest) < 3:
        raise ValueError(f"ILLUMINACLIP needs a file and three thresholds: {args}")
    adapters = sort_adapters(read_fasta(find_adapters(path)))
    log.info("ILLUMINACLIP: Using %d prefix pairs, %d forward/reverse sequences, %d forward only sequences, %d reverse only sequences", len(adapters.pairs), len(adapters.common), len(adapters.forward), len(adapters.reverse))
    return make_clip(adapters, rest)


register("ILLUMINACLIP", _clip)
