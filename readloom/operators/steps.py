"""Trimming steps: each shortens, keeps or drops a read.

A ``ColumnStep`` is an expression over one read and its slot (0 forward, 1 reverse) and
runs inside the JVM. A ``BatchStep`` works on the matrices of an Arrow batch. Most steps are
both: the JVM has no vectorised operation over the bases of a read, and its lambdas take
tens of times longer for them, so the chain lets it do the ``light`` steps only, which
need no look at single bases. New steps are added with ``register``.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.operators.batch import Batch, first_true, last_true
from readloom.functions.quality import SHIFT, cut, first_good, let, masked_quality, quality_values, recoded, shifted

log = logging.getLogger("readloom")

UNBOUNDED = 2**31 - 1


class Step:
    """A parsed step; ``text`` is what it was parsed from."""

    text: str = ""
    light: bool = False


class ColumnStep(Step):
    def apply(self, read: Column, slot: Column, slots: int) -> Column:
        """The shortened read, or null to drop it."""
        raise NotImplementedError


class BatchStep(Step):
    def run(self, reads: list[Batch]) -> None:
        """Narrow or drop the reads of a batch, one or two to a row; by default slot by slot."""
        for slot, batch in enumerate(reads):
            self.narrow(batch, slot, len(reads))

    def narrow(self, b: Batch, slot: int, slots: int) -> None:
        raise NotImplementedError


_registry: dict[str, Callable[[str], Step]] = {}


def register(name: str, make: Callable[[str], Step]) -> None:
    """Make ``NAME[:args]`` available in step lists; ``make`` gets the text after the colon."""
    _registry[name] = make


def parse_step(text: str) -> Step:
    """One step from ``NAME[:args]``; names are case-sensitive and unknown ones raise."""
    at = text.find(":")
    name, args = (text[:at], text[at + 1 :]) if at > 0 else (text, "")
    if name not in _registry:
        raise ValueError(f"unknown step {name}")
    step = _registry[name](args)
    step.text = text
    return step


def parse_steps(texts: list[str]) -> list[Step]:
    return [parse_step(t) for t in texts]


def _length(read: Column) -> Column:
    return F.length(read["sequence"])


@dataclass
class Leading(ColumnStep, BatchStep):
    """Cut bases of low quality off the start; a read without a good base is dropped."""

    quality: int

    def narrow(self, b, slot, slots):
        at, there = first_true(b.inside & (b.q >= self.quality))
        b.drop(~there)
        b.narrow(at, b.end - at)

    def apply(self, read, slot, slots):
        at = first_good(masked_quality(read), read, self.quality)
        return let(at, lambda p: F.when(p > 0, cut(read, p - 1, _length(read) - p + 1)))


@dataclass
class Trailing(ColumnStep, BatchStep):
    """Cut bases of low quality off the end; the first base is never looked at, so it alone does not save a read."""

    quality: int

    def narrow(self, b, slot, slots):
        at, there = last_true(b.inside & (b.q >= self.quality))
        b.drop(~there | (at <= b.start))
        b.narrow(b.start, at + 1 - b.start)

    def apply(self, read, slot, slots):
        from_end = first_good(F.reverse(masked_quality(read)), read, self.quality)
        return let(from_end, lambda p: F.when((p > 0) & (p < _length(read)), cut(read, F.lit(0), _length(read) - p + 1)))


@dataclass
class EndCrop(ColumnStep, BatchStep):
    """Drop bases at one end and what exceeds a greatest length, by slot (first, middle, last)."""

    head: bool
    bases: tuple[int, int, int]
    longest: tuple[int, int, int]

    light = True

    def narrow(self, b, slot, slots):
        k = 0 if slot == 0 else 2 if slot == slots - 1 else 1
        gone = self.bases[k] + np.maximum(0, b.n - self.bases[k] - self.longest[k])
        b.drop(b.n <= gone)
        b.narrow(b.start + gone * self.head, b.n - gone)

    def apply(self, read, slot, slots):
        # the first slot is the first read, the last slot the last one if there are several
        def by_slot(v):
            out = F.when(slot == 0, F.lit(v[0]))
            if slots > 1:
                out = out.when(slot == slots - 1, F.lit(v[2]))
            return out.otherwise(F.lit(v[1])).cast("long")

        n = _length(read)
        bases = by_slot(self.bases)
        cropped = (bases + F.greatest(F.lit(0), n - bases - by_slot(self.longest))).cast("int")
        return let(cropped, lambda gone: F.when(n > gone, F.when(gone == 0, read).otherwise(cut(read, gone if self.head else F.lit(0), n - gone))))


def _end_crop(head: bool) -> Callable[[str], Step]:
    def make(args: str) -> Step:
        v = [int(x) for x in args.split(":")]
        no_limit = UNBOUNDED // 2
        if len(v) == 1:
            return EndCrop(head, (v[0],) * 3, (no_limit,) * 3)
        if len(v) == 2:
            return EndCrop(head, (v[0],) * 3, (v[1],) * 3)
        if len(v) == 4:
            return EndCrop(head, (v[0], v[0], v[2]), (v[1], v[1], v[3]))
        if len(v) == 6:
            return EndCrop(head, (v[0], v[2], v[4]), (v[1], v[3], v[5]))
        log.warning("%s with %d arguments has no effect", "HEADCROP" if head else "TAILCROP", len(v))
        return EndCrop(head, (0,) * 3, (no_limit,) * 3)

    return make


@dataclass
class Crop(ColumnStep, BatchStep):
    """Keep the first bases; 0 leaves an empty read that survives."""

    length: int

    light = True

    def narrow(self, b, slot, slots):
        b.narrow(b.start, np.minimum(b.n, self.length))

    def apply(self, read, slot, slots):
        return F.when(_length(read) < self.length, read).otherwise(cut(read, F.lit(0), F.lit(self.length)))


@dataclass
class SlidingWindow(ColumnStep, BatchStep):
    """Cut where the mean quality of a window falls below the threshold, then low bases off the new end.

    Reads shorter than the window and reads whose first window is low are dropped; at least one base stays.
    """

    window: int
    quality: float

    def narrow(self, b, slot, slots):
        w, least = self.window, np.float32(np.float32(self.quality) * np.float32(self.window))
        b.drop(b.n < w)
        b.narrow(b.start, b.n)
        if b.width < w:
            return
        at = np.arange(b.width - w + 1)
        low = (b.sums[:, w:] - b.sums[:, :-w]) < least
        first, there = first_true(low & (at >= b.start[:, None]) & (at + w <= b.end[:, None]))
        b.drop(there & (first == b.start))
        b.narrow(b.start, np.where(there, first - b.start + w - 1, b.n))
        last, good = last_true(b.inside & (b.q >= np.float32(self.quality)))
        b.narrow(b.start, np.where(good, last + 1 - b.start, 1))

    def apply(self, read, slot, slots):
        w = self.window
        # sums are integers: below a limit is below the next integer up
        least = int(np.ceil(float(np.float32(np.float32(self.quality) * np.float32(w)))))
        n = _length(read)

        def place(q: Column) -> Column:
            total = lambda i: sum((F.get(q, i + j) for j in range(1, w)), F.get(q, i))
            low = F.transform(F.sequence(F.lit(0), n - w), lambda i: total(i) < least)
            return F.array_position(low, True).cast("int")

        def shorten(kept: Column) -> Column:
            # places from the end of what the windows left; at least one base stays
            start = F.reverse(F.substring(masked_quality(read), F.lit(1), kept))
            bad = let(first_good(start, read, int(np.ceil(self.quality))), lambda p: F.when(p == 0, kept - 1).otherwise(p - 1))
            return let(kept - bad, lambda left: F.when(left < n, cut(read, F.lit(0), left)).otherwise(read))

        # place 1 is a low first window, which drops the read
        done = let(let(quality_values(read), place), lambda f: F.when(f != 1, let(F.when(f == 0, n).otherwise(f + w - 2), shorten)))
        return F.when(n >= w, done)


@dataclass
class MinLength(ColumnStep, BatchStep):
    length: int

    light = True

    def narrow(self, b, slot, slots):
        b.drop(b.n < self.length)
        b.narrow(b.start, b.n)

    def apply(self, read, slot, slots):
        return F.when(_length(read) >= self.length, read)


@dataclass
class MaxLength(ColumnStep, BatchStep):
    length: int

    light = True

    def narrow(self, b, slot, slots):
        b.drop(b.n > self.length)
        b.narrow(b.start, b.n)

    def apply(self, read, slot, slots):
        return F.when(_length(read) <= self.length, read)


@dataclass
class AverageQuality(ColumnStep, BatchStep):
    """Keep reads of at least this mean quality; the empty read stays."""

    quality: int

    def narrow(self, b, slot, slots):
        r = np.arange(b.rows)
        b.drop(b.sums[r, b.end] - b.sums[r, b.start] < self.quality * b.n)
        b.narrow(b.start, b.n)

    def apply(self, read, slot, slots):
        total = F.aggregate(quality_values(read), F.lit(0).cast("long"), lambda a, q: a + q)
        return F.when(total >= F.lit(self.quality) * _length(read), read)


@dataclass
class BaseCount(ColumnStep, BatchStep):
    """Keep reads in which the given characters occur at least and at most so often."""

    bases: str
    least: int = 0
    most: int | None = None

    light = True

    def narrow(self, b, slot, slots):
        count = (b.inside & np.isin(b.chars, [ord(c) for c in self.bases])).sum(axis=1)
        b.drop((count < self.least) | (count > (UNBOUNDED if self.most is None else self.most)))
        b.narrow(b.start, b.n)

    def apply(self, read, slot, slots):
        n = _length(read) - F.length(F.translate(read["sequence"], self.bases, ""))
        fits = n >= self.least
        return F.when(fits if self.most is None else fits & (n <= self.most), read)


@dataclass
class ToPhred(ColumnStep, BatchStep):
    """Re-encode qualities with the other offset."""

    offset: int

    light = True

    def narrow(self, b, slot, slots):
        # the quality values stay; the text is shifted when the chain ends
        b.offset = np.full(b.rows, self.offset, np.int32)

    def apply(self, read, slot, slots):
        by = -SHIFT if self.offset == 33 else SHIFT
        return F.when(read["phred_offset"] == self.offset, read).otherwise(recoded(read, shifted(read["quality"], by), self.offset))


@dataclass
class MaxInfo(BatchStep):
    """Cut where the balance of length and error rate is best; 64-bit fixed-point scores that wrap around."""

    target: int
    strictness: float
    tables: tuple[np.ndarray, np.ndarray] = field(default=None, repr=False)

    LONGEST = 1000
    HIGHEST = 60

    def __post_init__(self):
        s = np.float32(self.strictness)
        rest = np.float32(1) - s
        i = np.arange(self.LONGEST, dtype=np.float64)
        with np.errstate(over="ignore", divide="ignore"):
            unique = np.log(1.0 / (1.0 + np.exp(self.target - i - 1)))
        by_length = unique + np.log(i + 1) * float(rest)
        q = np.arange(self.HIGHEST + 1, dtype=np.float64)
        by_quality = np.log(1.0 - np.power(0.1, (0.5 + q) / 10.0)) * float(s)

        def ratio(v):
            with np.errstate(divide="ignore"):
                return np.float64(2**63 - 1) / (max(v[0], np.abs(v[1:]).max()) * 2 * self.LONGEST)

        scale = max(ratio(by_length), ratio(by_quality))

        def fixed(v):
            with np.errstate(invalid="ignore"):
                x = np.nan_to_num(np.trunc(v * scale), nan=0.0, posinf=np.inf, neginf=-np.inf)
            top = float(2**63)
            out = np.clip(x, -top, np.nextafter(top, 0)).astype(np.int64)
            return np.where(x >= top, np.int64(2**63 - 1), out)

        self.tables = fixed(by_length), fixed(by_quality)

    def narrow(self, b, slot, slots):
        if b.n[b.alive].max(initial=0) > self.LONGEST:
            raise ValueError(f"MAXINFO takes reads of at most {self.LONGEST} bases")
        q = b.aligned(b.q)
        w = q.shape[1]
        if not w:
            b.drop(b.n == 0)
            return
        by_length, by_quality = self.tables
        with np.errstate(over="ignore"):
            scores = by_length[:w] + np.cumsum(by_quality[np.clip(q, 0, self.HIGHEST)], axis=1, dtype=np.int64)
        # scores are compared as doubles, so near ties count as ties; the last of equal maxima counts
        scores = np.where(np.arange(w) < b.n[:, None], scores.astype(np.float64), -np.inf)
        best = scores.max(axis=1)
        last, _ = last_true((scores == best[:, None]) & (np.arange(w) < b.n[:, None]))
        b.drop((b.n == 0) | (best == 0))
        b.narrow(b.start, np.minimum(last + 1, b.n))


register("LEADING", lambda a: Leading(int(a)))
register("TRAILING", lambda a: Trailing(int(a)))
register("HEADCROP", _end_crop(True))
register("TAILCROP", _end_crop(False))
register("CROP", lambda a: Crop(int(a)))
register("SLIDINGWINDOW", lambda a: SlidingWindow(int(a.split(":")[0]), float(a.split(":")[1])))
register("MAXINFO", lambda a: MaxInfo(int(a.split(":")[0]), float(a.split(":")[1])))
register("MINLEN", lambda a: MinLength(int(a)))
register("MAXLEN", lambda a: MaxLength(int(a)))
register("AVGQUAL", lambda a: AverageQuality(int(a)))
register("TOPHRED33", lambda a: ToPhred(33))
register("TOPHRED64", lambda a: ToPhred(64))


def _base_count(args: str) -> Step:
    v = args.split(":")
    return BaseCount(v[0], int(v[1]) if len(v) > 1 else 0, int(v[2]) if len(v) > 2 else None)


register("BASECOUNT", _base_count)
