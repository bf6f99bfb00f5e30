"""Near-duplicate sequences by PartEnum signatures over sets of k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.sequence import content_key
from readloom.llm.kmers import by_size, encode, mix, windows
from readloom.session import broadcast_if_small, materialize

K = 12
FULL = 0.7  # share of the common k-mers of a band that may be without a signature: its number of parts
LEAST_PARTS = 5  # parts from which pairs of k-mers are fewer than is worth their while
MEETINGS = 2  # signatures that two sets must have in common
INNER = 4  # bases of the least substring of a k-mer, which places it in a part
LEAST_COMMON = 3  # common k-mers that are asked for among the rarest of two sets that hold many frequent ones
HOT_TEXTS = 8  # texts of the sample that hold a k-mer that counts as frequent; this changes the cost, never the result
HOT = 1 << 18  # most frequent k-mers of the sample that are told apart; so does this
SAMPLE = 50_000  # texts in which k-mers are counted for this
LEVEL = int(8 * np.log2(HOT_TEXTS))
SLOT_BITS = 24
BUCKET_ROWS = 1_000_000  # rows that a task pairs at a time
SIGNATURES = 120  # signatures of a text, about: this sets the number of buckets
SPARE_BITS = 12  # bits of a signature beyond those that tell all signatures apart

KMERS = pa.schema([("bucket", pa.int32()), ("sig", pa.binary()), ("rep", pa.binary()), ("rank", pa.binary()), ("size", pa.binary())])
MET = pa.schema([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
KMERS_SQL, MET_SQL, PAIR_SQL = "bucket int, sig binary, rep binary, rank binary, size binary", "bucket int, a binary, b binary", "a long, b long"
MOST_TASKS = 20_000  # a task takes several buckets, one after the other, when there are more
TILE = 1024  # sets of a large group that are paired with each other at a time


def classes(df: DataFrame, text: Column) -> DataFrame:
    """One row ``(rep, seq)`` per distinct non-null text, written down; ``rep`` numbers the texts, with gaps."""
    seqs = df.select(text.alias("seq")).where("seq IS NOT NULL").distinct()
    return materialize(seqs.select(F.monotonically_increasing_id().alias("rep"), "seq"), "classes")


def _sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, k-mer) of all distinct k-mers of each text in this order, and the sizes of the sets."""
    codes, _, length = encode(texts)
    kmer, whole = windows(codes, k)
    at = np.flatnonzero(whole)
    row = np.repeat(np.arange(len(texts)), length + 1)[at]
    packed = (row.astype(np.uint64) << np.uint64(2 * k)) | kmer[at].astype(np.uint64)
    packed.sort()
    if len(packed):
        packed = packed[np.append(True, packed[1:] != packed[:-1])]
    row = (packed >> np.uint64(2 * k)).astype(np.int64)
    return row, packed & np.uint64(4**k - 1), np.bincount(row, minlength=len(texts))


def _scramble(kmer: np.ndarray, k: int) -> np.ndarray:
    """Another k-mer for each, one to one, so that neighbours in the alphabet are far apart."""
    x = kmer ^ (kmer >> np.uint64(k))
    x = (x * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(4**k - 1)
    return x ^ (x >> np.uint64(k))


def _overlap(sizes: np.ndarray, gamma: float) -> np.ndarray:
    """Common k-mers that two sets of together ``sizes`` need for the similarity ``gamma``."""
    return np.ceil(gamma / (1 + gamma) * sizes - 1e-9).astype(np.int64)


def _narrow(x: np.ndarray) -> bytes:
    """Integers as their least value, a width and the differences to it in that many bytes."""
    if not len(x):
        return b""
    base = x.min()
    y = (x - base).astype(np.uint64)
    width = next(w for w in (1, 2, 3, 4, 8) if int(y.max()) < 256**w)
    cells = y.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3] if width == 3 else y.astype(f"<u{width}")
    return np.int64(base).tobytes() + bytes([width]) + cells.tobytes()


def _wide(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.int64)
    if packed[8] == 3:
        cells = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, 3)
        y = np.pad(cells, ((0, 0), (0, 1))).view("<u4").ravel()
    else:
        y = np.frombuffer(packed, f"<u{packed[8]}", offset=9)
    return y.astype(np.int64) + np.frombuffer(packed, np.int64, 1)[0]


def _packed(bucket: np.ndarray, columns: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    """One row for each run of ``bucket``; the first column, which rises within it, as its first value and differences. Columns that are not given are null."""
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(start[1:], len(bucket))
    cells = [[np.int64(x[i]).tobytes() + _narrow(np.diff(x[i:j])) if c == 0 else _narrow(x[i:j]) for i, j in zip(start, ends)] for c, x in enumerate(columns)]
    none = [pa.nulls(len(start), pa.binary())] * (len(schema) - 1 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(bucket[start].astype(np.int32)), *(pa.array(x, pa.binary()) for x in cells), *none], schema=schema)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each bucket with its columns as a whole, from packed rows sorted by bucket; null columns are left out."""
    of, held = None, []
    for batch in batches:
        for bucket, first, *rest in zip(batch.column(0).to_pylist(), *(c.to_pylist() for c in batch.columns[1:])):
            if bucket != of and held:
                yield of, [np.concatenate(x) for x in zip(*held)]
                held = []
            of = bucket
            rising = np.cumsum(np.concatenate([np.frombuffer(first, np.int64, 1), _wide(first[8:])]))
            held.append([rising, *(_wide(x) for x in rest if x is not None)])
    if held:
        yield of, [np.concatenate(x) for x in zip(*held)]


def _frequent(k: int, hot: int):
    """Over a sample: one row of the ``hot`` most frequent slots of k-mers and a level for each, a higher one for more texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            _, kmer, _ = _sets(batch.column("seq").to_pylist(), k)
            slot, n = np.unique(_scramble(kmer, k) & np.uint64((1 << SLOT_BITS) - 1), return_counts=True)
            count[slot.astype(np.int64)] += n
        seen = np.flatnonzero(count > 1)
        if len(seen) > hot:
            seen = seen[np.argpartition(count[seen], -hot)[-hot:]]
        level = np.minimum(255, 8 * np.log2(count[seen])).astype(np.uint8)  # LEVEL for HOT_TEXTS
        yield pa.RecordBatch.from_arrays([pa.array([seen.astype(np.uint32).tobytes()]), pa.array([level.tobytes()])], names=["slot", "level"])

    return run


class Bands:
    """Bands of set sizes, and for each the parts of its domain.

    The band of two sets is that of the larger one. Its sets are at most 1 / gamma times as large as its least, so that a set
    takes part in its own band and, as the smaller one, in the next ones that a similar set can belong to.
    """

    def __init__(self, gamma: float, least: int, largest: int):
        self.gamma, self.least, self.low = gamma, least, [least]
        while self.low[-1] / gamma <= largest and len(self.low) < 64:
            self.low.append(max(self.low[-1] + 1, int(np.ceil(self.low[-1] / gamma - 1e-9))))
        low = np.array(self.low)
        full = FULL * _overlap(low + np.maximum(least, np.ceil(gamma * low - 1e-9)), gamma)
        self.parts = np.where(full >= LEAST_PARTS, full, 0).astype(np.int64)

    def common(self, band: int, size: np.ndarray) -> np.ndarray:
        """The least number of k-mers that a set shares with one that is similar, if the larger one of both is in the band; 0 if there is none."""
        low = self.low[band]
        high = self.low[band + 1] if band + 1 < len(self.low) else np.inf
        own = (size >= low) & (size < high)
        partner = np.where(own, np.maximum(self.least, np.ceil(self.gamma * size - 1e-9)), low)
        fit = own | (size < low) & (size >= self.gamma * low - 1e-9) & (size >= self.least)
        return np.where(fit, _overlap(size + partner, self.gamma), 0)


def _part(kmer: np.ndarray, parts: int, k: int) -> np.ndarray:
    """The part of each k-mer: that of its substring of least hash, moved on by the place of this.

    Any cut of the domain will do. In this one neighbours in a text mostly hold the same substring at different places and so
    lie in different parts: two k-mers that overlap tell little more than one.
    """
    m = min(INNER, k)
    order = mix(np.arange(4**m, dtype=np.uint64)) >> np.uint64(40)
    least = np.full(len(kmer), np.iinfo(np.int64).max)
    for at in range(k - m + 1):
        inner = (kmer >> np.uint64(2 * at)) & np.uint64(4**m - 1)
        least = np.minimum(least, (order[inner.astype(np.int64)].astype(np.int64) << 8) | at)
    return ((least >> 8) + (least & 255)) % parts


def _pairs_in_parts(row: np.ndarray, kmer: np.ndarray, parts: int, band: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) for every two k-mers of a row that lie in one part."""
    group = row * parts + _part(kmer, parts, k)
    by = np.lexsort((kmer, group))
    group, kmer, row = group[by], kmer[by], row[by]
    rows, sigs = [], []
    far, at = 1, np.arange(len(group))
    while len(at):
        at = at[at + far < len(group)]
        at = at[group[at] == group[at + far]]
        rows.append(row[at])
        sigs.append(mix(mix(kmer[at] + (np.uint64(band + 1) << np.uint64(56))) + kmer[at + far]))
        far += 1
    return np.concatenate(rows) if rows else row, np.concatenate(sigs) if sigs else kmer


def _signatures(k: int, bands: Bands, common: int, plan: tuple[int, int, int], frequent):
    """The signatures of each set: in buckets below the first number of ``plan`` those of two k-mers, above the single k-mers of sets that need them."""
    pair_buckets, kmer_buckets, bits = plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.zeros(1 << SLOT_BITS, np.uint8)
        slot, value = frequent.value
        level[np.frombuffer(slot, np.uint32)] = np.frombuffer(value, np.uint8)
        for whole in batches:
            for batch in by_size(whole):
                # numbers of one file of texts are close to each other
                file = batch.column("rep").to_numpy() >> 33
                cut = np.flatnonzero(np.append(True, file[1:] != file[:-1]))
                for a, b in zip(cut, np.append(cut[1:], len(file))):
                    yield from work(batch.slice(a, b - a), level)

    def work(batch: pa.RecordBatch, level: np.ndarray) -> Iterator[pa.RecordBatch]:
        reps = batch.column("rep").to_numpy()
        row, kmer, sizes = _sets(batch.column("seq").to_pylist(), k)
        on = sizes[row] >= bands.least
        row, kmer = row[on], kmer[on]
        sig = _scramble(kmer, k)
        if not len(row):
            return
        rare = level[sig & np.uint64((1 << SLOT_BITS) - 1)]
        cold = rare < LEVEL
        hot = np.bincount(row[~cold], minlength=len(reps))
        crow, ckmer = row[cold], kmer[cold]
        crank = np.arange(len(crow)) - np.searchsorted(crow, crow)
        single = np.zeros(len(reps), bool)
        rows, sigs = [], []
        for band, parts in enumerate(bands.parts.tolist()):
            c = bands.common(band, sizes)
            there = c > 0
            # of ``enough`` common k-mers some pairs lie in one part; sets of which so many may be frequent meet by single k-mers
            enough = parts + MEETINGS
            single |= there & ((hot > c - enough) | (parts == 0))
            if parts:
                take = there[crow] & (crank < (sizes - c + enough)[crow])
                r, s = _pairs_in_parts(crow[take], ckmer[take], parts, band, k)
                rows.append(r)
                sigs.append(s)
        r, s = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (rows, sigs))
        if len(r):
            s = s >> np.uint64(64 - bits)
            by = np.argsort(s)
            s, r = s[by].astype(np.int64), r[by].astype(np.int64)
            yield _packed(_bucket(s, bits, pair_buckets), [s, reps[r]], KMERS)
        on = single[row]
        if on.any():
            yield from rarest(row[on], sig[on], rare[on], sizes, reps)

    def rarest(row: np.ndarray, sig: np.ndarray, rare: np.ndarray, sizes: np.ndarray, reps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The k-mers that a similar set must share ``common`` of, with their rank by rarity."""
        shift = np.uint64(2 * k)
        order = (row.astype(np.uint64) << (shift + np.uint64(8))) | (rare.astype(np.uint64) << shift) | sig
        order.sort()
        row = (order >> (shift + np.uint64(8))).astype(np.int64)
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        size = sizes[row]
        # the least overlap is that with the smallest set that may be similar
        on = rank <= size - _overlap(size + np.maximum(bands.least, np.ceil(bands.gamma * size - 1e-9)), bands.gamma) + common
        sig, row, rank, size = (order[on] & np.uint64(4**k - 1)).astype(np.int64), row[on], rank[on], size[on]
        by = np.argsort(sig)
        yield _packed(pair_buckets + _bucket(sig[by], 2 * k, kmer_buckets), [sig[by], reps[row[by]], rank[by], size[by]], KMERS)

    return run


def _bucket(sig: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Ranges of equal width of a number of so many bits."""
    return (sig >> max(0, bits - 30)) * buckets >> min(bits, 30)


def _group_pairs(sig: np.ndarray, rep: np.ndarray, rank: np.ndarray, size: np.ndarray, gamma: float, common: int = LEAST_COMMON) -> Iterator[pa.RecordBatch]:
    """All pairs within each run of equal k-mers whose sizes and ranks allow the similarity, in bounded pieces."""
    if not len(sig):
        return
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    count = np.diff(np.append(start, len(sig)))
    for n in np.unique(count[count > 1]):
        at = start[count == n]
        if n <= TILE:
            i, j = np.triu_indices(n, 1)
            step = max(1, 1_000_000 // len(i))
            tiles = (((at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()) for k in range(0, len(at), step))
        else:
            tiles = _tiles(at, int(n))
        for x, y in tiles:
            # the size bands: sets whose sizes differ by more than the factor gamma cannot be similar
            fit = (rep[x] != rep[y]) & (np.minimum(size[x], size[y]) >= gamma * np.maximum(size[x], size[y]))
            x, y = x[fit], y[fit]
            # of an overlap of c, the ``common`` rarest stand among the first size - c + common of both sets
            c = _overlap(size[x].astype(np.int64) + size[y], gamma) - common
            fit = (rank[x] <= size[x] - c) & (rank[y] <= size[y] - c)
            x, y = x[fit], y[fit]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[x], rep[y])), pa.array(np.maximum(rep[x], rep[y]))], schema=PAIR)


def _tiles(starts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for s in starts:
        for i in range(0, n, TILE):
            for j in range(i, n, TILE):
                x, y = np.meshgrid(np.arange(i, min(i + TILE, n)), np.arange(j, min(j + TILE, n)), indexing="ij")
                above = x < y
                yield s + x[above], s + y[above]


def _meet(gamma: float, common: int, plan: tuple[int, int, int], buckets: int):
    """The pairs (a, b) that meet in each signature: in buckets below ``buckets`` those that have met in two k-mers, above in single ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pieces: list[pa.RecordBatch], sure: bool) -> pa.RecordBatch:
            a, b = (np.concatenate([p.column(c).to_numpy() for p in pieces]) for c in (0, 1))
            bucket = (mix(a.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((b, a, bucket))
            return _packed(bucket[by] + (0 if sure else buckets), [a[by], b[by]], MET)

        for of, columns in _by_bucket(batches):
            by = np.argsort(columns[0])
            sure = of < plan[0]
            # two k-mers of one part do not tell of sizes and ranks: all fit
            columns = [x[by] for x in columns] if not sure else [columns[0][by], columns[1][by], np.ones(len(by), np.int64), np.full(len(by), 100)]
            pieces, n = [], 0
            for piece in _group_pairs(*columns, gamma, common):
                pieces.append(piece)
                n += piece.num_rows
                if n > BUCKET_ROWS:
                    yield out(pieces, sure)
                    pieces, n = [], 0
            if pieces:
                yield out(pieces, sure)

    return run


def _often(common: int, buckets: int):
    """The pairs that have met in ``MEETINGS`` signatures of two k-mers, or in ``common`` single ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, (a, b) in _by_bucket(batches):
            by = np.lexsort((b, a))
            a, b = a[by], b[by]
            start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            at = start[np.diff(np.append(start, len(a))) >= (MEETINGS if of < buckets else common)]
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at])], schema=PAIR)

    return run


def _verify(k: int, gamma: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            row, kmer, sizes = _sets(batch.column("seq_a").to_pylist() + batch.column("seq_b").to_pylist(), k)
            both = np.sort(((row % n).astype(np.uint64) << np.uint64(2 * k)) | kmer)
            twice = both[1:][both[1:] == both[:-1]]
            common = np.bincount((twice >> np.uint64(2 * k)).astype(np.int64), minlength=n)
            union = sizes[:n] + sizes[n:] - common
            fit = (common >= gamma * union) & (union > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(fit)), batch.column("b").filter(pa.array(fit)), pa.array(common[fit] / union[fit])], schema=schema)

    return run


def _by_task(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows sorted by bucket, as many buckets to each task as to the next."""
    tasks = min(buckets, MOST_TASKS)
    return rows.repartitionById(tasks, F.floor(F.col("bucket") * F.lit(tasks) / F.lit(buckets)).cast("int")).sortWithinPartitions("bucket")


def similar_classes(texts: DataFrame, gamma: float = 0.5, least: int = 20, k: int = K, hot: int = HOT) -> DataFrame:
    """Pairs ``(a, b, similarity)`` of the texts in ``texts`` (rep, seq), a < b, with Jaccard similarity >= ``gamma``.

    See ``near_duplicates``. ``texts`` should be materialized: it is read several times.
    """
    if not 0 < gamma <= 1:
        raise ValueError("the similarity lies between 0 and 1")
    sc = texts.sparkSession.sparkContext
    n, longest = texts.agg(F.count(F.lit(1)), F.max(F.length("seq"))).first()
    sample = texts.where(F.pmod(F.xxhash64("seq"), F.lit(n // SAMPLE + 1)) == 0).select("seq").repartition(1)
    frequent = sc.broadcast(tuple(map(bytes, sample.mapInArrow(_frequent(k, hot), "slot binary, level binary").first() or (b"", b""))))
    least = max(1, least)
    bands = Bands(gamma, least, max(least, (longest or 0) - k + 1))
    common = max(1, min(LEAST_COMMON, int(_overlap(np.array(2 * least), gamma))))
    cores = sc.defaultParallelism
    pair_buckets, kmer_buckets = max(cores, n * SIGNATURES // BUCKET_ROWS), max(cores, n * 45 // BUCKET_ROWS)
    plan = pair_buckets, kmer_buckets, min(62, max(1, n * SIGNATURES).bit_length() + SPARE_BITS)
    rows = texts.mapInArrow(_signatures(k, bands, common, plan, frequent), KMERS_SQL)
    met = _by_task(rows, pair_buckets + kmer_buckets).mapInArrow(_meet(gamma, common, plan, kmer_buckets), MET_SQL)
    often = _by_task(met, 2 * kmer_buckets).mapInArrow(_often(common, kmer_buckets), PAIR_SQL)
    pairs = materialize(often.distinct(), "candidates")
    met = materialize(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "met")
    seqs = materialize(texts.join(broadcast_if_small(met, 64), "rep", "left_semi"), "met-texts")
    left, right = seqs.select(F.col("rep").alias("a"), F.col("seq").alias("seq_a")), seqs.select(F.col("rep").alias("b"), F.col("seq").alias("seq_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "seq_a", "seq_b").mapInArrow(_verify(k, gamma), "a long, b long, similarity double")


def near_duplicates(df: DataFrame, key: str, text: Column, gamma: float = 0.5, least: int = 20, k: int = K, hot: int = HOT) -> DataFrame:
    """Pairs ``(key_a, key_b, similarity)``, the smaller key first, of rows whose texts differ but are similar.

    Similarity is the Jaccard similarity of the sets of distinct k-base substrings that hold
    only A, C, G and T; rows with fewer than ``least`` of them and rows with a null text are left
    out. A key that occurs in several rows with one text counts once; rows with a null key are
    left out. Empty tables and empty texts give no rows; other columns are not read.

    Method: PartEnum signatures over the distinct texts, complete for every set and ``gamma``. Pairs of sets belong to
    bands of sizes. Of two similar sets of sizes m and n, c = ceil(gamma / (1 + gamma) * (m + n)) k-mers or more are common,
    so at most m - c of the one and n - c of the other are not, and the first P + w common ones, in any order of all k-mers, stand among
    the first m - c + P + w and n - c + P + w. The domain of k-mers is cut into P parts, fewer than the common k-mers of the band:
    among P + w k-mers w pairs or more lie in one part each, and every two k-mers of a part are a signature. Sets that
    have w = ``MEETINGS`` signatures in common are candidates. A signature names two k-mers, so sets that share little else hardly ever meet in so many.

    K-mers that a sample holds often (adapters, tails) would bring half a table together and have no signatures. Two sets may then
    be without enough of them only if each holds more than c - P - w frequent k-mers; such sets also meet by a prefix filter over single
    k-mers, the rarest first: the ``LEAST_COMMON`` first common ones stand among the first
    m - c + ``LEAST_COMMON`` and n - c + ``LEAST_COMMON``. So do all sets of bands whose parts would be fewer than ``LEAST_PARTS`` (a low ``gamma``).
    What counts as frequent changes the cost, not the pairs. Pairs that meet are verified on the whole sets. Copies of a
    text are one class and are expanded only into the resulting pairs.
    """
    texts = classes(df.where(F.col(key).isNotNull()), text)
    found = materialize(similar_classes(texts, gamma, least, k, hot), "similar")
    member = members(df, key, text, texts, found.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    a = member.select(F.col("rep").alias("a"), F.col("key").alias("ka"))
    b = member.select(F.col("rep").alias("b"), F.col("key").alias("kb"))
    pairs = found.join(a, "a").join(b, "b")
    return pairs.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "similarity")


def members(df: DataFrame, key: str, text: Column, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """``(rep, key)``: the distinct keys of the classes in ``reps``; rows meet by a 128-bit hash of the text."""
    named = materialize(texts.join(reps, "rep", "left_semi").select("rep", *content_key(F.col("seq"))), "members")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *content_key(text))
    return rows.join(broadcast_if_small(named, 80), ["h1", "h2"]).select("rep", "key").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(rep, root)`` of all ends of ``edges`` (a, b): ``root`` is the least end that edges lead to.

    Each round takes the least root of all neighbours and then the root of that root, so paths halve; labels are written
    down after each, and only a count comes to the driver.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("n")).select("rep", F.least("rep", "n").alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("rep")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("rep") == F.col("a")).select("rep", "root", F.least("root", "near").alias("to"))
        step = materialize(step, "labels")
        jump = step.select(F.col("rep").alias("to"), F.col("to").alias("further"))
        after = materialize(step.join(jump, "to").select("rep", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), "labels")
        if not after.where("moved").limit(1).count():
            return after.select("rep", "root")
        labels = after.select("rep", "root")


def similar_groups(df: DataFrame, key: str, text: Column, gamma: float = 0.5, least: int = 20, k: int = K, hot: int = HOT) -> DataFrame:
    """``(key, group, links)``: one row for each key and text; ``group`` is the least key of the texts that similarity joins, directly or through others.

    ``links`` is the number of other texts that are similar to the row's. Copies of one text are one group, and a text without
    similar ones is a group by itself; pairs of copies are never listed. See ``near_duplicates`` for similarity and nulls;
    texts of fewer than ``least`` k-mers are similar to none.
    """
    texts = classes(df.where(F.col(key).isNotNull()), text)
    found = materialize(similar_classes(texts, gamma, least, k, hot).select("a", "b"), "similar")
    links = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    of = components(found).join(links, "rep")
    named = texts.join(of, "rep", "left").select(F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), *content_key(F.col("seq")))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), text.alias("text")).where("text IS NOT NULL").select("key", *content_key(F.col("text"))).distinct()
    placed = materialize(rows.join(named, ["h1", "h2"]).select("key", "root", "links"), "placed")
    least_key = placed.groupBy("root").agg(F.min("key").alias("group"))
    return placed.join(least_key, "root").select("key", "group", "links")
