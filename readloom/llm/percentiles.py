"""Percentiles per group by radix selection over order-preserving integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.session import broadcast_if_small, materialize

DIGIT_BITS = 16
WORTH = 8  # how many times fewer the rows that later passes need must be to be written down


@F.arrow_udf(T.LongType())
def _float_key(x: pa.Array) -> pa.Array:
    """Doubles to integers of the same order; -0.0 counts as 0.0 and NaN is largest."""
    v = x.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    v = np.where(np.isnan(v), np.nan, v)  # one NaN, above infinity
    bits = v.view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.arrow_udf(T.DoubleType())
def _float_value(key: pa.Array) -> pa.Array:
    k = key.to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array(np.where(k < 0, k ^ np.int64(0x7FFFFFFFFFFFFFFF), k).view(np.float64))


def order_key(value: Column, kind: T.DataType) -> Column:
    """An integer that sorts as ``value`` does; null stays null."""
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.when(value.isNotNull(), _float_key(value.cast("double")))
    return value.cast("long")


def from_order_key(key: Column, kind: T.DataType) -> Column:
    """The value that ``order_key`` made the key from."""
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.when(key.isNotNull(), _float_value(key)).cast(kind)
    return key.cast(kind)


def percentile_pieces(df: DataFrame, groups: list[str], value: str, bits: int = 64) -> DataFrame:
    """A mergeable summary ``(*groups, key, n)`` of the non-null values of ``value``.

    ``bits`` below 64 keeps only the highest bits of the key. For floating values 32
    bits bound the relative error by 2**-20; the percentile then is the lower end of
    its bin. Pieces of separate partitions or days are combined by ``merge_pieces``.
    """
    key = order_key(F.col(value), df.schema[value].dataType)
    if bits < 64:
        key = F.shiftleft(F.shiftright(key, 64 - bits), 64 - bits)
    return df.select(*groups, key.alias("key")).where("key IS NOT NULL").groupBy(*groups, "key").agg(F.count(F.lit(1)).alias("n"))


def merge_pieces(*pieces: DataFrame) -> DataFrame:
    """One summary of several: counts of equal groups and keys are added."""
    whole = pieces[0]
    for p in pieces[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*[c for c in whole.columns if c != "n"]).agg(F.sum("n").alias("n"))


def radix_select(pieces: DataFrame, groups: list[str], pcts: list[float], digit_bits: int = DIGIT_BITS) -> DataFrame:
    """``(*groups, pct, key)``: the smallest key with at least pct % of its group's counts at or below it.

    From the highest digit down, each pass histograms one digit of the keys that share the
    digits found so far and follows the digit in which the target rank lies; 64 / digit_bits
    passes end at the exact key. Every histogram has at most 2**digit_bits bins for a group
    and target, and is combined before the shuffle; no group is ever sorted or collected. A pass reads
    the pieces once; as soon as the rows that later passes need are ``WORTH`` times fewer, these are written down and read instead.
    Groups of null are groups; a percentile of 0 is the smallest key.
    """
    if any(not 0 <= p <= 100 for p in pcts):
        raise ValueError("percentiles lie between 0 and 100")
    names = [f"g{i}" for i in range(len(groups))]
    # flipping the sign bit makes unsigned order the order of the keys
    base = pieces.select(*[F.col(g).alias(a) for g, a in zip(groups, names)], F.col("key").bitwiseXOR(F.lit(-(2**63))).alias("u"), "n")
    # ranks in exact decimal arithmetic, percentiles to six places
    steps = F.explode(F.array(*[F.lit(round(p * 1_000_000)) for p in sorted(set(pcts))]))
    rank = F.greatest(F.lit(1), F.ceil(F.col("total").cast("decimal(20,0)") * F.col("micro").cast("decimal(9,0)") / F.lit(100_000_000).cast("decimal(9,0)"))).cast("long")
    inside = (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c"))
    found = [(F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"), F.shiftleft("prefix", digit_bits).bitwiseOR(F.col("digit")).alias("prefix"), "c", "total"]

    def histogram(rows: DataFrame, done: int) -> DataFrame:
        at = F.shiftrightunsigned("u", 64 - done) if done else F.lit(0).cast("long")
        digit = F.shiftrightunsigned("u", 64 - done - digit_bits).bitwiseAND(F.lit((1 << digit_bits) - 1))
        upto = Window.partitionBy(*names, "p").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        hist = rows.groupBy(*names, at.alias("p"), digit.alias("digit")).agg(F.sum("n").alias("c"))
        return hist.withColumn("upto", F.sum("c").over(upto))

    whole = histogram(base, 0).withColumn("total", F.sum("c").over(Window.partitionBy(*names))).withColumn("prefix", F.col("p"))
    want = whole.select("*", steps.alias("micro")).withColumn("rank", rank).where(inside).select(*names, "micro", *found)
    kept = None
    for done in range(digit_bits, 64, digit_bits):
        # a row per group and percentile: written down, each pass plans against its true size
        want = materialize(want, f"targets{done}")
        followed = want.select(*[F.col(a).alias(f"w_{a}") for a in names], F.col("prefix").alias("w_p"), "c").distinct()
        many, left = followed.agg(F.count(F.lit(1)), F.sum("c")).first()
        if kept is None:
            kept = want.select(*names, "total").distinct().agg(F.sum("total")).first()[0] or 0
        same = F.shiftrightunsigned("u", 64 - done) == F.col("w_p")
        for a in names:
            same = same & F.col(a).eqNullSafe(F.col(f"w_{a}"))
        rows = base.join(broadcast_if_small(followed.drop("c"), 100, many), same, "left_semi")
        if left and left * WORTH <= kept:
            # the rows that later passes need are few: written down, the source is not read again
            rows = base = materialize(rows, f"followed{done}")
            kept = left
        hist = histogram(rows, done).withColumnsRenamed({a: f"h_{a}" for a in names})
        hit = (F.col("prefix") == F.col("p")) & inside
        for a in names:
            hit = hit & F.col(a).eqNullSafe(F.col(f"h_{a}"))
        want = want.drop("c").join(hist, hit).select(*names, "micro", *found)
    return want.select(*[F.col(a).alias(g) for g, a in zip(groups, names)], (F.col("micro") / 1_000_000).alias("pct"), F.col("prefix").bitwiseXOR(F.lit(-(2**63))).alias("key"))


def radix_percentiles(df: DataFrame, groups: list[str], value: str, pcts: list[float], digit_bits: int = DIGIT_BITS) -> DataFrame:
    """Exact percentiles ``(*groups, pct, value)`` of a numeric column per group.

    The p-th percentile is the smallest value v such that at least p % of the group's
    values are at most v. Null values do not count, and a group of nulls alone has no
    row; NaN is larger than every number and -0.0 equals 0.0; decimals are compared as
    doubles. Groups of null are groups. An empty table gives no rows. Other columns are
    not read. Each pass reads the rows and counts one digit of them before anything is shuffled, so that
    at most 2**digit_bits counts for a group and target travel, however many values differ.
    """
    kind = df.schema[value].dataType
    rows = df.select(*groups, order_key(F.col(value), kind).alias("key"), F.lit(1).cast("long").alias("n")).where("key IS NOT NULL")
    picked = radix_select(rows, groups, pcts, digit_bits)
    return picked.select(*groups, "pct", from_order_key(F.col("key"), kind).alias("value"))


QUALITY_PIECES = "run_id string, lane int, phred_offset int, code int, n long"


def _quality_histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of quality characters per (run, lane, offset); code -1 stands under an upper-case N."""
    out_schema = pa.schema([("run_id", pa.string()), ("lane", pa.int32()), ("phred_offset", pa.int32()), ("code", pa.int32()), ("n", pa.int64())])
    for batch in batches:
        if not batch.num_rows:
            continue
        gid = np.zeros(batch.num_rows, np.int64)
        for c in ("run_id", "lane", "phred_offset"):
            coded = batch.column(c).dictionary_encode("encode")
            gid = gid * len(coded.dictionary) + coded.indices.to_numpy()
        first, gid = np.unique(gid, return_index=True, return_inverse=True)[1:]
        seq = _code_points(batch.column("sequence"))
        qual = _code_points(batch.column("quality"))
        row = np.repeat(np.arange(len(gid)), qual[1])
        place = np.arange(len(row)) - np.repeat(np.cumsum(qual[1]) - qual[1], qual[1])
        code = qual[0].astype(np.int64)
        inside = place < seq[1][row]
        starts = np.cumsum(seq[1]) - seq[1]
        under = np.zeros(len(row), bool)
        under[inside] = seq[0][starts[row[inside]] + place[inside]] == ord("N")
        code[under] = -1
        key, n = np.unique((gid[row].astype(np.int64) << 22) | (code + 1), return_counts=True)
        g = first[key >> 22]
        cols = [batch.column(c).take(pa.array(g)) for c in ("run_id", "lane", "phred_offset")]
        yield pa.RecordBatch.from_arrays([cols[0].cast(pa.string()), cols[1].cast(pa.int32()), cols[2].cast(pa.int32()), pa.array((key & ((1 << 22) - 1)) - 1, pa.int32()), pa.array(n, pa.int64())], schema=out_schema)


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column in a row, and how many each value has."""
    texts = column.to_pylist()
    joined = "".join(texts)
    if joined.isascii():
        return np.frombuffer(joined.encode("ascii"), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def base_quality_pieces(reads: DataFrame, runs: DataFrame) -> DataFrame:
    """``(run_id, lane, key, n)`` over all bases of reads with sequence and quality.

    The value of a base is its quality character minus ``phred_offset`` (where null, that
    of the read's run), but 0 under an upper-case N of the sequence as written. Qualities
    that are longer than their sequence count whole. Reads of which neither offset is
    known have no values. Histograms are made per batch of reads, so that what is shuffled
    is a few dozen counts for each run and lane instead of the bases.
    """
    cols = ["run_id", "lane", "phred_offset", "sequence", "quality"]
    counts = reads.where("sequence IS NOT NULL AND quality IS NOT NULL").select(*cols).mapInArrow(_quality_histograms, QUALITY_PIECES)
    counts = counts.groupBy("run_id", "lane", "phred_offset", "code").agg(F.sum("n").alias("n"))
    offsets = runs.select(F.col("run_id").alias("of_run"), F.col("phred_offset").alias("run_offset"))
    with_offset = counts.join(offsets, F.col("run_id") == F.col("of_run"), "left").withColumn("offset", F.coalesce("phred_offset", "run_offset"))
    value = F.when(F.col("code") == -1, F.lit(0)).otherwise(F.col("code") - F.col("offset")).cast("long")
    return with_offset.where("offset IS NOT NULL").groupBy("run_id", "lane", value.alias("key")).agg(F.sum("n").alias("n"))
