"""Most frequent values of a column by exact refinement of hash prefixes."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.session import broadcast_if_small, materialize

#: Bits of the hash that are known after each pass.
LEVELS = (16, 32, 64)


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - bits) if bits < 64 else F.col("h")


def _kth_lower_bound(hashes: DataFrame, k: int, rows: int, probe_rows: int) -> int:
    """A count that at least ``k`` values reach: the exact counts of values named by a bounded sample."""
    part = min(1.0, probe_rows / max(rows, 1))
    # the sample is taken by a second hash, so equal values stand or fall row by row, not together
    named = hashes.where(F.rand(7) < part).groupBy("h").count().orderBy(F.desc("count"), "h").limit(4 * k).select("h")
    named = broadcast_if_small(materialize(named, "probe"), 64)
    least = hashes.join(named, "h", "left_semi").groupBy("h").count().orderBy(F.desc("count")).limit(k).agg(F.min("count"), F.count(F.lit(1))).first()
    return int(least[0]) if least[1] == k else 1


def frequent_values(
    df: DataFrame,
    value: Column,
    key: str | None = None,
    k: int | None = None,
    min_share: float | None = None,
    levels: tuple[int, ...] = LEVELS,
    probe_rows: int = 200_000,
) -> DataFrame:
    """Values of ``value`` with their counts and shares: ``(value, n, share)``.

    ``k`` asks for the k most frequent values (ties at the end go to the smaller value),
    ``min_share`` for the values that make up at least this share of the counted rows;
    with both, both must hold. Rows whose value is null are not counted. With ``key``,
    each key counts once however often its row is repeated (of differing values of one
    key, the one with the smallest hash counts); rows with a null key are then one key.
    The empty string is a value like any other, an empty table gives no rows, and other
    columns of ``df``, whatever their names, are not touched.

    Method: 64-bit hashes are counted by prefix, 16 bits first. A value cannot be more
    frequent than its prefix, so only prefixes that reach the bound are refined in the
    next pass: the least count asked for, or a count that k values surely reach (the
    exact counts of candidates named by a sample of at most about ``probe_rows`` rows;
    a poor sample only weakens the pruning). After the last pass the full values of the
    remaining hashes are read, and if two values share a hash they are counted apart.
    The counts are exact. Memory is bounded by the 65,536 groups of the first pass and
    by what can still beat the bound in later ones; counts are combined before each
    shuffle, so one value with a third of all rows is no hot spot.
    """
    if k is None and min_share is None:
        raise ValueError("give k, min_share or both")
    cols = [value.alias("v")] + ([F.col(key).alias("key")] if key else [])
    rows = df.select(*cols).where("v IS NOT NULL")
    keyed = rows.select(F.xxhash64("v").alias("h"), *(["key"] if key else []))
    hashes = materialize(keyed.groupBy("key").agg(F.min("h").alias("h")).select("h") if key else keyed, "hashes")
    n = hashes.count()
    bound = 1
    if min_share is not None:
        bound = max(1, math.ceil(Fraction(str(min_share)) * n))
    if k is not None and n:
        bound = max(bound, _kth_lower_bound(hashes, k, n, probe_rows))
    kept: DataFrame | None = None
    for i, bits in enumerate(levels):
        at = hashes if kept is None else hashes.join(kept, _prefix(levels[i - 1]) == F.col("p"), "left_semi")
        counts = at.groupBy(_prefix(bits).alias("p")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= bound)
        kept = materialize(counts, f"prefix{bits}")
        kept = broadcast_if_small(kept, 64) if bits < 64 else kept
    small = broadcast_if_small(kept.select("p"), 64)
    named = materialize(rows.select("v", F.xxhash64("v").alias("p")).join(small, "p", "left_semi").groupBy("p", "v").agg(F.count(F.lit(1)).alias("rows")), "values")
    shared = named.groupBy("p").count().where("count > 1").select("p")
    if shared.limit(1).count():
        # two values under one hash: count them by value, each key once
        one = rows.withColumn("p", F.xxhash64("v")).join(shared, "p", "left_semi")
        one = one.groupBy("key").agg(F.min(F.struct("p", "v")).alias("r")).select("r.p", "r.v") if key else one
        apart = one.groupBy("p", "v").agg(F.count(F.lit(1)).alias("n"))
        found = named.join(kept, "p").join(shared, "p", "left_anti").select("v", "n").unionByName(apart.where(F.col("n") >= bound).select("v", "n"))
    else:
        found = named.join(kept, "p").select("v", "n")
    out = found.select(F.col("v").alias("value"), "n", (F.col("n") / F.lit(max(n, 1))).alias("share"))
    return out.orderBy(F.desc("n"), "value").limit(k) if k is not None else out
