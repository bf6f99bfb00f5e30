"""One row per key without shuffling the rows whose key is unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import BROADCAST_BYTES, materialize


def once_per_key(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Keep one row of each ``key``: the first by ``order`` (nulls last), then by the row's hash.

    Keys that repeat are found from the key column alone (counts are combined before
    the shuffle, so a key with a third of all rows is no hot spot). Rows with a unique
    key then pass straight through; only the rows of repeated keys are shuffled, if the
    list of repeated keys is small enough to broadcast, else both sides are joined by key.
    Rows whose key is null are all kept: they cannot be told to be the same.
    """
    again = materialize(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_k")), "repeated-keys")
    n = again.count()
    if not n:
        return df
    if n * 64 <= BROADCAST_BYTES:
        again = F.broadcast(again)
    match = F.col(key) == F.col("_k")
    unique = df.join(again, match, "left_anti")
    rest = df.join(again, match, "left_semi")
    rank = [F.col(order).isNull(), F.col(order)] if order else []
    held = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(df.columns)])
    first = rest.groupBy(key).agg(F.min_by(held, F.struct(*rank, F.xxhash64(*df.columns))).alias("_r"))
    return unique.unionByName(first.select(*[F.col("_r").getField(f"f{i}").alias(c) for i, c in enumerate(df.columns)]))
