"""Pairs of reads: routing, validation of names, and pairing anew by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.names import canonical_name
from readloom.session import materialize



def route(df: DataFrame) -> dict[str, DataFrame]:
    """The four outputs of a trimmed paired frame: ``1P`` and ``2P`` for full pairs, ``1U`` and ``2U`` for single survivors.

    Each is ``(ordinal, read)``; order is that of ``ordinal``. Use ``routed`` for one pass over the input.
    """
    both = F.col("r1").isNotNull() & F.col("r2").isNotNull()
    pick = lambda where, r: df.where(where).select("ordinal", F.col(r).alias("read"))
    return {"1P": pick(both, "r1"), "1U": pick(F.col("r1").isNotNull() & F.col("r2").isNull(), "r1"), "2P": pick(both, "r2"), "2U": pick(F.col("r2").isNotNull() & F.col("r1").isNull(), "r2")}


def routed(df: DataFrame) -> DataFrame:
    """``(ordinal, stream, read)`` with the streams of ``route`` in one pass, to be written by stream."""
    kind = F.when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), F.lit("P")).otherwise(F.lit("U"))
    rows = F.array(F.struct(F.concat(F.lit("1"), kind).alias("stream"), F.col("r1").alias("read")), F.struct(F.concat(F.lit("2"), kind).alias("stream"), F.col("r2").alias("read")))
    return df.select("ordinal", F.explode(rows).alias("x")).select("ordinal", "x.stream", "x.read").where("read IS NOT NULL")


def survivors(df: DataFrame) -> DataFrame:
    """``(ordinal, read)`` of the single reads that were not dropped."""
    return df.where("r1 IS NOT NULL").select("ordinal", F.col("r1").alias("read"))




def names_match(forward: Column, reverse: Column) -> Column:
    """Whether two names belong to mates: by their canonical form, else up to the first blank with 1 against 2."""
    a, b = canonical_name(forward), canonical_name(reverse)
    x, y = F.substring_index(forward, " ", 1), F.substring_index(reverse, " ", 1)
    agree = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: (p == q) | ((p == "1") & (q == "2")))
    loose = (F.length(x) == F.length(y)) & ((F.length(x) == 0) | F.forall(agree, lambda z: z))
    return F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(loose)


def validate_pairs(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """``(ordinal, forward_name, reverse_name)`` of the first pair whose names do not match; no row if all do.

    Inputs are ``(ordinal, r1)``. A record without a mate also fails. Nothing is dropped:
    trimming goes on with pairs by position whatever comes out here.
    """
    f = forward.select("ordinal", F.col("r1")["name"].alias("forward_name"))
    r = reverse.select("ordinal", F.col("r1")["name"].alias("reverse_name"))
    both = f.join(r, "ordinal", "full_outer")
    bad = ~F.coalesce(names_match(F.col("forward_name"), F.col("reverse_name")), F.lit(False))
    first = both.where(bad).agg(F.min_by(F.struct("ordinal", "forward_name", "reverse_name"), "ordinal").alias("x"))
    return first.where("x IS NOT NULL").select("x.*")


def cut_name(name: Column, delimiter: str | None) -> Column:
    """The name before the last delimiter, whole if it has none."""
    if not delimiter:
        return name
    d = re.escape(delimiter[0])
    return F.regexp_replace(name, f"{d}[^{d}]*$", "")


class RepairError(ValueError):
    """The two files cannot be paired by name."""


def repair_by_name(forward: DataFrame, reverse: DataFrame, delimiter: str | None = None, check: bool = True) -> dict[str, DataFrame]:
    """Pair two sets of reads ``(ordinal, r1)`` by name: ``1P``, ``1U``, ``2P``, ``2U`` as ``(ordinal, read)``.

    Names are cut before the last ``delimiter``. A name twice in one set raises, and so do
    common names that come in different orders. ``check`` runs both tests, which need the
    names only: the distributed sorts by ordinal number the common names on each side.
    Empty sets pair to nothing; reads that are null are left out.
    """
    key = cut_name(F.col("r1")["name"], delimiter)
    f, r = (d.where("r1 IS NOT NULL").select("ordinal", key.alias("key"), F.col("r1").alias("read")) for d in (forward, reverse))
    if check:
        names = [materialize(d.select("key", "ordinal"), "names") for d in (f, r)]
        for side, d in zip(("first", "second"), names):
            again = d.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("key").limit(1).collect()
            if again:
                raise RepairError(f"name {again[0][0]} is in the {side} input more than once")
        common = materialize(names[0].join(names[1].select("key", F.col("ordinal").alias("other")), "key").select("ordinal", "other"), "common")
        if _out_of_order(common):
            raise RepairError("the names that both inputs have come in different orders")
    pick = lambda a, b, how: a.join(b.select("key"), "key", how).select("ordinal", "read")
    return {"1P": pick(f, r, "left_semi"), "1U": pick(f, r, "left_anti"), "2P": pick(r, f, "left_semi"), "2U": pick(r, f, "left_anti")}


def _out_of_order(common: DataFrame) -> bool:
    """Whether ``other`` ever falls while ``ordinal`` rises, told from the bounds of range partitions and within them."""
    parts = common.repartitionByRange("ordinal").withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "by-range")
    w = Window.partitionBy("part").orderBy("ordinal")
    inner = parts.withColumn("before", F.lag("other").over(w)).where("other < before").limit(1).count()
    if inner:
        return True
    # a row per partition
    bounds = parts.groupBy("part").agg(F.min("ordinal").alias("at"), F.min("other").alias("lo"), F.max("other").alias("hi"))
    over = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return bool(bounds.withColumn("top", F.max("hi").over(over)).where("lo < top").limit(1).count())


def paired_by_name(forward: DataFrame, reverse: DataFrame, delimiter: str | None = None) -> DataFrame:
    """``(name, ordinal1, ordinal2)`` of the names that both sets have."""
    key = cut_name(F.col("r1")["name"], delimiter)
    f = forward.where("r1 IS NOT NULL").select(key.alias("name"), F.col("ordinal").alias("ordinal1"))
    r = reverse.where("r1 IS NOT NULL").select(key.alias("name"), F.col("ordinal").alias("ordinal2"))
    return f.join(r, "name")
