"""Reads by barcode: the first label, in the order given, whose code the read begins with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.quality import cut

UNKNOWN = "UNKNOWN"


def mismatches(sequence: Column, code: str) -> Column:
    """Characters in which the start of the sequence differs from the code; null if it is shorter."""
    off = F.lit(0)
    for i, c in enumerate(code):
        off = off + (F.substring(sequence, i + 1, 1) != c).cast("int")
    return F.when(F.length(sequence) >= len(code), off)


def split_barcodes(df: DataFrame, codes: dict[str, str], most: int = 0, clip: bool = False, read: str = "r1") -> DataFrame:
    """Set ``barcode_label`` of a read column to the first label of ``codes`` (label: code) that fits, else ``UNKNOWN``.

    A code fits if the read begins with it, up to ``most`` mismatches; reads shorter than a
    code do not fit it. ``clip`` cuts the code off. Null reads stay null. The codes of one
    run are few: they become one expression, without a join or shuffle.
    """
    r = F.col(read)
    label, size = F.lit(UNKNOWN), F.lit(0)
    for name, code in reversed(codes.items()):
        seq = r["sequence"]
        fits = seq.startswith(code) if most == 0 else F.coalesce(mismatches(seq, code) <= most, F.lit(False))
        label, size = F.when(fits, F.lit(name)).otherwise(label), F.when(fits, F.lit(len(code))).otherwise(size)
    marked = r.withField("barcode_label", label)
    out = cut(marked, size, F.length(r["sequence"]) - size) if clip else marked
    return df.withColumn(read, F.when(r.isNotNull(), out))
