"""The data model: reads as structs, read groups as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READ_FIELDS = ("name", "sequence", "comment", "quality", "barcode_label", "phred_offset", "head_pos")
READ_SQL = "struct<name: string, sequence: string, comment: string, quality: string, barcode_label: string, phred_offset: int, head_pos: int>"


def read_struct(name, sequence, comment, quality, phred_offset, barcode_label=None, head_pos=0) -> Column:
    """A read; null if it has no sequence or no quality."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = F.struct(
        c(name).cast("string").alias("name"),
        c(sequence).cast("string").alias("sequence"),
        F.coalesce(c(comment).cast("string"), F.lit("")).alias("comment"),
        c(quality).cast("string").alias("quality"),
        c(barcode_label).cast("string").alias("barcode_label"),
        c(phred_offset).cast("int").alias("phred_offset"),
        F.coalesce(c(head_pos).cast("int"), F.lit(0)).alias("head_pos"),
    )
    return F.when(c(sequence).isNotNull() & c(quality).isNotNull(), made)


def single(df: DataFrame, ordinal: str = "ordinal", read: str = "r1") -> DataFrame:
    """``(ordinal, r1, o1_name, o1_len)`` of a table with a read struct."""
    r = F.col(read)
    return df.select(F.col(ordinal).alias("ordinal"), r.alias("r1"), r["name"].alias("o1_name"), F.length(r["sequence"]).alias("o1_len"))


def paired(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """``(ordinal, r1, o1_name, o1_len, r2, o2_name, o2_len)``: records of equal ordinal, the excess of either side dropped."""
    f, r = single(forward), single(reverse)
    r = r.select("ordinal", F.col("r1").alias("r2"), F.col("o1_name").alias("o2_name"), F.col("o1_len").alias("o2_len"))
    return f.join(r, "ordinal")


def from_table(df: DataFrame, ordinal: str = "ordinal", phred_offset: str | int = "phred_offset") -> DataFrame:
    """``(ordinal, r1)`` of a table that holds the fields of a read as columns; missing ones are null."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    offset = F.col(phred_offset) if isinstance(phred_offset, str) else F.lit(phred_offset)
    return df.select(F.col(ordinal).alias("ordinal"), read_struct(has("name"), F.col("sequence"), has("comment"), F.col("quality"), offset, has("barcode_label"), has("head_pos")).alias("r1"))
