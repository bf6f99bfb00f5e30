"""Scalar column functions over sequences, qualities and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_sequence(sequence: Column) -> Column:
    """Upper case, U read as T and ``.`` as N; null stays null, the empty sequence stays empty."""
    return F.upper(F.translate(sequence, "uU.", "tTN"))


def reverse_complement(sequence: Column) -> Column:
    """Other strand: ACGT against TGCA, every other character becomes N."""
    return F.reverse(F.translate(F.regexp_replace(sequence, "[^ACGT]", "N"), "ACGT", "TGCA"))


def content_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that together stand for a text in joins that need not carry it."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("other"), text).alias("h2")]
