"""Column functions over quality strings, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters that can stand for a quality, by code.
CHARACTERS = "".join(map(chr, range(256)))
SHIFT = 31  # between the encodings with offset 33 and 64


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def masked_quality(read: Column) -> Column:
    """The quality with the character for 0 under every upper-case N; only reads with an N pay for it."""
    per_base = F.zip_with(F.split(read["sequence"], ""), F.split(read["quality"], ""), lambda s, q: F.when(s == "N", F.char(read["phred_offset"])).otherwise(q))
    return F.when(read["sequence"].contains("N"), F.array_join(per_base, "")).otherwise(read["quality"])


def first_good(text: Column, read: Column, threshold: int) -> Column:
    """The 1-based place of the first character of ``text`` that stands for at least ``threshold``, 0 if there is none.

    Patterns are compiled once, so the two offsets in use have one each; others are looked up by trimming.
    """

    def place(offset: int) -> Column:
        code = offset + threshold
        return F.regexp_instr(text, F.lit(f"[^\\x00-\\x{code - 1:02x}]" if code > 0 else "[\\x00-\\x{ffff}]"))

    low = F.substring(F.lit(CHARACTERS), F.lit(1), F.greatest(read["phred_offset"] + F.lit(threshold), F.lit(0)))
    left = F.length(F.ltrim(text, low))
    other = F.when(left > 0, F.length(text) - left + 1).otherwise(F.lit(0))
    return F.when(read["phred_offset"] == 33, place(33)).when(read["phred_offset"] == 64, place(64)).otherwise(other)


def quality_values(read: Column) -> Column:
    """Qualities as integers, 0 under an upper-case N; the empty read has none."""
    chars = F.split(masked_quality(read), "")
    values = F.transform(chars, lambda c: F.ascii(c) - read["phred_offset"])
    return F.when(F.length(read["quality"]) == 0, F.array().cast("array<int>")).otherwise(values)


def shifted(quality: Column, by: int) -> Column:
    """The quality with every character's code moved by ``by``."""
    codes = range(max(0, -by), 256 + SHIFT)
    return F.translate(quality, "".join(map(chr, codes)), "".join(chr(c + by) for c in codes))


def cut(read: Column, start: Column, length: Column) -> Column:
    """The read's part of ``length`` bases from the 0-based ``start``; head_pos moves along."""
    return F.struct(
        read["name"].alias("name"),
        F.substring(read["sequence"], start + 1, length).alias("sequence"),
        read["comment"].alias("comment"),
        F.substring(read["quality"], start + 1, length).alias("quality"),
        read["barcode_label"].alias("barcode_label"),
        read["phred_offset"].alias("phred_offset"),
        (read["head_pos"] + start).cast("int").alias("head_pos"),
    )


def recoded(read: Column, quality: Column, offset: int) -> Column:
    return F.struct(read["name"].alias("name"), read["sequence"].alias("sequence"), read["comment"].alias("comment"), quality.alias("quality"), read["barcode_label"].alias("barcode_label"), F.lit(offset).alias("phred_offset"), read["head_pos"].alias("head_pos"))
