"""Survival counts, their text, and the per-read trim log."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: labels of the summary
SINGLE_LABELS = {"surviving": "Surviving", "dropped": "Dropped"}
PAIRED_LABELS = {"both": "Both Surviving", "forward_only": "Forward Only Surviving", "reverse_only": "Reverse Only Surviving", "dropped": "Dropped"}


def single_stats(df: DataFrame) -> DataFrame:
    """One row ``(input, surviving, dropped)`` of a trimmed single frame, counted in one pass."""
    there, kept = F.col("o1_len").isNotNull(), F.col("r1").isNotNull()
    return df.agg(F.count_if(there).alias("input"), F.count_if(kept).alias("surviving"), F.count_if(there & ~kept).alias("dropped"))


def paired_stats(df: DataFrame) -> DataFrame:
    """One row ``(input, both, forward_only, reverse_only, dropped)``; only rows that began with both reads count."""
    there = F.col("o1_len").isNotNull() & F.col("o2_len").isNotNull()
    f, r = F.col("r1").isNotNull(), F.col("r2").isNotNull()
    n = lambda c, name: F.count_if(there & c).alias(name)
    return df.agg(n(F.lit(True), "input"), n(f & r, "both"), n(f & ~r, "forward_only"), n(~f & r, "reverse_only"), n(~f & ~r, "dropped"))


def percent(part: int, whole: int) -> str:
    """Two places, halves to the even digit; of nothing, NaN."""
    if not whole:
        return "NaN"
    # the double that the division gives, rounded by its exact value
    return str(Decimal(100.0 * part / whole).quantize(Decimal("0.01"), ROUND_HALF_EVEN))


def stats_line(row: dict) -> str:
    """The console line of a row of ``single_stats`` or ``paired_stats``."""
    labels = PAIRED_LABELS if "both" in row else SINGLE_LABELS
    head = "Input Read Pairs" if "both" in row else "Input Reads"
    return f"{head}: {row['input']} " + " ".join(f"{name}: {row[k]} ({percent(row[k], row['input'])}%)" for k, name in labels.items())


def stats_summary(row: dict) -> str:
    """The lines of the summary file."""
    pair = "both" in row
    labels = PAIRED_LABELS if pair else SINGLE_LABELS
    lines = [f"{'Input Read Pairs' if pair else 'Input Reads'}: {row['input']}"]
    for k, name in labels.items():
        lines += [f"{name} Reads: {row[k]}", f"{name} Read Percent: {percent(row[k], row['input'])}"]
    return "\n".join(lines) + "\n"


def _entry(mate: int) -> Column:
    r, name, length = F.col(f"r{mate}"), F.col(f"o{mate}_name"), F.col(f"o{mate}_len")
    kept = F.length(r["sequence"])
    end = r["head_pos"] + kept
    zero = lambda c: F.when(r.isNotNull(), c).otherwise(F.lit(0)).cast("int")
    return F.struct(F.lit(mate).alias("mate"), name.alias("read_name"), zero(kept).alias("length"), zero(r["head_pos"]).alias("start_pos"), zero(end).alias("end_pos"), zero(length - end).alias("trim_tail"), length.alias("_had"))


def trim_log(df: DataFrame) -> DataFrame:
    """``(ordinal, mate, read_name, length, start_pos, end_pos, trim_tail)``: a row per input read, zeros if it was dropped.

    For files order it by ``(ordinal, mate)``; see ``write_trim_log``.
    """
    mates = [1, 2] if "r2" in df.columns else [1]
    rows = df.select("ordinal", F.explode(F.array(*[_entry(m) for m in mates])).alias("x")).where("x._had IS NOT NULL")
    return rows.select("ordinal", "x.mate", "x.read_name", "x.length", "x.start_pos", "x.end_pos", "x.trim_tail")


def log_lines(log: DataFrame) -> DataFrame:
    """The log's text lines as ``(ordinal, mate, value)``."""
    parts = [F.col(c).cast("string") for c in ("read_name", "length", "start_pos", "end_pos", "trim_tail")]
    return log.select("ordinal", "mate", F.concat_ws(" ", *parts).alias("value"))
