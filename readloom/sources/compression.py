"""Codecs by file suffix."""

from __future__ import annotations

from pyspark.sql.readwriter import DataFrameWriter

# fixed values: the suffixes, in any case
CODECS = {".gz": "gzip", ".bz2": "bzip2"}
#: Hadoop's names of the levels 1..9.
LEVELS = ("BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")


def codec(path: str) -> str | None:
    """The codec that a file's suffix names, None for plain text; zip archives raise, as Hadoop cannot read them."""
    low = path.lower().rstrip("/")
    if low.endswith(".zip"):
        raise ValueError(f"zip archives are not supported: {path}")
    return next((c for s, c in CODECS.items() if low.endswith(s)), None)


def compressed(writer: DataFrameWriter, kind: str | None, level: int | None = None) -> DataFrameWriter:
    """A writer with a codec and, for gzip, a level of 1..9."""
    if level is not None and not 1 <= level <= 9:
        raise ValueError(f"compression level {level} is not within 1..9")
    if kind is None:
        return writer
    writer = writer.option("compression", kind)
    return writer.option("zlib.compress.level", LEVELS[level - 1]) if level is not None and kind == "gzip" else writer
