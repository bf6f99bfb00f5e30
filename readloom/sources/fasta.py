"""FASTA on the driver: adapter files are a few kilobytes."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = 60

#: Folders searched for adapter files that are not found by their path.
ADAPTER_DIRS: list[str] = []


def read_fasta(path: str) -> list[tuple[str, str]]:
    """``(name, sequence)`` of every record: the name up to the first blank or ``|``, the sequence's lines joined.

    What stands before the first ``>`` and lines that begin with ``;`` are skipped.
    """
    records: list[tuple[str, list[str]]] = []
    with open(path, encoding="utf-8") as lines:
        for raw in lines:
            line = raw.strip()
            if line.startswith(">"):
                records.append((re.split(r"[ |]", line[1:].strip(), maxsplit=1)[0], []))
            elif records and line and not line.startswith(";"):
                records[-1][1].append(line)
    return [(name, "".join(parts)) for name, parts in records]


def find_adapters(path: str) -> str:
    """The file at an absolute path, in one of ``ADAPTER_DIRS``, or under the working directory."""
    for p in [path] * os.path.isabs(path) + [os.path.join(d, path) for d in ADAPTER_DIRS] + [os.path.join(os.getcwd(), path)]:
        if os.path.isfile(p):
            return p
    raise FileNotFoundError(f"no adapter file {path}")


def write_fasta(df: DataFrame, path: str, name: str = "name", sequence: str = "sequence", compression: str | None = None) -> None:
    """Records with 60 bases to a line."""
    body = F.regexp_replace(F.regexp_replace(F.col(sequence), f"(.{{{LINE}}})", "$1\n"), "\n$", "")
    writer = df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), body).alias("value")).write
    (writer.option("compression", compression) if compression else writer).text(path)
