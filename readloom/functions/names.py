"""Read names: the canonical form that both mates share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the two layouts of instrument read names, older first; group 2 is what mates share
PATTERNS = [
    "(.* )?([^:]+:[0-9]+:[0-9]+:[0-9]+:[0-9]+#[A-Z0-9]+).*",
    "(.* )?([^:]+:[0-9]+:[A-Z0-9]+:[0-9]+:[0-9]+:[0-9]+:[0-9]+).*",
]


def canonical_name(name: Column) -> Column:
    """The shared part of a name by the first layout found in it; null if neither is."""
    out = F.lit(None).cast("string")
    for p in reversed(PATTERNS):
        out = F.when(name.rlike(p), F.regexp_replace(name, p, "$2")).otherwise(out)
    return out
