"""Step chains over single and paired reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import readloom.operators.clip  # noqa: F401  (registers its step)
from readloom.functions.quality import SHIFT, cut, recoded, shifted
from readloom.operators.batch import ROWS, Batch
from readloom.operators.steps import BatchStep, ColumnStep, Step, parse_steps


def _column_steps(df: DataFrame, steps: list[ColumnStep], slots: int) -> DataFrame:
    """All steps in one projection.

    The reads of a row are an array and each step is a lambda over it: the lambda's variable is
    bound once, so that the expression stays linear in the number of steps however often a
    step names its read. A null element is a dropped read.
    """
    state = F.array(*[F.col(f"r{i + 1}") for i in range(slots)])
    for step in steps:
        state = F.transform(state, _over_slots(step, slots))
    wide = df.withColumn("_state", state)
    return wide.withColumns({f"r{i + 1}": F.get("_state", F.lit(i)) for i in range(slots)}).drop("_state")


def _over_slots(step: ColumnStep, slots: int):
    return lambda r, i: F.when(r.isNotNull(), step.apply(r, i, slots))


_KEPT = T.StructType([T.StructField(f"{c}{i}", T.IntegerType()) for i in (1, 2) for c in ("start", "n", "offset")])
_KEPT_ARROW = pa.struct([(f.name, pa.int32()) for f in _KEPT.fields])


def _kept_parts(steps: list[BatchStep]):
    """The part of each read that a chain keeps, as (start, n, offset) by slot; n is -1 for a dropped read."""

    def run(*columns: pa.Array) -> pa.Array:
        rows, out = len(columns[0]), []
        for at in range(0, rows, ROWS):
            reads = [Batch(*(c.slice(at, ROWS) for c in columns[i : i + 3])) for i in range(0, len(columns), 3)]
            for step in steps:
                step.run(reads)
            parts = [x.astype(np.int32) for b in reads for x in (b.start, np.where(b.alive, b.n, -1), b.offset)]
            parts += [np.zeros(len(parts[0]), np.int32)] * (6 - len(parts))
            out.append(pa.StructArray.from_arrays([pa.array(p) for p in parts], fields=list(_KEPT_ARROW)))
        return pa.concat_arrays(out) if out else pa.array([], _KEPT_ARROW)

    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    # not pushed below filters on its result, which would run the chain once for the filter and once for the reads
    return F.arrow_udf(run, _KEPT).asNondeterministic()


def _batch_steps(df: DataFrame, steps: list[BatchStep], slots: int) -> DataFrame:
    """A whole run of steps in one pass over Arrow batches; the reads themselves are cut in the JVM."""
    reads = [F.col(f"r{i + 1}") for i in range(slots)]
    cols = [r[c] for r in reads for c in ("sequence", "quality", "phred_offset")]
    kept = df.withColumn("_kept", _kept_parts(steps)(*cols))

    def part(r, k, i):
        start, n, offset = (k[f"{c}{i}"] for c in ("start", "n", "offset"))
        shorter = F.when(n < F.length(r["sequence"]), cut(r, start, n)).otherwise(r)
        moved = F.when(offset == 33, recoded(shorter, shifted(shorter["quality"], -SHIFT), 33)).otherwise(recoded(shorter, shifted(shorter["quality"], SHIFT), 64))
        changed = any(getattr(s, "offset", None) for s in steps)
        return F.when(r.isNotNull() & (n >= 0), F.when(offset == r["phred_offset"], shorter).otherwise(moved) if changed else shorter)

    return kept.withColumns({f"r{i + 1}": part(r, F.col("_kept"), i + 1) for i, r in enumerate(reads)}).drop("_kept")


def trim(df: DataFrame, steps: list[str | Step], slots: int | None = None, engine: str = "auto") -> DataFrame:
    """Run steps in the given order over rows with a read ``r1`` or two reads ``r1`` and ``r2``.

    Dropped reads become null; rows and all other columns stay, so that stats, logs and
    routing can be taken from the result. The plan is narrow: no step shuffles, and
    the same call works on a stream. Steps do not commute and are never reordered.

    A chain in which all steps are light is one projection in the JVM. Otherwise each run of
    steps that can work on batches is one Arrow pass. ``engine`` "jvm" or "arrow" takes that
    form of every step that has it.
    """
    parsed = [s if isinstance(s, Step) else parse_steps([s])[0] for s in steps]
    slots = slots or (2 if "r2" in df.columns else 1)
    jvm = engine == "jvm" or engine == "auto" and all(s.light for s in parsed)
    runs: list[tuple[bool, list[Step]]] = []
    for step in parsed:
        by_column = isinstance(step, ColumnStep) and (jvm or not isinstance(step, BatchStep))
        if not runs or runs[-1][0] != by_column:
            runs.append((by_column, []))
        runs[-1][1].append(step)
    for by_column, run in runs:
        df = (_column_steps if by_column else _batch_steps)(df, run, slots)
    return df


def trim_single(df: DataFrame, steps: list[str | Step], engine: str = "auto") -> DataFrame:
    """``trim`` over ``(ordinal, r1, o1_name, o1_len)``."""
    return trim(df, steps, 1, engine)


def trim_paired(df: DataFrame, steps: list[str | Step], engine: str = "auto") -> DataFrame:
    """``trim`` over ``(ordinal, r1, o1_name, o1_len, r2, o2_name, o2_len)``."""
    return trim(df, steps, 2, engine)
