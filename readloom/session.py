"""Session helpers: shared scratch storage, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes (estimated from counted rows) that a side may have to be broadcast.
BROADCAST_BYTES = 32 << 20

#: Estimated bytes below which an input is spread over all cores.
SMALL_BYTES = 1 << 30

_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own only where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="readloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for spark, path in _written:
        try:
            _drop(spark, path)
        except Exception:  # the session is gone, and with it a temporary folder
            pass


atexit.register(_sweep)


@contextmanager
def scratch() -> Iterator[None]:
    """Remove at the end what was written down within: results that read it must have been used by then."""
    before = len(_written)
    try:
        yield
    finally:
        for spark, path in _written[before:]:
            _drop(spark, path)
        del _written[before:]


def materialize(df: DataFrame, what: str = "step") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it back.

    Cuts the lineage so that a lost executor costs one stage, not the whole plan,
    and gives the optimizer true sizes. The table is removed when the process ends, or the ``scratch`` block around it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/readloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if ``rows`` x ``row_bytes`` stays under ``limit``; otherwise leave the join to Spark.

    ``rows`` is counted when not given, so pass a materialized frame.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= limit else df


def spread(df: DataFrame, small: int = SMALL_BYTES) -> DataFrame:
    """Give a small input to all cores: a single file of a few row groups is otherwise one task.

    Inputs that the optimizer estimates at ``small`` bytes or more have splits enough and are left as they are.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < small else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
