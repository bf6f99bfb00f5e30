"""The same chains over streams: every step is stateless, so trimming needs no state of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from readloom.operators.stats import paired_stats, single_stats
from readloom.plans.chain import trim
from readloom.session import scratch_dir


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def trim_stream(stream: DataFrame, steps: list[str]) -> DataFrame:
    """``trim`` over a stream of read rows; append mode, no state."""
    return trim(stream, steps)


def running_stats(trimmed: DataFrame) -> DataFrame:
    """The counts of all reads so far: one row in complete mode, whose state is a handful of counters."""
    return paired_stats(trimmed) if "r2" in trimmed.columns else single_stats(trimmed)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Process what is there in micro-batches through ``sink(batch, number)`` and stop.

    The offsets are kept in ``checkpoint``, by default a folder in the shared scratch space; a
    query that is started again with its folder goes on where it ended.
    """
    import uuid

    at = checkpoint or f"{scratch_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
