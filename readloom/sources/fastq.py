"""FASTQ as a DataFrame, numbered in file order, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.schema import paired, read_struct
from readloom.session import BROADCAST_BYTES, materialize
from readloom.sources.compression import codec, compressed

LINES = 4
PROBE = 10_000  # records looked at to tell the encoding
SPLIT_BYTES = (4 << 20, 128 << 20)  # bounds of the block size
MOST_BLOCKS = 400_000  # beyond that many blocks they grow instead
HEADER, REST = -1, 2**62  # places of the rows before and behind the lines of a block

LINES_SQL = "at int, file long, block long, idx long, value string"
RECORD = pa.schema([("ordinal", pa.int64()), ("name", pa.string()), ("sequence", pa.string()), ("comment", pa.string()), ("quality", pa.string())])
RECORD_SQL = "ordinal long, name string, sequence string, comment string, quality string"


class FastqError(ValueError):
    """The text is not FASTQ."""


def _split_bytes(spark: SparkSession, paths: list[str]) -> int:
    """A block size for inputs: some blocks for each core of the cluster as it is now."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        size += sum(fs.getContentSummary(s.getPath()).getLength() for s in fs.globStatus(path) or [])
    low, high = SPLIT_BYTES
    return max(low, min(high, size // (3 * spark.sparkContext.defaultParallelism)), size // MOST_BLOCKS)


def _lines(spark: SparkSession, paths: list[str], split_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(at, file, block, idx, value)``, the lines, and ``(at, file, place)``, the order of all files.

    ``at`` is the place in ``paths``, ``file`` stands for the file, ``idx`` rises with the lines of a block.
    The files are read in a session of their own that holds the block size, so that every job over
    the lines sees the same blocks, whatever is set elsewhere and however many executors there are.
    """
    for p in paths:
        codec(p)
    pinned = spark.newSession()
    for k in spark.conf.getAll:
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            pinned.conf.set(k, spark.conf.get(k))
    pinned.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes or _split_bytes(spark, paths)))
    # the block size no longer looks at the number of cores
    pinned.conf.set("spark.sql.files.minPartitionNum", "1")
    parts = [spark.createDataFrame([], LINES_SQL)]  # the first of a union gives its session to the result
    listed = []
    for i, p in enumerate(paths):
        text = pinned.read.text(p)
        names = sorted(text.inputFiles())
        # one file is written in two ways
        listed += [(i, n, place) for place, f in enumerate(names) for n in {f, f.replace("file:///", "file:/")}]
        place = F.xxhash64("_metadata.file_path").alias("file")
        parts.append(text.select(F.lit(i).alias("at"), place, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("idx"), "value"))
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionAll(p)
    files = spark.createDataFrame(listed, "at int, name string, place int")
    return lines, files.select("at", F.xxhash64("name").alias("file"), "place")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: its number of lines and the first of them."""
    now, n, head, out = None, 0, [], []
    for batch in batches:
        for block, lines in _runs(batch):
            if block != now:
                if now is not None:
                    out.append((*now, n, head))
                now, n, head = block, 0, []
            if len(head) < LINES - 1:
                head = head + lines.slice(0, LINES - 1 - len(head)).to_pylist()
            n += len(lines)
    if now is not None:
        out.append((*now, n, head))
    if out:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["at", "file", "block", "n", "head"])


def _runs(batch: pa.RecordBatch, value: str = "value") -> Iterator[tuple[tuple[int, int, int], pa.Array]]:
    """Each block of a batch with its lines."""
    if not batch.num_rows:
        return
    ids = [batch.column(c).to_numpy() for c in ("at", "file", "block")]
    new = np.zeros(batch.num_rows, bool)
    for x in ids:
        new[1:] |= x[1:] != x[:-1]
    cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield tuple(int(x[a]) for x in ids), batch.column(value).slice(a, b - a)


class _Block:
    """The lines of one block as they come, cut into records."""

    def __init__(self, first: int, base: int, n: int, rest: list[str]):
        self.line, self.base, self.last, self.rest = first, base, first + n, rest
        self.held = pa.array([], pa.string())

    def records(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        begin = self.line - len(self.held)
        self.line += len(lines)
        if len(self.held):
            lines = pa.concat_arrays([self.held, lines])
        # the lines before the first record belong to one that the block before has taken
        lines = lines.slice(-begin % LINES)
        begin += -begin % LINES
        whole = len(lines) // LINES
        self.held = lines.slice(whole * LINES)
        if whole:
            at = np.arange(whole) * LINES
            yield self._batch(begin // LINES, whole, [lines.take(pa.array(at + i)) for i in range(LINES)])

    def end(self) -> Iterator[pa.RecordBatch]:
        """The record that the block's end cuts, of which ``rest`` are the other lines."""
        if self.line != self.last:
            raise FastqError("a file has changed while it was read")
        if len(self.held):
            text = [*self.held.to_pylist(), *self.rest]
            yield self._batch((self.line - len(self.held)) // LINES, 1, [pa.array(text[i : i + 1] or [None], pa.string()) for i in range(LINES)])

    def _batch(self, record: int, n: int, columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(n) + self.base + record), *columns], schema=RECORD)


def _number(held):
    """The records of blocks; where a block begins is looked up in ``held`` or stands in rows around its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value if held is not None else None
        of, block = None, None
        for batch in batches:
            if known is not None:
                for now, lines in _runs(batch):
                    if now != of:
                        if block:
                            yield from block.end()
                        of, block = now, _Block(*known[now])
                    yield from block.records(lines)
            elif batch.num_rows:
                idx = batch.column("idx").to_numpy()
                kind = np.where(idx == HEADER, 0, np.where(idx < REST, 1, 2))
                cuts = [0, *(np.flatnonzero(np.diff(kind) != 0) + 1).tolist(), len(kind)]
                for a, b in zip(cuts, cuts[1:]):
                    value = batch.column("value").slice(a, b - a)
                    if kind[a] == 0:
                        # a block of a header alone cannot be: it would have no lines
                        if block:
                            yield from block.end()
                        block = _Block(*map(int, value[0].as_py().split()), [])
                    elif kind[a] == 1:
                        yield from block.records(value)
                    else:
                        block.rest += value.to_pylist()
        if block:
            yield from block.end()

    return run


def _blocks(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``(at, file, block, first, base, n, rest)``: what each block must know to cut its lines into records.

    ``first`` is the number of its first line in the file, ``base`` that of the file's first record among all,
    ``rest`` the lines of later blocks that end its last record.
    """
    heads = materialize(lines.drop("idx").mapInArrow(_heads, "at int, file long, block long, n long, head array<string>"), "block-heads")
    in_file = Window.partitionBy("at", "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads.withColumn("first", F.coalesce(F.sum("n").over(in_file), F.lit(0)))
    # a row per file
    order = Window.orderBy("at", "place").rowsBetween(Window.unboundedPreceding, -1)
    sizes = heads.groupBy("at", "file").agg(F.ceil(F.sum("n") / LINES).cast("long").alias("records")).join(files, ["at", "file"], "left")
    unknown = F.raise_error(F.lit("a file was read that had not been listed")).cast("long")
    before = F.when(F.col("place").isNull(), unknown).otherwise(F.coalesce(F.sum("records").over(order), F.lit(0)))
    bases = sizes.select("at", "file", before.alias("base"))
    starts = starts.join(bases, ["at", "file"])
    end = F.col("first") + F.col("n")
    begun = end - F.pmod(end, F.lit(LINES)) >= F.col("first")
    missing = F.when((F.pmod(end, F.lit(LINES)) != 0) & begun, F.pmod(-end, F.lit(LINES))).otherwise(0)
    wanted = starts.where(missing > 0).select("at", "file", "block", F.explode(F.sequence(end, end + missing - 1)).alias("line"))
    given = starts.select("at", "file", "first", F.posexplode("head").alias("i", "text")).select("at", "file", (F.col("first") + F.col("i")).alias("line"), "text")
    found = wanted.join(given, ["at", "file", "line"]).groupBy("at", "file", "block")
    rest = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("rest"))
    return materialize(starts.drop("head").join(rest, ["at", "file", "block"], "left").withColumn("rest", F.coalesce("rest", F.array().cast("array<string>"))), "blocks")


def read_lines_as_records(spark: SparkSession, paths: list[str], split_bytes: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(ordinal, name, sequence, comment, quality, reason)`` of all records; ``reason`` tells what is wrong with one.

    ``split_bytes`` is the size of the blocks that a file is read in, by default what gives every core some. The
    list of blocks goes to every task if it has at most ``broadcast_bytes``; otherwise the lines are brought together
    with it by block and put in order again, which gives the same records at the cost of a shuffle.
    """
    lines, files = _lines(spark, paths, split_bytes)
    blocks = _blocks(lines, files)
    size = blocks.agg(F.sum(F.lit(400) + F.aggregate("rest", F.lit(0), lambda n, t: n + F.octet_length(t)))).first()[0] or 0
    if size <= broadcast_bytes:
        rows = blocks.select("at", "file", "block", "first", "base", "n", "rest").collect()
        held = spark.sparkContext.broadcast({tuple(r[:3]): tuple(r[3:]) for r in rows})
        records = lines.drop("idx").mapInArrow(_number(held), RECORD_SQL)
    else:
        of = ["at", "file", "block"]
        header = blocks.select(*of, F.lit(HEADER).cast("long").alias("idx"), F.concat_ws(" ", "first", "base", "n").alias("value"))
        rest = blocks.select(*of, F.posexplode("rest").alias("i", "value")).select(*of, (F.col("i") + F.lit(REST)).alias("idx"), "value")
        together = lines.unionByName(header).unionByName(rest).repartition(*of).sortWithinPartitions(*of, "idx")
        records = together.mapInArrow(_number(None), RECORD_SQL)
    reason = (
        F.when(~F.coalesce(F.col("name").startswith("@"), F.lit(False)), "Invalid FASTQ name line")
        .when(F.col("sequence").isNull(), "Missing sequence line")
        .when(F.col("comment").isNull(), "Missing comment line")
        .when(~F.col("comment").startswith("+"), "Invalid FASTQ comment line")
        .when(F.col("quality").isNull(), "Missing quality line")
        .when(F.length("sequence") != F.length("quality"), "Sequence and quality length don't match")
    )
    return records.withColumn("reason", reason)


def read_fastq(spark: SparkSession, paths: str | list[str], phred_offset: int | None = None, mode: str = "strict", **how) -> DataFrame:
    """``(ordinal, r1)`` of FASTQ files, plain, gzip (any number of members) or bzip2, in the order of the files.

    A record is four lines; a quality may begin with ``@``. ``ordinal`` counts from 0 through
    all files, those of a folder or pattern by name. ``mode`` "strict" fails on the first bad record, "permissive" adds ``reason``
    and leaves ``r1`` null for bad ones (see ``operators.malformed`` for the edits that would
    mend them). Without ``phred_offset`` the encoding is told from the first records of the first file.

    Blocks of splittable files are read in parallel: a first pass counts their lines and keeps the
    first three of each, after which every block knows the numbers of its lines and how its last
    record ends. Records never leave their task. Both passes see the same blocks (``_lines``), and a block in which the second
    finds other lines than the first raises. ``how``: see ``read_lines_as_records``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if phred_offset is None:
        phred_offset = detect_encoding(spark, paths)
    records = read_lines_as_records(spark, paths, **how)
    read = read_struct(F.substring("name", 2, 2**31 - 1), F.col("sequence"), F.substring("comment", 2, 2**31 - 1), F.col("quality"), phred_offset)
    if mode == "permissive":
        return records.select("ordinal", F.when(F.col("reason").isNull(), read).alias("r1"), "reason")
    failed = F.raise_error(F.concat(F.col("reason"), F.lit(": record "), F.col("ordinal").cast("string"))).cast(records.select(read.alias("r")).schema["r"].dataType)
    return records.select("ordinal", F.when(F.col("reason").isNotNull(), failed).otherwise(read).alias("r1"))


def _outside(quality: str, low: int, high: int) -> Column:
    """How many characters of a quality have codes from ``low`` to ``high``."""
    return F.length(quality) - F.length(F.translate(quality, "".join(map(chr, range(low, high + 1))), ""))


LOW, HIGH = (33, 58), (80, 104)  # codes that only one of the encodings uses


def _encoding(low, high):
    return F.when((low == 0) & (high > 0), 64).when((high == 0) & (low > 0), 33).otherwise(0)


def phred_histogram(df: DataFrame, quality: str = "quality", ordinal: str = "ordinal", most: int | None = PROBE, groups: tuple[str, ...] = ()) -> DataFrame:
    """``(*groups, low, high, phred)`` over the first ``most`` records: characters with codes 33..58 and 80..104, and 33, 64 or 0 for neither.

    ``most`` is part of what the detection is: it looks at the start of a file. None looks at all records.
    """
    first = df.where(F.col(quality).isNotNull() & (F.lit(True) if most is None else F.col(ordinal) < most))
    sums = first.groupBy(*groups).agg(*[F.coalesce(F.sum(_outside(quality, *r)), F.lit(0)).alias(c) for c, r in (("low", LOW), ("high", HIGH))])
    return sums.withColumn("phred", _encoding(F.col("low"), F.col("high")))


def _told(found: int) -> int:
    if not found:
        raise FastqError("the first records do not tell the quality encoding; give the offset")
    return found


def detect_phred(records: DataFrame) -> int:
    """33 or 64; raises if the first records do not tell."""
    return _told(phred_histogram(records).first()["phred"])


def detect_encoding(spark: SparkSession, paths: list[str]) -> int:
    """``detect_phred`` of the first file that has lines, of which only the beginning is read: two counts for each line come to the driver."""
    for p in paths:
        codec(p)
        listed = sorted(spark.read.text(p).inputFiles())
        for f in [p] if len(listed) == 1 else [re.sub(r"([\\[\]{}*?])", r"\\\1", unquote(f)) for f in listed]:
            counts = spark.read.text(f).select(*[_outside("value", *r).alias(c) for c, r in (("low", LOW), ("high", HIGH))]).take(PROBE * LINES)
            if counts:
                low, high = (sum(r[i] for r in counts[LINES - 1 :: LINES]) for i in (0, 1))
                return _told(64 if not low and high else 33 if low and not high else 0)
    return _told(0)


def read_fastq_pair(spark: SparkSession, forward: str | list[str], reverse: str | list[str], phred_offset: int | None = None, mode: str = "strict", **how) -> DataFrame:
    """``(ordinal, r1, o1_name, o1_len, r2, o2_name, o2_len)``: records of two files paired by position.

    The excess of the longer file is dropped. Both files must be found to have one encoding.
    """
    sides = [[p] if isinstance(p, str) else list(p) for p in (forward, reverse)]
    if phred_offset is None:
        found = [detect_encoding(spark, s) for s in sides]
        if found[0] != found[1]:
            raise FastqError(f"the inputs have different encodings: {found[0]} and {found[1]}")
        phred_offset = found[0]
    f, r = (read_fastq(spark, s, phred_offset, mode, **how) for s in sides)
    return paired(f, r)


def fastq_text(read) -> Column:
    """The four lines of a read, without the last line end."""
    return F.concat(F.lit("@"), read["name"], F.lit("\n"), read["sequence"], F.lit("\n+"), read["comment"], F.lit("\n"), read["quality"])


def write_fastq(df: DataFrame, path: str, read: str = "read", compression: str | None = None, level: int | None = None, single_file: bool = False) -> None:
    """Write reads in order of ``ordinal``: a folder of parts, or one file of all parts put end to end.

    A path that ends with ``/`` always is a folder of parts, which is written in parallel.

    The codec is ``compression`` or what the path's suffix names. Parts of gzip or bzip2 put end to
    end are one valid file; readers of several members see the same text.
    """
    kind = compression or codec(path)
    text = df.select("ordinal", fastq_text(F.col(read)).alias("value")).where("value IS NOT NULL")
    write_lines(text, ["ordinal"], path, kind, level, single_file)


def write_trim_log(lines: DataFrame, path: str, single_file: bool = True) -> None:
    """Write ``stats.log_lines`` in order of read and mate."""
    write_lines(lines, ["ordinal", "mate"], path, codec(path), None, single_file)


def write_lines(lines: DataFrame, order: list[str], path: str, kind: str | None, level: int | None, single_file: bool) -> None:
    spark = lines.sparkSession
    single_file &= not path.endswith("/")
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value")
    at = f"{path}.parts" if single_file else path
    compressed(ranged.write.mode("overwrite"), kind, level).text(at)
    if single_file:
        _join_parts(spark, at, path)


def _join_parts(spark: SparkSession, parts: str, path: str) -> None:
    """One file of the parts in order, which go: the file system links their blocks where it can, else they are copied."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    names = sorted(s.getPath().toString() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    out = fs.create(target, True)
    try:
        if names:
            out.close()
            paths = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(names))
            for i, name in enumerate(names):
                paths[i] = jvm.org.apache.hadoop.fs.Path(name)
            try:
                fs.concat(target, paths)
                names = []
            except (Py4JJavaError, PySparkException):
                out = fs.create(target, True)
        for name in names:
            part = fs.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()
    fs.delete(source, True)
