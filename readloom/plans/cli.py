"""Command line: ``SE``, ``PE``, ``REPAIR`` and ``-version`` over FASTQ files.

``python -m readloom PE [-phred33|-phred64] [-trimlog FILE] [-summary FILE] [-basein FILE]
[-baseout FILE] [-validatePairs] [-compressLevel N] [-quiet] IN1 IN2 1P 1U 2P 2U STEP...``
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from readloom import __version__
from readloom.operators.pairs import repair_by_name, route, survivors, validate_pairs
from readloom.operators.stats import log_lines, paired_stats, single_stats, stats_line, stats_summary, trim_log
from readloom.operators.steps import parse_steps
from readloom.plans.chain import trim_paired, trim_single
from readloom.schema import single
from readloom.session import materialize, scratch
from readloom.sources.fastq import read_fastq, read_fastq_pair, write_fastq, write_trim_log
from readloom.sources.templates import mate_path, output_paths

log = logging.getLogger("readloom")

VALUED = {"-trimlog", "-summary", "-basein", "-baseout", "-compressLevel", "-threads"}
FLAGS = {"-phred33", "-phred64", "-validatePairs", "-quiet", "-version", "-compressStream", "-compressBlock"}
PAIRED_ONLY = {"-basein", "-baseout", "-validatePairs"}


class UsageError(ValueError):
    """The arguments are not understood."""


@dataclass
class Options:
    mode: str
    values: dict[str, str] = field(default_factory=dict)
    flags: set[str] = field(default_factory=set)
    inputs: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    steps: list[str] = field(default_factory=list)

    @property
    def phred(self) -> int | None:
        return 33 if "-phred33" in self.flags else 64 if "-phred64" in self.flags else None

    @property
    def level(self) -> int | None:
        return int(self.values["-compressLevel"]) if "-compressLevel" in self.values else None


def parse(args: list[str]) -> Options:
    """Options and files of a ``SE`` or ``PE`` run; -threads and the compression modes are taken and have no effect."""
    if not args or args[0] not in ("SE", "PE"):
        raise UsageError("begin with SE, PE or REPAIR")
    o, rest, i = Options(args[0]), [], 1
    while i < len(args):
        a = args[i]
        if a.startswith("-") and not rest or a in VALUED | FLAGS:
            if a in PAIRED_ONLY and o.mode == "SE" or a not in VALUED | FLAGS:
                raise UsageError(f"unknown option {a}")
            if a in VALUED:
                if i + 1 == len(args):
                    raise UsageError(f"{a} needs a value")
                i += 1
                o.values[a] = args[i]
            else:
                o.flags.add(a)
        else:
            rest.append(a)
        i += 1
    if "-threads" in o.values or o.flags & {"-compressStream", "-compressBlock"}:
        log.info("Spark sets the parallelism and compresses by part; -threads, -compressStream and -compressBlock have no effect")
    if o.level is not None and not 1 <= o.level <= 9:
        raise UsageError("-compressLevel is within 1..9")
    ins, outs = (1, 1) if o.mode == "SE" else (0 if "-basein" in o.values else 2, 0 if "-baseout" in o.values else 4)
    if len(rest) < ins + outs + 1:
        raise UsageError(f"{o.mode} needs {ins} input files, {outs} output files and a step")
    o.inputs, o.outputs, o.steps = rest[:ins], rest[ins : ins + outs], rest[ins + outs :]
    if "-basein" in o.values:
        o.inputs = [o.values["-basein"], mate_path(o.values["-basein"])]
    if "-baseout" in o.values:
        o.outputs = list(output_paths(o.values["-baseout"]).values())
    return o


def _report(o: Options, row: dict) -> str:
    line = stats_line(row)
    if "-quiet" not in o.flags:
        print(line)
    if "-summary" in o.values:
        with open(o.values["-summary"], "w", encoding="utf-8") as f:
            f.write(stats_summary(row))
    return line


def run(spark: SparkSession, args: list[str]) -> dict:
    """Run ``SE``, ``PE`` or ``REPAIR``; returns the row of counts. What was written down on the way is removed."""
    if "-version" in args:
        print(__version__)
        return {"version": __version__}
    with scratch():
        return repair(spark, args[1:]) if args and args[0] == "REPAIR" else trim_files(spark, parse(args))


def trim_files(spark: SparkSession, o: Options) -> dict:
    """The trimmed frame is written once and read by every output."""
    steps = parse_steps(o.steps)
    if o.mode == "SE":
        done = materialize(trim_single(single(read_fastq(spark, o.inputs[0], o.phred)), steps), "trimmed")
        write_fastq(survivors(done), o.outputs[0], level=o.level, single_file=True)
        row = single_stats(done).first().asDict()
    else:
        if "-validatePairs" in o.flags:
            bad = validate_pairs(read_fastq(spark, o.inputs[0], o.phred), read_fastq(spark, o.inputs[1], o.phred)).first()
            if bad:
                log.warning("Pair validation failed at record: %d (%s, %s)", *bad)
        done = materialize(trim_paired(read_fastq_pair(spark, *o.inputs, o.phred), steps), "trimmed")
        for path, reads in zip(o.outputs, route(done).values()):
            write_fastq(reads, path, level=o.level, single_file=True)
        row = paired_stats(done).first().asDict()
    if "-trimlog" in o.values:
        write_trim_log(log_lines(trim_log(done)), o.values["-trimlog"])
    _report(o, row)
    return row


def repair(spark: SparkSession, args: list[str]) -> dict:
    """``REPAIR [-delim C] IN1 IN2 1P 1U 2P 2U``: pair two files by name."""
    delimiter = None
    if args[:1] == ["-delim"]:
        delimiter, args = args[1], args[2:]
    if len(args) != 6:
        raise UsageError("REPAIR needs 2 input and 4 output files")
    # names decide, so the encoding does not matter
    sides = [materialize(read_fastq(spark, p, 33), "reads") for p in args[:2]]
    parts = repair_by_name(*sides, delimiter)
    for path, reads in zip(args[2:], parts.values()):
        write_fastq(reads, path, single_file=True)
    return {k: v.agg(F.count(F.lit(1))).first()[0] for k, v in parts.items()}


def main(argv: list[str]) -> int:
    logging.basicConfig(level=logging.WARNING if "-quiet" in argv else logging.INFO, format="%(message)s")
    spark = SparkSession.builder.appName("readloom").getOrCreate()
    try:
        run(spark, argv)
    except UsageError as e:
        print(f"{e}\n{__doc__}")
        return 1
    return 0
