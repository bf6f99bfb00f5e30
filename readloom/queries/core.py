"""Queries of the engine's own operators over the test tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.names import PATTERNS, canonical_name
from readloom.functions.quality import quality_values
from readloom.functions.sequence import normal_sequence, reverse_complement
from readloom.operators.barcodes import split_barcodes
from readloom.operators.clip import Adapters, make_clip, sort_adapters
from readloom.operators.malformed import parse_records
from readloom.operators.pairs import RepairError, paired_by_name, repair_by_name, routed, validate_pairs
from readloom.operators.stats import PAIRED_LABELS, log_lines, paired_stats, single_stats, stats_line, trim_log
from readloom.plans.chain import trim_paired, trim_single
from readloom.schema import paired, read_struct, single
from readloom.session import broadcast_if_small, scratch_dir, spread, table
from readloom.sources.fastq import phred_histogram, read_fastq, write_fastq
from readloom.streaming import read_stream, run_available, running_stats, trim_stream


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ordinal, r1)`` of fastq_reads, redelivered rows included; where the offset is null, that of the run."""
    runs = table(spark, sf_dir, "runs").select(F.col("run_id").alias("of"), F.col("phred_offset").alias("run_offset"))
    cols = ["ordinal", "run_id", "name", "sequence", "comment", "quality", "barcode_label", "phred_offset", "head_pos"]
    rows = spread(table(spark, sf_dir, "fastq_reads").select(*cols)).join(broadcast_if_small(runs, 80), F.col("run_id") == F.col("of"), "left")
    offset = F.coalesce("phred_offset", "run_offset")
    read = read_struct(F.col("name"), F.col("sequence"), F.col("comment"), F.col("quality"), offset, F.col("barcode_label"), F.col("head_pos"))
    return rows.select("ordinal", read.alias("r1")).where("r1 IS NOT NULL")


def _mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "mates")
    read = read_struct(F.col("name"), F.col("sequence"), F.col("comment"), F.col("quality"), F.col("phred_offset"), F.col("barcode_label"), F.col("head_pos"))
    return m.select("ordinal", read.alias("r1")).where("r1 IS NOT NULL")


def _singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(_reads(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(_reads(spark, sf_dir), _mates(spark, sf_dir))


def _kept(df: DataFrame, read: str = "r1") -> DataFrame:
    r = F.col(read)
    return df.where(r.isNotNull()).select("ordinal", r["sequence"].alias("sequence"), r["quality"].alias("quality"), r["phred_offset"].alias("phred_offset"), r["head_pos"].alias("head_pos"))


def _lengths(df: DataFrame) -> DataFrame:
    """Lengths of both reads, -1 for a dropped one."""
    length = lambda r: F.coalesce(F.length(F.col(r)["sequence"]), F.lit(-1))
    return df.select("ordinal", length("r1").alias("length1"), length("r2").alias("length2"))


def _step(*steps: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _kept(trim_single(_singles(spark, sf_dir), list(steps)))


CHAIN = ["LEADING:3", "TRAILING:3", "SLIDINGWINDOW:4:15", "MINLEN:36"]
LONG_CHAIN = ["TOPHRED33", "LEADING:3", "TRAILING:3", "HEADCROP:1", "CROP:140", "SLIDINGWINDOW:4:15", "TAILCROP:1", "AVGQUAL:20", "BASECOUNT:N:0:5", "MAXLEN:150", "MINLEN:36", "TOPHRED64"]


def slot_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = trim_paired(_pairs(spark, sf_dir), ["HEADCROP:3:60:5:50", "TAILCROP:1:58:0:0:2:45"])
    return done.select("ordinal", F.col("r1")["sequence"].alias("s1"), F.col("r2")["sequence"].alias("s2"))


MOST_ADAPTERS = 100_000


def _adapter_rows(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """The adapter table as (name, sequence), which every task gets: tens of rows, refused beyond ``MOST_ADAPTERS``."""
    rows = table(spark, sf_dir, "adapters").where("sequence IS NOT NULL").select("name", F.upper("sequence"), "side").orderBy("name").limit(MOST_ADAPTERS + 1).collect()
    if len(rows) > MOST_ADAPTERS:
        raise ValueError("too many adapters")
    end = {"forward": "/1", "reverse": "/2"}
    return [(n.removesuffix("/1").removesuffix("/2") + end.get(side, ""), s) for n, s, side in rows]


def _adapters(spark: SparkSession, sf_dir: str) -> Adapters:
    return sort_adapters(_adapter_rows(spark, sf_dir))


def clip_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(trim_single(_singles(spark, sf_dir), [make_clip(_adapters(spark, sf_dir), ["2", "30", "10"])]))


def _palindromes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    # a forward and a reverse sequence of one name are a pair
    rows = _adapter_rows(spark, sf_dir)
    a, named = sort_adapters(rows), sort_adapters([(f"Prefix{n}", x) for n, x in rows])
    # as in files that list both, each is searched for by itself too: a pair alone tells only read-through into both mates
    clip = make_clip(Adapters(named.pairs, a.forward, a.reverse, a.common), ["2", "30", "10", *more])
    done = trim_paired(_pairs(spark, sf_dir), [clip])
    return _lengths(done)


def clip_palindrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _palindromes(spark, sf_dir)


def clip_keep_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _palindromes(spark, sf_dir, "2", "true")


def barcode_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = {"one": "ACGT", "two": "ACG", "three": "TT", "four": "GATTA"}
    done = split_barcodes(_reads(spark, sf_dir), codes, clip=True)
    return done.select("ordinal", F.col("r1")["barcode_label"].alias("label"), F.length(F.col("r1")["sequence"]).alias("length"), F.col("r1")["head_pos"].alias("head_pos"))


def barcode_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = split_barcodes(_reads(spark, sf_dir), {"one": "ACGTAC", "two": "TTGATC"}, most=2)
    return done.groupBy(F.col("r1")["barcode_label"].alias("label")).agg(F.count(F.lit(1)).alias("n"))


def pair_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("ordinal", "o1_name", "o1_len", "o2_name", "o2_len")


def pair_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = routed(trim_paired(_pairs(spark, sf_dir), ["TRAILING:20", "MINLEN:60"]))
    return done.select("ordinal", "stream", F.col("read")["sequence"].alias("sequence"))


def pair_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_pairs(_reads(spark, sf_dir).join(_mates(spark, sf_dir).select("ordinal"), "ordinal", "left_semi").dropDuplicates(["ordinal"]), _mates(spark, sf_dir))


def name_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fastq_reads").select("ordinal", canonical_name(F.col("name")).alias("canonical"))


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).groupBy("ordinal").agg(F.min_by("r1", F.col("r1")["name"]).alias("r1"))


def repair_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired_by_name(_once(spark, sf_dir), _mates(spark, sf_dir), " ").select("ordinal1", "ordinal2")


def repair_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and mates paired anew by name: which of the four outputs each goes to, whether or not ``repair_check`` refuses the tables."""
    parts = repair_by_name(_once(spark, sf_dir), _mates(spark, sf_dir), " ", check=False)
    return reduce(DataFrame.unionByName, [d.select(F.lit(stream).alias("stream"), "ordinal", F.col("read")["name"].alias("name")) for stream, d in parts.items()])


def repair_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the names of reads and mates cannot be paired, of the tests for repeated names and order; null if they can."""
    reason = None
    try:
        repair_by_name(_once(spark, sf_dir), _mates(spark, sf_dir), " ")
    except RepairError as e:
        reason = str(e)
    return spark.createDataFrame([(reason,)], "reason string")


def stats_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single_stats(trim_single(_singles(spark, sf_dir), CHAIN))


def stats_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired_stats(trim_paired(_pairs(spark, sf_dir), ["TRAILING:20", "MINLEN:60"]))


def log_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim_log(trim_single(_singles(spark, sf_dir), ["HEADCROP:3", "TRAILING:10", "MINLEN:50"]))


def log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded log, each read and mate once."""
    log = table(spark, sf_dir, "trim_log").groupBy("ordinal", "mate").agg(F.max("length").alias("length"), F.max("trim_tail").alias("trim_tail"), F.max("start_pos").alias("start_pos"))
    return log.groupBy("mate").agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("length") == 0).alias("dropped"), F.sum("length").alias("bases"), F.sum("start_pos").alias("head"), F.sum("trim_tail").alias("tail"))


def phred_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the qualities of each run tell of its encoding, over all its reads."""
    return phred_histogram(table(spark, sf_dir, "fastq_reads").select("run_id", "quality", "ordinal"), most=None, groups=("run_id",))


def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fastq_reads").select("ordinal", reverse_complement(F.col("sequence")).alias("other_strand"))


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fastq_reads").select("ordinal", normal_sequence(F.col("sequence")).alias("sequence"))


def quality_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate(quality_values(F.col("r1")), F.lit(0).cast("long"), lambda a, q: a + q)
    return _reads(spark, sf_dir).select("ordinal", total.alias("total"))


def chain_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lengths(trim_paired(_pairs(spark, sf_dir), CHAIN))


def chain_clip_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipping and trimming of pairs in one chain, summed up."""
    return paired_stats(trim_paired(_pairs(spark, sf_dir), [make_clip(_adapters(spark, sf_dir), ["2", "30", "10"]), *CHAIN]))


def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as compressed FASTQ parts and read back, numbered in file order."""
    at = f"{scratch_dir(spark)}/fastq-{uuid.uuid4().hex}"
    write_fastq(_reads(spark, sf_dir).select("ordinal", F.col("r1").alias("read")), at, compression="gzip")
    return read_fastq(spark, at, 33).select("r1.name", "r1.sequence", "r1.comment", "r1.quality")


def _blocks(spark: SparkSession, sf_dir: str, suffix: str, split_bytes: int) -> DataFrame:
    """Reads written as one file in order and read back in blocks, with their numbers."""
    at = f"{scratch_dir(spark)}/fastq-{uuid.uuid4().hex}.fq{suffix}"
    write_fastq(_reads(spark, sf_dir).select("ordinal", F.col("r1").alias("read")), at, single_file=True)
    return read_fastq(spark, at, 33, split_bytes=split_bytes).select("ordinal", "r1.name", "r1.sequence", "r1.comment", "r1.quality")


def fastq_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, "", 100_000)


def fastq_bzip2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, ".bz2", 300_000)


def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain over a stream of the table's files with running counts; the last counts come out. Where the offset is null, that of the run."""
    path = f"{sf_dir}/fastq_reads.parquet"
    # a pattern, as the table is a file here and a folder there
    rows = read_stream(spark, f"{sf_dir}/fastq_reads.parque[t]", spark.read.parquet(path).schema).where("sequence IS NOT NULL AND quality IS NOT NULL")
    runs = table(spark, sf_dir, "runs").select(F.col("run_id").alias("of"), F.col("phred_offset").alias("run_offset"))
    rows = rows.join(broadcast_if_small(runs, 80), F.col("run_id") == F.col("of"), "left").withColumn("phred_offset", F.coalesce("phred_offset", "run_offset"))
    read = read_struct(F.col("name"), F.col("sequence"), F.col("comment"), F.col("quality"), F.col("phred_offset"), F.col("barcode_label"), F.col("head_pos"))
    counts = running_stats(trim_stream(single(rows.select("ordinal", read.alias("r1"))), CHAIN))
    last: list = []
    run_available(counts, lambda batch, _: last.append(batch.collect()), "complete")
    return spark.createDataFrame(last[-1] if last else [], "input long, surviving long, dropped long")


def stats_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of counts of a paired run."""
    row = stats_pe(spark, sf_dir).first().asDict()
    return spark.createDataFrame([(stats_line(row),)], "line string")


def log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the log of a run, as written to a file."""
    return log_lines(log_se(spark, sf_dir)).select("ordinal", "mate", F.col("value").alias("line"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(table(spark, sf_dir, "raw_records"), "raw_id").where("reason IS NOT NULL").select("raw_id", "reason")


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(table(spark, sf_dir, "raw_records"), "raw_id").where("reason IS NULL").select("raw_id", "read.*")


def p3_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every record that fails for its quotes, delimiters or line ends."""
    bad = parse_records(table(spark, sf_dir, "raw_records"), "raw_id").where("cost > 0")
    return bad.select("raw_id", "reason", "cost", F.concat_ws("; ", "edits").alias("edits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "leading": _step("LEADING:20"),
    "trailing": _step("TRAILING:20"),
    "headcrop": _step("HEADCROP:5:60"),
    "tailcrop": _step("TAILCROP:7:50"),
    "crop": _step("CROP:80"),
    "slidingwindow": _step("SLIDINGWINDOW:4:15"),
    "maxinfo": _step("MAXINFO:40:0.5"),
    "minlen": _step("MINLEN:76"),
    "maxlen": _step("MAXLEN:100"),
    "avgqual": _step("AVGQUAL:28"),
    "basecount": _step("BASECOUNT:GC:20:60"),
    "tophred33": _step("TOPHRED33"),
    "tophred64": _step("TOPHRED64"),
    "chain_se": _step(*CHAIN),
    "chain_long": _step(*LONG_CHAIN),
    **{
        f.__name__: f
        for f in (
            slot_crops, clip_simple, clip_palindrome, clip_keep_both, barcode_split, barcode_mismatch, pair_zip, pair_route, pair_validate, name_canonical, repair_names, repair_split, repair_check,
            stats_se, stats_pe, log_se, log_totals, phred_detect, revcomp, normal, quality_sums, chain_pe, chain_clip_pe, fastq_round_trip, fastq_blocks, fastq_bzip2, stream_stats, stats_text, log_text, p3_found, p3_loaded, p3_edits,
        )
    },
}

# --- SQL -------------------------------------------------------------------------------------------
# Each step maps rows of the state (ordinal, s, q, o, h) to such rows; v are the qualities.


def _values(s: str = "s", q: str = "q", o: str = "o") -> str:
    return f"list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN {s}[i] = 'N' THEN 0 ELSE ascii({q}[i]) - {o} END)"


_START = """reads AS (SELECT f.ordinal, f.name, f.sequence AS s, f.quality AS q, coalesce(f.phred_offset, r.phred_offset) AS o, f.head_pos AS h
  FROM fastq_reads f LEFT JOIN runs r USING (run_id) WHERE f.sequence IS NOT NULL AND f.quality IS NOT NULL)"""
_MATES = "mates_ok AS (SELECT ordinal, name, sequence AS s, quality AS q, phred_offset AS o, head_pos AS h FROM mates WHERE sequence IS NOT NULL AND quality IS NOT NULL)"
_CUT = "s[{a}:{b}] AS s, q[{a}:{b}] AS q, o, CAST(h + {a} - 1 AS INTEGER) AS h"


def _sql_step(step: str, source: str) -> str:
    """A query over the state ``source`` that gives the state after the step."""
    name, *args = step.split(":")
    n = "length(s)"
    keep = f"(SELECT *, {_values()} AS v FROM {source})"
    if name == "LEADING":
        return f"SELECT ordinal, name, {_CUT.format(a='k', b='length(s)')} FROM (SELECT *, list_position(list_transform(v, lambda x: x >= {args[0]}), true) AS k FROM {keep}) WHERE k > 0"
    if name == "TRAILING":
        return f"SELECT ordinal, name, {_CUT.format(a='1', b='k')} FROM (SELECT *, list_max(list_filter(range(2, {n} + 1), lambda i: v[i] >= {args[0]})) AS k FROM {keep}) WHERE k IS NOT NULL"
    if name in ("HEADCROP", "TAILCROP"):
        most = args[1] if len(args) > 1 else str((2**31 - 1) // 2)
        gone = f"{args[0]} + greatest(0, {n} - {args[0]} - {most})"
        part = _CUT.format(a="g + 1", b=n) if name == "HEADCROP" else _CUT.format(a="1", b=f"{n} - g")
        return f"SELECT ordinal, name, {part} FROM (SELECT *, {gone} AS g FROM {source}) WHERE {n} > g"
    if name == "CROP":
        return f"SELECT ordinal, name, {_CUT.format(a='1', b=args[0])} FROM {source}"
    if name == "SLIDINGWINDOW":
        w, q = int(args[0]), args[1]
        total = " + ".join(f"v[i + {j}]" for j in range(w))
        low = f"list_position(list_transform(range(1, {n} - {w} + 2), lambda i: {total} < {w} * {q}), true)"
        kept = f"CASE WHEN coalesce(f, 0) = 0 THEN {n} ELSE f + {w} - 2 END"
        last = f"greatest(1, coalesce(list_max(list_filter(range(1, k + 1), lambda i: v[i] >= {q})), 1))"
        return f"SELECT ordinal, name, {_CUT.format(a='1', b='m')} FROM (SELECT *, {last} AS m FROM (SELECT *, {kept} AS k FROM (SELECT *, {low} AS f FROM {keep} WHERE {n} >= {w}) WHERE f IS NULL OR f <> 1))"
    if name == "MINLEN":
        return f"SELECT * FROM {source} WHERE {n} >= {args[0]}"
    if name == "MAXLEN":
        return f"SELECT * FROM {source} WHERE {n} <= {args[0]}"
    if name == "AVGQUAL":
        return f"SELECT ordinal, name, s, q, o, h FROM {keep} WHERE coalesce(list_sum(v), 0) >= {args[0]} * {n}"
    if name == "BASECOUNT":
        count = f"{n} - length(translate(s, '{args[0]}', ''))"
        return f"SELECT * FROM {source} WHERE {count} >= {args[1] if len(args) > 1 else 0}" + (f" AND {count} <= {args[2]}" if len(args) > 2 else "")
    if name in ("TOPHRED33", "TOPHRED64"):
        to = int(name[-2:])
        moved = f"array_to_string(list_transform(string_split(q, ''), lambda c: chr(ascii(c) {'- 31' if to == 33 else '+ 31'})), '')"
        return f"SELECT ordinal, name, s, CASE WHEN o = {to} THEN q ELSE {moved} END AS q, {to} AS o, h FROM {source}"
    if name == "MAXINFO":
        # the tables as SQL: 64-bit fixed-point logarithms, by length and by quality
        t, strict = args
        lengths = f"list_transform(range(0, 1000), lambda i: -ln(1 + exp(CAST({t} - i - 1 AS DOUBLE))) + ln(i + 1.0::DOUBLE) * CAST(1 - CAST({strict} AS FLOAT) AS DOUBLE))"
        qualities = f"list_transform(range(0, 61), lambda x: ln(1 - pow(0.1::DOUBLE, (0.5 + x) / 10.0)) * CAST(CAST({strict} AS FLOAT) AS DOUBLE))"
        ratio = lambda v: f"9223372036854775807::DOUBLE / (greatest({v}[1], list_max(list_transform({v}[2:], lambda y: abs(y)))) * 2000)"
        scale = f"SELECT ln_, q_, greatest({ratio('ln_')}, {ratio('q_')}) AS k_ FROM (SELECT {lengths} AS ln_, {qualities} AS q_)"
        tables = f"SELECT list_transform(ln_, lambda y: CAST(trunc(y * k_) AS BIGINT)) AS ln_, list_transform(q_, lambda y: CAST(trunc(y * k_) AS BIGINT)) AS q_ FROM ({scale})"
        return f"""SELECT ordinal, name, {_CUT.format(a='1', b='k')} FROM (SELECT *, list_max(list_filter(range(1, len(score) + 1), lambda i: score[i] = list_max(score))) AS k, list_max(score) AS top FROM
          (SELECT *, list_transform(range(1, {n} + 1), lambda i: CAST(ln_[i] + list_sum(list_transform(v[1:i], lambda x: q_[least(greatest(x, 0), 60) + 1])) AS DOUBLE)) AS score FROM {keep}, ({tables}))) WHERE {n} > 0 AND top <> 0"""
    raise ValueError(step)


def _sql_chain(steps: list[str], source: str = "reads", tag: str = "t") -> tuple[str, str]:
    """CTEs for a chain and the name of the last."""
    parts = []
    for i, step in enumerate(steps):
        parts.append(f"{tag}{i} AS ({_sql_step(step, source)})")
        source = f"{tag}{i}"
    return ", ".join(parts), source


_STATE = "ordinal, s AS sequence, q AS quality, CAST(o AS INTEGER) AS phred_offset, h AS head_pos"


def _sql_kept(*steps: str) -> str:
    with_, last = _sql_chain(list(steps))
    return f"WITH {_START}, {with_} SELECT {_STATE} FROM {last}"


def _sql_pairs(steps1: list[str], steps2: list[str], select: str) -> str:
    """Both sides of each pair after their steps: rows carry a number, as ordinals of reads repeat."""
    both = "pairs AS (SELECT row_number() OVER () AS i, r.ordinal, r.name AS n1, r.s AS s1, r.q AS q1, r.o AS o1, r.h AS h1, m.name AS n2, m.s AS s2, m.q AS q2, m.o AS o2, m.h AS h2 FROM reads r JOIN mates_ok m USING (ordinal))"
    one, last1 = _sql_chain(steps1, "side1", "a")
    two, last2 = _sql_chain(steps2, "side2", "b")
    sides = "side1 AS (SELECT i AS ordinal, n1 AS name, s1 AS s, q1 AS q, o1 AS o, h1 AS h FROM pairs), side2 AS (SELECT i AS ordinal, n2 AS name, s2 AS s, q2 AS q, o2 AS o, h2 AS h FROM pairs)"
    out = f"done AS (SELECT p.ordinal, x.s AS a, y.s AS b FROM pairs p LEFT JOIN {last1} x ON x.ordinal = p.i LEFT JOIN {last2} y ON y.ordinal = p.i)"
    return f"WITH {_START}, {_MATES}, {both}, {sides}, {one}, {two}, {out} {select}"


_BITS = "2 * hamming({0}, {1}) - hamming(translate({0}, 'ACGT', 'BBBB'), translate({1}, 'ACGT', 'BBBB')) <= 4"
_PLAIN = "regexp_replace({}, '[^ACGT]', 'N', 'g')"


def _sql_simple(source: str, side: str, tag: str) -> str:
    """CTEs ending in ``{tag}cut`` (ordinal, k): the leftmost offset of each row at which an adapter of the side, or a common one, matches.

    Seeds are 16-mers of which at most two bases differ, every fourth of an adapter of 24 bases or more; a place with
    a seed and over 15 bases of overlap matches if 17 bases (a score of 10) agree without a mismatch between them.
    """
    return f"""{tag}ad AS (SELECT DISTINCT upper(sequence) AS c FROM adapters WHERE side IN ('{side}', 'common') AND length(sequence) >= 16),
      {tag}seed AS (SELECT c, unnest(range(0, length(c) - 15, CASE WHEN length(c) < 24 THEN 1 ELSE 4 END)) AS j FROM {tag}ad),
      {tag}win AS (SELECT c, j, substr({_PLAIN.format("c")}, j + 1, 16) AS w FROM {tag}seed),
      {tag}pos AS (SELECT ordinal, i, substr({_PLAIN.format("s")}, i + 1, 16) AS w FROM (SELECT ordinal, s, unnest(range(0, length(s) - 15)) AS i FROM {source})),
      {tag}text AS (SELECT DISTINCT w FROM {tag}pos),
      {tag}near AS (SELECT t.w, x.c, x.j FROM {tag}text t JOIN {tag}win x ON {_BITS.format("t.w", "x.w")}),
      {tag}at AS (SELECT DISTINCT ordinal, c, i - j AS f FROM {tag}pos JOIN {tag}near USING (w)),
      {tag}over AS (SELECT a.*, r.s, r.o, r.q, least(length(r.s) - greatest(f, 0), length(c) - greatest(-f, 0)) AS m FROM {tag}at a JOIN {source} r USING (ordinal)),
      {tag}run AS (SELECT ordinal, f, array_to_string(list_transform(range(1, m + 1), lambda t: CASE WHEN s[greatest(f, 0) + t] = 'N' OR c[greatest(-f, 0) + t] = 'N' THEN '0'
          WHEN s[greatest(f, 0) + t] = c[greatest(-f, 0) + t] THEN 'M' WHEN ascii(q[greatest(f, 0) + t]) - o = 0 THEN '0' ELSE 'X' END), '') AS z FROM {tag}over WHERE m > 15),
      {tag}cut AS (SELECT ordinal, min(f) AS k FROM {tag}run WHERE list_max(list_transform(string_split(z, 'X'), lambda y: length(replace(y, '0', '')))) >= 17 GROUP BY ordinal)"""


def _sql_palindrome(least: int) -> str:
    """CTEs ending in ``pal`` (i, k): the bases kept of pairs that read through, over ``pairs``; k is null without a match."""
    return f"""couple AS (SELECT p, right(x, p) AS x, right(y, p) AS y FROM (SELECT upper(f.sequence) AS x, upper(r.sequence) AS y, least(length(x), length(y)) AS p FROM adapters f
          JOIN adapters r ON f.side = 'forward' AND r.side = 'reverse' AND regexp_replace(f.name, '/[12]$', '') = regexp_replace(r.name, '/[12]$', ''))),
      laid AS (SELECT i, p, x || s1 AS a, y || s2 AS b, q1, q2, o1, o2, length(x || s1) AS la, length(y || s2) AS lb FROM pairs, couple),
      steps AS (SELECT *, unnest(range(greatest(p - 16, 0), greatest(la, lb) - 15 - {least})) AS n FROM laid WHERE la - 15 > p AND lb - 15 > p),
      ways AS (SELECT *, least(n // 2 - greatest(p - 16, 0) // 2, least(la, lb) - 16 - p) AS up FROM steps),
      places AS (SELECT *, p + up AS ref, n - up AS test FROM ways),
      cmp AS (SELECT *, {_PLAIN.format("a")} AS pa, {_PLAIN.format("b")} AS pb FROM places),
      hit AS (SELECT *, n + p + 16 AS total FROM cmp WHERE test < lb - 15 AND {_BITS.format("substr(pa, ref + 1, 16)", "reverse(translate(substr(pb, test + 1, 16), 'ACGT', 'TGCA'))")}
          OR test < la - 15 AND {_BITS.format("substr(pa, test + 1, 16)", "reverse(translate(substr(pb, ref + 1, 16), 'ACGT', 'TGCA'))")}),
      both_ AS (SELECT *, greatest(total - la, 0) AS skb, greatest(total - lb, 0) AS ska, total - greatest(total - la, 0) - greatest(total - lb, 0) AS m FROM hit),
      score AS (SELECT i, p, total, list_transform(range(0, m), lambda t: struct_pack(c := a[t + ska + 1], d := translate(pb[skb + m - t], 'ACGT', 'TGCA'),
          e := CASE WHEN t + ska < p THEN 100 WHEN a[t + ska + 1] = 'N' THEN 0 ELSE ascii(q1[t + ska + 1 - p]) - o1 END,
          g := CASE WHEN skb + m - t <= p THEN 100 WHEN b[skb + m - t] = 'N' THEN 0 ELSE ascii(q2[skb + m - t - p]) - o2 END)) AS v FROM both_),
      sums AS (SELECT i, total - 2 * p AS k, list_sum(list_transform(v, lambda z: CASE WHEN z.c = 'N' OR z.d = 'N' THEN 0::DECIMAL(9, 5) WHEN z.c = z.d THEN 0.60206::DECIMAL(9, 5) ELSE -(least(z.e, z.g) // 10)::DECIMAL(9, 5) END)) AS t FROM score),
      pal AS (SELECT i, min(k) AS k FROM sums WHERE t >= 30 GROUP BY i)"""


def _sql_clipped(source: str, tag: str, kept: str | None = None) -> str:
    """The state after clipping; ``kept`` is a query (ordinal, k) of further cuts."""
    cuts = f"(SELECT ordinal, min(k) AS k FROM (SELECT * FROM {tag}cut{f' UNION ALL {kept}' if kept else ''}) GROUP BY ordinal)"
    return f"{tag}clipped AS (SELECT r.ordinal, r.name, {_CUT.format(a='1', b='coalesce(c.k, length(s))')} FROM {source} r LEFT JOIN {cuts} c ON c.ordinal = r.ordinal WHERE c.k IS NULL OR c.k > 0)"


def _sql_clip_single() -> str:
    numbered = "numbered AS (SELECT row_number() OVER () AS ordinal, ordinal AS true_, name, s, q, o, h FROM reads)"
    return f"""WITH {_START}, {numbered}, {_sql_simple("numbered", "forward", "f")}, {_sql_clipped("numbered", "f")}
      SELECT n.true_ AS ordinal, c.s AS sequence, c.q AS quality, CAST(c.o AS INTEGER) AS phred_offset, c.h AS head_pos FROM fclipped c JOIN numbered n ON n.ordinal = c.ordinal"""


def _sql_clip_pairs(select: str, palindrome: int | None, keep_both: bool = False, steps: list[str] | None = None) -> str:
    """Pairs after clipping, with read-through into prefixes of at least ``palindrome`` bases, and after ``steps``; ``done`` is (ordinal, a, b)."""
    pal = f", {_sql_palindrome(palindrome)}" if palindrome else ""
    one = "SELECT i, k FROM pal" if palindrome else None
    two = ("SELECT i, k FROM pal" if keep_both else "SELECT i, 0 FROM pal") if palindrome else None
    chain1, last1 = _sql_chain(steps, "fclipped", "a") if steps else ("none1 AS (SELECT 1)", "fclipped")
    chain2, last2 = _sql_chain(steps, "rclipped", "b") if steps else ("none2 AS (SELECT 1)", "rclipped")
    both = "pairs AS (SELECT row_number() OVER () AS i, r.ordinal, r.name AS n1, r.s AS s1, r.q AS q1, r.o AS o1, r.h AS h1, m.name AS n2, m.s AS s2, m.q AS q2, m.o AS o2, m.h AS h2 FROM reads r JOIN mates_ok m USING (ordinal))"
    sides = "side1 AS (SELECT i AS ordinal, n1 AS name, s1 AS s, q1 AS q, o1 AS o, h1 AS h FROM pairs), side2 AS (SELECT i AS ordinal, n2 AS name, s2 AS s, q2 AS q, o2 AS o, h2 AS h FROM pairs)"
    out = f"done AS (SELECT p.ordinal, x.s AS a, y.s AS b FROM pairs p LEFT JOIN {last1} x ON x.ordinal = p.i LEFT JOIN {last2} y ON y.ordinal = p.i)"
    return f"""WITH {_START}, {_MATES}, {both}, {sides}, {_sql_simple("side1", "forward", "f")}, {_sql_simple("side2", "reverse", "r")}{pal},
      {_sql_clipped("side1", "f", one)}, {_sql_clipped("side2", "r", two)}, {chain1}, {chain2}, {out} {select}"""


_LENGTHS = "SELECT ordinal, CAST(coalesce(length(a), -1) AS INTEGER) AS length1, CAST(coalesce(length(b), -1) AS INTEGER) AS length2 FROM done"
_PAIR_COUNTS = """SELECT count(*) AS input, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS forward_only,
      count(*) FILTER (a IS NULL AND b IS NOT NULL) AS reverse_only, count(*) FILTER (a IS NULL AND b IS NULL) AS dropped FROM done"""
_CANONICAL = "CASE " + " ".join(f"WHEN regexp_matches(name, '{p.split('(')[2].split(')')[0]}') THEN regexp_replace(name, '{p}', '\\2')" for p in PATTERNS) + " END"
_SIDES = ["TRAILING:20", "MINLEN:60"]
_chain_sql, _chain_last = _sql_chain(CHAIN)
_log_sql, _log_last = _sql_chain(["HEADCROP:3", "TRAILING:10", "MINLEN:50"], "numbered")

_FIELD = r'("(?:[^"]|"")*"|[^",\r\n]*)'
_RECORDS = rf"""
 t AS (SELECT *, payload IS NULL OR trim(payload, chr(32) || chr(9) || chr(10) || chr(13)) = '' AS blank, regexp_replace(payload, '\r?\n$', '') AS body FROM raw_records),
 l AS (SELECT *, CASE WHEN layout = 'fastq' THEN regexp_split_to_array(body, '\r?\n') END AS lines,
         CASE WHEN layout = 'csv' AND NOT blank THEN regexp_full_match(payload, '{_FIELD}(,{_FIELD})*') END AS quoted,
         CASE WHEN layout = 'csv' AND NOT blank THEN regexp_full_match(payload, '{_FIELD},{_FIELD},{_FIELD},{_FIELD}') END AS four FROM t),
 e AS (SELECT *, regexp_extract(payload, '{_FIELD},{_FIELD},{_FIELD},{_FIELD}', ['a', 'b', 'c', 'd']) AS x FROM l),
 f AS (SELECT *, CASE WHEN layout = 'fastq' THEN lines[1:4] WHEN four THEN
         list_transform([x.a, x.b, x.c, x.d], lambda y: CASE WHEN y LIKE '"%' THEN replace(y[2:-2], '""', '"') ELSE y END) END AS v FROM e),
 r AS (SELECT raw_id, layout, v, CASE WHEN blank THEN 'empty' WHEN NOT quoted THEN 'quoting' WHEN NOT four OR len(lines) <> 4 THEN 'field_count'
         WHEN layout = 'csv' AND v[1] = '' OR layout = 'fastq' AND (v[1] NOT LIKE '@%' OR length(v[1]) < 2) THEN 'name'
         WHEN layout = 'fastq' AND v[3] NOT LIKE '+%' THEN 'comment' WHEN NOT regexp_full_match(v[2], '[ACGTNacgtn]+') THEN 'sequence'
         WHEN length(v[2]) <> length(v[4]) THEN 'length'
         WHEN len(list_filter(string_split(v[4], ''), lambda c: ascii(c) - phred_offset NOT BETWEEN 0 AND 41)) > 0 THEN 'quality' END AS reason FROM f)"""

_LOG = f"""WITH {_START}, base AS (SELECT row_number() OVER () AS i, * FROM reads), numbered AS (SELECT i AS ordinal, name, s, q, o, h FROM base), {_log_sql}
      SELECT b.ordinal, 1 AS mate, b.name AS read_name, CAST(coalesce(length(x.s), 0) AS INTEGER) AS length, CAST(coalesce(x.h, 0) AS INTEGER) AS start_pos, CAST(coalesce(x.h + length(x.s), 0) AS INTEGER) AS end_pos,
        CAST(coalesce(length(b.s) - x.h - length(x.s), 0) AS INTEGER) AS trim_tail FROM base b LEFT JOIN {_log_last} x ON x.ordinal = b.i"""
#: Records are numbered in order of their ordinals; rows of one ordinal are alike.
_NUMBERED = f"WITH {_START} SELECT row_number() OVER (ORDER BY f.ordinal) - 1 AS ordinal, f.name, f.sequence, coalesce(f.comment, '') AS comment, f.quality FROM fastq_reads f WHERE sequence IS NOT NULL AND quality IS NOT NULL"

SQL: dict[str, str] = {
    "leading": _sql_kept("LEADING:20"),
    "trailing": _sql_kept("TRAILING:20"),
    "headcrop": _sql_kept("HEADCROP:5:60"),
    "tailcrop": _sql_kept("TAILCROP:7:50"),
    "crop": _sql_kept("CROP:80"),
    "slidingwindow": _sql_kept("SLIDINGWINDOW:4:15"),
    "maxinfo": _sql_kept("MAXINFO:40:0.5"),
    "minlen": _sql_kept("MINLEN:76"),
    "maxlen": _sql_kept("MAXLEN:100"),
    "avgqual": _sql_kept("AVGQUAL:28"),
    "basecount": _sql_kept("BASECOUNT:GC:20:60"),
    "tophred33": _sql_kept("TOPHRED33"),
    "tophred64": _sql_kept("TOPHRED64"),
    "chain_se": _sql_kept(*CHAIN),
    "chain_long": _sql_kept(*LONG_CHAIN),
    "slot_crops": _sql_pairs(["HEADCROP:3:60", "TAILCROP:1:58"], ["HEADCROP:5:50", "TAILCROP:2:45"], "SELECT ordinal, a AS s1, b AS s2 FROM done"),
    "pair_zip": f"WITH {_START}, {_MATES} SELECT r.ordinal, r.name AS o1_name, CAST(length(r.s) AS INTEGER) AS o1_len, m.name AS o2_name, CAST(length(m.s) AS INTEGER) AS o2_len FROM reads r JOIN mates_ok m USING (ordinal)",
    "pair_route": _sql_pairs(_SIDES, _SIDES, "SELECT ordinal, CASE WHEN b IS NULL THEN '1U' ELSE '1P' END AS stream, a AS sequence FROM done WHERE a IS NOT NULL UNION ALL SELECT ordinal, CASE WHEN a IS NULL THEN '2U' ELSE '2P' END, b FROM done WHERE b IS NOT NULL"),
    "stats_pe": _sql_pairs(_SIDES, _SIDES, "SELECT count(*) AS input, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS forward_only, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS reverse_only, count(*) FILTER (a IS NULL AND b IS NULL) AS dropped FROM done"),
    "chain_pe": _sql_pairs(CHAIN, CHAIN, "SELECT ordinal, CAST(coalesce(length(a), -1) AS INTEGER) AS length1, CAST(coalesce(length(b), -1) AS INTEGER) AS length2 FROM done"),
    "stats_se": f"WITH {_START}, {_chain_sql} SELECT n AS input, k AS surviving, n - k AS dropped FROM (SELECT count(*) AS n FROM reads), (SELECT count(*) AS k FROM {_chain_last})",
    "stream_stats": f"WITH {_START}, {_chain_sql} SELECT n AS input, k AS surviving, n - k AS dropped FROM (SELECT count(*) AS n FROM reads), (SELECT count(*) AS k FROM {_chain_last})",
    "fastq_blocks": _NUMBERED,
    "fastq_bzip2": _NUMBERED,
    "log_se": _LOG,
    "log_text": f"SELECT ordinal, mate, concat_ws(' ', read_name, length, start_pos, end_pos, trim_tail) AS line FROM ({_LOG})",
    "stats_text": f"SELECT 'Input Read Pairs: ' || x.input {' '.join(f"|| ' {label}: ' || x.{c} || format(' ({{:.2f}}%)', 100.0 * x.{c} / x.input)" for c, label in PAIRED_LABELS.items())} AS line FROM ({_sql_pairs(_SIDES, _SIDES, _PAIR_COUNTS)}) AS x",
    "log_totals": """SELECT mate, count(*) AS reads, count(*) FILTER (length = 0) AS dropped, CAST(sum(length) AS BIGINT) AS bases, CAST(sum(start_pos) AS BIGINT) AS head, CAST(sum(trim_tail) AS BIGINT) AS tail
      FROM (SELECT ordinal, mate, max(length) AS length, max(trim_tail) AS trim_tail, max(start_pos) AS start_pos FROM trim_log GROUP BY ALL) GROUP BY mate""",
    "clip_simple": _sql_clip_single(),
    "clip_palindrome": _sql_clip_pairs(_LENGTHS, 8),
    "clip_keep_both": _sql_clip_pairs(_LENGTHS, 2, True),
    "chain_clip_pe": _sql_clip_pairs(_PAIR_COUNTS, None, steps=CHAIN),
    "barcode_split": f"""WITH {_START}, c AS (SELECT *, CASE WHEN starts_with(s, 'ACGT') THEN 'one' WHEN starts_with(s, 'ACG') THEN 'two' WHEN starts_with(s, 'TT') THEN 'three' WHEN starts_with(s, 'GATTA') THEN 'four' ELSE 'UNKNOWN' END AS label FROM reads),
      d AS (SELECT *, CASE label WHEN 'one' THEN 4 WHEN 'two' THEN 3 WHEN 'three' THEN 2 WHEN 'four' THEN 5 ELSE 0 END AS k FROM c) SELECT ordinal, label, CAST(length(s) - k AS INTEGER) AS length, CAST(h + k AS INTEGER) AS head_pos FROM d""",
    "barcode_mismatch": f"""WITH {_START} SELECT CASE WHEN length(s) >= 6 AND hamming(s[1:6], 'ACGTAC') <= 2 THEN 'one' WHEN length(s) >= 6 AND hamming(s[1:6], 'TTGATC') <= 2 THEN 'two' ELSE 'UNKNOWN' END AS label, count(*) AS n FROM reads GROUP BY 1""",
    "name_canonical": f"SELECT ordinal, {_CANONICAL} AS canonical FROM fastq_reads",
    "pair_validate": f"""WITH {_START}, {_MATES}, f AS (SELECT DISTINCT ordinal, name FROM reads), j AS (SELECT m.ordinal, f.name AS forward_name, m.name AS reverse_name FROM mates_ok m LEFT JOIN f USING (ordinal)),
      c AS (SELECT *, {_CANONICAL.replace('name', 'forward_name')} AS a, {_CANONICAL.replace('name', 'reverse_name')} AS b, string_split(split_part(forward_name, ' ', 1), '') AS x, string_split(split_part(reverse_name, ' ', 1), '') AS y FROM j)
      SELECT ordinal, forward_name, reverse_name FROM c WHERE NOT coalesce(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a = b ELSE len(x) = len(y) AND len(list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i] AND NOT (x[i] = '1' AND y[i] = '2'))) = 0 END, false) ORDER BY ordinal LIMIT 1""",
    "repair_split": f"""WITH {_START}, {_MATES}, f AS (SELECT ordinal, min(name) AS name, regexp_replace(min(name), ' [^ ]*$', '') AS k FROM reads GROUP BY ordinal),
      m AS (SELECT ordinal, name, regexp_replace(name, ' [^ ]*$', '') AS k FROM mates_ok)
      SELECT CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.k = f.k) THEN '1P' ELSE '1U' END AS stream, ordinal, name FROM f
      UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.k = m.k) THEN '2P' ELSE '2U' END, ordinal, name FROM m""",
    "repair_names": f"WITH {_START}, {_MATES}, f AS (SELECT ordinal, min(name) AS name FROM reads GROUP BY ordinal) SELECT f.ordinal AS ordinal1, m.ordinal AS ordinal2 FROM f JOIN mates_ok m ON regexp_replace(f.name, ' [^ ]*$', '') = regexp_replace(m.name, ' [^ ]*$', '')",
    "phred_detect": """WITH c AS (SELECT run_id, unnest(string_split(quality, '')) AS c FROM fastq_reads WHERE quality IS NOT NULL),
      s AS (SELECT run_id, count(*) FILTER (ascii(c) BETWEEN 33 AND 58) AS low, count(*) FILTER (ascii(c) BETWEEN 80 AND 104) AS high FROM c GROUP BY run_id)
      SELECT run_id, low, high, CAST(CASE WHEN low = 0 AND high > 0 THEN 64 WHEN high = 0 AND low > 0 THEN 33 ELSE 0 END AS INTEGER) AS phred FROM s""",
    "revcomp": "SELECT ordinal, reverse(translate(regexp_replace(sequence, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS other_strand FROM fastq_reads",
    "normal": "SELECT ordinal, upper(translate(sequence, 'uU.', 'tTN')) AS sequence FROM fastq_reads",
    "quality_sums": f"WITH {_START} SELECT ordinal, CAST(list_sum({_values()}) AS BIGINT) AS total FROM reads",
    "fastq_round_trip": f"SELECT f.name, f.sequence, coalesce(f.comment, '') AS comment, f.quality FROM fastq_reads f WHERE sequence IS NOT NULL AND quality IS NOT NULL",

    "p3_found": f"WITH {_RECORDS} SELECT raw_id, reason FROM r WHERE reason IS NOT NULL",
    "p3_loaded": f"WITH {_RECORDS} SELECT raw_id, CASE WHEN layout = 'fastq' THEN v[1][2:] ELSE v[1] END AS name, v[2] AS sequence, CASE WHEN layout = 'fastq' THEN v[3][2:] ELSE v[3] END AS comment, v[4] AS quality FROM r WHERE reason IS NULL",
}
