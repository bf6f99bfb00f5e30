import bz2
import gzip
import random

import pytest

from readloom.plans.cli import UsageError, parse, run
from readloom.schema import read_struct
from readloom.sources.compression import codec, compressed
from readloom.sources.fasta import read_fasta, write_fasta
from readloom.sources.fastq import FastqError, detect_phred, read_fastq, read_fastq_pair, read_lines_as_records, write_fastq
from readloom.sources.templates import mate_path, output_paths

TEXT = "@first of two\nACCTGN\n+\n!5AF+@\n@second\nTTG\n+note\n@@I\n"


def names(df):
    return [r["r1"]["name"] for r in df.orderBy("ordinal").collect()]


def records(n, start=0):
    rnd = random.Random(n)
    out = []
    for i in range(n):
        m = rnd.randint(0, 60)
        out.append((f"r{start + i}", "".join(rnd.choices("ACGTN", k=m)), "@+"[i % 2] * (i % 3), "".join(rnd.choices("@+!5I", k=m))))
    return out


def text(rs, end="\n"):
    return "".join(f"@{n}{end}{s}{end}+{c}{end}{q}{end}" for n, s, c, q in rs)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_codecs_and_line_ends(spark, tmp_path, end):
    rs = records(50)
    body = text(rs, end).encode()
    files = {"a.fq": body, "a.fq.gz": gzip.compress(body[: len(body) // 2]) + gzip.compress(body[len(body) // 2 :]), "a.fq.BZ2": bz2.compress(body), "b.fq.bz2": bz2.compress(body)}
    for name, data in files.items():
        if name.endswith("BZ2"):
            continue  # Hadoop's own choice of a codec looks at lower case only
        (tmp_path / name).write_bytes(data)
        got = [(r["ordinal"], *r["r1"][:4]) for r in read_fastq(spark, str(tmp_path / name), 33).orderBy("ordinal").collect()]
        assert got == [(i, *r) for i, r in enumerate(rs)]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_blocks_of_plain_files(spark, tmp_path, broadcast_bytes):
    """Records are found and numbered however the blocks cut them, through several files, with the list of blocks in every task or not."""
    for size, n in ((9, 3), (200, 30), (2000, 300)):
        first, second = records(n), records(n - 2, n)
        (tmp_path / "z.fq").write_text(text(first))
        (tmp_path / "a.fq").write_text(text(second)[:-1])
        df = read_fastq(spark, [str(tmp_path / "z.fq"), str(tmp_path / "a.fq")], 33, split_bytes=size)
        got = [(r["ordinal"], *r["r1"][:4]) for r in df.orderBy("ordinal").collect()]
        assert got == [(i, *r) for i, r in enumerate(first + second)]


def test_blocks_under_pressure(spark, tmp_path):
    """Neither spilled sorts and joins nor a block size set between planning and reading lose lines or their order."""
    rs = [(f"r{i}", "ACGT"[i % 4] * (i % 50), "", "I" * (i % 50)) for i in range(8_000)]
    (tmp_path / "big.fq").write_text(text(rs))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.sortMergeJoinExec.buffer.spill.threshold", "500")
        for broadcast_bytes in (1 << 20, 0):
            spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
            df = read_fastq(spark, str(tmp_path / "big.fq"), 33, split_bytes=60_000, broadcast_bytes=broadcast_bytes)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "150k")
            got = [(r["ordinal"], *r["r1"][:4]) for r in df.orderBy("ordinal").collect()]
            assert got == [(i, *r) for i, r in enumerate(rs)]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.sortMergeJoinExec.buffer.spill.threshold")


def test_order_of_files(spark, tmp_path):
    """Files stand in the order given, those of a folder or pattern by name; names may hold blanks and signs, or end alike."""
    folder = tmp_path / "a folder"
    folder.mkdir()
    for name in ("xa.fq", "a.fq", "p%20é#+.fq"):
        (folder / name).write_text(text([(name, "A", "", "5")]))
    got = lambda *p: names(read_fastq(spark, list(p)))
    assert got(str(folder)) == ["a.fq", "p%20é#+.fq", "xa.fq"]
    assert got(str(folder / "xa.fq"), str(folder / "a.fq"), str(folder / "xa.fq")) == ["xa.fq", "a.fq", "xa.fq"]
    assert got(str(folder / "?a.fq"), str(folder / "p%20é#+.fq")) == ["xa.fq", "p%20é#+.fq"]


def test_changed_file(spark, tmp_path):
    (tmp_path / "c.fq").write_text(text(records(50)))
    df = read_fastq(spark, str(tmp_path / "c.fq"), 33)
    (tmp_path / "c.fq").write_text(text(records(50)) + text(records(1)))
    with pytest.raises(Exception, match="changed"):
        df.collect()


def test_bzip2_blocks(spark, tmp_path):
    """Several blocks of a bzip2 file give the records of the plain one."""
    rs = [(f"r{i}", "".join(random.Random(i).choices("ACGT", k=100)), "", "".join(random.Random(-i).choices("56789", k=100))) for i in range(12_000)]
    (tmp_path / "m.fq.bz2").write_bytes(bz2.compress(text(rs).encode(), 1))
    df = read_fastq(spark, str(tmp_path / "m.fq.bz2"), split_bytes=150_000)
    assert df.rdd.getNumPartitions() > 3
    got = [(r["ordinal"], *r["r1"][:4]) for r in df.orderBy("ordinal").collect()]
    assert got == [(i, *r) for i, r in enumerate(rs)]


def test_no_shuffle(spark, tmp_path):
    (tmp_path / "n.fq").write_text(text(records(50)))
    plan = read_fastq(spark, str(tmp_path / "n.fq"), 33)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize(
    "body, reason",
    [
        ("read1\nA\n+\nI\n", "name line"), ("\nA\n+\nI\n", "name line"), ("@a\n", "Missing sequence"), ("@a\nA\n", "Missing comment"), ("@a\nA\n+\n", "Missing quality"),
        ("@a\nA\n-\nI\n", "comment line"), ("@a\nAC\n+\nI\n", "length"),
    ],
)
def test_malformed(spark, tmp_path, body, reason):
    (tmp_path / "x.fq").write_text(TEXT + body)
    with pytest.raises(Exception, match=reason):
        read_fastq(spark, str(tmp_path / "x.fq"), 33).collect()
    got = read_fastq(spark, str(tmp_path / "x.fq"), 33, mode="permissive").orderBy("ordinal").collect()
    assert [r["reason"] is None for r in got] == [True, True, False] and reason in got[2]["reason"] and got[2]["r1"] is None


def test_encoding(spark, tmp_path):
    def found(*qualities):
        (tmp_path / "e.fq").write_text("".join(f"@r\n{'A' * len(q)}\n+\n{q}\n" for q in qualities))
        return detect_phred(read_lines_as_records(spark, [str(tmp_path / "e.fq")]))

    assert found("III", "I5I") == 33 and found("hhh") == 64
    for bad in (("III",), ("5h",)):
        with pytest.raises(FastqError):
            found(*bad)
    (tmp_path / "n.fq").write_text("")
    with pytest.raises(FastqError):
        read_fastq(spark, str(tmp_path / "n.fq"))
    assert read_fastq(spark, str(tmp_path / "n.fq"), 33).count() == 0


@pytest.mark.parametrize("suffix, opener", [("", open), (".gz", gzip.open), (".bz2", bz2.open)])
def test_single_file_round_trip(spark, tmp_path, suffix, opener):
    (tmp_path / "in.fq").write_text(TEXT * 1)
    df = read_fastq(spark, str(tmp_path / "in.fq"), 33).withColumnRenamed("r1", "read").repartition(3)
    for level in (None, 1, 5, 9):
        path = str(tmp_path / f"out.fq{suffix}")
        write_fastq(df, path, level=level, single_file=True)
        with opener(path, "rt") as f:
            assert f.read() == TEXT
    with pytest.raises(ValueError):
        compressed(df.write, "gzip", 10)


def test_zip_is_refused():
    assert (codec("a.GZ"), codec("a.bz2"), codec("a.fq")) == ("gzip", "bzip2", None)
    with pytest.raises(ValueError):
        codec("a.zip")


def test_pair_of_files(spark, tmp_path):
    (tmp_path / "1.fq").write_text(text(records(9)))
    (tmp_path / "2.fq").write_text(text(records(7)))
    df = read_fastq_pair(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq"), 33)
    assert df.count() == 7
    (tmp_path / "3.fq").write_text("@a\nA\n+\nh\n")
    (tmp_path / "4.fq").write_text("@a\nA\n+\n5\n")
    with pytest.raises(FastqError, match="different"):
        read_fastq_pair(spark, str(tmp_path / "3.fq"), str(tmp_path / "4.fq"))


def test_fasta(spark, tmp_path):
    spark.createDataFrame([("a", "ACGT" * 30), ("b", "A" * 61), ("c", "")], "name string, sequence string").coalesce(1).write.parquet(str(tmp_path / "p"))
    write_fasta(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "f"))
    part = next((tmp_path / "f").glob("part-*"))
    assert max(map(len, part.read_text().splitlines())) == 60
    assert read_fasta(str(part)) == [("a", "ACGT" * 30), ("b", "A" * 61), ("c", "")]


@pytest.mark.parametrize("one, two", [("x/a_R1_001.fq.gz", "x/a_R2_001.fq.gz"), ("a_1.fq.gz", "a_2.fq.gz"), ("a.f.fastq", "a.r.fastq"), ("a_f.txt", "a_r.txt"), ("a.1", "a.2"), ("b_1_1.fq", "b_1_2.fq")])
def test_templates(one, two):
    assert mate_path(one) == two


def test_output_names():
    assert list(output_paths("d/o.fq.gz").values()) == ["d/o_1P.fq.gz", "d/o_1U.fq.gz", "d/o_2P.fq.gz", "d/o_2U.fq.gz"]
    with pytest.raises(ValueError):
        mate_path("x.fq")


def test_commands(spark, tmp_path, capsys):
    at = lambda n: str(tmp_path / n)
    (tmp_path / "a_1.fq").write_text(text([("n0", "ACGTAC", "", "IIIIII"), ("n1", "ACG", "", "III"), ("n2", "ACGTA", "", "IIIII")]))
    (tmp_path / "a_2.fq").write_text(text([("n0", "ACGTAC", "", "IIIIII"), ("n1", "ACGTT", "", "IIIII"), ("n2", "AC", "", "II")]))
    row = run(spark, ["SE", "-phred33", "-trimlog", at("log"), "-summary", at("sum"), at("a_1.fq"), at("se.fq.gz"), "HEADCROP:1", "MINLEN:4"])
    assert row == {"input": 3, "surviving": 2, "dropped": 1} and "Input Reads: 3 Surviving: 2 (66.67%)" in capsys.readouterr().out
    assert gzip.open(at("se.fq.gz"), "rt").read() == "@n0\nCGTAC\n+\nIIIII\n@n2\nCGTA\n+\nIIII\n"
    assert (tmp_path / "log").read_text() == "n0 5 1 6 0\nn1 0 0 0 0\nn2 4 1 5 0\n"
    assert (tmp_path / "sum").read_text().startswith("Input Reads: 3\nSurviving Reads: 2\n")
    row = run(spark, ["PE", "-phred33", "-quiet", "-validatePairs", "-basein", at("a_1.fq"), "-baseout", at("o.fq"), "-threads", "4", "MINLEN:5"])
    assert row == {"input": 3, "both": 1, "forward_only": 1, "reverse_only": 1, "dropped": 0} and capsys.readouterr().out == ""
    assert {p.name: p.read_text().count("@") for p in tmp_path.glob("o_*.fq")} == {"o_1P.fq": 1, "o_1U.fq": 1, "o_2P.fq": 1, "o_2U.fq": 1}
    assert run(spark, ["REPAIR", at("a_1.fq"), at("a_2.fq"), *[at(f"r{i}.fq") for i in range(4)]]) == {"1P": 3, "1U": 0, "2P": 3, "2U": 0}
    run(spark, ["-version"])


@pytest.mark.parametrize("args", [[], ["XX"], ["SE", "a", "b"], ["PE", "a", "b", "c", "d", "e", "f"], ["SE", "-basein", "x", "a", "b", "MINLEN:1"], ["SE", "-nope", "a", "b", "MINLEN:1"], ["SE", "a", "b", "MINLEN:1", "-threads"], ["SE", "-compressLevel", "0", "a", "b", "MINLEN:1"]])
def test_usage(args):
    with pytest.raises(UsageError):
        parse(args)


def test_read_struct_of_nulls(spark):
    df = spark.createDataFrame([("n", None, "I"), ("n", "A", None), (None, "", "")], "n string, s string, q string")
    assert [r["r"] is None for r in df.select(read_struct(df.n, df.s, None, df.q, 33).alias("r")).collect()] == [True, True, False]
