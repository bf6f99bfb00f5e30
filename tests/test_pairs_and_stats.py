import pytest
from pyspark.sql import functions as F

from readloom.functions.names import canonical_name
from readloom.functions.sequence import normal_sequence, reverse_complement
from readloom.operators.barcodes import split_barcodes
from readloom.operators.keyed import once_per_key
from readloom.operators.pairs import RepairError, repair_by_name, route, routed, survivors, validate_pairs
from readloom.operators.stats import log_lines, paired_stats, percent, single_stats, stats_line, stats_summary, trim_log
from readloom.plans.chain import trim_paired, trim_single
from readloom.schema import from_table, single
from tests.helpers import READS, outcome, pairs, reads, singles


def named(spark, *names, start=0):
    rows = [(start + i, n, "ACGT", "", "IIII", 33) for i, n in enumerate(names)]
    return from_table(spark.createDataFrame(rows, READS))


def test_routing_and_stats(spark, rows):
    df = trim_paired(pairs(spark, [("ACGT", "I"), ("ACGT", "I"), ("A", "I"), ("A", "I"), ("ACGT", "I")], [("ACGT", "I"), ("A", "I"), ("ACGT", "I"), ("A", "I")]), ["MINLEN:4"])
    parts = route(df)
    assert {k: [r["ordinal"] for r in v.orderBy("ordinal").collect()] for k, v in parts.items()} == {"1P": [0], "1U": [1], "2P": [0], "2U": [2]}
    assert rows(routed(df).select("ordinal", "stream")) == [(0, "1P"), (0, "2P"), (1, "1U"), (2, "2U")]
    row = paired_stats(df).first().asDict()
    assert row == {"input": 4, "both": 1, "forward_only": 1, "reverse_only": 1, "dropped": 1}
    assert stats_line(row) == "Input Read Pairs: 4 Both Surviving: 1 (25.00%) Forward Only Surviving: 1 (25.00%) Reverse Only Surviving: 1 (25.00%) Dropped: 1 (25.00%)"
    single_row = single_stats(trim_single(singles(spark, ("ACGT", "I"), ("A", "I"), ("A", "I")), ["MINLEN:2"])).first().asDict()
    assert single_row == {"input": 3, "surviving": 1, "dropped": 2}
    assert stats_summary(single_row) == "Input Reads: 3\nSurviving Reads: 1\nSurviving Read Percent: 33.33\nDropped Reads: 2\nDropped Read Percent: 66.67\n"
    assert stats_summary(row).splitlines()[1:3] == ["Both Surviving Reads: 1", "Both Surviving Read Percent: 25.00"]
    assert (percent(1, 800), percent(3, 800), percent(0, 0)) == ("0.12", "0.38", "NaN")
    assert single_stats(singles(spark, ("A", "I")).limit(0)).first().asDict() == {"input": 0, "surviving": 0, "dropped": 0}


def test_log(spark):
    df = trim_single(singles(spark, ("ACGTACGT", "I"), ("AC", "I")), ["HEADCROP:2", "CROP:3"])
    lines = [r["value"] for r in log_lines(trim_log(df)).orderBy("ordinal", "mate").collect()]
    assert lines == ["read0 3 2 5 3", "read1 0 0 0 0"]
    both = trim_log(trim_paired(pairs(spark, [("ACGT", "I")], [("AC", "I")]), ["MINLEN:3"])).orderBy("ordinal", "mate").collect()
    assert [(r["mate"], r["length"], r["trim_tail"]) for r in both] == [(1, 4, 0), (2, 0, 0)]
    # what is cut from the ends and what is left make up the read
    log = trim_log(trim_single(singles(spark, *[("ACGTACGTACGT"[:n], "#" + "I" * 11) for n in range(1, 13)]), ["LEADING:5", "CROP:7"])).where("length > 0")
    assert log.where(F.col("length") + F.col("start_pos") + F.col("trim_tail") != F.col("ordinal") + 1).count() == 0


def test_survivors(spark):
    df = trim_single(singles(spark, ("ACGT", "I"), ("A", "I")), ["MINLEN:2"])
    assert [r["ordinal"] for r in survivors(df).collect()] == [0]


@pytest.mark.parametrize(
    "name, want",
    [
        ("HWUSI-EAS100R:6:73:941:1973#0/1", "HWUSI-EAS100R:6:73:941:1973#0"),
        ("EAS139:136:FC706VJ:2:2104:15343:197393 1:Y:18:ATCACG", "EAS139:136:FC706VJ:2:2104:15343:197393"),
        ("SRR1.1 EAS139:136:FC706VJ:2:2104:15343:197393 length=36", "EAS139:136:FC706VJ:2:2104:15343:197393"),
        ("read1", None),
        ("", None),
    ],
)
def test_canonical(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(canonical_name(F.col("n"))).first()[0] == want


def test_validation(spark):
    first = named(spark, "a/1 x", "b1", "c", "EAS139:136:FC706VJ:2:2104:15343:197393 1:N:0:A")
    good = named(spark, "a/2 y", "b2", "c", "EAS139:136:FC706VJ:2:2104:15343:197393 2:N:0:A")
    assert validate_pairs(first, good).count() == 0
    assert [r["ordinal"] for r in validate_pairs(first, named(spark, "a/2", "b2", "d", "x")).collect()] == [2]
    # 1 stands against 2, not the other way round; a missing mate fails too
    assert validate_pairs(named(spark, "b2"), named(spark, "b1")).count() == 1
    assert [r["ordinal"] for r in validate_pairs(first, good.where("ordinal < 3")).collect()] == [3]
    assert validate_pairs(first.limit(0), good.limit(0)).count() == 0


def test_repair(spark):
    f, r = named(spark, "a 1", "b 1", "c 1", "d"), named(spark, "x 2", "b 2", "d 2")
    got = {k: [x["read"]["name"] for x in v.orderBy("ordinal").collect()] for k, v in repair_by_name(f, r, " ").items()}
    assert got == {"1P": ["b 1", "d"], "1U": ["a 1", "c 1"], "2P": ["b 2", "d 2"], "2U": ["x 2"]}
    with pytest.raises(RepairError, match="order"):
        repair_by_name(named(spark, *[f"n{i}" for i in range(40)]), named(spark, *[f"n{i}" for i in [*range(38), 39, 38]]))
    with pytest.raises(RepairError, match="more than once"):
        repair_by_name(named(spark, "a x", "a y"), named(spark, "a"), " ")
    assert repair_by_name(f.limit(0), r)["2U"].count() == 3
    # cut before the last delimiter
    assert repair_by_name(named(spark, "a_b_1"), named(spark, "a_b_2"), "_")["1P"].count() == 1


def test_barcodes(spark):
    df = reads(spark, ("ACGTT", "I"), ("ACCTT", "I"), ("TTTTT", "I"), ("AC", "I"), ("", ""))
    label = lambda d: [r["r1"]["barcode_label"] for r in d.orderBy("ordinal").collect()]
    codes = {"long": "ACGT", "short": "AC"}
    assert label(split_barcodes(df, codes)) == ["long", "short", "UNKNOWN", "short", "UNKNOWN"]
    assert label(split_barcodes(df, codes, most=1)) == ["long", "long", "UNKNOWN", "short", "UNKNOWN"]
    assert outcome(split_barcodes(df, codes, clip=True))[:3] == [("T", "I", 4), ("CTT", "III", 2), ("TTTTT", "IIIII", 0)]


def test_strings(spark):
    got = spark.createDataFrame([("AGTCG",), ("aNG",), ("",), (None,)], "s string").select(reverse_complement(F.col("s")), normal_sequence(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("CGACT", "AGTCG"), ("CNN", "ANG"), ("", ""), (None, None)]
    assert spark.range(1).select(normal_sequence(F.lit("acguU.n"))).first()[0] == "ACGTTNN"


def test_once_per_key(spark, rows):
    data = [(1, 5, "late"), (1, 3, "first"), (1, None, "never"), (2, None, None), (None, 1, "a"), (None, 1, "a"), (3, 1, "same"), (3, 1, "same")]
    df = spark.createDataFrame(data, "k int, t int, _n string")
    assert rows(once_per_key(df, "k", "t")) == sorted([(1, 3, "first"), (2, None, None), (None, 1, "a"), (None, 1, "a"), (3, 1, "same")], key=repr)
    assert once_per_key(df.limit(0), "k").count() == 0
    assert once_per_key(df.where("k = 2"), "k").count() == 1


def test_once_per_key_beyond_broadcast(spark, rows, monkeypatch):
    import readloom.operators.keyed as module

    monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    df = spark.range(100).selectExpr("id % 60 AS k", "id AS t")
    assert rows(once_per_key(df, "k", "t")) == sorted([(i, i) for i in range(60)], key=repr)


def test_single_keeps_names(spark):
    df = single(named(spark, "n"))
    assert df.columns == ["ordinal", "r1", "o1_name", "o1_len"]
