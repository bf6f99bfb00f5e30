import numpy as np
import pytest

from readloom.operators.steps import ColumnStep, MaxInfo, parse_step, parse_steps, register
from readloom.plans.chain import trim_paired, trim_single
from tests.helpers import outcome, pairs, singles


def one(spark, step, sequence, quality, offset=33):
    """The outcome, which both forms of a step agree on."""
    got = [outcome(trim_single(singles(spark, (sequence, quality), offset=offset), [step], engine))[0] for engine in ("arrow", "jvm")]
    assert got[0] == got[1]
    return got[0]


@pytest.mark.parametrize(
    "step, sequence, quality, expected",
    [
        ("LEADING:3", "ACGTA", "!#5II", ("GTA", "5II", 2)),
        ("LEADING:3", "NNGTA", "IIIII", ("GTA", "III", 2)),
        ("LEADING:3", "ACGT", "####", None),
        ("LEADING:3", "", "", None),
        ("LEADING:0", "ACGT", "!!!!", ("ACGT", "!!!!", 0)),
        ("TRAILING:3", "ACGT", "I###", None),
        ("TRAILING:3", "ACGT", "II##", ("AC", "II", 0)),
        ("TRAILING:3", "A", "I", None),
        ("TRAILING:3", "ACGNN", "IIIII", ("ACG", "III", 0)),
        ("SLIDINGWINDOW:4:15", "ACGTACGT", "IIII####", ("ACGT", "IIII", 0)),
        ("SLIDINGWINDOW:4:15", "ACG", "III", None),
        ("SLIDINGWINDOW:4:15", "ACGTACGT", "####IIII", None),
        ("SLIDINGWINDOW:4:15", "ACGTACGT", "I", ("ACGTACGT", "IIIIIIII", 0)),
        ("SLIDINGWINDOW:1:15", "A", "I", ("A", "I", 0)),
        ("SLIDINGWINDOW:4:15", "ACGTAC", "IIIII#", ("ACGTA", "IIIII", 0)),
        ("HEADCROP:2:3", "ACGTACGT", "I", ("CGT", "III", 5)),
        ("TAILCROP:2:3", "ACGTACGT", "I", ("ACG", "III", 0)),
        ("HEADCROP:8", "ACGTACGT", "I", None),
        ("HEADCROP:1:2:3", "ACGTACGT", "I", ("ACGTACGT", "IIIIIIII", 0)),
        ("TAILCROP:1:2:3:4:5", "ACGT", "I", ("ACGT", "IIII", 0)),
        ("HEADCROP:0", "", "", None),
        ("CROP:0", "ACGT", "I", ("", "", 0)),
        ("CROP:9", "ACGT", "I", ("ACGT", "IIII", 0)),
        ("AVGQUAL:20", "ANGT", "II55", ("ANGT", "II55", 0)),
        ("AVGQUAL:21", "ANGT", "II55", None),
        ("AVGQUAL:20", "", "", ("", "", 0)),
        ("BASECOUNT:GC:2:3", "GGCC", "I", None),
        ("BASECOUNT:GC:2:3", "GCTT", "I", ("GCTT", "IIII", 0)),
        ("BASECOUNT:GC:2:3", "gcTT", "I", None),
        ("BASECOUNT:N", "ACGT", "I", ("ACGT", "IIII", 0)),
        ("TOPHRED64", "AC", "II", ("AC", "hh", 0)),
        ("TOPHRED33", "AC", "II", ("AC", "II", 0)),
        ("MINLEN:4", "ACGT", "I", ("ACGT", "IIII", 0)),
        ("MINLEN:5", "ACGT", "I", None),
        ("MAXLEN:3", "ACGT", "I", None),
        ("MAXINFO:4:0.5", "", "", None),
    ],
)
def test_vectors(spark, step, sequence, quality, expected):
    assert one(spark, step, sequence, quality) == expected


def test_other_offset(spark):
    assert one(spark, "LEADING:3", "ACGT", "@BhN", offset=64) == ("GT", "hN", 2)
    assert one(spark, "TOPHRED33", "AC", "hh", offset=64) == ("AC", "II", 0)


def test_null_reads_and_order(spark):
    df = singles(spark, ("ACGTACGT", "I"), ("AC", "I")).selectExpr("ordinal", "if(ordinal = 1, null, r1) AS r1", "o1_name", "o1_len", "'x' AS sequence")
    got = outcome(trim_single(df, ["HEADCROP:2", "CROP:3"]))
    assert got == [("GTA", "III", 2), None]


def test_slots(spark):
    df = trim_paired(pairs(spark, [("ACGTACGT", "I")], [("ACGTACGT", "I")]), ["HEADCROP:1:100:3:100"])
    assert outcome(df) == [("CGTACGT", "I" * 7, 1)] and outcome(df, "r2") == [("TACGT", "I" * 5, 3)]
    df = trim_paired(pairs(spark, [("ACGTACGT", "I")], [("ACGTACGT", "I")]), ["TAILCROP:1:100:7:100:3:4"])
    assert outcome(df) == [("ACGTACG", "I" * 7, 0)] and outcome(df, "r2") == [("ACGT", "I" * 4, 0)]


def test_twelve_steps_stay_linear(spark):
    steps = ["LEADING:3", "TRAILING:3", "SLIDINGWINDOW:4:15"] * 4
    df = trim_single(singles(spark, ("ACGTACGTAC", "I")), steps, "jvm")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    short = trim_single(singles(spark, ("ACGTACGTAC", "I")), steps[:3], "jvm")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 6 * len(short)
    assert outcome(df) == [("ACGTACGTAC", "I" * 10, 0)]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_forms_agree_on_random_chains(spark):
    rng = np.random.default_rng(5)
    data = []
    for _ in range(150):
        n = int(rng.integers(0, 90))
        data.append(("".join(rng.choice(list("ACGTNacg"), n)), "".join(chr(33 + int(x)) for x in np.clip(rng.normal(25, 14, n), 0, 41))))
    pool = ["LEADING:12", "TRAILING:12", "SLIDINGWINDOW:4:18", "SLIDINGWINDOW:5:20.5", "HEADCROP:2:70", "TAILCROP:1", "CROP:60", "MINLEN:12", "MAXLEN:80", "AVGQUAL:22", "BASECOUNT:GCN:2:40", "TOPHRED64", "TOPHRED33"]
    for _ in range(4):
        steps = [str(x) for x in rng.choice(pool, 5)]
        got = [[None if r["r1"] is None else tuple(r["r1"]) for r in trim_single(singles(spark, *data), steps, engine).orderBy("ordinal").collect()] for engine in ("arrow", "jvm")]
        assert got[0] == got[1]


def test_unknown_and_registered():
    for bad in ("NOPE:1", "leading:3", ":3"):
        with pytest.raises(ValueError):
            parse_step(bad)

    class Same(ColumnStep):
        def apply(self, read, slot, slots):
            return read

    register("SAME", lambda a: Same())
    assert isinstance(parse_steps(["SAME"])[0], Same)


def scalar_max_info(step, q):
    by_length, by_quality = step.tables
    total, best, at = 0, -float("inf"), 0
    for i, x in enumerate(q):
        total += int(by_quality[min(max(x, 0), 60)])
        score = float(int(by_length[i]) + total)
        if score >= best:
            best, at = score, i + 1
    return -1 if at < 1 or best == 0 else at


def test_max_info_against_scalar(spark):
    rng = np.random.default_rng(3)
    for target, strictness in ((40, 0.5), (20, 0.9), (70, 0.1), (900, 0.8)):
        step = MaxInfo(target, strictness)
        data, want = [], []
        for _ in range(40):
            n = int(rng.integers(1, 121))
            q = rng.integers(0, 42, n)
            s = "".join(rng.choice(list("ACGTN"), n))
            data.append((s, "".join(chr(33 + int(x)) for x in q)))
            k = scalar_max_info(step, [0 if c == "N" else int(x) for c, x in zip(s, q)])
            want.append(None if k < 0 else s[:k])
        got = outcome(trim_single(singles(spark, *data), [f"MAXINFO:{target}:{strictness}"]))
        assert [g and g[0] for g in got] == want


def test_max_info_refuses_long_reads(spark):
    with pytest.raises(Exception, match="1000"):
        one(spark, "MAXINFO:40:0.5", "A" * 1001, "I")
