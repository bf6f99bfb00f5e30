import math
import random

import pytest

from readloom.llm.percentiles import base_quality_pieces, merge_pieces, percentile_pieces, radix_percentiles, radix_select


def exact(values, p):
    v = sorted(values, key=lambda x: (isinstance(x, float) and math.isnan(x), x))
    return v[max(1, math.ceil(len(v) * p / 100)) - 1]


def test_floats_and_integers(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.uniform(-1e6, 1e6), rnd.uniform(-1e-6, 1e-6), 0.0, -0.0, float("inf"), -1.5]), rnd.randint(-(2**62), 2**62)) for _ in range(900)]
    rows += [("a", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, i long")
    for col, at in (("x", 1), ("i", 2)):
        got = {(r["g"], r["pct"]): r["value"] for r in radix_percentiles(df, ["g"], col, [0, 1, 50, 99.9, 100]).collect()}
        for g in ("a", "b", None):
            mine = [r[at] for r in rows if r[0] == g and r[at] is not None]
            for p in (0, 1, 50, 99.9, 100):
                assert got[(g, p)] == exact(mine, p)
    whole = radix_percentiles(df, [], "i", [50]).collect()
    assert whole[0]["value"] == exact([r[2] for r in rows if r[2] is not None], 50)
    assert radix_percentiles(df, ["g"], "i", [50], digit_bits=8).where("g = 'a'").first()["value"] == exact([r[2] for r in rows if r[0] == "a" and r[2] is not None], 50)


def test_cases(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("b", None)], "g string, x double")
    got = {(r[0], r[1]): r[2] for r in radix_percentiles(df, ["g"], "x", [50, 100]).collect()}
    assert got[("a", 50)] == 1.0 and math.isnan(got[("a", 100)]) and len(got) == 2
    assert radix_percentiles(df.limit(0), ["g"], "x", [50]).count() == 0
    assert radix_percentiles(df.limit(0), [], "x", [50]).count() == 0
    clash = spark.createDataFrame([(1, 2, 3, 4, 5)], "key int, n int, u int, prefix int, digit int")
    assert [r["digit"] for r in radix_percentiles(clash, ["prefix"], "digit", [50]).withColumnRenamed("value", "digit").collect()] == [5]
    with pytest.raises(ValueError):
        radix_select(percentile_pieces(df, ["g"], "x"), ["g"], [101])


def test_scans(spark):
    """Each digit reads the rows once at most, and what later digits need is written down when it is little."""
    for spread, most in ((lambda i: float(i * i), 2), (lambda i: float(i % 3), 4)):
        read = spark.sparkContext.accumulator(0)

        def counted(batches, read=read):
            for b in batches:
                read.add(b.num_rows)
                yield b

        df = spark.createDataFrame([(i % 2, spread(i)) for i in range(4000)], "g int, x double").mapInArrow(counted, "g int, x double")
        got = {(r["g"], r["pct"]): r["value"] for r in radix_percentiles(df, ["g"], "x", [50]).collect()}
        assert got == {(g, 50): exact([spread(i) for i in range(4000) if i % 2 == g], 50) for g in (0, 1)}
        assert read.value <= most * 4000


def test_pieces_merge_with_bounded_error(spark):
    rnd = random.Random(2)
    days = [[rnd.lognormvariate(0, 3) for _ in range(500)] for _ in range(3)]
    frames = [spark.createDataFrame([(1, x) for x in d], "g int, x double") for d in days]
    exact_ = merge_pieces(*[percentile_pieces(f, ["g"], "x") for f in frames])
    rough = merge_pieces(*[percentile_pieces(f, ["g"], "x", bits=32) for f in frames])
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from readloom.llm.percentiles import from_order_key

    for pieces, error in ((exact_, 0), (rough, 2**-20)):
        for r in radix_select(pieces, ["g"], [5, 50, 95]).withColumn("v", from_order_key(F.col("key"), T.DoubleType())).collect():
            want = exact(sum(days, []), r["pct"])
            assert abs(r["v"] - want) <= error * abs(want)


def test_base_qualities(spark):
    reads = spark.createDataFrame(
        [("r", 1, 33, "ACN", "I5I", "x"), ("r", 1, None, "Nn", "hh", "x"), ("q", 2, None, "A", "I", "x"), (None, None, 33, "A", "é", "x"), ("r", 1, 33, "A", "III", "x"), ("r", 1, 33, None, "I", "x"), ("r", 1, 33, "", "", "x")],
        "run_id string, lane int, phred_offset int, sequence string, quality string, key string",
    )
    runs = spark.createDataFrame([("r", 64)], "run_id string, phred_offset int")
    got = {(r["run_id"], r["lane"], r["key"]): r["n"] for r in base_quality_pieces(reads, runs).collect()}
    assert got == {("r", 1, 40): 5, ("r", 1, 20): 1, ("r", 1, 0): 2, (None, None, 200): 1}
