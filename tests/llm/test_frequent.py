import collections
import random

from pyspark.sql import functions as F

from readloom.llm.frequent import frequent_values


def table(spark, values, **extra):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v string")


def top(df):
    return [(r["value"], r["n"]) for r in df.collect()]


def test_against_counter(spark):
    rnd = random.Random(1)
    values = [str(int(rnd.paretovariate(0.8))) for _ in range(5000)]
    want = sorted(collections.Counter(values).items(), key=lambda x: (-x[1], x[0]))
    df = table(spark, values)
    assert top(frequent_values(df, F.col("v"), k=12)) == want[:12]
    # a poor sample only weakens the pruning
    assert top(frequent_values(df, F.col("v"), k=12, probe_rows=0)) == want[:12]
    assert sorted(top(frequent_values(df, F.col("v"), min_share=0.01))) == sorted(x for x in want if x[1] * 100 >= len(values))
    assert top(frequent_values(df, F.col("v"), k=3, min_share=0.01)) == [x for x in want if x[1] * 100 >= len(values)][:3]


def test_share_is_exact(spark):
    df = table(spark, ["a"] * 1 + [f"x{i}" for i in range(199)])
    assert len(top(frequent_values(df, F.col("v"), min_share=0.005))) == 200
    df = table(spark, ["a"] * 2 + [f"x{i}" for i in range(399)])
    assert top(frequent_values(df, F.col("v"), min_share=0.005)) == []


def test_keys_count_once(spark):
    rows = [(1, "a"), (1, "a"), (1, "a"), (2, "b"), (3, "b"), (None, "c"), (None, "c"), (4, None)]
    df = spark.createDataFrame(rows, "k long, v string")
    assert sorted(top(frequent_values(df, F.col("v"), key="k", k=9))) == [("a", 1), ("b", 2), ("c", 1)]


def test_ties_nulls_empty_and_names(spark):
    df = spark.createDataFrame([("b", 1, 2), ("a", 1, 2), ("", 3, 4), ("", 3, 4), (None, 5, 6)], "v string, n int, h int")
    assert top(frequent_values(df, F.col("v"), k=2)) == [("", 2), ("a", 1)]
    assert top(frequent_values(df.limit(0), F.col("v"), k=2)) == []
    assert top(frequent_values(df.limit(0), F.col("v"), min_share=0.1)) == []
    long = "x" * 300_000
    assert top(frequent_values(table(spark, [long, long, "y"]), F.col("v"), k=1)) == [(long, 2)]


def test_values_that_share_a_hash(spark, monkeypatch):
    import readloom.llm.frequent as module

    class Clash:
        """All functions, but a hash that tells lengths only."""

        def __getattr__(self, name):
            return getattr(F, name)

        def xxhash64(self, *c):
            return F.length(c[0]).cast("long") * F.lit(2**56)

    monkeypatch.setattr(module, "F", Clash())
    df = table(spark, ["aa"] * 3 + ["bb"] * 2 + ["c"])
    assert sorted(top(frequent_values(df, F.col("v"), min_share=0.3))) == [("aa", 3), ("bb", 2)]
    assert sorted(top(frequent_values(df, F.col("v"), key="k", min_share=0.3))) == [("aa", 3), ("bb", 2)]
