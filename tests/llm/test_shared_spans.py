import collections
import random

import pytest
from pyspark.sql import functions as F

from readloom.llm.shared_spans import shared_by_record, stretches_by_record


places: set = set()  # (key, begin, bases) of the last brute force


def brute(rows, extra=(), span=32):
    texts = {s for k, s in rows if s is not None and k is not None}
    where = collections.defaultdict(set)
    ok = lambda w: set(w) <= set("ACGT")
    for s in texts:
        for i in range(len(s) - span + 1):
            where[s[i : i + span]].add(s)
    other = {e[i : i + span] for e in extra if e for i in range(len(e) - span + 1)}
    out = {}
    places.clear()
    for k, s in rows:
        if s is None or k is None:
            continue
        cover = [False] * len(s)
        for i in range(len(s) - span + 1):
            w = s[i : i + span]
            if ok(w) and (len(where[w]) > 1 or w in other):
                cover[i : i + span] = [True] * span
        if any(cover):
            begins = [i for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1])]
            out[k] = (len(s), sum(cover), len(begins))
            places.update((k, i, (cover[i:] + [False]).index(False)) for i in begins)
    return out


def run(spark, rows, extra=None, **how):
    df = spark.createDataFrame(rows, "k long, s string")
    e = None if extra is None else spark.createDataFrame([(x,) for x in extra], "seq string")
    got = {}
    for r in shared_by_record(df, "k", F.col("s"), e, **how).collect():
        assert r["key"] not in got
        got[r["key"]] = (r["bases"], r["shared"], r["stretches"])
    return got


def data(seed, n):
    rnd = random.Random(seed)
    dna = lambda m: "".join(rnd.choice("ACGT") for _ in range(m))
    pool = [dna(60) for _ in range(12)] + ["G" * 60, "AC" * 30, "T" * 31]
    rows = []

    def piece():
        p, at = rnd.choice(pool), rnd.randint(0, 30)
        return rnd.choice([dna(rnd.randint(0, 40)), p[at : at + rnd.randint(20, 60)], "N", p[:32], p[:31]])

    for i in range(n):
        rows.append((i, "".join(piece() for _ in range(rnd.randint(0, 5)))))
    return rows + rows[:5] + [(n + 1, rows[3][1]), (n + 2, None), (None, pool[0])]


@pytest.mark.parametrize("how", [{}, {"hot_rows": 3}, {"hot_rows": 0, "probe_rows": 10}])
def test_against_all_spans(spark, how):
    rows = data(1, 150)
    want = brute(rows)
    assert len(want) > 60
    # stretches that touch count as one
    assert run(spark, rows, **how) == want


@pytest.mark.parametrize("span", [16, 20, 33, 50, 100])
def test_lengths_of_spans(spark, span):
    """Spans of any length, their places, and anchors that only the tasks find to be hot."""
    rnd = random.Random(span)
    pool = ["".join(rnd.choices("ACGT", k=180)) for _ in range(8)] + ["ACG" * 60]
    rows = []
    for i in range(70):
        p, at = rnd.choice(pool), rnd.randint(0, 60)
        rows.append((i, "".join(rnd.choices("ACGT", k=rnd.randint(0, 30))) + p[at : at + span + rnd.randint(-1, 40)] + rnd.choice(["", "N", pool[0][:span]])))
    want = brute(rows, span=span)
    assert len(want) > 20
    df = spark.createDataFrame(rows, "k long, s string")
    for how in ({}, {"hot_rows": 5, "probe_rows": 0}):
        assert {tuple(r) for r in stretches_by_record(df, "k", F.col("s"), span=span, **how).collect()} == places
    assert run(spark, rows, span=span) == want
    with pytest.raises(ValueError):
        shared_by_record(df, "k", F.col("s"), span=15)


def test_key_with_two_texts(spark):
    rnd = random.Random(8)
    a, b = "".join(rnd.choices("ACGT", k=60)), "".join(rnd.choices("ACGT", k=60))
    df = spark.createDataFrame([(1, a), (1, b), (2, a[:40] + "N")], "k long, s string")
    assert sorted(tuple(r) for r in shared_by_record(df, "k", F.col("s")).collect()) == [(1, 60, 40, 1), (2, 41, 40, 1)]


def test_extra_and_share(spark):
    s = "".join(random.Random(3).choices("ACGT", k=64))
    rows = [(-5, "AC" + s[:40]), (2, s[:31]), (3, "N" * 70)]
    assert run(spark, rows, [s, s, None, ""]) == brute(rows, [s])
    assert run(spark, rows, [s], least_share=0.96) == {}
    assert list(run(spark, rows, [s], least_share=0.95)) == [-5]


def test_cases(spark):
    s = "".join(random.Random(4).choices("ACGT", k=40))
    assert run(spark, []) == {}
    assert run(spark, [(1, s), (2, s), (3, "")]) == {}
    assert run(spark, [(1, s + s)]) == {}
    long = "".join(random.Random(5).choices("ACGT", k=60_000))
    assert run(spark, [(1, long), (2, "N" + long)]) == {1: (60_000, 60_000, 1), 2: (60_001, 60_000, 1)}
    df = spark.createDataFrame([(1, s, 1, 1), (2, "A" + s, 1, 1)], "k long, s string, rep int, shared int")
    assert shared_by_record(df, "k", F.col("s")).count() == 2
