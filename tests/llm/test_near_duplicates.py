import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm.near_duplicates import KMERS, MEETINGS, Bands, _by_bucket, _narrow, _packed, _pairs_in_parts, _wide, components, near_duplicates, similar_groups


def kmers(s, k=12):
    return {s[i : i + k] for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")}


def brute(rows, gamma=0.5, least=20):
    rows = sorted({(k, s) for k, s in rows if s is not None and k is not None})
    sets = [(k, s, kmers(s)) for k, s in rows]
    out = set()
    for i, (a, s, x) in enumerate(sets):
        for b, t, y in sets[i + 1 :]:
            if s != t and min(len(x), len(y)) >= least and len(x & y) >= gamma * len(x | y):
                out.add((min(a, b), max(a, b)))
    return out


def edited(rnd, s, edits):
    s = list(s)
    for _ in range(edits):
        i = rnd.randrange(len(s))
        kind = rnd.random()
        if kind < 0.5:
            s[i] = rnd.choice("ACGTN")
        elif kind < 0.75:
            s.insert(i, rnd.choice("ACGT"))
        else:
            del s[i]
    return "".join(s)


def data(seed, families, adapter=""):
    rnd = random.Random(seed)
    rows = []
    for _ in range(families):
        base = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(36, 151)))
        for _ in range(rnd.randint(1, 4)):
            s = edited(rnd, base, rnd.randint(0, 4))
            if adapter and rnd.random() < 0.6:
                s = s[: rnd.randint(0, len(s))] + adapter + "G" * rnd.randint(0, 30)
            rows.append((len(rows), s))
            if rnd.random() < 0.2:
                rows.append((len(rows) if rnd.random() < 0.5 else len(rows) - 1, s))
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "k long, s string")
    return {(r[0], r[1]) for r in near_duplicates(df, "k", F.col("s"), **how).collect()}


def test_against_all_pairs(spark):
    rows = data(1, 120)
    want = brute(rows)
    assert len(want) > 60
    assert run(spark, rows) == want


def test_hot_parts(spark):
    """With a bound of 3 sets the adapter's and even families' parts are hot: the finest partition finds the pairs."""
    rows = data(2, 60, "CTAGGACTTCAGGATTCGCAACTGATCCGTAAGC")
    want = brute(rows)
    assert len(want) > 60
    assert run(spark, rows, hot=3) == want
    assert run(spark, rows) == want


def test_cases(spark):
    s = "".join(random.Random(5).choices("ACGT", k=60))
    t = s[:30] + "A" + s[31:] if s[30] != "A" else s[:30] + "C" + s[31:]
    rows = [(1, s), (2, s), (3, t), (3, t), (4, None), (None, s), (5, ""), (6, "N" * 60), (7, s[:20])]
    assert run(spark, rows, gamma=0.4) == {(1, 3), (2, 3)}
    assert run(spark, rows[:0]) == set()
    long = "".join(random.Random(6).choices("ACGT", k=50_000))
    assert run(spark, [(1, long), (2, long[:-1])]) == {(1, 2)}
    df = spark.createDataFrame([(1, s, 0, 0), (2, t, 0, 0)], "k long, s string, rep int, seq int")
    assert near_duplicates(df, "k", F.col("s"), gamma=0.4).count() == 1


def test_large_group_in_tiles():
    import numpy as np

    from readloom.llm.near_duplicates import TILE, _group_pairs

    n = TILE + 5
    same = np.zeros(n, np.int64)
    pairs = [b for b in _group_pairs(same, np.arange(n), np.ones(n, np.int32), np.full(n, 30, np.int32), 0.5)]
    assert sum(b.num_rows for b in pairs) == n * (n - 1) // 2


def test_partly_hot_reads(spark):
    """An adapter over 256 texts hold alike counts for pairs of which one set has little of it."""
    adapter, rows = "CTAGGACTTCAGGATTCGCAACTGATCCGTAAGC", []
    rnd = random.Random(3)
    for _ in range(1100):
        insert = "".join(rnd.choices("ACGT", k=rnd.randint(8, 40)))
        for _ in range(2):
            rows.append((len(rows), (edited(rnd, insert, rnd.randint(0, 3)) + adapter + "G" * 30)[:36]))
    want = brute(rows)
    assert len(want) > 500
    assert run(spark, rows) == want


def test_short_reads(spark):
    """Reads of 31 to 36 bases fall into few parts of any kind: cut ends and edits leave hardly a whole one."""
    rnd, rows = random.Random(4), []
    for _ in range(700):
        n = rnd.choice((31, 33, 36))
        base = "".join(rnd.choices("ACGT", k=n + 12))
        i = rnd.randint(0, 10)
        rows.append((len(rows), base[:n]))
        rows.append((len(rows), edited(rnd, base, rnd.randint(1, 3))[:n] if rnd.random() < 0.5 else base[i : i + n]))
    want = brute(rows)
    assert len(want) > 200
    assert run(spark, rows) == want


@pytest.mark.parametrize("gamma", [0.1, 0.2, 0.5, 0.8, 1.0])
def test_similarities(spark, gamma):
    """Any similarity, over random reads, tandem repeats and reads with adapters, long and short."""
    rnd, rows = random.Random(6), []
    for kind in range(3):
        for _ in range(30):
            n = rnd.choice((31, 45, 60, 100, 300))
            unit = "".join(rnd.choices("ACGT", k=rnd.choice((7, 20)) if kind == 1 else n))
            base = (unit * n)[:n] + ("CTAGGACTTCAGGATTCGCAACTGATCC" if kind == 2 else "")
            for _ in range(3):
                at = rnd.randint(0, 9)
                rows.append((len(rows), edited(rnd, base, rnd.randint(0, 4))[at:]))
    want = brute(rows, gamma)
    assert want or gamma == 1.0
    assert run(spark, rows, gamma=gamma) == want


def test_family(spark):
    """Many texts near to one text and to each other."""
    rnd = random.Random(7)
    base = "".join(rnd.choices("ACGT", k=90))
    rows = [(i, edited(rnd, base, rnd.randint(1, 4))) for i in range(500)]
    want = brute(rows)
    assert len(want) > 30_000
    assert run(spark, rows) == want


def test_packing():
    rnd = np.random.default_rng(1)
    for top in (1, 200, 60_000, 10_000_000, 2**40, 2**62):
        x = rnd.integers(0, top, 50)
        assert (_wide(_narrow(x)) == x).all()
    bucket, sig = np.array([0, 0, 2]), np.array([5, 2**40, 7])
    batch = _packed(bucket, [sig, np.array([9, -1, 2**62])], KMERS)
    got = list(_by_bucket([batch]))
    assert [(b, [x.tolist() for x in c]) for b, c in got] == [(0, [[5, 2**40], [9, -1]]), (2, [[7], [2**62]])]


def test_every_similar_pair_has_a_signature():
    """The bound behind the signatures, on sets at the edge of the similarity."""
    rnd = np.random.default_rng(2)
    bands = Bands(0.5, 20, 200)
    for _ in range(300):
        n = int(rnd.integers(20, 160))
        m = int(rnd.integers(n, min(2 * n, 160) + 1))
        c = int(np.ceil((m + n) / 3))
        if c > n:
            continue
        tokens = np.sort(rnd.choice(1 << 24, m + n - c, replace=False).astype(np.uint64))
        mixed = rnd.permutation(m + n - c)
        sets = [np.sort(tokens[mixed[:m]]), np.sort(tokens[np.append(mixed[:c], mixed[m:])])]
        band = max(b for b, low in enumerate(bands.low) if low <= m)
        parts = int(bands.parts[band])
        found = []
        for x in sets:
            least = int(bands.common(band, np.array([len(x)]))[0])
            assert 0 < least <= c
            x = x[: len(x) - least + parts + MEETINGS]
            found.append(set(_pairs_in_parts(np.zeros(len(x), np.int64), x, parts, band)[1].tolist()))
        assert len(found[0] & found[1]) >= MEETINGS


def test_groups(spark):
    rows = data(9, 40)
    rows += [(1000, None), (None, rows[0][1]), (1001, "ACGT"), (1002, "ACGT")]
    pairs = brute(rows)
    texts = {(k, s) for k, s in rows if k is not None and s is not None}
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {x: set() for x in texts}
    for x in texts:
        for y in texts:
            if x[1] == y[1]:
                root[find(x)] = find(y)
            elif (min(x[0], y[0]), max(x[0], y[0])) in pairs and min(len(kmers(x[1])), len(kmers(y[1]))) >= 20 and 2 * len(kmers(x[1]) & kmers(y[1])) >= len(kmers(x[1]) | kmers(y[1])):
                root[find(x)] = find(y)
                links[x].add(y[1])
    want = sorted((k, min(y[0] for y in texts if find(y) == find((k, s))), len(links[(k, s)])) for k, s in texts)
    df = spark.createDataFrame(rows, "k long, s string")
    assert sorted(tuple(r) for r in similar_groups(df, "k", F.col("s")).collect()) == want
    assert similar_groups(df.limit(0), "k", F.col("s")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in components(chain).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
