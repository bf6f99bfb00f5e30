"""Adapter clipping against a model that works base by base."""

import random

import numpy as np
import pytest

from readloom.operators.clip import Adapters, make_clip, sort_adapters
from readloom.operators.steps import parse_step
from readloom.plans.chain import trim_paired, trim_single
from readloom.sources.fasta import find_adapters, read_fasta
from tests.helpers import outcome, pairs, singles

P1, P2 = "CTAGGACTTCAGGATTCGCAACTGATCCGTAAGC", "GATCCTGAAGCTTACGGTCAATGCCATGTTCGAC"
SIM2_RC, SIM1_RC = "GTCGAACATGGCATTGACCGTAAGCTTCAGGATC", "GCTTACGGATCAGTTGCGAATCCTGAAGTCCTAG"
MATCH = np.float32(0.60206)


def rc(s):
    return "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(c, "N") for c in reversed(s))


def bits(a, b):
    """Differing bits of two bases, None for padding."""
    a, b = (x if x in ("A", "C", "G", "T") else None for x in (a, b))
    return 0 if a == b else 1 if a is None or b is None else 2


def at(s, i):
    return s[i] if 0 <= i < len(s) else None


def simple(seq, q, clip, mm, threshold):
    """The leftmost offset with a seed and enough score, or None."""
    over = min(15, int(np.float32(threshold) / MATCH))
    found = set()
    n = len(seq)
    if len(clip) < 16:
        starts = range(len(clip) - over)
    elif len(clip) < 24:
        starts = range(len(clip) - 15)
    else:
        starts = range(0, len(clip) - 15, 4)
    for i in range(n - over):
        for j in starts:
            width = min(16, n - i)
            if len(clip) < 16:
                width = min(width, len(clip))
            if sum(bits(at(seq, i + t), at(clip, j + t)) for t in range(width)) <= 2 * mm:
                found.add(i - j)
    for off in sorted(found):
        length = min(n - max(off, 0), len(clip) - max(-off, 0))
        if length <= over:
            continue
        run = best = np.float32(0)
        for t in range(length):
            a, b, qa = seq[max(off, 0) + t], clip[max(-off, 0) + t], q[max(off, 0) + t]
            v = np.float32(0) if "N" in (a, b) else MATCH if a == b else np.float32(-qa) / np.float32(10)
            run = np.float32(0) if v < 0 else np.float32(run + v)
            best = max(best, run)
        if best >= threshold:
            return off
    return None


def palindrome(s1, q1, s2, q2, one, two, mm, threshold, least):
    p = len(one)
    a, b = one + s1, two + s2
    qa, qb = [100] * p + q1, [100] * p + q2
    places_a, places_b = len(a) - 15, len(b) - 15
    if places_a <= p or places_b <= p:
        return None

    def seed(x, i, y, j):
        # the window of x from i against the reverse complement of the window of y from j
        w = rc(y[j : j + 16])
        return sum(bits(x[i + t], w[t]) for t in range(16)) <= 2 * mm

    ref, count = p, max(p - 16, 0)
    test = count
    while count < max(len(a), len(b)) - 15 - least:
        if (test < places_b and seed(a, ref, b, test)) or (test < places_a and seed(a, test, b, ref)):
            total = count + p + 16
            skip_b, skip_a = max(total - len(a), 0), max(total - len(b), 0)
            overlap = total - skip_a - skip_b
            score = np.float32(0)
            for i in range(overlap):
                i1, i2 = i + skip_a, skip_b + overlap - i - 1
                c, d = a[i1], rc(b[i2])
                if c == "N" or d == "N":
                    continue
                score = np.float32(score + (MATCH if c == d else np.float32(-(min(qa[i1], qb[i2]) // 10))))
            if score >= threshold:
                return total - 2 * p
        count += 1
        if count % 2 == 0 and ref + 1 < places_a and ref + 1 < places_b:
            ref += 1
        else:
            test += 1
    return None


def model(reads, adapters, args):
    mm, pal, sim = args[:3]
    least = args[3] if len(args) > 3 else 8
    both = len(args) > 4 and args[4]
    keep = [None] * len(reads)
    values = [None if r is None else [0 if c == "N" else ord(x) - 33 for c, x in zip(*r)] for r in reads]
    low = lambda k, v: v if k is None else min(k, v)
    if len(reads) == 2 and None not in reads:
        for one, two in adapters.pairs:
            k = palindrome(reads[0][0], values[0], reads[1][0], values[1], one, two, mm, pal, least)
            if k is not None:
                keep[0] = low(keep[0], k)
                keep[1] = low(keep[1], k) if both else 0
    for slot, mine in enumerate((adapters.forward, adapters.reverse)[: len(reads)]):
        if reads[slot] is None or (keep[slot] is not None and keep[slot] <= 0):
            continue
        for clip in mine + adapters.common:
            k = simple(reads[slot][0], values[slot], clip, mm, sim)
            if k is not None:
                keep[slot] = low(keep[slot], k)
    return [None if r is None else r[0] if k is None else r[0][:k] if k > 0 else None for r, k in zip(reads, keep)]


def random_reads(seed, count, adapters, low_quality=True):
    rnd = random.Random(seed)
    out = []
    for _ in range(count):
        n = rnd.randint(0, 110)
        insert = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 90)))
        clip = rnd.choice(adapters)
        clip = clip[rnd.choice([0, 0, 0, rnd.randint(0, 12)]) :] if rnd.random() < 0.3 else clip
        s = list((insert + clip + "".join(rnd.choice("ACGT") for _ in range(120)))[:n])
        for i in range(len(s)):
            if rnd.random() < 0.03:
                s[i] = rnd.choice("ACGTNn")
        out.append(("".join(s), "".join(chr(33 + (rnd.randint(0, 41) if low_quality else 40)) for _ in s)))
    return out


@pytest.mark.parametrize("size, args", [(34, (2, 30, 10)), (34, (1, 30, 7)), (34, (0, 30, 5)), (20, (2, 30, 7)), (23, (1, 30, 10)), (14, (1, 30, 5)), (15, (2, 30, 7)), (15, (2, 30, 10)), (24, (2, 30, 8)), (34, (2, 30, 0))])
def test_simple_against_model(spark, size, args):
    clips = (SIM2_RC[:size], SIM1_RC[-size:])
    data = random_reads(size + args[0], 150, clips)
    adapters = Adapters(forward=clips[:1], common=clips[1:])
    got = outcome(trim_single(singles(spark, *data), [make_clip(adapters, [str(x) for x in args])]))
    assert [g and g[0] for g in got] == [model([d], adapters, args)[0] for d in data]


@pytest.mark.parametrize("args", [(2, 30, 10), (2, 30, 10, 2, True), (1, 20, 7, 1, True), (2, 40, 10, 8, False)])
def test_palindrome_against_model(spark, args):
    rnd = random.Random(len(args) + args[1])
    first, second = [], []
    for _ in range(220):
        insert = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 90)))
        n1, n2 = rnd.randint(0, 90), rnd.randint(0, 90)
        if rnd.random() < 0.5:
            n2 = n1
        sides = []
        for n, s in ((n1, insert + rc(P2)), (n2, rc(insert) + rc(P1))):
            s = list((s + "".join(rnd.choice("ACGT") for _ in range(120)))[:n])
            for i in range(len(s)):
                if rnd.random() < 0.03:
                    s[i] = rnd.choice("ACGTN")
            sides.append(("".join(s), "".join(chr(33 + rnd.randint(2, 41)) for _ in s)))
        first.append(sides[0])
        second.append(sides[1])
    adapters = Adapters(pairs=((P1, P2),), forward=(SIM2_RC,), reverse=(SIM1_RC[:20],), common=())
    done = trim_paired(pairs(spark, first, second), [make_clip(adapters, [str(x).lower() for x in args])]).cache()
    got = list(zip([g and g[0] for g in outcome(done)], [g and g[0] for g in outcome(done, "r2")]))
    want = [tuple(model([a, b], adapters, args)) for a, b in zip(first, second)]
    assert got == want
    assert sum(w[0] is not None and len(w[0]) < len(a[0]) for w, a in zip(want, first)) > 20


def test_vectors(spark):
    insert = "ACGATTGCAGGCTAACCGTATTGCAATCCG"
    clip = lambda *a, **k: make_clip(Adapters(**k), [str(x) for x in a])
    run = lambda step, s, q="I": (outcome(trim_single(singles(spark, (s, q)), [step]))[0] or (None,))[0]
    assert run(clip(2, 30, 10, common=(SIM2_RC,)), insert + SIM2_RC[:20]) == insert
    assert run(clip(2, 30, 10, common=(SIM2_RC,)), SIM2_RC + insert) is None
    # one mismatch in the middle of an overlap of 23 leaves runs of 11, too short for a threshold of 7
    off = {"A": "C", "C": "A", "G": "T", "T": "G"}
    s = SIM2_RC[:11] + off[SIM2_RC[11]] + SIM2_RC[12:23]
    assert run(clip(1, 30, 7, common=(SIM2_RC,)), insert + s) == insert + s
    f, r = insert + rc(P2)[:20], rc(insert) + rc(P1)[:20]
    pair = lambda step, a, b: [(outcome(d)[0] or (None,))[0] for d in [trim_paired(pairs(spark, [(a, "I")], [(b, "I")]), [step])]] + [
        (outcome(trim_paired(pairs(spark, [(a, "I")], [(b, "I")]), [step]), "r2")[0] or (None,))[0]
    ]
    p = ((P1, P2),)
    assert pair(clip(2, 30, 10, pairs=p), f, r) == [insert, None]
    assert pair(clip(2, 30, 10, 8, "true", pairs=p), f, r) == [insert, rc(insert)]
    dimer = (rc(P2) + insert)[:50], (rc(P1) + insert)[:50]
    assert pair(clip(2, 30, 10, 8, "true", pairs=p), *dimer) == [None, None]
    for size, kept in ((42, 42), (43, 50)):
        long = (insert + insert[::-1])[:size]
        a, b = (long + rc(P2))[:50], (rc(long) + rc(P1))[:50]
        assert len(pair(clip(2, 30, 10, pairs=p), a, b)[0]) == kept


def test_sides_and_files(tmp_path, monkeypatch):
    records = [("PrefixX/1", "AACC"), ("PrefixX/2", "GGTTA"), ("PrefixY/1", "ACGT"), ("a/1", "TTTT"), ("b/1", "TTTT"), ("c/2", "CCCC"), ("d", "GGGG"), ("d", "GGGA")]
    a = sort_adapters(records)
    assert a == Adapters((("AACC", "GTTA"),), ("ACGT", "TTTT"), ("CCCC",), ("GGGA",))
    f = tmp_path / "my.fa"
    f.write_text("; note\n>one/1 first\nACGT\nACGT\n;skip\n>two|x\n ACG \n")
    assert read_fasta(str(f)) == [("one/1", "ACGTACGT"), ("two", "ACG")]
    monkeypatch.chdir(tmp_path)
    assert find_adapters("my.fa") == str(f)
    step = parse_step("ILLUMINACLIP:my.fa:2:30:10:4:TRUE")
    assert (step.seed_mismatches, step.palindrome, step.simple, step.least_prefix, step.keep_both) == (2, 30, 10, 4, True)
    with pytest.raises(FileNotFoundError):
        parse_step("ILLUMINACLIP:none.fa:2:30:10")
    with pytest.raises(ValueError):
        parse_step("ILLUMINACLIP:my.fa:2:30")


def test_queries_pair_all_adapters(spark, monkeypatch):
    """Every forward sequence that has a reverse one is tested for palindromes with it."""
    from readloom.queries import core

    seen = []
    adapters = core.Adapters((), tuple(f"ACGTACGT{'A' * i}" for i in range(9)), tuple(f"TTGGCCAA{'C' * i}" for i in range(6)), ())
    rows = [(f"N{i}/{end}", x) for end, side in ((1, adapters.forward), (2, adapters.reverse)) for i, x in enumerate(side)]
    monkeypatch.setattr(core, "_adapter_rows", lambda *_: rows)
    monkeypatch.setattr(core, "make_clip", lambda a, args: seen.append(a))
    monkeypatch.setattr(core, "_pairs", lambda *_: None)
    monkeypatch.setattr(core, "trim_paired", lambda *_: None)
    monkeypatch.setattr(core, "_lengths", lambda *_: None)
    core.clip_palindrome(spark, "")
    assert len(seen[0].pairs) == 6 and seen[0].forward == adapters.forward and seen[0].reverse == adapters.reverse
