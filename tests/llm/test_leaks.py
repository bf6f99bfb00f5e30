import random

from readloom.llm import leaks
from readloom.llm.leaks import build_index, near_passages, shared_passages, words

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just those people how too little state good very make world still see own men work here get both between life being under".split()


def pairs(df):
    return {(r["doc"], r["item"]): (r["longest"], r["words"]) for r in df.collect()}


def brute(docs, items, n=12):
    out = {}
    for d, text in docs:
        w = words(text) if text is not None and d is not None else []
        grams = {}
        for i in range(len(w) - n + 1):
            grams.setdefault(tuple(w[i : i + n]), []).append(i)
        for k, item in items:
            v = words(item) if item is not None and k is not None else []
            cover, best = set(), 0
            for j in range(len(v) - n + 1):
                for i in grams.get(tuple(v[j : j + n]), []):
                    m = n
                    while i + m < len(w) and j + m < len(v) and w[i + m] == v[j + m]:
                        m += 1
                    best = max(best, m)
                    cover |= set(range(j, j + m))
            if best:
                out[(d, k)] = (best, len(cover))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "k long, t string"), "k", "t", spark.createDataFrame(items, "i long, t string"), "i", "t"


def test_words():
    assert words("<b class='x'>It&apos;s</b>&nbsp;[quote=me_1]A-1_b[/quote] [b]É&amp;ß[/b] [X] [1]") == ["it", "s", "a", "1", "b", "é", "ß", "x", "1"]


def test_against_all_phrases(spark):
    rnd = random.Random(1)
    # few words, so that parts of passages agree by chance
    some = WORDS[:25]
    items = [(i, " ".join(rnd.choices(some, k=rnd.randint(8, 40)))) for i in range(15)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            item = rnd.choice(items)[1].split()
            a = rnd.randint(0, len(item))
            parts += [*rnd.choices(some, k=rnd.randint(0, 15)), *item[a : a + rnd.randint(5, 30)]]
        text = " ".join(parts)
        docs.append((d, text.upper() if d % 3 else "> " + text.replace(" ", ",&nbsp;<br>")))
    want = brute(docs, items)
    assert 10 < len(want)
    assert pairs(shared_passages(*frames(spark, docs, items))) == want


def test_cases(spark, monkeypatch):
    item = " ".join(WORDS[:20])
    docs = [(1, item), (2, None), (3, ""), (None, item), (4, " ".join(WORDS[5:16])), (5, " ".join(WORDS[4:16]) + " x " + " ".join(WORDS[:4])), (6, "w " * 200_000 + item)]
    items = [(1, item), (2, item), (3, None), (4, ""), (5, "a b c"), (None, item)]
    want = {(d, i): v for d, v in ((1, (20, 20)), (5, (12, 12)), (6, (20, 20))) for i in (1, 2)}
    assert pairs(shared_passages(*frames(spark, docs, items))) == want
    monkeypatch.setattr(leaks, "VOCABULARY_BYTES", 10)
    assert pairs(shared_passages(*frames(spark, docs, items))) == want
    assert pairs(shared_passages(*frames(spark, docs[:0], items))) == {}
    assert pairs(shared_passages(*frames(spark, docs, items[:0]))) == {}
    clash = spark.createDataFrame([(1, item, 1, 2)], "doc long, term string, item int, pos int")
    assert len(pairs(shared_passages(clash, "doc", "term", clash, "item", "term"))) == 1


def test_index_and_near(spark):
    docs = spark.createDataFrame([(1, "A b, a!")], "k long, t string")
    assert sorted(map(tuple, build_index(docs, "k", "t").collect())) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "a")]
    item = WORDS[:30]
    gone = [w for i, w in enumerate(item) if i not in (14, 15, 29)]
    swapped = item[:13] + ["other", *item[13:]]
    docs = [(1, " ".join(gone)), (2, " ".join(swapped)), (3, " ".join(WORDS[40:90])), (4, " ".join(item[:13]))]
    got = {(r["doc"], r["item"]): r["words"] for r in near_passages(*frames(spark, docs, [(1, " ".join(item))])).collect()}
    assert got == {(1, 1): 27, (2, 1): 30}


def near_brute(docs, items, slack=3, share=0.6):
    out = {}
    for d, text in docs:
        places = {}
        for p, w in enumerate(words(text)):
            places.setdefault(w, []).append(p)
        for k, item in items:
            v = words(item)
            at = [{p - i + e for p in places.get(w, []) for e in range(-slack, slack + 1)} for i, w in enumerate(v)]
            best = max((sum(s in a for a in at) for s in set().union(*at)), default=0)
            if best and best >= share * len(v):
                out[(d, k)] = best
    return out


def test_near_against_all_shifts(spark):
    """Retyped copies lose the rarest word of every passage, and items may be short."""
    rnd = random.Random(7)
    items = [(i, " ".join([*rnd.choices(WORDS, k=rnd.randint(3, 40)), f"absent{i}"])) for i in range(25)]
    docs = []
    for d in range(150):
        copy = rnd.choice(items)[1].split()
        for _ in range(rnd.randint(0, len(copy) // 2)):
            i = rnd.randrange(len(copy))
            copy[i : i + 1] = rnd.choice(([], ["typo"], [copy[i], "typo"], [rnd.choice(WORDS)]))
        docs.append((d, " ".join([*rnd.choices(WORDS, k=rnd.randint(0, 30)), *copy, *rnd.choices(WORDS[:9], k=rnd.randint(0, 30))])))
    want = near_brute(docs, items)
    assert len(want) > 80
    got = {(r["doc"], r["item"]): r["words"] for r in near_passages(*frames(spark, docs, items)).collect()}
    assert got == want
