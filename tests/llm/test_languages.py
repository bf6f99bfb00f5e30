import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm.bayes import bounded_sample
from readloom.llm.languages import best_path, document_languages, fit_languages, label_language, language_segments, prose_words

SENTENCES = {
    "en": "the nightly job keeps a very noisy start although nobody changed anything while the others look fine and we threw the batch away because the header looks different",
    "de": "der nächtliche lauf hat schon wieder eine leere ausgabe gezeigt obwohl niemand etwas geändert hat und wir haben den stapel weggeworfen weil die kopfzeile anders aussieht",
    "fr": "la tâche de nuit garde un début très bruité alors que personne n'a rien changé et nous avons jeté le lot parce que l'entête est différente depuis la semaine dernière",
    "es": "la tarea de la noche guarda un comienzo con mucho ruido aunque nadie ha cambiado nada y hemos tirado el lote porque la cabecera es distinta desde la semana pasada",
    "pt": "a tarefa da noite guarda um começo com muito ruído embora ninguém tenha mudado nada e deitámos fora o lote porque o cabeçalho é diferente desde a semana passada",
    "nl": "de nachtelijke taak bewaart een heel onrustig begin hoewel niemand iets veranderd heeft en wij hebben de partij weggegooid omdat de kop er anders uitziet sinds vorige week",
    "pl": "nocne zadanie trzyma bardzo zaszumiony początek choć nikt niczego nie zmienił i wyrzuciliśmy całą partię bo nagłówek wygląda inaczej od zeszłego tygodnia",
    "ru": "ночная задача хранит очень шумное начало хотя никто ничего не менял и мы выбросили всю партию потому что заголовок другой с прошлой недели",
}
DOCS = "k long, t string, l string"


def shuffled(rnd, lang, n):
    return " ".join(rnd.choices(SENTENCES[lang].split(), k=n))


def corpus(seed, n=300):
    """Texts with a tenth of their labels wrong and a third of them in two languages: rows, and true words by language."""
    rnd = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        main, other = rnd.sample(list(SENTENCES), 2)
        parts = {main: 40} | ({other: 30} if i % 3 == 0 else {})
        rows.append((i, "\n".join(shuffled(rnd, x, m) for x, m in parts.items()), rnd.choice(list(SENTENCES)) if i % 10 == 0 else main))
        truth[i] = parts
    return rows, truth


def test_labels(spark):
    named = {" en": "en", "EN-us": "en", "Deutsch": "de", "fre": "fr", "español": "es", "pt_BR": "pt", "dut": "nl", "Polish": "pl", "русский": "ru"}
    df = spark.createDataFrame([(a, b) for a, b in named.items()] + [(x, None) for x in ("", "und", "unknown", "??", "xx", None)], "l string, want string")
    assert [r for r in df.select("want", label_language(F.col("l")).alias("got")).collect() if r[0] != r[1]] == []


def test_prose():
    text = "[quote=user_1]Hello there [/quote]\nuser_00481:\n> quoted words, S00166 v0.38 zitra_46 (8585)\n```\nWARN rec 1\n```\n<pre>log</pre>[code]a b[/code]see [url=http://x.example/t/4]link[/url] https://a.b/c don't\n-- \nsignature here"
    assert prose_words(text) == ["hello", "there", "quoted", "words", "see", "link", "don't"]
    assert prose_words("a" * 500_000 + " " + "1" * 500_000 + ":") == ["a" * 500_000]
    assert prose_words("") == [] and prose_words("```never closed a b c") == []


def test_held_out_accuracy(spark):
    rows, _ = corpus(1)
    matrix = fit_languages(spark.createDataFrame(rows, DOCS), "k", "t", "l")
    held, truth = corpus(2)
    segments = language_segments(spark.createDataFrame(held, DOCS), "k", "t", "l", matrix).cache()
    got = {(r["key"], r["lang"]): r for r in document_languages(segments).collect() if r["words"] >= 20}
    want = {(k, lang): n for k, parts in truth.items() for lang, n in parts.items()}
    assert len(set(got) ^ set(want)) <= 0.01 * len(want)
    assert np.mean([abs(got[x]["words"] - want[x]) <= 2 for x in want if x in got]) > 0.97
    assert all(0 < r["confidence"] <= 1 for r in got.values())
    assert segments.groupBy("key").agg(F.count("*").alias("n"), F.max("segment").alias("m")).where("m <> n - 1").count() == 0


def test_cases(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34", "en"), (None, SENTENCES["en"], "en"), (5, SENTENCES["de"] + " ", None), (5, SENTENCES["de"], None)], DOCS)
    df = df.withColumns({"lang": F.lit(1), "words": F.lit(1), "key": F.lit("x"), "h": F.lit(0)})
    got = language_segments(df, "k", "t", "l").collect()
    assert sorted((r["key"] is None, r["key"]) for r in got)[:1] == [(False, 5)] and len({r["key"] for r in got}) == 2
    assert language_segments(df.limit(0), "k", "t", "l").count() == 0
    assert language_segments(df.where("l IS NULL"), "k", "t", "l").count() == 0
    rows, _ = corpus(3)
    long = " ".join(SENTENCES["pl"] for _ in range(3000))
    out = document_languages(language_segments(spark.createDataFrame([*rows, (900, long, "en")], DOCS), "k", "t", "l", with_prose=True)).where("key = 900 AND words > 100").collect()
    assert [r["lang"] for r in out] == ["pl"] and out[0]["words"] > 0.98 * len(long.split())


@pytest.mark.parametrize("switch", [0.5, 3.0])
def test_path_against_enumeration(switch):
    import itertools

    rng = np.random.default_rng(1)
    lengths = np.array([3, 0, 5, 1, 4])
    scores = rng.normal(size=(lengths.sum(), 3))
    path = best_path(scores, lengths, switch)
    at = 0
    for n in lengths:
        part = scores[at : at + n]
        value = lambda p, part=part: sum(part[i, s] for i, s in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))
        if n:
            assert value(path[at : at + n]) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=n)))
        at += n


def test_words_after_a_quoted_signature_stay():
    assert prose_words("> hello\n> -- \n> sent by me\n> > deeper\nown reply\n-- \ngone\nfor good") == ["hello", "own", "reply"]
    assert prose_words("> > one\n> > -- \n> > gone\n> two\n> -- \n> gone") == ["one", "two"]
    assert prose_words("one\n--\ntwo") == ["one", "two"]


def test_other_languages(spark):
    """Languages are a parameter; labels of others name none."""
    rows, _ = corpus(3, 120)
    df = spark.createDataFrame(rows, DOCS)
    some = {"ru": ("rus",), "de": ("deutsch",)}
    got = language_segments(df, "k", "t", "l", spellings=some).select("lang").distinct().collect()
    assert {r[0] for r in got} == {"ru", "de"}
    named = spark.createDataFrame([("Deutsch",), ("en",), ("RUS",)], "l string").select(label_language(F.col("l"), some)).collect()
    assert [r[0] for r in named] == ["de", None, "ru"]


def test_bounded_sample(spark):
    rows = [(i, "x" * (i % 7)) for i in range(5000)] + [(7, None)]
    df = spark.createDataFrame(rows, "k long, t string").select(F.xxhash64("k", "t").alias("h"), "t")
    order = sorted(df.collect(), key=lambda r: r["h"])
    for most, size in ((10_000, 1 << 20), (100, 1 << 20), (100, 50), (100, 0)):
        want, total = [], 0
        for r in order[:most]:
            total += len(r["t"] or "")
            if total > size:
                break
            want.append(tuple(r))
        got = [tuple(r) for r in bounded_sample(df, "h", "t", most, size).collect()]
        assert got == want or size == 0 and not any(t for _, t in got)
