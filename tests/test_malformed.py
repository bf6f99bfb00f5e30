import random
import re

import pytest

from pyspark.sql import functions as F

from readloom.operators.malformed import _plain_parts, _plain_read, least_edits, least_line_edits, parse_free, parse_record, parse_records


def brute(text, fields):
    """The least number of quotes and delimiters to insert or delete, by trying all."""
    seen, layer, cost = {text}, [text], 0
    while True:
        for x in layer:
            p = parse_free(x)
            if p is not None and fields in (None, len(p)):
                return cost
        after = {x[:i] + m + x[i:] for x in layer for i in range(len(x) + 1) for m in '",'}
        after |= {x[:i] + x[i + 1 :] for x in layer for i, c in enumerate(x) if c in '",'}
        layer = list(after - seen)
        seen |= after
        cost += 1


def apply(text, ops):
    """The text after the told edits."""
    out, done = [], 0
    for op in ops:
        what, mark, *_, at = op.split()
        at, char = int(at), {"quote": '"', "delimiter": ",", "line": "\n"}[mark]
        out.append(text[done:at])
        done = at
        if what == "insert":
            out.append(char)
        else:
            assert text[at] == char or text[at : at + 2] == "\r\n" and char == "\n"
            done = at + 1 + (text[at] == "\r")
    return "".join(out) + text[done:]


def test_cheapest_edits():
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice('",,ab\n') for _ in range(rnd.randint(0, 7)))
        for fields in (None, 3):
            cost, ops = least_edits(text, fields)
            assert cost == len(ops)
            mended = parse_free(apply(text, ops))
            assert mended is not None and fields in (None, len(mended))
            if cost <= 2:
                assert cost == brute(text, fields)


def test_edits_look_at_types():
    """Of equally cheap edits those are told that leave fields of their types."""
    assert least_edits("r1,ACGT,IIII", 4) == (1, ["insert delimiter at 7"])
    assert least_edits("r1:ACGT,,IIII", 4) == (1, ["insert delimiter at 3"])
    assert least_edits("r,1,ACGT,,IIII", 4) == (1, ["delete delimiter at 1"])
    assert least_line_edits("@r1\nACGT+\nIIII\n") == (1, ["insert line end at 8"])
    assert least_line_edits("@r1\nAC\r\nGT\n+\nIIII") == (1, ["delete line end at 6"])
    assert least_line_edits("@r1\nACGT\n+\nII\nII\n\n") == (2, ["delete line end at 13", "delete line end at 16"])
    cost, ops = least_line_edits("x\n" * 60)
    assert cost == len(ops) == 56


def test_cheapest_line_ends():
    rnd = random.Random(2)
    for _ in range(400):
        text = "".join(rnd.choice(["@", "+", "A", "x", "\n", "\r\n"]) for _ in range(rnd.randint(1, 12)))
        cost, ops = least_line_edits(text)
        lines = lambda t: len(re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", t)))
        assert cost == len(ops) == abs(lines(text) - 4)
        last = re.search(r"\r?\n\Z", text)
        body = text[: last.start()] if last else text
        assert len(re.split(r"\r?\n", apply(body, ops))) == 4


def test_plain_reads_are_those_of_the_program(spark):
    """What the JVM loads is what the program loads at no cost, of all records without quotes and many with."""
    rnd = random.Random(3)
    data = []
    for i in range(4000):
        csv = rnd.random() < 0.5
        n = rnd.choice([3, 3, 3, 1])
        parts = [rnd.choice(["r", "", "@r", "a b"]), rnd.choice(["ACG", "acg", "ACG", "AX", "é"])[:n], rnd.choice(["", "c", "+", "x\r"]), rnd.choice(["III", "!J5", "hhh", "K~ "])[:3]]
        text = ",".join(rnd.choice(['"{}"', "{}", "{}", "{}"]).format(x) for x in parts) if csv else rnd.choice(["\n", "\r\n"]).join([rnd.choice(["@", "@", ""]) + parts[0], parts[1], rnd.choice(["+", "+", "-"]) + parts[2], parts[3]])
        data.append((i, "csv" if csv else "fastq", rnd.choice([33, 64, 50, None]), text + rnd.choice(["", "", "\n", ",", "\r\n\n"])))
    df = spark.createDataFrame(data, "id long, layout string, phred_offset int, payload string")
    plain = {r[0]: r[1] for r in df.select("id", _plain_read(_plain_parts(F.col("payload"), F.col("layout")), F.col("layout"), F.col("phred_offset"))).collect()}
    whole = {r["id"]: r for r in parse_records(df, "id").collect()}
    loaded = 0
    for i, layout, offset, text in data:
        reason, cost, edits, fields = parse_record(text, layout, offset)
        assert (whole[i]["reason"], whole[i]["cost"], whole[i]["edits"], whole[i]["read"] and list(whole[i]["read"])) == (reason, cost, edits, None if reason else fields)
        if plain[i]:
            assert list(plain[i]) == fields
            loaded += 1
        else:
            assert reason or '"' in text or offset == 50
    assert loaded > 20


@pytest.mark.parametrize(
    "payload, layout, reason",
    [
        (None, "csv", "empty"), (" \r\n\t", "fastq", "empty"), ("x", None, "layout"), ("x", "xml", "layout"),
        ('a,"AC,,II', "csv", "quoting"), ('a,A"C,,II', "csv", "quoting"), ('"a"b,AC,,II', "csv", "quoting"), ("a,AC,,II\n", "csv", "quoting"),
        ("a,AC,II", "csv", "field_count"), ("a,AC,,II,", "csv", "field_count"), (",AC,,II", "csv", "name"), ('"",AC,,II', "csv", "name"),
        ("a,,,", "csv", "sequence"), ("a,AX,,II", "csv", "sequence"), ("a,AC,,I", "csv", "length"), ("a,AC,,I~", "csv", "quality"), ("a,AC,,I ", "csv", "quality"),
        ("@a\nAC\n+\nII\n", "fastq", None), ("@a\r\nAC\r\n+x\r\nII", "fastq", None), ("@a\nAC\n+\nII\n\n", "fastq", "field_count"), ("@a\nAC\n+", "fastq", "field_count"),
        ("a\nAC\n+\nII", "fastq", "name"), ("@\nAC\n+\nII", "fastq", "name"), ("@a\nAC\n-\nII", "fastq", "comment"), ("@a\nA.\n+\nII", "fastq", "sequence"), ("@a\nAC\n+\nI", "fastq", "length"),
        ('"a ""x"", 1",acgN,"two\nlines","I,""5"', "csv", None),
    ],
)
def test_reasons(payload, layout, reason):
    assert parse_record(payload, layout, 33)[0] == reason


def test_fields():
    assert parse_record('"a ""x"", 1",acgN,"two\nlines","I,""5"', "csv", 33)[3] == ['a "x", 1', "acgN", "two\nlines", 'I,"5']
    assert parse_record("@a b\nAC\n+c\nII", "fastq", 33)[3] == ["a b", "AC", "c", "II"]
    assert parse_record("a,AC,,II", "csv", None)[0] == "quality"
    assert parse_record("a,AC,,hh", "csv", 64)[0] is None


def test_rows(spark, rows):
    data = [(1, "csv", 33, "a,AC,,II", "x"), (1, "csv", 33, "a,AC,,II", "x"), (2, "csv", 33, 'a,"AC,,II', "x"), (3, None, None, None, "x"), (None, "fastq", 33, "@a\n" + "A" * 200_000 + "\n+\n" + "I" * 200_000, "x"), (4, "csv", 33, 'a,' * 40_000 + '"', "x")]
    df = spark.createDataFrame(data, "id long, layout string, phred_offset int, payload string, sequence string")
    got = rows(parse_records(df, "id").selectExpr("id", "reason", "cost", "length(read.sequence)"))
    assert got == sorted([(1, None, 0, 2), (1, None, 0, 2), (2, "quoting", 1, None), (3, "empty", 0, None), (None, None, 0, 200_000), (4, "quoting", 1, None)], key=repr)
    assert parse_records(df.limit(0), "id").count() == 0
    with pytest.raises(ValueError):
        parse_records(df.withColumnRenamed("id", "reason"), "reason")
