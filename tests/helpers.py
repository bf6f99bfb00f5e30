from readloom.schema import from_table, paired, single

READS = "ordinal long, name string, sequence string, comment string, quality string, phred_offset int"


def reads(spark, *pairs, offset=33):
    """(ordinal, r1) of (sequence, quality) pairs; a quality of one character stands for all bases."""
    data = [(i, f"read{i}", s, "", q * len(s) if len(q) == 1 and len(s) != 1 else q, offset) for i, (s, q) in enumerate(pairs)]
    return from_table(spark.createDataFrame(data, READS))


def singles(spark, *pairs, offset=33):
    return single(reads(spark, *pairs, offset=offset))


def pairs(spark, first, second):
    return paired(reads(spark, *first), reads(spark, *second))


def outcome(df, read="r1"):
    """(sequence, quality, head_pos) by ordinal, None for dropped reads."""
    got = {r["ordinal"]: r[read] for r in df.collect()}
    return [None if got[i] is None else (got[i]["sequence"], got[i]["quality"], got[i]["head_pos"]) for i in sorted(got)]
