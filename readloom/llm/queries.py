"""Queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.sequence import normal_sequence
from readloom.llm.frequent import frequent_values
from readloom.llm.languages import document_languages, label_language, language_segments
from readloom.llm.leaks import near_passages, shared_passages
from readloom.llm.mixing import mix_sources
from readloom.llm.near_duplicates import near_duplicates, similar_groups
from readloom.llm.percentiles import base_quality_pieces, radix_percentiles, radix_select
from readloom.llm.shared_spans import shared_by_record, stretches_by_record
from readloom.operators.keyed import once_per_key
from readloom.session import materialize, table



def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "fastq_reads")
    return frequent_values(reads, normal_sequence(F.col("sequence")), key="ordinal", min_share=0.005).select(F.col("value").alias("sequence"))


def p1_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "fastq_reads")
    return frequent_values(reads, normal_sequence(F.col("sequence")), key="ordinal", k=10).select(F.col("value").alias("sequence"), "n")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "fastq_reads")
    pairs = near_duplicates(reads, "ordinal", normal_sequence(F.col("sequence")))
    return pairs.select(F.col("key_a").alias("ordinal_a"), F.col("key_b").alias("ordinal_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every read and how many different sequences are near to its own."""
    return similar_groups(table(spark, sf_dir, "fastq_reads"), "ordinal", normal_sequence(F.col("sequence"))).withColumnRenamed("key", "ordinal")


def _qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["ordinal", "run_id", "lane", "phred_offset", "sequence", "quality", "loaded_at"]
    reads = once_per_key(table(spark, sf_dir, "fastq_reads").select(*cols), "ordinal", "loaded_at")
    return materialize(base_quality_pieces(reads, table(spark, sf_dir, "runs")), "qualities")


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = radix_select(_qualities(spark, sf_dir), ["run_id", "lane"], [10, 25, 50, 75, 90])
    return picked.select("run_id", "lane", F.col("pct").cast("int").alias("pct"), F.col("key").alias("value"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = radix_select(_qualities(spark, sf_dir), ["run_id", "lane"], [10, 50])
    low = ((F.col("pct") == 10) & (F.col("key") < 10)) | ((F.col("pct") == 50) & (F.col("key") < 28))
    return picked.where(low).select("run_id", "lane", F.col("pct").cast("int").alias("pct"))


def p4_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return radix_percentiles(items, ["l_returnflag"], "l_extendedprice", [1, 50, 99.9]).select("l_returnflag", "pct", "value")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "fastq_reads")
    forward = table(spark, sf_dir, "adapters").where("side = 'forward'").select(F.upper("sequence").alias("seq"))
    return shared_by_record(reads, "ordinal", normal_sequence(F.col("sequence")), forward, 0.5).select(F.col("key").alias("ordinal"))


def p5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal shared stretches of every read and their places."""
    reads = table(spark, sf_dir, "fastq_reads")
    forward = table(spark, sf_dir, "adapters").where("side = 'forward'").select(F.upper("sequence").alias("seq"))
    return stretches_by_record(reads, "ordinal", normal_sequence(F.col("sequence")), forward).withColumnRenamed("key", "ordinal")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "longest", "words", "coverage")


def p6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")
    return near.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "words", "coverage")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"), soft=False)
    return mix.report.where("NOT reachable").select("source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets")).report


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"))
    return mix.documents.withColumnRenamed("key", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs = document_languages(language_segments(docs, "doc_id", "text", "lang")).where("words >= 20")
    labels = docs.select(F.col("doc_id").alias("key"), label_language(F.col("lang")).alias("label"))
    named = langs.join(labels, "key").where(~F.col("lang").eqNullSafe(F.col("label")))
    return named.select(F.col("key").alias("doc_id"), "lang")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_segments(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", with_prose=True).withColumnRenamed("key", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_top, p2_found, p2_groups, p4_found, p4_percentiles, p4_prices, p5_found, p5_spans, p6_found, p6_passages, p6_near, p7_found, p7_report, p7_mix, p8_found, p8_segments)
}

_READS = "SELECT ordinal, upper(translate(any_value(sequence), 'uU.', 'tTN')) AS s FROM fastq_reads WHERE sequence IS NOT NULL GROUP BY ordinal"
_BASES = """
 r AS (SELECT ordinal, any_value(run_id) AS run_id, any_value(lane) AS lane, any_value(phred_offset) AS po, any_value(sequence) AS s, any_value(quality) AS q
       FROM fastq_reads WHERE sequence IS NOT NULL AND quality IS NOT NULL GROUP BY ordinal),
 b AS (SELECT r.run_id, r.lane, coalesce(r.po, runs.phred_offset) AS po, unnest(string_split(s, '')) AS c, unnest(string_split(q, '')) AS q FROM r LEFT JOIN runs USING (run_id)),
 v AS (SELECT run_id, lane, CASE WHEN c = 'N' THEN 0 ELSE ascii(q) - po END AS v, count(*) AS n FROM b WHERE po IS NOT NULL GROUP BY ALL),
 u AS (SELECT *, sum(n) OVER (PARTITION BY run_id, lane ORDER BY v) AS upto, sum(n) OVER (PARTITION BY run_id, lane) AS total FROM v),
 p AS (SELECT run_id, lane, pct, min(v) AS value FROM u, (SELECT unnest([10, 25, 50, 75, 90]) AS pct) WHERE upto * 100 >= pct * total GROUP BY ALL)"""

_CLASSES = f"reads AS ({_READS}), classes AS (SELECT s, min(ordinal) AS rep FROM reads GROUP BY s)"
#: Pairs of similar classes.
_SIMILAR = f"""{_CLASSES}, k AS (SELECT DISTINCT rep, s[i:i + 11] AS k FROM (SELECT rep, s, unnest(range(1, length(s) - 10)) AS i FROM classes)),
      ok AS (SELECT *, count(*) OVER (PARTITION BY rep) AS n FROM k WHERE NOT contains(k, 'N')), big AS (SELECT * FROM ok WHERE n >= 20),
      pairs AS (SELECT a.rep AS a, b.rep AS b FROM big a JOIN big b ON a.k = b.k AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 2 * count(*) >= a.n + b.n - count(*))"""
#: The starts of shared spans in each class and the next of them.
_SPOTS = f"""{_CLASSES}, w AS (SELECT rep, i, s[i:i + 31] AS w FROM (SELECT rep, s, unnest(range(1, length(s) - 30)) AS i FROM classes)),
      ad AS (SELECT -1 AS rep, unnest(list_transform(range(1, length(sequence) - 30), lambda i: upper(sequence)[i:i + 31])) AS w FROM adapters WHERE side = 'forward'),
      shared AS (SELECT w FROM (SELECT rep, w FROM w UNION ALL SELECT rep, w FROM ad) WHERE regexp_full_match(w, '[ACGT]+') GROUP BY w HAVING count(DISTINCT rep) > 1),
      spots AS (SELECT rep, i, lead(i) OVER (PARTITION BY rep ORDER BY i) AS next FROM w WHERE w IN (SELECT w FROM shared))"""
#: What `words` does, with the entities that the test tables hold.
_PLAIN = "lower(replace(replace(replace(replace(regexp_replace({text}, '<[^<>]*>|\\[/?[a-z]+\\]|\\[[a-z]+=[^\\]]*\\]', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))"
_WORDS = f"regexp_extract_all({_PLAIN}, '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"


def _placed(key: str, of: str) -> str:
    """Every word of each text and its place."""
    return f"SELECT {key}, i, w[i] AS w FROM (SELECT {key}, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT {key}, {_WORDS.format(text='text')} AS w FROM {of} WHERE text IS NOT NULL))"


def _grams(key: str, of: str, place: str = "") -> str:
    text = _WORDS.format(text="text")
    return f"SELECT DISTINCT {key}, {place and place + ','} array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, {text} AS w FROM {of} WHERE text IS NOT NULL))"


SQL: dict[str, str] = {
    "p2_found": f"""WITH {_SIMILAR}, m AS (SELECT rep, ordinal FROM classes JOIN reads USING (s))
      SELECT least(x.ordinal, y.ordinal) AS ordinal_a, greatest(x.ordinal, y.ordinal) AS ordinal_b FROM pairs JOIN m x ON x.rep = a JOIN m y ON y.rep = b""",
    "p2_groups": f"""WITH RECURSIVE {_SIMILAR}, edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
      reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
      root AS (SELECT rep, least(rep, coalesce(min(b), rep)) AS g FROM classes LEFT JOIN reach ON a = rep GROUP BY rep),
      links AS (SELECT a AS rep, count(*) AS n FROM edges GROUP BY a)
      SELECT ordinal, g AS "group", coalesce(n, 0) AS links FROM reads JOIN classes USING (s) JOIN root USING (rep) LEFT JOIN links USING (rep)""",
    "p5_found": f"""WITH {_SPOTS}, c AS (SELECT rep, sum(least(32, coalesce(next - i, 32))) AS n FROM spots GROUP BY rep)
      SELECT ordinal FROM c JOIN classes USING (rep) JOIN reads USING (s) WHERE 2 * n >= length(s)""",
    "p5_spans": f"""WITH {_SPOTS}, b AS (SELECT rep, i, CASE WHEN i - lag(i) OVER (PARTITION BY rep ORDER BY i) <= 32 THEN 0 ELSE 1 END AS new FROM spots),
      g AS (SELECT rep, i, sum(new) OVER (PARTITION BY rep ORDER BY i) AS g FROM b)
      SELECT ordinal, min(i) - 1 AS "begin", max(i) + 32 - min(i) AS bases FROM g JOIN classes USING (rep) JOIN reads USING (s) GROUP BY ordinal, g""",
    "p6_found": f"WITH d AS ({_grams('doc_id', 'documents')}), e AS ({_grams('item_id', 'eval_items')}) SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)",
    "p6_passages": f"""WITH d AS ({_grams('doc_id', 'documents', 'i')}), e AS ({_grams('item_id', 'eval_items', 'i')}), len AS (SELECT item_id, len({_WORDS.format(text="text")}) AS length FROM eval_items),
      m AS (SELECT doc_id, item_id, e.i AS ip, d.i - e.i AS shift FROM d JOIN e USING (g)), r AS (SELECT *, ip - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY ip) AS run FROM m),
      l AS (SELECT doc_id, item_id, max(n) + 11 AS longest FROM (SELECT doc_id, item_id, count(*) AS n FROM r GROUP BY doc_id, item_id, shift, run) GROUP BY ALL),
      w AS (SELECT doc_id, item_id, count(*) AS words FROM (SELECT DISTINCT doc_id, item_id, unnest(range(ip, ip + 12)) AS p FROM m) GROUP BY ALL)
      SELECT doc_id, item_id, longest, words, words / length AS coverage FROM l JOIN w USING (doc_id, item_id) JOIN len USING (item_id)""",
    "p6_near": f"""WITH d AS ({_placed('doc_id', 'documents')}), e AS ({_placed('item_id', 'eval_items')}), len AS (SELECT item_id, count(*) AS length FROM e GROUP BY item_id),
      m AS (SELECT d.doc_id, e.item_id, e.i AS ip, d.i - e.i AS off FROM d JOIN e USING (w)),
      able AS (SELECT doc_id, item_id, length FROM (SELECT doc_id, item_id, count(DISTINCT ip) AS n FROM m GROUP BY ALL) JOIN len USING (item_id) WHERE n / length >= 0.6),
      x AS (SELECT DISTINCT doc_id, item_id, length, ip, unnest(range(off - 6, off + 1)) AS s FROM m JOIN able USING (doc_id, item_id)),
      c AS (SELECT doc_id, item_id, length, count(*) AS n FROM x GROUP BY doc_id, item_id, length, s)
      SELECT doc_id, item_id, max(n) AS words, max(n) / length AS coverage FROM c GROUP BY doc_id, item_id, length HAVING max(n) / length >= 0.6""",
    "p1_found": f"WITH r AS ({_READS}) SELECT s AS sequence FROM r GROUP BY s HAVING count(*) * 1000 >= 5 * (SELECT count(*) FROM r)",
    "p1_top": f"SELECT s AS sequence, count(*) AS n FROM ({_READS}) GROUP BY s ORDER BY n DESC, s LIMIT 10",
    "p4_percentiles": f"WITH {_BASES} SELECT run_id, lane, CAST(pct AS INTEGER) AS pct, CAST(value AS BIGINT) AS value FROM p",
    "p4_found": f"WITH {_BASES} SELECT run_id, lane, CAST(pct AS INTEGER) AS pct FROM p WHERE (pct = 10 AND value < 10) OR (pct = 50 AND value < 28)",
    "p4_prices": """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i,
        count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL)
      SELECT l_returnflag, CAST(pct AS DOUBLE) AS pct, min(v) AS value FROM r, (SELECT unnest([1.0, 50.0, 99.9]) AS pct) WHERE i * 100 >= pct * n GROUP BY ALL""",
}
