"""Evaluation texts in a training corpus, by a positional inverted index."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import broadcast_if_small, materialize

PHRASE = 12
SEEDED = 0.5  # share of the words needed that must be among the rarest; changes the cost, not the result
VOCABULARY_BYTES = 16 << 20  # most bytes of test terms that are handed to every task

_TAGS = re.compile(r"<[^<>]*>|\[/?[a-z]+\]|\[[a-z]+=[^\]]*\]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-case runs of letters and digits, without tags and with HTML entities decoded."""
    return _WORD.findall(html.unescape(_TAGS.sub(" ", text)).lower())


def _postings(vocabulary):
    """(id, pos, term) of every word, or with a vocabulary (a broadcast set) of those in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = vocabulary.value if vocabulary is not None else None
        for batch in batches:
            ids, at, pos, term = batch.column("id"), [], [], []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), pa.array(pos, pa.int32()), pa.array(term, pa.string())], names=["id", "pos", "term"])

            for i, text in enumerate(batch.column("text").to_pylist()):
                for p, w in enumerate(words(text)):
                    if keep is None or w in keep:
                        at.append(i)
                        pos.append(p)
                        term.append(w)
                if len(at) > 200_000:
                    yield out()
                    at, pos, term = [], [], []
            if at:
                yield out()

    return run


def build_index(df: DataFrame, key: str, text: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """The positional index of a table: postings ``(id, pos, term)``, one per word of each text.

    ``vocabulary`` (term) keeps the postings of its terms only, for an index that will answer
    questions about those; within ``VOCABULARY_BYTES`` it is handed to the tasks, beyond that
    it is joined. Null and empty texts and rows with a null key have no postings.
    """
    spark = df.sparkSession
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = df.schema[key].dataType.simpleString()
    schema = f"id {kind}, pos int, term string"
    if vocabulary is None:
        return rows.mapInArrow(_postings(None), schema)
    vocabulary = vocabulary.distinct()
    size = vocabulary.agg(F.sum(F.octet_length("term") + 60)).first()[0] or 0
    if size > VOCABULARY_BYTES:
        return rows.mapInArrow(_postings(None), schema).join(vocabulary, "term", "left_semi")
    held = spark.sparkContext.broadcast(frozenset(r[0] for r in vocabulary.collect()))
    return rows.mapInArrow(_postings(held), schema)


def _postings_and_terms(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index of the corpus, the terms of the items, and these with ``df``, the postings of each term in the corpus."""
    terms = materialize(build_index(items, item_key, item_text).select(F.col("id").alias("item"), F.col("pos").alias("ipos"), "term"), "item-terms")
    index = materialize(build_index(corpus, key, text, terms.select("term")).withColumnRenamed("id", "doc"), "postings")
    lists = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return index, terms, terms.join(lists, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))


def _search(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, phrase: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index of the corpus, the terms of the items, and the candidates (doc, item, shift)."""
    index, terms, rare = _postings_and_terms(corpus, key, text, items, item_key, item_text)
    # the rarest term of every passage of ``phrase`` words: any shared passage holds one
    passage = Window.partitionBy("item").orderBy("ipos").rowsBetween(0, phrase - 1)
    first = rare.select("item", "ipos", F.min(F.struct("df", "ipos", "term")).over(passage).alias("r"), F.count(F.lit(1)).over(passage).alias("n")).where(F.col("n") == phrase)
    anchors = materialize(first.select("item", F.col("r.ipos").alias("ipos"), F.col("r.term").alias("term")).distinct(), "anchors")
    candidates = index.join(broadcast_if_small(anchors, 120), "term").select("doc", "item", (F.col("pos") - F.col("ipos")).alias("shift")).distinct()
    return index, terms, candidates


def shared_passages(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, phrase: int = PHRASE) -> DataFrame:
    """``(doc, item, longest, words, coverage)`` for corpus texts and items with ``phrase`` or more consecutive words in common.

    ``longest`` is the length of the longest common passage in words, ``words`` the words of
    the item in such passages (each once) and ``coverage`` their share of the item. See
    ``words`` for what a word is. Null keys and texts, and texts of fewer words than
    ``phrase``, match nothing; an item in several rows, or a key of several documents, is taken
    as one text per row only if keys are unique. Empty tables give no rows; other columns are
    not read.

    Method: the postings of the corpus are stored with positions. For each passage of an
    item the list of its rarest term gives the candidates (document, shift between the
    positions), and intersecting the lists of the item's other terms, offset by their place in
    the item, leaves the words that agree; runs of at least ``phrase`` of these are passages.
    Only rare terms start a search, so frequent words never meet each other.
    """
    index, terms, candidates = _search(corpus, key, text, items, item_key, item_text, phrase)
    candidates = materialize(candidates, "shifts")
    met = candidates.join(index, "doc").select("doc", "item", "shift", (F.col("pos") - F.col("shift")).alias("ipos"), "term")
    agree = met.join(broadcast_if_small(terms, 120), ["item", "ipos", "term"])
    order = Window.partitionBy("doc", "item", "shift").orderBy("ipos")
    runs = agree.withColumn("run", F.col("ipos") - F.row_number().over(order)).groupBy("doc", "item", "shift", "run").agg(F.count(F.lit(1)).alias("n"), F.min("ipos").alias("from"))
    runs = runs.where(F.col("n") >= phrase)
    lengths = terms.groupBy("item").agg(F.count(F.lit(1)).alias("length"))
    # passages of one item may overlap at different shifts: count each word of the item once
    upto = Window.partitionBy("doc", "item").orderBy("from", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("from") + F.col("n")
    fresh = F.greatest(F.lit(0), end - F.greatest("from", F.coalesce(F.max(end).over(upto), F.col("from"))))
    whole = runs.withColumn("fresh", fresh).groupBy("doc", "item").agg(F.max("n").alias("longest"), F.sum("fresh").alias("words"))
    return whole.join(broadcast_if_small(lengths, 40), "item").select("doc", "item", "longest", "words", (F.col("words") / F.col("length")).alias("coverage"))


def near_passages(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, phrase: int = PHRASE, slack: int = 3, share: float = 0.6) -> DataFrame:
    """``(doc, item, words, coverage)``: proximity matches, where at least ``share`` of an item's words lie near their place.

    A word of the item is near if the document has it within ``slack`` positions of where a
    shift puts it, so that words left out, added or exchanged do not matter; ``words`` is the
    most over all shifts. Items of any length count, and ``phrase`` has no effect here. Nulls
    and empty tables are as in ``shared_passages``.

    Method: where m of the n words of an item must be near, a document holds at least c of its
    n - m + c rarest, c being ``SEEDED`` of m; documents that do are candidates, in which all
    words are laid over each other. The first place of a word in the range of shifts that
    begins at s counts for s, so that a running sum along the shifts counts each word once.
    """
    index, terms, rare = _postings_and_terms(corpus, key, text, items, item_key, item_text)
    rank = F.row_number().over(Window.partitionBy("item").orderBy("df", "term", "ipos"))
    ranked = rare.withColumn("rank", rank).withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("item")))
    ranked = ranked.withColumn("m", F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("length") - 1e-9))).withColumn("c", F.ceil(F.lit(SEEDED) * F.col("m")))
    # a term of several places weighs as many words
    seeds = ranked.where((F.col("df") > 0) & (F.col("rank") <= F.col("length") - F.col("m") + F.col("c"))).groupBy("item", "term", "c").agg(F.count(F.lit(1)).alias("n"))
    seeds = materialize(seeds, "seeds")
    held = index.select("doc", "term").distinct().join(broadcast_if_small(seeds, 120), "term")
    candidates = materialize(held.groupBy("doc", "item").agg(F.sum("n").alias("n"), F.first("c").alias("c")).where("n >= c").select("doc", "item"), "candidates")
    inner = terms.withColumnRenamed("item", "i").withColumnRenamed("term", "t")
    on = (F.col("item") == F.col("i")) & (F.col("term") == F.col("t"))
    met = candidates.join(index, "doc").join(broadcast_if_small(inner, 120), on).select("doc", "item", "ipos", (F.col("pos") - F.col("ipos")).alias("at")).repartition("doc", "item")
    before = F.lag("at").over(Window.partitionBy("doc", "item", "ipos").orderBy("at"))
    met = met.withColumn("since", F.greatest(F.col("at") - 2 * slack, before + 1))
    edges = met.select("doc", "item", F.inline(F.array(F.struct(F.col("since").alias("s"), F.lit(1).alias("d")), F.struct((F.col("at") + 1).alias("s"), F.lit(-1).alias("d")))))
    steps = edges.groupBy("doc", "item", "s").agg(F.sum("d").alias("d"))
    counts = steps.select("doc", "item", F.sum("d").over(Window.partitionBy("doc", "item").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    lengths = terms.groupBy("item").agg(F.count(F.lit(1)).alias("length"))
    best = counts.groupBy("doc", "item").agg(F.max("n").alias("words")).join(broadcast_if_small(lengths, 40), "item")
    return best.select("doc", "item", "words", (F.col("words") / F.col("length")).alias("coverage")).where(F.col("coverage") >= share)
