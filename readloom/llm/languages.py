"""Languages of documents and of their stretches, where labels are missing or wrong."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.bayes import BUCKETS, Features, bounded_sample, fit, ngrams, score

#: The languages, and spellings of each besides its code: three letters, English name, own name.
SPELLINGS = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german", "deutsch"),
    "fr": ("fra", "fre", "french", "français", "francais"),
    "es": ("spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("por", "portuguese", "português", "portugues"),
    "nl": ("nld", "dut", "dutch", "nederlands"),
    "pl": ("pol", "polish", "polski"),
    "ru": ("rus", "russian", "русский"),
}
TRAIN_DOCS = 20_000  # most labelled documents that the classifier is fitted on
TRAIN_WORDS = 400  # what a longer text is weighted down to in the fit
SWITCH = 9.0  # what a change of language costs, in nats
WEIGHT = 0.6  # n-grams of a word overlap; their log probabilities count by this
ROUNDS = 3  # fits; from the second on, words train the language they were found in

_BLOCK = re.compile(r"```.*?(?:```|\Z)|\[code\].*?(?:\[/code\]|\Z)|<pre>.*?(?:</pre>|\Z)", re.S | re.I)
_SIGNATURE = re.compile(r"^((?:> ?)*)-- \r?$", re.M)
_QUOTE = re.compile(r"^(?:> ?)*", re.M)
_URL = re.compile(r"\b(?:https?|ftp)://\S+|\bwww\.\S+")
_TAG = re.compile(r"<[^<>]*>|\[/?[a-z]+(?:=[^\]]*)?\]|\[\.\.\.\]")
_AUTHOR = re.compile(r"^(?:> ?)*\S{0,80}\d\S{0,80}:[^\S\n]*$", re.M)
_CODE_WORD = re.compile(r"(?<!\S)[^\s\d_]*+[\d_]\S*+")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")


def label_language(label: Column, spellings: dict[str, tuple[str, ...]] = SPELLINGS) -> Column:
    """The code that a label names in any of its ``spellings``; null if it names none of these languages."""
    plain = F.lower(F.trim(label))
    stem = F.regexp_replace(plain, "[-_].*$", "")
    out = F.lit(None).cast("string")
    for code, names in spellings.items():
        out = F.when(stem.isin(code, *names), F.lit(code)).otherwise(out)
    return out


def _unsigned(text: str) -> str:
    """The text without signatures: each goes from a line ``-- `` to where the depth of its quote falls, unquoted to the end."""
    kept, at = [], 0
    while mark := _SIGNATURE.search(text, at):
        kept.append(text[at : mark.start()])
        depth = mark[1].count(">")
        at = next((q.start() for q in _QUOTE.finditer(text, mark.end()) if q[0].count(">") < depth), len(text))
    return "".join([*kept, text[at:]])


def prose(text: str) -> str:
    """The text without signature, code and log blocks, tags and URLs; quote marks are taken off."""
    t = _BLOCK.sub("\n", text)
    t = _unsigned(t)
    t = html.unescape(_URL.sub(" ", _TAG.sub(" ", t)))
    t = _AUTHOR.sub("", t)
    return re.sub(r"^(?:> ?)+", "", t, flags=re.M)


def prose_words(text: str) -> list[str]:
    """Words of prose in lower case; what holds digits or underscores is no word."""
    return _WORD.findall(_CODE_WORD.sub(" ", prose(text)).lower())


def _vectors(lists: list[list[str]], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the distinct words, and the word number and text number of every word."""
    seen: dict[str, int] = {}
    word = np.fromiter((seen.setdefault(w, len(seen)) for x in lists for w in x), np.int64)
    text = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    bucket, row = Features(ngrams).sparse(list(seen))
    return score(matrix, bucket, row, len(seen)) * WEIGHT, word, text


def best_path(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """The likeliest language of every word: Viterbi over all texts at once, a change costs ``switch``."""
    n, k = len(lengths), scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order] if n else np.zeros(0, np.int64)
    length = lengths[order]
    longest = int(length[0]) if n else 0
    came = np.zeros((len(scores), k), np.int8)
    value = np.zeros((n, k))
    last = np.zeros((n, k))
    for t in range(longest):
        m = int(np.searchsorted(-length, -t, "left"))  # texts with more than t words
        v = value[:m]
        if t:
            top = v.argmax(axis=1)
            other = v[np.arange(m), top][:, None] - switch
            stay = v >= other
            came[start[:m] + t] = np.where(stay, np.arange(k), top[:, None])
            v = np.where(stay, v, other)
        value[:m] = v + scores[start[:m] + t]
        ended = length[:m] == t + 1
        last[:m][ended] = value[:m][ended]
    path = np.zeros(len(scores), np.int8)
    state = last.argmax(axis=1) if n else np.zeros(0, np.int64)
    for t in range(longest - 1, -1, -1):
        m = int(np.searchsorted(-length, -t, "left"))
        at = start[:m] + t
        path[at] = state[:m]
        if t:
            state[:m] = came[at, state[:m]]
    return path


def _count(word: np.ndarray, label: np.ndarray, weight: np.ndarray, bucket: np.ndarray, row: np.ndarray, words: int, classes: int) -> np.ndarray:
    out = np.zeros((classes, BUCKETS))
    for c in range(classes):
        n = np.bincount(word[label == c], weights=weight[label == c], minlength=words)
        out[c] = np.bincount(bucket, weights=n[row], minlength=BUCKETS)
    return out


def fit_languages(df: DataFrame, key: str, text: str, label: str, most: int = TRAIN_DOCS, rounds: int = ROUNDS, spellings: dict[str, tuple[str, ...]] = SPELLINGS) -> np.ndarray | None:
    """Log probabilities (languages x buckets) fitted on labelled documents; None if there are none.

    The languages are those of ``spellings``. At most ``most`` labelled documents, of ``bayes.TRAIN_BYTES`` in all, take part, those with the least hashes.
    Their labels are partly wrong and texts mix languages, so after a first fit on the labels
    the words are trained as the language that the path through their text gives them.
    """
    names = tuple(spellings)
    code = label_language(F.col(label), spellings)
    rows = df.where(F.col(text).isNotNull()).select(F.xxhash64(key, text).alias("h"), F.col(text).alias("text"), code.alias("code")).where("code IS NOT NULL")
    sample = bounded_sample(rows, "h", "text", most).select("text", "code").collect()
    if not sample:
        return None
    lists = [prose_words(r[0]) for r in sample]
    lengths = np.array([len(x) for x in lists])
    seen: dict[str, int] = {}
    word = np.fromiter((seen.setdefault(w, len(seen)) for x in lists for w in x), np.int64)
    bucket, row = Features(ngrams).sparse(list(seen))
    label_of = np.repeat(np.array([names.index(r[1]) for r in sample]), lengths)
    # no text counts for more than so many words, or one long text under a wrong label would spoil its language
    weight = np.repeat(np.minimum(1.0, TRAIN_WORDS / np.maximum(lengths, 1)), lengths)
    matrix = fit(_count(word, label_of, weight, bucket, row, len(seen), len(names)))
    for _ in range(rounds - 1):
        vector = score(matrix, bucket, row, len(seen)) * WEIGHT
        path = best_path(vector[word], lengths, SWITCH)
        matrix = fit(_count(word, path, weight, bucket, row, len(seen), len(names)))
    return matrix


_SEGMENTS = "key {}, segment int, lang string, words int, confidence double"


def _segments(held, switch: float, with_prose: bool, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = held.value
        for whole in batches:
            # Arrow batches are bounded in rows; long texts are taken in smaller groups of rows
            for batch in _by_size(whole):
                lists = [prose_words(t) for t in batch.column("text").to_pylist()]
                lengths = np.array([len(x) for x in lists], np.int64)
                if not lengths.sum():
                    continue
                vector, word, text = _vectors(lists, matrix)
                per_word = vector[word]
                path = best_path(per_word, lengths, switch)
                first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (path[1:] != path[:-1])))
                n = np.diff(np.append(first, len(path)))
                total = np.add.reduceat(per_word, first, axis=0)
                total -= total.max(axis=1, keepdims=True)
                lang = path[first]
                likely = np.exp(total)
                sure = likely[np.arange(len(first)), lang] / likely.sum(axis=1)
                of = text[first]
                begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                number = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
                out = {
                    "key": batch.column("key").take(pa.array(of)),
                    "segment": pa.array(number.astype(np.int32)),
                    "lang": pa.array([names[i] for i in lang]),
                    "words": pa.array(n.astype(np.int32)),
                    "confidence": pa.array(sure),
                }
                if with_prose:
                    flat = [w for x in lists for w in x]
                    out["prose"] = pa.array([" ".join(flat[a : a + b]) for a, b in zip(first.tolist(), n.tolist())])
                yield pa.RecordBatch.from_pydict(out)

    return run


def _by_size(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    size = np.cumsum([len(t) for t in batch.column("text").to_pylist()])
    group = size // most
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for a, b in zip(cut, np.append(cut[1:], len(size))):
        yield batch.slice(a, b - a)


def language_segments(df: DataFrame, key: str, text: str, label: str, matrix: np.ndarray | None = None, switch: float = SWITCH, most: int = TRAIN_DOCS, with_prose: bool = False, spellings: dict[str, tuple[str, ...]] = SPELLINGS) -> DataFrame:
    """``(key, segment, lang, words, confidence[, prose])``: the stretches of one language in every text.

    Multinomial naive Bayes over hashed character n-grams scores every word of prose; the
    likeliest path through the text, on which a change of language costs ``switch``, gives
    the stretches. ``confidence`` is the posterior of the stretch's language. The languages are those of ``spellings``, at most 127. The matrix of log
    probabilities (8 x 65,536 floats, 2 MB at any size of the corpus) is broadcast; scoring is
    one narrow pass. Null, empty and wordless texts have no rows; without any labelled
    document there is nothing to fit and no rows come out; rows are taken one by one, so
    repeated keys give repeated rows. Other columns are not read.
    """
    if matrix is None:
        matrix = fit_languages(df, key, text, label, most, spellings=spellings)
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    if matrix is None:
        rows, matrix = rows.limit(0), np.zeros((len(spellings), BUCKETS), np.float32)
    held = df.sparkSession.sparkContext.broadcast(matrix)
    schema = _SEGMENTS.format(df.schema[key].dataType.simpleString()) + ", prose string" * with_prose
    return rows.mapInArrow(_segments(held, switch, with_prose, tuple(spellings)), schema)


def document_languages(segments: DataFrame) -> DataFrame:
    """``(key, lang, words, share, confidence)`` for each language of each document, from its stretches."""
    by = segments.groupBy("key", "lang").agg(F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"))
    total = F.sum("words").over(Window.partitionBy("key"))
    return by.select("key", "lang", "words", (F.col("words") / total).alias("share"), "confidence")
