"""Long exact spans shared between records, by winnowed anchors that are extended both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.kmers import by_size, encode, mix, windows
from readloom.llm.near_duplicates import classes, members
from readloom.session import broadcast_if_small, materialize

ANCHOR = 16
SPAN = 32
HOT_ROWS = 200_000  # rows under one anchor beyond which they are compared by another way
EXTRA = -(2**63)  # stands for all texts of the extra table
PROBE_ROWS = 200_000  # rows of the sample in which such anchors are looked for
PROBE_LEAST = 50  # rows that an anchor must have in it
WORD = 32  # bases in a 64-bit integer
LAID = 1_000_000  # bases around anchors that are laid out at a time

ANCHORS = pa.schema([("anchor", pa.int32()), ("rep", pa.int64()), ("pos", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("around", pa.binary())])
ANCHOR_SQL = "anchor int, rep long, pos int, left int, right int, around binary"
#: Starts of shared spans, from ``start`` to ``stop``, or, where ``anchor`` is not null, a row of a group left for later.
FOUND = pa.schema([("rep", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("anchor", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("around", pa.binary())])
FOUND_SQL = "rep long, start int, stop int, anchor int, left int, right int, around binary"


def _anchors(span: int):
    """Winnowed 16-mers with the ``span`` - 16 bases on either side and how many of those are known.

    Of the 16-mers in each window of ``span`` bases the one with the least hash is taken, on ties the
    rightmost, so every window holds an anchor that depends on its bases alone.
    """
    w, flank = span - ANCHOR + 1, span - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole):
                codes, start, _ = encode(batch.column("seq").to_pylist())
                n = len(codes) - span + 1
                if n <= 0:
                    continue
                short, _ = windows(codes, ANCHOR)
                bad = np.concatenate([np.zeros(1, np.int64), np.cumsum(codes == 4)])
                clean = bad[span:] == bad[:-span]
                # the greatest key has the least hash and, on ties, the rightmost place
                hashed = ~mix(short) >> np.uint64(32)
                best, done = (hashed << np.uint64(31)) | np.arange(len(short), dtype=np.uint64), 1
                while done * 2 <= w:
                    best = np.maximum(best[: len(best) - done], best[done:])
                    done *= 2
                best = np.maximum(best[:n], best[w - done : w - done + n])
                pos = np.unique((best[clean] & np.uint64((1 << 31) - 1)).astype(np.int64))
                if not len(pos):
                    continue
                row = np.searchsorted(start, pos, "right") - 1
                ends = np.flatnonzero(codes == 4)
                right = np.minimum(ends[np.searchsorted(ends, pos)] - pos - ANCHOR, flank)
                left = np.minimum(pos - np.concatenate([[-1], ends])[np.searchsorted(ends, pos)] - 1, flank)
                # what lies around the anchor, four bases to a byte
                pad = np.concatenate([np.zeros(flank, np.uint8), codes & 3, np.zeros(flank + 4, np.uint8)])
                four = windows(pad, 4)[0].astype(np.uint8)
                size = -(-flank // 4)
                step = 4 * np.arange(size)
                around = np.concatenate([four[pos[:, None] + step], four[(pos + flank + ANCHOR)[:, None] + step]], axis=1)
                cells = [short[pos].astype(np.uint32).view(np.int32), batch.column("rep").to_numpy()[row], pos - start[row], left, right]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cells, ANCHORS)), _binary(around)], schema=ANCHORS)

    return run


def _binary(cells: np.ndarray) -> pa.Array:
    n, width = cells.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(cells).tobytes())])


def _cells(column: pa.Array, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(column), 0), np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), width)


def _extended(span: int, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All spans that hold the anchor: (row, bases left of the anchor, the span as 64-bit integers)."""
    flank = span - ANCHOR
    size = around.shape[1] // 2
    two = lambda x: ((x[:, :, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).reshape(len(x), -1)[:, :flank]
    middle = (anchor.view(np.uint32)[:, None] >> np.arange(30, -1, -2, dtype=np.uint32)) & 3
    bases = np.concatenate([two(around[:, :size]), middle.astype(np.uint8), two(around[:, size:])], axis=1).astype(np.uint64)
    length = min(span, WORD)
    # doubling: the integer of 2m bases is that of m bases beside that of the m next
    built, done = {1: bases}, 1
    while done * 2 <= length:
        x = built[done]
        built[done * 2] = (x[:, : x.shape[1] - done] << np.uint64(2 * done)) | x[:, done:]
        done *= 2
    word, at = built[done], done
    while at < length:
        step = 1 << ((length - at).bit_length() - 1)
        part = built[step][:, at:]
        m = min(word.shape[1], part.shape[1])
        word, at = (word[:, :m] << np.uint64(2 * step)) | part[:, :m], at + step
    rows, lefts = np.nonzero((left[:, None] >= np.arange(flank + 1)) & (right[:, None] >= flank - np.arange(flank + 1)))
    begin = flank - lefts
    offsets = [*range(0, span - length, WORD), span - length]
    return rows, lefts, [word[rows, begin + o] for o in offsets]


def _shared(rep: np.ndarray, row: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Which of the spans another record has too."""
    if not len(row):
        return np.zeros(0, np.int64)
    order = np.lexsort(words[::-1]) if len(words) > 1 else np.argsort(words[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[0] = True
    for w in words:
        s = w[order]
        new[1:] |= s[1:] != s[:-1]
    start = np.flatnonzero(new)
    r = rep[row[order]]
    other = np.minimum.reduceat(r, start) != np.maximum.reduceat(r, start)
    return order[np.repeat(other, np.diff(np.append(start, len(order))))]


def _starts(rep: np.ndarray, at: np.ndarray) -> pa.RecordBatch | None:
    """The starts of shared spans as runs of neighbours."""
    on = rep != EXTRA
    rep, at = rep[on], at[on]
    if not len(rep):
        return None
    order = np.lexsort((at, rep))
    rep, at = rep[order], at[order]
    first = np.flatnonzero(np.append(True, (rep[1:] != rep[:-1]) | (at[1:] > at[:-1] + 1)))
    last = np.append(first[1:], len(rep)) - 1
    cells = [pa.array(rep[first]), pa.array(at[first], pa.int32()), pa.array(at[last], pa.int32())]
    return pa.RecordBatch.from_arrays([*cells, *(pa.nulls(len(first), f.type) for f in list(FOUND)[3:])], schema=FOUND)


def _shared_in_groups(span: int, most: int):
    """Over rows sorted by anchor: the spans around each anchor that another record has too; groups of over ``most`` rows are handed on."""
    width = 2 * -(-(span - ANCHOR) // 4)
    piece = max(1, LAID // (2 * span))

    def work(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        anchor, rep = table.column("anchor").to_numpy(), table.column("rep").to_numpy()
        start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        count = np.diff(np.append(start, len(anchor)))
        many = np.minimum.reduceat(rep, start) != np.maximum.reduceat(rep, start)
        on = np.flatnonzero(np.repeat(many, count))
        if not len(on):
            return
        # whole groups, as many as may be laid out at a time
        ends = np.cumsum(count[many])
        cut = np.flatnonzero(np.append(True, ends[1:] // piece != ends[:-1] // piece))
        edges = [0, *ends[cut[1:] - 1].tolist(), int(ends[-1])]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            part = table.take(pa.array(on[a:b]))
            anchor, rep, pos, left, right = (part.column(i).to_numpy() for i in range(5))
            row, before, words = _extended(span, anchor, left, right, _cells(part.column(5), width))
            hit = _shared(rep, row, words)
            out = _starts(rep[row[hit]], pos[row[hit]] - before[hit])
            if out is not None:
                yield out

    def later(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = {f.name: batch.column(f.name) if f.name in batch.schema.names else None for f in FOUND}
        cells["start"] = batch.column("pos")
        return pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, f.type) if cells[f.name] is None else cells[f.name] for f in FOUND], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, passed = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            if passed is not None:
                end = int(np.searchsorted(anchor, passed, "right"))
                if end:
                    yield later(batch.slice(0, end))
                if end == batch.num_rows:
                    continue
                batch, anchor, passed = batch.slice(end), anchor[end:], None
            last = int(np.searchsorted(anchor, anchor[-1]))
            if held and held[0].column("anchor")[0].as_py() == int(anchor[0]) and not last:
                held.append(batch)
                n += batch.num_rows
            else:
                # the group held may go on in this batch, all of it but the last group is complete
                whole = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()
                for x in whole:
                    yield from work(x)
                held, n = [batch.slice(last)], batch.num_rows - last
            if n > most:
                passed = int(anchor[-1])
                for x in held:
                    yield later(x)
                held, n = [], 0
        if held:
            for x in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield from work(x)

    return run


def _spans(span: int):
    """Every span around anchors as bytes, with its record and place."""
    width = 2 * -(-(span - ANCHOR) // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, LAID // (2 * span))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                rep, pos = batch.column("rep").to_numpy(), batch.column("pos").to_numpy()
                row, before, words = _extended(span, batch.column("anchor").to_numpy(), batch.column("left").to_numpy(), batch.column("right").to_numpy(), _cells(batch.column("around"), width))
                cells = np.stack(words, axis=1).view(np.uint8).reshape(len(row), -1) if len(row) else np.zeros((0, 8), np.uint8)
                yield pa.RecordBatch.from_arrays([_binary(cells), pa.array(rep[row]), pa.array((pos[row] - before).astype(np.int32))], names=["span", "rep", "at"])

    return run


def _merged(span: int):
    """Over rows sorted by record: the maximal stretches that its shared spans cover, as (rep, begin, bases)."""

    def work(rep: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((start, rep))
        rep, start, end = rep[order], start[order].astype(np.int64), stop[order].astype(np.int64) + span
        who = np.cumsum(np.append(False, rep[1:] != rep[:-1])).astype(np.int64)
        # the furthest end so far in the same record
        upto = np.maximum.accumulate(end + (who << 32)) - (who << 32)
        first = np.append(True, (who[1:] != who[:-1]) | (start[1:] > upto[:-1]))
        ix = np.flatnonzero(first)
        last = np.append(ix[1:], len(rep)) - 1
        return pa.RecordBatch.from_arrays([pa.array(rep[ix]), pa.array(start[ix]), pa.array(upto[last] - start[ix])], names=["rep", "begin", "bases"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                now = [np.concatenate(z) for z in zip(held, now)]
            last = int(np.searchsorted(now[0], now[0][-1]))
            # a record that fills more than a batch is held as its stretches
            out = work(*[x[last:] for x in now])
            held = [out.column(0).to_numpy(), out.column(1).to_numpy(), out.column(1).to_numpy() + out.column(2).to_numpy() - span]
            if last:
                yield work(*[x[:last] for x in now])
        if held is not None:
            yield work(*held)

    return run


def shared_stretches(texts: DataFrame, extra: DataFrame | None = None, span: int = SPAN, hot_rows: int = HOT_ROWS, probe_rows: int = PROBE_ROWS) -> DataFrame:
    """``(rep, begin, bases)``: the maximal shared stretches of each record of ``texts`` (rep, seq); ``begin`` counts from 0.

    A base is shared if it lies in a span of ``span`` (16 or more) bases A, C, G, T that also occurs
    in another record or in a row of ``extra`` (seq). ``texts`` holds different texts only
    and should be materialized; ``extra`` may repeat texts and hold nulls.

    Method: seed and extend. Records meet on winnowed 16-mers, of which every window of ``span`` bases
    holds one. Around each anchor that two records have, the matches are extended to all
    spans that hold it, compared base by base as integers, and the spans that another
    record has too are merged into maximal stretches per record. No pairs of records are
    listed: a span is shared if the least and the greatest record under it differ. Anchors
    with more than ``hot_rows`` rows are compared span by span with counts combined before the shuffle: those
    that a bounded sample tells from the start, any other when its task has seen so many rows of it.
    """
    if span < ANCHOR:
        raise ValueError(f"spans have at least {ANCHOR} bases")
    rows = texts.select("rep", "seq")
    if extra is not None:
        # extra texts need not be told apart: what counts is that they are not the record itself
        named = extra.where("seq IS NOT NULL").select(F.lit(EXTRA).alias("rep"), "seq").distinct()
        rows = rows.unionByName(named)
    anchors = rows.mapInArrow(_anchors(span), ANCHOR_SQL)
    part = min(1.0, probe_rows / max(texts.count(), 1))
    probe = texts.where(F.rand(5) < part).select("rep", "seq").mapInArrow(_anchors(span), ANCHOR_SQL).groupBy("anchor").count()
    # at most as many as the sample has rows by PROBE_LEAST
    hot = materialize(probe.where(F.col("count") > max(part * hot_rows, min(PROBE_LEAST, hot_rows))).select("anchor"), "hot-anchors")
    some = hot.count()
    near = broadcast_if_small(hot, 16, some)
    cold = anchors.join(near, "anchor", "left_anti") if some else anchors
    found = materialize(cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shared_in_groups(span, hot_rows), FOUND_SQL), "shared-starts")
    starts = found.where("anchor IS NULL").select("rep", "start", "stop")
    left = found.where("anchor IS NOT NULL").select("anchor", "rep", F.col("start").alias("pos"), "left", "right", "around")
    if some:
        left = left.unionByName(anchors.join(near, "anchor", "left_semi").select(left.columns))
    if some or left.limit(1).count():
        spans = left.mapInArrow(_spans(span), "span binary, rep long, at int")
        shared = materialize(spans.groupBy("span").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("span"), "hot-spans")
        again = spans.join(broadcast_if_small(shared, 80 + span // 4), "span", "left_semi").where(F.col("rep") != EXTRA)
        starts = starts.unionByName(again.select("rep", F.col("at").alias("start"), F.col("at").alias("stop")))
    return starts.repartition("rep").sortWithinPartitions("rep").mapInArrow(_merged(span), "rep long, begin long, bases long")


def shared_spans(texts: DataFrame, extra: DataFrame | None = None, **how) -> DataFrame:
    """``(rep, bases, shared, stretches)`` for each record of ``texts`` (rep, seq) with a shared span.

    ``bases`` is the length of the record, ``shared`` the bases in its shared stretches, ``stretches`` their number;
    see ``shared_stretches`` for these and for ``how``.
    """
    cover = shared_stretches(texts, extra, **how).groupBy("rep").agg(F.sum("bases").alias("shared"), F.count(F.lit(1)).alias("stretches"))
    return cover.join(texts.select("rep", F.length("seq").alias("bases")), "rep").select("rep", "bases", "shared", "stretches")


def shared_by_record(df: DataFrame, key: str, text: Column, extra: DataFrame | None = None, least_share: float = 0.0, **how) -> DataFrame:
    """``(key, bases, shared, stretches)`` per record with shared bases; see ``shared_spans``.

    Records with equal texts are one record: a text is not shared with its own copies. Rows with
    a null key or text are left out, records without shared bases have no row, and of a key
    with several rows and one text one row comes out; a key with several texts has a row for each that
    shares. ``least_share`` keeps records of which
    at least this share of all bases is shared. Empty tables give no rows.
    """
    texts = classes(df.where(F.col(key).isNotNull()), text)
    found = materialize(shared_spans(texts, extra, **how).where(F.col("shared") >= F.lit(least_share) * F.col("bases")), "shared")
    return members(df, key, text, texts, found.select("rep")).join(found, "rep").select("key", "bases", "shared", "stretches")


def stretches_by_record(df: DataFrame, key: str, text: Column, extra: DataFrame | None = None, **how) -> DataFrame:
    """``(key, begin, bases)``: the maximal shared stretches of every record, by key; rows as in ``shared_by_record``."""
    texts = classes(df.where(F.col(key).isNotNull()), text)
    found = materialize(shared_stretches(texts, extra, **how), "stretches")
    return members(df, key, text, texts, found.select("rep").distinct()).join(found, "rep").select("key", "begin", "bases")
