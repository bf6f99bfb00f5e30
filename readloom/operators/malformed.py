"""Records that cannot become reads, told apart by a minimum-cost error parse."""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = 4
MAX_QUALITY = 41

START, BARE, QUOTED, CLOSED = range(4)  # states within a field
_ENDS = (START, BARE, CLOSED)
_TOKEN = re.compile(r'"|,|[\r\n]+|[^",\r\n]+')
# the same, cut where bases begin and end, so that a delimiter can be set there
_TYPED_TOKEN = re.compile(r'"|,|[\r\n]+|[ACGTNacgtn]+|[^",\r\nACGTNacgtn]+')
_LINE_TOKEN = re.compile(r"\r?\n|@|\+|[ACGTNacgtn]+|(?:(?!\r?\n)[^@+ACGTNacgtn])+")
_LAST_END = re.compile(r"\r?\n\Z")
MARKED = 3  # the phase of a name line that so far is its mark alone
_LINE_END = re.compile(r"\r?\n")
_BASES = re.compile(r"[ACGTNacgtn]+")


def _kind(token: str) -> str:
    return token if token in '",' else "line" if token[0] in "\r\n" else "text"


#: (state, kind of token) -> state; what is missing costs an edit.
_LEGAL = {
    (START, '"'): QUOTED, (START, ","): START, (START, "text"): BARE,
    (BARE, ","): START, (BARE, "text"): BARE,
    (QUOTED, '"'): CLOSED, (QUOTED, ","): QUOTED, (QUOTED, "text"): QUOTED, (QUOTED, "line"): QUOTED,
    (CLOSED, '"'): QUOTED, (CLOSED, ","): START,
}
_EDITABLE = {'"': "quote", ",": "delimiter"}


def parse_free(payload: str) -> list[str] | None:
    """The fields of the parse that costs nothing, or None if every parse needs an edit.

    This is the layer of cost 0 of the dynamic program: it holds one state at each place.
    """
    state, fields, field = START, [], []
    for token in _TOKEN.findall(payload):
        kind = _kind(token)
        after = _LEGAL.get((state, kind))
        if after is None:
            return None
        if kind == "," and state != QUOTED:
            fields.append("".join(field))
            field = []
        elif kind != '"' or state == CLOSED:
            field.append(token)
        state = after
    if state not in _ENDS:
        return None
    fields.append("".join(field))
    return fields


#: What a field may hold, by its place: name, sequence, comment, quality. Phases of a field: nothing yet, fit so far, unfit.
NAME, SEQUENCE, COMMENT, QUALITY = range(FIELDS)
EMPTY, FIT, UNFIT = range(3)
_EDIT = 8  # an edit weighs more than all unfit fields


def _fits(text: str, field: int, offset: int | None) -> bool:
    if field == SEQUENCE:
        return bool(_BASES.fullmatch(text))
    if field == QUALITY:
        return offset is not None and ord(min(text)) >= offset and ord(max(text)) <= offset + MAX_QUALITY
    return True


def _unfit(field: int, phase: int) -> int:
    """1 if a field that ends in this phase cannot be loaded."""
    return int(phase == UNFIT or phase == EMPTY and field != COMMENT)


def least_edits(payload: str, fields: int | None = None, offset: int | None = 33) -> tuple[int, list[str]]:
    """Cost and operations of the cheapest edit of quotes and delimiters after which the payload parses.

    Dynamic programming over (place, state[, fields begun, phase]): a token is read at no cost where
    the grammar allows it, a quote or delimiter is inserted or deleted at the cost of 1. With
    ``fields`` the parse must also have that many, and of equally cheap edits the one that leaves the fewest
    fields that do not fit their type (a name, bases, anything, qualities of ``offset``) is told.
    An operation reads "insert quote at 17". Time is linear in the number of tokens.
    """

    def read(s: tuple, kind: str, token: str) -> tuple[tuple, int] | None:
        """The state after a token and the unfit fields that it ends."""
        state, n, phase = s
        after = _LEGAL.get((state, kind))
        if after is None or not fields:
            return None if after is None else ((after, n, phase), 0)
        if kind == "," and state != QUOTED:
            return None if n == fields else ((after, n + 1, EMPTY), _unfit(n - 1, phase))
        if kind == '"' and state != CLOSED:  # a quote that opens or closes
            return (after, n, phase), 0
        return (after, n, UNFIT if phase == UNFIT or not _fits(token, n - 1, offset) else FIT), 0

    best: dict[tuple, int] = {(START, 1, EMPTY): 0}
    trail: list[dict[tuple, tuple[tuple, str, bool]]] = []
    at = 0
    pattern = _TYPED_TOKEN if fields else _TOKEN
    for token in [*pattern.findall(payload), ""]:
        # insertions before the token; two in a row (an empty quoted field) may pay, so relax until nothing changes
        back: dict[tuple, tuple[tuple, str, bool]] = {}
        todo = deque(sorted(best, key=best.get))
        while todo:
            s = todo.popleft()
            for mark, name in _EDITABLE.items():
                got = read(s, mark, mark)
                if got and best.get(got[0], 1 << 60) > best[s] + _EDIT + got[1]:
                    best[got[0]] = best[s] + _EDIT + got[1]
                    back[got[0]] = (s, f"insert {name} at {at}", True)
                    todo.append(got[0])
        trail.append(back)
        if token == "":
            break
        kind = _kind(token)
        new: dict[tuple, int] = {}
        moved: dict[tuple, tuple[tuple, str, bool]] = {}
        for s, cost in best.items():
            got = read(s, kind, token)
            if got and cost + got[1] < new.get(got[0], 1 << 60):
                new[got[0]] = cost + got[1]
                moved[got[0]] = (s, "", False)
            if kind in _EDITABLE and cost + _EDIT < new.get(s, 1 << 60):
                new[s] = cost + _EDIT
                moved[s] = (s, f"delete {_EDITABLE[kind]} at {at}", False)
        trail.append(moved)
        best = new
        at += len(token)
    ends = [(best[s] + (_unfit(s[1] - 1, s[2]) if fields else 0), s) for s in best if s[0] in _ENDS and (fields is None or s[1] == fields)]
    cost, state = min(ends)
    return cost // _EDIT, _told(trail, state)


def _told(trail: list[dict], state: tuple) -> list[str]:
    """The operations that lead to a state; even steps of the trail are insertions, of which several may follow each other."""
    ops: list[str] = []
    for level in reversed(range(len(trail))):
        while state in trail[level]:
            state, op, again = trail[level][state]
            if op:
                ops.append(op)
            if not again:
                break
    return ops[::-1]


def least_line_edits(payload: str, offset: int | None = 33) -> tuple[int, list[str]]:
    """Cost and operations of the cheapest insertion or deletion of line ends after which the payload has four lines.

    The same program over (place, line, phase): of equally cheap edits the one that leaves the fewest lines that are not
    what their place asks for: ``@`` and a name, bases, ``+``, qualities. A last line end is optional and no line of its own.
    """

    def phase_of(field: int, phase: int, token: str) -> int:
        if phase == EMPTY and field in (NAME, COMMENT):
            # the mark alone is no name, but a comment
            return UNFIT if token[0] != "@+"[field // 2] else MARKED if field == NAME and len(token) == 1 else FIT
        return UNFIT if phase == UNFIT or not _fits(token, field, offset) else FIT

    def unfit(field: int, phase: int) -> int:
        return int(phase != FIT)

    body = payload[: -len(end[0])] if (end := _LAST_END.search(payload)) else payload
    best: dict[tuple, int] = {(NAME, EMPTY): 0}
    trail: list[dict[tuple, tuple[tuple, str, bool]]] = []
    at = 0
    for token in [*_LINE_TOKEN.findall(body), ""]:
        back: dict[tuple, tuple[tuple, str, bool]] = {}
        # from the first line to the last, so that one pass finds several insertions in a row
        for s in sorted(best):
            todo = s
            while todo[0] < QUALITY and best[todo] + _EDIT + unfit(*todo) < best.get((todo[0] + 1, EMPTY), 1 << 60):
                after = (todo[0] + 1, EMPTY)
                best[after] = best[todo] + _EDIT + unfit(*todo)
                back[after] = (todo, f"insert line end at {at}", True)
                todo = after
        trail.append(back)
        if token == "":
            break
        new: dict[tuple, int] = {}
        moved: dict[tuple, tuple[tuple, str, bool]] = {}

        def put(after: tuple, cost: int, of: tuple, op: str) -> None:
            if cost < new.get(after, 1 << 60):
                new[after] = cost
                moved[after] = (of, op, False)

        for s, cost in best.items():
            if token[-1] == "\n":
                if s[0] < QUALITY:
                    put((s[0] + 1, EMPTY), cost + unfit(*s), s, "")
                put(s, cost + _EDIT, s, f"delete line end at {at}")
            else:
                put((s[0], phase_of(*s, token)), cost, s, "")
        trail.append(moved)
        best = new
        at += len(token)
    cost, state = min((best[s] + unfit(*s), s) for s in best if s[0] == QUALITY)
    return cost // _EDIT, _told(trail, state)


def _fastq(payload: str, offset: int | None) -> tuple[str | None, int, list[str], list[str] | None]:
    lines = _LINE_END.split(payload)
    if len(lines) > 1 and lines[-1] == "":
        lines.pop()
    if len(lines) != FIELDS:
        return "field_count", *least_line_edits(payload, offset), None
    if len(lines[0]) < 2 or lines[0][0] != "@":
        return "name", 0, [], None
    if lines[2][:1] != "+":
        return "comment", 0, [], None
    return None, 0, [], [lines[0][1:], lines[1], lines[2][1:], lines[3]]


def _csv(payload: str, offset: int | None) -> tuple[str | None, int, list[str], list[str] | None]:
    fields = parse_free(payload)
    if fields is None:
        return "quoting", *least_edits(payload), None
    if len(fields) != FIELDS:
        return "field_count", *least_edits(payload, FIELDS, offset), None
    return ("name" if fields[0] == "" else None), 0, [], fields


def parse_record(payload: str | None, layout: str | None, offset: int | None) -> tuple[str | None, int, list[str], list[str] | None]:
    """(reason, cost, edits, fields) of one record; the reason is None for a record that loads."""
    if payload is None or not payload.strip():
        return "empty", 0, [], None
    if layout not in ("csv", "fastq"):
        return "layout", 0, [], None
    reason, cost, edits, fields = (_csv if layout == "csv" else _fastq)(payload, offset)
    if reason:
        return reason, cost, edits, None
    _, sequence, _, quality = fields
    if not _BASES.fullmatch(sequence):
        return "sequence", 0, [], None
    if len(quality) != len(sequence):
        return "length", 0, [], None
    if offset is None or ord(min(quality)) < offset or ord(max(quality)) > offset + MAX_QUALITY:
        return "quality", 0, [], None
    return None, 0, [], fields


_READ = pa.struct([(c, pa.string()) for c in ("name", "sequence", "comment", "quality")])
_OUT = pa.struct([("reason", pa.string()), ("cost", pa.int32()), ("edits", pa.list_(pa.string())), ("read", _READ)])
_OUT_SQL = "struct<reason: string, cost: int, edits: array<string>, read: struct<name: string, sequence: string, comment: string, quality: string>>"


def _parse(done: pa.Array, payload: pa.Array, layout: pa.Array, offset: pa.Array) -> pa.Array:
    """What ``parse_record`` says of the records that are not done."""
    done = done.to_numpy(zero_copy_only=False).astype(bool)
    todo = pa.array(np.flatnonzero(~done))
    out = []
    for record in zip(*(c.take(todo).to_pylist() for c in (payload, layout, offset))):
        reason, cost, edits, fields = parse_record(*record)
        out.append({"reason": reason, "cost": cost, "edits": edits, "read": None if reason else dict(zip(("name", "sequence", "comment", "quality"), fields))})
    return pa.array(out, _OUT).take(pa.array(np.cumsum(~done) - 1, mask=done))


def _plain_parts(payload: Column, layout: Column) -> Column:
    """The lines of a fastq record, or the fields of a csv record that has no quote and no line end; null otherwise."""
    return F.when(layout == "fastq", F.split(payload, r"\r?\n", -1)).when((layout == "csv") & ~payload.rlike("[\"\r\n]"), F.split(payload, ",", -1))


def _plain_read(parts: Column, layout: Column, offset: Column) -> Column:
    """The read of a record whose parts are right at no cost and have valid values; null for all others."""
    fastq = layout == "fastq"
    name, sequence, comment, quality, more = (F.get(parts, F.lit(i)) for i in range(FIELDS + 1))
    lines = ((F.size(parts) == FIELDS) | ((F.size(parts) == FIELDS + 1) & (more == ""))) & name.startswith("@") & (F.length(name) > 1) & comment.startswith("+")
    shape = F.when(fastq, lines).otherwise((F.size(parts) == FIELDS) & (name != ""))
    # fixed values: qualities 0..41 as characters from 33 or 64 on
    scale = F.when(offset == 33, quality.rlike(r"\A[!-J]*+\z")).when(offset == 64, quality.rlike(r"\A[@-i]*+\z")).otherwise(False)
    valid = shape & (F.length(sequence) == F.length(quality)) & sequence.rlike(r"\A[ACGTNacgtn]++\z") & scale
    bare = lambda x: F.when(fastq, F.substring(x, 2, 2**31 - 1)).otherwise(x)
    return F.when(valid, F.struct(bare(name).alias("name"), sequence.alias("sequence"), bare(comment).alias("comment"), quality.alias("quality")))


def parse_records(df: DataFrame, key: str, payload: str = "payload", layout: str = "layout", offset: str = "phred_offset") -> DataFrame:
    """``(key, reason, cost, edits, read)`` for every row: either ``reason`` or ``read`` is null.

    A record is parsed by dynamic programming that may insert or delete quotes, delimiters and, in fastq records,
    line ends at the cost of 1. Where a parse without edits has valid values, the record
    loads as ``read`` (name, sequence, comment, quality). Otherwise ``reason`` is the first of
    ``empty``, ``layout`` (neither csv nor fastq), ``quoting``, ``field_count``, ``name``,
    ``comment``, ``sequence``, ``length``, ``quality`` that applies, and for quoting and field
    counts ``cost`` and ``edits`` tell the cheapest repair and its places. A bare csv field holds no line break. A null payload is ``empty``, a null
    layout ``layout``, a null offset ``quality``. Nothing is trimmed. Rows come out one for
    one, repeated or not; an empty table gives none; other columns are not read. The step is
    narrow: no shuffle, one pass over the payloads. The layer of cost 0 is decided in the JVM for records without
    quotes; only the others are looked at token by token.
    """
    if key in ("reason", "cost", "edits", "read"):
        raise ValueError(f"the key cannot be named {key}")
    rows = df.select(F.col(key).alias("_key"), F.col(payload).cast("string").alias("_payload"), F.col(layout).cast("string").alias("_layout"), F.col(offset).cast("int").alias("_offset"))
    # one column after the other, each of which is worked out once
    rows = rows.withColumn("_parts", _plain_parts(F.col("_payload"), F.col("_layout")))
    rows = rows.withColumn("_plain", _plain_read(F.col("_parts"), F.col("_layout"), F.col("_offset")))
    done = F.col("_plain").isNotNull()
    # not pushed below filters on its result, which would parse once for the filter and once for the reads
    program = F.arrow_udf(_parse, _OUT_SQL).asNondeterministic()
    parsed = rows.withColumn("_parsed", program(done, F.when(~done, F.col("_payload")), F.when(~done, F.col("_layout")), F.when(~done, F.col("_offset"))))
    told = [F.when(done, F.lit(0)).otherwise(F.col("_parsed.cost")).alias("cost"), F.when(done, F.array().cast("array<string>")).otherwise(F.col("_parsed.edits")).alias("edits")]
    return parsed.select(F.col("_key").alias(key), F.col("_parsed.reason").alias("reason"), *told, F.coalesce("_plain", "_parsed.read").alias("read"))
