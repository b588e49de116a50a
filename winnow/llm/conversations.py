"""Repair of conversations by the cheapest edits, found by square-root checkpointed dynamic programming.

A sound conversation is ``(s?(ua)+)?`` by the initials of its roles.  The programme has
four states: nothing yet, after a system row, after a user row, after an assistant row.
A vector of costs to go belongs to each row; it follows from that of the next row, so
a walk back over m rows stores the vectors at every sqrt(m)-th only.  The walk forward
computes each block's vectors anew from the checkpoint behind it and takes, of the
edits that are tight, the one of the ASCII-least letter.

Rows travel without their texts: (turn, role, two hashes, faults), equal ones once with
their number.  They are dealt by ranges of (conversation, turn, role, hash), so a long
conversation lies in many partitions.  Only a partition's first and last conversation
can go on in another; what such a piece does to costs is a 4 x 4 matrix.  The driver
gets two pieces a partition, multiplies the matrices from the end (the vectors at the
pieces' ends are the outermost checkpoints), and hands back each piece's vector and
state.  At last texts and edits meet by conversation, sorted, and are read row by row
with one hash as the state, which is all that a conversation of any length needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import SPACE, col, shared

DELETE, INSERT, REROLE = 3, 2, 2
#: Costs to go after the last row, by state.
_END = (0, 4, 2, 0)
#: The state after an inserted row or a changed role, by state; 2 is after a user row, 3 after an assistant's.
_NEED = (2, 2, 3, 2)
#: The state after a kept row, by state and initial (s, u, a, other); -1 where it can't be kept.
_KEEP = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
_FAR = 1 << 60
_ROLE = {2: "user", 3: "assistant"}

Vector = tuple[int, int, int, int]


def before(code: int, after: Vector) -> Vector:
    """Costs to go before a row, insertions included; ``code`` is initial + 4 if it is truncated, -1 if it has to go."""
    if code < 0:
        return after
    cut, initial = code >> 2, code & 3
    w = []
    for s in range(4):
        least = min(DELETE + after[s], REROLE + cut + after[_NEED[s]])
        kept = _KEEP[s][initial]
        w.append(min(least, cut + after[kept]) if kept >= 0 else least)
    user, assistant = min(w[2], INSERT + w[3]), min(w[3], INSERT + w[2])
    return min(w[0], INSERT + user), min(w[1], INSERT + user), user, assistant


def matrix(codes: list[int]) -> list[Vector]:
    """By state at the end and state at the beginning: the least cost of a piece's edits."""
    out = []
    for end in range(4):
        v: Vector = tuple(0 if s == end else _FAR for s in range(4))
        for code in reversed(codes):
            v = before(code, v)
        out.append(v)
    return out


def times(m: list[Vector], after: Vector) -> Vector:
    """Costs to go at a piece's beginning, from those at its end."""
    return tuple(min(_FAR, min(m[end][s] + after[end] for end in range(4))) for s in range(4))


def walk(codes: list[int], after: Vector, state: int) -> tuple[list[str], int]:
    """Of each row the letters of its edits, insertions before it included, and the state at the end."""
    size = max(1, isqrt(len(codes)))
    marks, v = {}, after
    for i in range(len(codes) - 1, -1, -1):
        if (i + 1) % size == 0 or i == len(codes) - 1:
            marks[i // size] = v  # what comes after the block
        v = before(codes[i], v)
    edits = []
    for block in range(-(-len(codes) // size)):
        part = codes[block * size : (block + 1) * size]
        vectors = [marks.pop(block)]
        for code in reversed(part):
            vectors.append(before(code, vectors[-1]))
        vectors.reverse()
        for code, now, then in zip(part, vectors, vectors[1:], strict=False):
            done = ""
            while True:
                need = _NEED[state]
                if code < 0 or DELETE + then[state] == now[state]:
                    edits.append(done + "D")
                    break
                if INSERT + now[need] == now[state]:
                    done, state = done + "I", need
                    continue
                kept = _KEEP[state][code & 3]
                if kept >= 0 and (code >> 2) + then[kept] == now[state]:
                    edits.append(done + "K")
                    state = kept
                else:
                    edits.append(done + "R")
                    state = need
                break
    return edits, state


def _pieces(table: pa.Table) -> list[tuple[int, int]]:
    """First row and end of each conversation of a partition."""
    ends = pc.run_end_encode(table.column("_c").combine_chunks())
    ends = (ends.chunk(0) if isinstance(ends, pa.ChunkedArray) else ends).run_ends.to_pylist()
    return list(zip([0, *ends], ends, strict=False))


def _codes(table: pa.Table, a: int, b: int) -> list[int]:
    part = table.slice(a, b - a)
    return [-1 if gone else code for code, gone in zip(part.column("_code").to_pylist(), part.column("_gone").to_pylist(), strict=True)]


def _ends(batches: Iterator[pa.RecordBatch], tell) -> Iterator[pa.RecordBatch]:
    """What ``tell`` says of a partition's first and last piece: (partition, place, conversation, numbers)."""
    held = list(batches)
    table = pa.Table.from_batches(held) if held else None
    if table is not None and table.num_rows:
        p, pieces = table.column("_p")[0].as_py(), _pieces(table)
        for place, (a, b) in enumerate(dict.fromkeys((pieces[0], pieces[-1]))):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([place], pa.int32()), table.column("_c").slice(a, 1).combine_chunks(), pa.array([tell(p, place, _codes(table, a, b))], pa.list_(pa.int64()))], ["p", "place", "_c", "x"])


def _matrices(batches):
    return _ends(batches, lambda p, place, codes: [x for v in matrix(codes) for x in v])


def _moves(sent):
    return lambda batches: _ends(batches, lambda p, place, codes: [walk(codes, sent.value[p, place], s)[1] for s in range(4)])


def _edits(sent):
    """The rows with the letters of their edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held or not (table := pa.Table.from_batches(held)).num_rows:
            return
        p, pieces, edits = table.column("_p")[0].as_py(), _pieces(table), []
        copies = table.column("_n").to_pylist()
        for a, b in pieces:
            place = 0 if a == 0 else 1 if b == table.num_rows else 2
            after, state, last = sent.value.get((p, place), (_END, 0, True))
            codes = _codes(table, a, b)
            done, state = walk(codes, after, state)
            # further copies of a row have to go, and rows that have none weren't there
            done = [e + "D" * (n - 1) if n else "" for e, n in zip(done, copies[a:b], strict=True)]
            if last:
                done[-1] += "I" * (_END[state] // INSERT)
            edits += done
        at = 0
        for batch in held:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits[at : at + batch.num_rows], pa.string())], [*batch.schema.names, "_edits"])
            at += batch.num_rows

    return run


def _chained(rows: DataFrame, conv_type: str) -> dict:
    """By partition and place what a piece needs to be walked: vector behind it, state before it, whether it is its conversation's last."""
    kind = f"p int, place int, _c {conv_type}, x array<bigint>"
    context = rows.sparkSession.sparkContext
    found = sorted(rows.mapInArrow(_matrices, kind).collect(), key=lambda r: (r.p, r.place))  # two a partition at most
    chains = [list(g) for _, g in groupby(found, lambda r: r._c)]
    behind: dict[tuple[int, int], Vector] = {}
    for chain in chains:
        v: Vector = _END
        for r in reversed(chain):
            behind[r.p, r.place] = v
            v = times([tuple(r.x[i : i + 4]) for i in range(0, 16, 4)], v)
    moves = {}
    if any(len(c) > 1 for c in chains):
        moves = {(r.p, r.place): r.x for r in rows.mapInArrow(_moves(context.broadcast(behind)), kind).collect()}
    out = {}
    for chain in chains:
        state = 0
        for r in chain:
            key = r.p, r.place
            out[key] = behind[key], state, r is chain[-1]
            state = moves[key][state] if moves else 0
    return out


class _Report:
    """Counts, audit and hash of one conversation while its rows pass; ``emit`` gets each repaired row's role and text."""

    def __init__(self, emit=None):
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = self.state = 0
        self.low = self.high = self.initial = self.want = None
        self.audit: list[str] = []
        self.sha, self.first, self.rest, self.emit = hashlib.sha256(), True, "", emit

    def _line(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False
        if self.emit:
            self.emit(role, text)

    def _inserted(self, letters: str) -> None:
        for _ in range(letters.count("I")):
            self.state = _NEED[self.state]
            self._line(_ROLE[self.state], "")

    def row(self, turn, role: str, code: int, blank: bool, gone: bool, n: int, edits: str) -> None:
        self.audit.append(edits)
        initial, cut = role[:1], code >> 2
        if n:
            self._counted(turn, initial, cut, blank, gone, n)
        self.cost += DELETE * edits.count("D") + INSERT * edits.count("I") + REROLE * edits.count("R") + cut * (edits.count("K") + edits.count("R"))
        at = max(edits.find("K"), edits.find("R"))
        if at < 0:
            self._inserted(edits)
            return
        self._inserted(edits[:at])
        self.rest = edits[at + 1 :]
        need, kept = _NEED[self.state], _KEEP[self.state]["sua".find(initial) if initial in ("s", "u", "a") else 3]
        self.want, self.state = (role, kept) if edits[at] == "K" else (_ROLE[need], need)

    def _counted(self, turn, initial: str, cut: int, blank: bool, gone: bool, n: int) -> None:
        if blank:
            self.blank += n
        else:
            self.duplicate += n if gone else n - 1
            self.truncated += int(bool(cut) and not gone)
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += n - 1
        self.initial = initial
        if turn is not None and turn != self.high:  # turns come sorted
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1

    def text(self, text: str) -> None:
        """The text of the row just told; those of its copies and of deleted rows aren't wanted."""
        if self.want is not None:
            self._line(self.want, text)
            self.want = None
            self._inserted(self.rest)

    def columns(self) -> list:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()]


def _conversations(batches: Iterator[pa.RecordBatch], emit=None) -> Iterator[tuple[object, _Report] | None]:
    """Each conversation and its report when its last row has passed, and None after each batch."""
    report, conv = None, None
    for batch in batches:
        for c, turn, role, kind, code, blank, gone, n, edits, text in zip(*(batch.column(k).to_pylist() for k in ("_c", "_t", "_r", "_kind", "_code", "_blank", "_gone", "_n", "_edits", "_x")), strict=True):
            if report is None or c != conv:
                if report is not None:
                    yield conv, report
                report, conv = _Report(emit and (lambda role, text, c=c: emit(c, role, text))), c
            if kind:
                report.text(text)
            else:
                report.row(turn, role, code, blank, gone, n, edits)
        yield None
    if report is not None:
        yield conv, report


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _batch(rows: list[list], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _reports(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for done in _conversations(batches):
            if done is not None:
                rows.append([done[0], *done[1].columns()])
            elif rows:
                yield _batch(rows, names, types)
                rows = []
        if rows:
            yield _batch(rows, names, types)

    names, types = ["_c", *_NUMBERS, "audit", "repaired_sha256"], [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return run


def _messages(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        now: list = [None, 0]  # conversation and its rows so far

        def emit(conv, role: str, text: str) -> None:
            if now[0] != conv:
                now[:] = conv, 0
            rows.append([conv, now[1], role, text])
            now[1] += 1

        for done in _conversations(batches, emit):
            if done is None and rows:
                yield _batch(rows, names, types)
                rows.clear()
        if rows:
            yield _batch(rows, names, types)

    names, types = ["_c", "place", "role", "text"], [kind, pa.int64(), pa.string(), pa.string()]
    return run


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of a test: by crc32 of ``conv:turn`` modulo 20 a row goes (0), loses its text (1) or its stops (2), comes twice (3) or becomes a user's (4).

    Nulls count as one space, but for turns, which stay null; ``copies`` says how often a row comes.
    """
    part = lambda name: F.coalesce(col(name).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(part(conv_col), F.lit(":"), part(turn_col))) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(part(text_col), "[.!?]", "")).otherwise(part(text_col))
    role = F.when(k == 4, "user").otherwise(part(role_col))
    return rows.select(col(conv_col).alias(conv_col), col(turn_col).alias(turn_col), role.alias(role_col), text.alias(text_col), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def _ordered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None) -> tuple[DataFrame, str]:
    """Edits and texts of each conversation, sorted within its partition."""
    part = lambda name: F.coalesce(col(name).cast("string"), F.lit(" "))
    n = F.lit(1) if copies_col is None else F.coalesce(col(copies_col), F.lit(0))
    base = rows.select(col(conv_col).alias("_c"), col(turn_col).cast("long").alias("_t"), part(role_col).alias("_r"), part(text_col).alias("_x"), n.cast("long").alias("_n"))
    base = base.withColumns({"_h": F.xxhash64("_c", "_r", "_x"), "_g": F.xxhash64(F.lit(1), "_x", "_r", "_c")})
    solid = F.rtrim("_x", F.lit(SPACE))
    initial = F.substring("_r", 1, 1)
    cut = (~F.right(solid, F.lit(1)).isin(".", "!", "?")).cast("int")
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + 4 * cut
    keys = ["_c", "_t", "_r", "_h", "_g"]
    slim = base.select(*keys, code.alias("_code"), (solid == "").alias("_blank"), "_n").groupBy(*keys, "_code", "_blank").agg(F.sum("_n").alias("_n"))
    place = F.struct(F.col("_t").isNotNull(), F.col("_t"))
    first = slim.filter("_n > 0 AND NOT _blank").groupBy("_h", "_g").agg(F.min(place).alias("_first"), F.count("*").alias("_rows")).filter("_rows > 1")
    # joined under another name than it was grouped by, so that adaptive execution can split a common key
    first = first.select(F.bitwise_not("_h").alias("_k"), F.col("_g").alias("_l"), "_first")
    slim = slim.withColumns({"_k": F.bitwise_not("_h"), "_l": F.col("_g")}).join(first, ["_k", "_l"], "left")
    gone = F.col("_blank") | F.coalesce(place > F.col("_first"), F.lit(False)) | (F.col("_n") == 0)
    slim = slim.select(*keys, "_code", "_blank", "_n", gone.alias("_gone"))
    slim = shared(slim.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()))
    conv_type = rows.schema[conv_col].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(_chained(slim, conv_type))
    edits = slim.mapInArrow(_edits(sent), StructType([*slim.schema.fields, StructField("_edits", StringType())]))
    edits = edits.drop("_p").withColumns({"_kind": F.lit(0), "_x": F.lit(None).cast("string")})
    none = {"_code": "int", "_blank": "boolean", "_gone": "boolean", "_edits": "string"}
    texts = base.filter((F.col("_n") > 0) & (solid != "")).withColumns({"_kind": F.lit(1), **{k: F.lit(None).cast(t) for k, t in none.items()}})
    return edits.unionByName(texts).repartition("_c").sortWithinPartitions(*keys, "_kind"), conv_type


def repair_report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """Faults, cost, edits and the hash of the repaired rows of each conversation.

    Result: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).
    Rows of a conversation are taken by turn, nulls first; those that share a turn by
    role, then by hash of role and text.  A row's first fault counts: blank (no
    character but white space), duplicate (role and text seen earlier), truncated (its
    last other character is none of ``.!?``).  Keeping costs 0, a change of role to user
    or assistant 2, deleting 3, inserting an empty user or assistant row 2; blank and
    duplicate rows have to go, a truncated one that stays costs 1 more.

    Defined cases: a null role or text counts as one space, a null conversation is one
    of its own; repeated rows are duplicates; a role without a first letter of s, u or a
    can't be kept; with ``copies_col``, a row comes that often (null: never), and a
    conversation all of whose rows come never has zeros, no edits and the hash of the
    empty text; turns are read as whole numbers; empty tables give no rows; other columns
    aren't read.  Texts are told apart by 128 bits of hashes.
    """
    ordered, kind = _ordered(rows, conv_col, turn_col, role_col, text_col, copies_col)
    arrow = rows.select(col(conv_col).alias("_c")).limit(0).toArrow().schema.field(0).type
    numbers = ", ".join(f"{x} long" for x in _NUMBERS)
    return ordered.mapInArrow(_reports(arrow), f"_c {kind}, {numbers}, audit string, repaired_sha256 string").withColumnRenamed("_c", conv_col)


def repaired_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """The repaired conversations: (conv, place from 0, role, text); cases as for ``repair_report``."""
    ordered, kind = _ordered(rows, conv_col, turn_col, role_col, text_col, copies_col)
    arrow = rows.select(col(conv_col).alias("_c")).limit(0).toArrow().schema.field(0).type
    return ordered.mapInArrow(_messages(arrow), f"_c {kind}, place long, role string, text string").withColumnRenamed("_c", conv_col)
