"""Operator 13: conversation structure repair by a dynamic program over a shared grammar.

The rows of a conversation become symbols: the role's initial with a mark for a truncated text, or one symbol for rows
that must go (blank or repeated).  Role states are 0 (nothing yet), 1 (system), 2 (user), 3 (assistant); each symbol
has a min-plus matrix whose entry (p, q) is the cheapest way to pass it from state p to q, with the edits as an audit
rope.  The sequences of many conversations are compressed by one Re-Pair grammar; each rule's matrix is the product of
its two parts, computed once and shared by all conversations that contain it.  A conversation's row vector times its
symbols' matrices is its repair.  Ties go to the least audit: two audits of equal cost over the same rows differ at a
place inside both, so the order of parts is the order of wholes and the products stay exact.

Partitions hold ranges of the order (conversation, turn, role, text digest), so that a huge conversation is spread over
many.  A conversation inside one range is finished there.  The first and the last one of each range, and one larger
than a block, leave a piece (counts and its whole matrix); pieces are multiplied in order, and their texts are then
streamed once more, in order, with the audit in front, to hash the repair.  That last pass is one task for each such
conversation because a SHA-256 can't be made from parts; it holds no more than a batch.

Repeated rows are counted before they are shuffled: of rows with one conversation, turn, role and text one travels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import claim_worker, materialize
from touchline.llm.grammar import Entry, Matrix, better, flat, product, repair, rule_matrices

#: Costs of edits.  Keep costs nothing; truncated rows that stay add LAME.
REROLE, DELETE, INSERT, LAME = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
#: The state after a user or assistant row that is put or re-roled at a state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row of an initial leads, by state.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INITIALS = "sua"
#: Symbols: twice the number of the initial (3: any other one), one more if truncated; GONE for rows that must go.
GONE = 8
#: Symbols and text bytes that a task holds at once.
BLOCK_SYMBOLS, BLOCK_BYTES = 20_000, 8 << 20

_BLANK = " \t\n\x0b\x0c\r"


def _base_matrices() -> dict[int, Matrix]:
    out = {}
    for symbol in range(GONE + 1):
        lame = LAME if symbol < GONE and symbol % 2 else 0
        keeps = KEEP.get(INITIALS[symbol // 2 : symbol // 2 + 1], {}) if symbol < GONE else {}
        matrix: Matrix = [[None] * 4 for _ in range(4)]
        for p in range(4):
            m, paid, audit = p, 0, ""
            for _ in range(3):  # more than two insertions lead back to where one leads
                ways = [(m, DELETE, "D")]
                if symbol < GONE:
                    ways += [(NEXT[m], REROLE + lame, "R")] + ([(keeps[m], lame, "K")] if m in keeps else [])
                for q, cost, edit in ways:
                    matrix[p][q] = better(matrix[p][q], (paid + cost, audit + edit))
                m, paid, audit = NEXT[m], paid + INSERT, audit + "I"
        out[symbol] = matrix
    return out


BASE = _base_matrices()
IDENTITY: Matrix = [[(0, "") if p == q else None for q in range(4)] for p in range(4)]
FROM_START: Matrix = [IDENTITY[START]]


def finished(row: list[Entry]) -> tuple[int, str]:
    """Cost and audit of the cheapest way to an accepted state; rows may be inserted at the end."""
    best: Entry = None
    for p, entry in enumerate(row):
        if entry is None:
            continue
        m, paid, audit = p, 0, ""
        for _ in range(3):
            if m in ACCEPTED:
                best = better(best, (entry[0] + paid, (entry[1], audit)))
            m, paid, audit = NEXT[m], paid + INSERT, audit + "I"
    return best[0], flat(best[1])


def solve(sequences: list[list[int]], whole: list[bool]) -> list[Matrix]:
    """Each sequence's matrix, or only its row of the start state where ``whole`` is false; equal sequences are solved once."""
    distinct = {tuple(s): None for s in sequences}
    packed, rules = repair([list(s) for s in distinct], GONE + 1)
    matrices = rule_matrices(rules, BASE, GONE + 1)
    code = dict(zip(distinct, packed, strict=True))
    done: dict[tuple, Matrix] = {}
    out = []
    for s, w in zip(sequences, whole, strict=True):
        key = (tuple(s), w)
        if key not in done:
            made = IDENTITY if w else FROM_START
            for symbol in code[key[0]]:
                made = product(made, matrices[symbol])
            done[key] = made
        out.append(done[key])
    return out


class _Lines:
    """The lines ``role:text`` of a repair, for rows that come one by one."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[str]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state, self.at = NEXT[self.state], self.at + 1
            yield f"{ROLE[self.state]}:"

    def of(self, role: str, text: str, copies: int) -> Iterator[str]:
        for _ in range(copies):
            yield from self.inserted()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit == "K":
                self.state = KEEP[role[0]][self.state]
                yield f"{role}:{text}"
            elif edit == "R":
                self.state = NEXT[self.state]
                yield f"{ROLE[self.state]}:{text}"


def repaired(rows: Iterable[tuple[str, str, int]], audit: str) -> Iterator[str]:
    """Lines after the edits; rows are (role, text, copies)."""
    lines = _Lines(audit)
    for row in rows:
        yield from lines.of(*row)
    yield from lines.inserted()


class _Digest:
    """SHA-256 of lines joined by newlines."""

    def __init__(self) -> None:
        self.hash, self.any = hashlib.sha256(), False

    def add(self, line: str) -> None:
        self.hash.update((("\n" if self.any else "") + line).encode())
        self.any = True


def digest(lines: Iterable[str]) -> str:
    out = _Digest()
    for line in lines:
        out.add(line)
    return out.hash.hexdigest()


COUNTS = ["blank", "duplicate", "truncated", "illegal"]


class _Piece:
    """What is known of a stretch of one conversation's rows, in order."""

    def __init__(self, conv: object) -> None:
        self.conv, self.count, self.symbols, self.rows, self.bytes = conv, dict.fromkeys(COUNTS, 0), [], [], 0
        self.first = self.last = None  # numbers of the outer rows' initials
        self.low = self.high = None  # outer turns; rows are in order
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fresh: bool, blank: bool, initial: int, cut: bool) -> None:
        if not copies:  # such a row only names its conversation
            return
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if blank:
            self.count["blank"] += copies
        else:
            self.count["duplicate"] += copies - fresh
            self.count["truncated"] += fresh and cut
        stays = fresh and not blank
        self.symbols += [2 * initial + cut if stays else GONE] + [GONE] * (copies - 1)
        self.count["illegal"] += (self.last is not None and not legal(self.last, initial)) + copies - 1
        self.first, self.last = initial if self.first is None else self.first, initial
        self.rows.append((role, text if stays else "", copies))
        self.bytes += len(text) if stays else 0

    def joined(self, other: _Piece) -> None:
        """Take in the counts of the stretch that follows."""
        for c in COUNTS:
            self.count[c] += other.count[c]
        if other.first is not None:
            self.count["illegal"] += self.last is not None and not legal(self.last, other.first)
            self.first, self.last = other.first if self.first is None else self.first, other.last
        if other.low is not None:
            self.turns += other.turns - (self.high == other.low)
            self.low, self.high = other.low if self.low is None else self.low, other.high

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def legal(a: int, b: int) -> bool:
    """Whether a row of initial b may follow one of initial a: su, ua, au."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _rows(rows: DataFrame, copies: Column | None, conv: str, turn: str, role: str, text: str) -> DataFrame:
    said = rows.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        (F.lit(1) if copies is None else copies).cast("long").alias("copies"),
    )
    return said.withColumn("name", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))


def _counted(said: DataFrame) -> DataFrame:
    """Each (conversation, turn, role, text) once, with its copies and whether the text is new in the conversation."""
    present = said.filter("copies > 0")
    rows = present.select("conv_id", "turn", "role", "name", "text", "copies", F.lit(False).alias("fresh"))
    none = F.lit(None)
    first = present.groupBy("conv_id", "role", "name").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"))
    first = first.select("conv_id", "first.turn", "role", "name", none.cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(True).alias("fresh"))
    absent = said.filter("copies <= 0").select("conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("name"), none.cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(False).alias("fresh"))
    every = rows.unionByName(first).unionByName(absent).groupBy("conv_id", "turn", "role", "name")
    counted = every.agg(F.max("text").alias("text"), F.sum("copies").alias("copies"), F.max("fresh").alias("fresh"))
    bare = F.rtrim(F.col("text"), F.lit(_BLANK))
    marks = {"blank": bare == "", "cut": ~F.right(bare, F.lit(1)).isin(".", "!", "?"), "initial": F.instr(F.lit(INITIALS), F.left("role", F.lit(1))) - 1}
    counted = counted.withColumns(marks)
    initial = F.when((F.col("initial") < 0) | (F.col("role") == ""), 3).otherwise(F.col("initial"))
    return counted.select("conv_id", "turn", "role", "name", F.when(F.col("fresh") & ~F.col("blank"), F.col("text")).otherwise("").alias("text"), "copies", "fresh", "blank", initial.cast("int").alias("initial"), "cut")


_LONG, _TEXT, _ENTRY = pa.int64(), pa.string(), pa.struct([("cost", pa.int64()), ("audit", pa.string())])
_RESULT = {"gaps": _LONG, "blank": _LONG, "duplicate": _LONG, "truncated": _LONG, "illegal": _LONG, "cost": _LONG, "audit": _TEXT, "repaired_sha256": _TEXT}
_PIECE = {"part": _LONG, "sub": _LONG, "first": _LONG, "last": _LONG, "low": _LONG, "high": _LONG, "turns": _LONG, "entries": pa.list_(_ENTRY)}
_SQL = {_LONG: "long", _TEXT: "string", pa.list_(_ENTRY): "array<struct<cost: long, audit: string>>"}
_IN = ["turn", "role", "text", "copies", "fresh", "blank", "initial", "cut"]
_COMBINED = {c: k for c, k in _RESULT.items() if c != "repaired_sha256"}


def _schema(kind: str, columns: dict[str, pa.DataType]) -> str:
    return ", ".join([f"conv_id {kind}", *[f"{c} {_SQL[k]}" for c, k in columns.items()]])


def _batch(ids: pa.DataType, columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": ids, **columns}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def _solved(kind: str, ordered: DataFrame) -> DataFrame:
    """Results of conversations inside a range, pieces of the others; ``ordered`` holds sorted ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("conversations")
        part, sub, ids = TaskContext.get().partitionId(), 0, None
        block: list[tuple[_Piece, bool]] = []  # closed stretches, and whether each is only a piece
        opened, piece, symbols, size = None, True, 0, 0

        def out(block: list[tuple[_Piece, bool]]) -> pa.RecordBatch:
            nonlocal sub
            rows = []
            for (p, whole), m in zip(block, solve([p.symbols for p, _ in block], [w for _, w in block]), strict=True):
                counts = [p.count[c] for c in COUNTS]
                if whole:
                    entries = [{"cost": None, "audit": None} if e is None else {"cost": e[0], "audit": flat(e[1])} for r in m for e in r]
                    rows.append((p.conv, None, *counts, None, None, None, part, sub, p.first, p.last, p.low, p.high, p.turns, entries))
                    sub += 1
                else:
                    cost, audit = finished(m[0])
                    rows.append((p.conv, p.gaps(), *counts, cost, audit, digest(repaired(p.rows, audit)), *[None] * len(_PIECE)))
            return _batch(ids, _RESULT | _PIECE, rows)

        for batch in batches:
            ids = batch.column(0).type
            for conv, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if opened is None or opened.conv != conv:
                    if opened is not None:
                        block.append((opened, piece))
                        piece, symbols, size = False, symbols + len(opened.symbols), size + opened.bytes
                        if symbols >= BLOCK_SYMBOLS or size >= BLOCK_BYTES:
                            yield out(block)
                            block, symbols, size = [], 0, 0
                    opened = _Piece(conv)
                opened.add(*row)
                if len(opened.symbols) >= BLOCK_SYMBOLS or opened.bytes >= BLOCK_BYTES:
                    yield out([*block, (opened, True)])
                    block, symbols, size, opened, piece = [], 0, 0, _Piece(conv), True
        if opened is not None:
            yield out([*block, (opened, True)])

    return ordered.select("conv_id", *_IN).mapInArrow(run, _schema(kind, _RESULT | _PIECE))


def _combined(kind: str, pieces: DataFrame) -> DataFrame:
    """Counts, cost and audit of each conversation from its pieces in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("conversations")
        opened, vector, ids = None, FROM_START, None

        def out() -> pa.RecordBatch:
            cost, audit = finished(vector[0])
            row = (opened.conv, opened.gaps(), *[opened.count[c] for c in COUNTS], cost, audit)
            return _batch(ids, _COMBINED, [row])

        for batch in batches:
            ids = batch.column(0).type
            for r in batch.to_pylist():
                if opened is None or opened.conv != r["conv_id"]:
                    if opened is not None:
                        yield out()
                    opened, vector = _Piece(r["conv_id"]), FROM_START
                p = _Piece(r["conv_id"])
                p.count = {c: r[c] for c in COUNTS}
                p.first, p.last, p.low, p.high, p.turns = (r[c] for c in ("first", "last", "low", "high", "turns"))
                opened.joined(p)
                entries = [None if e["cost"] is None else (e["cost"], e["audit"]) for e in r["entries"]]
                vector = product(vector, [entries[k : k + 4] for k in range(0, 16, 4)])
        if opened is not None:
            yield out()

    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "sub")
    return dealt.select("conv_id", *COUNTS, *_PIECE).mapInArrow(run, _schema(kind, _COMBINED))


def _hashed(kind: str, combined: DataFrame, said: DataFrame) -> DataFrame:
    """``combined`` with the digest of each repair: its rows stream by, behind the audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("conversations")
        head, lines, held, ids = None, None, None, None

        def done() -> pa.RecordBatch:
            for line in lines.inserted():
                held.add(line)
            return _batch(ids, _RESULT, [(*head, held.hash.hexdigest())])

        for batch in batches:
            ids = batch.column(0).type
            for conv, role, text, copies, *result in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if result[-1] is not None:
                    if head is not None:
                        yield done()
                    head, lines, held = (conv, *result), _Lines(result[-1]), _Digest()
                elif copies:
                    for line in lines.of(role, text, copies):
                        held.add(line)
        if head is not None:
            yield done()

    own = said.join(combined.select(F.col("conv_id").alias("_of")), F.col("conv_id").eqNullSafe(F.col("_of")), "left_semi")
    nothing = [F.lit(None).cast(_SQL[k]).alias(c) for c, k in _COMBINED.items()]
    rows = _counted(own).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "name", "text", "copies", *nothing)
    none = [F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("name", "string"), ("text", "string"))]
    heads = combined.select("conv_id", F.lit(0).alias("kind"), *none, F.lit(0).cast("long").alias("copies"), *_COMBINED)
    dealt = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "name")
    return dealt.select("conv_id", "role", "text", "copies", *_COMBINED).mapInArrow(run, _schema(kind, _RESULT))


def repair_conversations(rows: DataFrame, copies: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (nulls first), then role, then the text's digest.  ``copies`` is an integer column of the
    rows: how often each stands there; rows with 0 only name their conversation.  Null roles and texts are one space;
    a null conv_id is a conversation like others.  A conversation without rows has zeros, an empty audit and the digest
    of nothing; an empty table gives no rows; columns of any other name are ignored.  Texts of any length are hashed in
    parts.  Rows are compared by 128-bit digests of role and text.
    """
    said = _rows(rows, copies, conv_col, turn_col, role_col, text_col)
    kind, order = said.schema["conv_id"].dataType.simpleString(), ["conv_id", "turn", "role", "name"]
    solved = materialize(_solved(kind, _counted(said).repartitionByRange(*order).sortWithinPartitions(*order)))
    combined = materialize(_combined(kind, solved.filter("part is not null")))
    return solved.filter("part is null").select("conv_id", *_RESULT).unionByName(_hashed(kind, combined, said))


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """The test damage of the contract, by the checksum of ``conv_id:turn``: changed rows, and how often each stands."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).cast("int")
    text, role = part("text"), part("role")
    changed = rows.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )
    return changed, F.col("copies")
