"""Conversations repaired at the least cost, by tables of whole blocks of turns (the Four Russians' way).

A repaired conversation's roles read, by their initials, as an optional s and then
ua, ua, ... . Edits keep, re-role, delete or insert a row. What the rest of a
conversation costs from each of the four states of this pattern is a vector; less its
least entry, there are only few such vectors. A table, worked out once a task, says
for each vector and each block of four symbols which vector stands before the block.

The blocks are looked up from the end to the start, which leaves the vector at every
block's end. Each block is then expanded against that direction, row by row, and
read on from the state reached so far: of the edits that reach the least cost the one
with the least letter is taken, so ties are broken from the first edit on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require, written

RETELL, DROP, ADD, UNFINISHED = 1, 2, 5, 5
#: Symbols of a block.
BLOCK = 4
#: Rows and characters over which a conversation is worked on in pieces, and rows of a piece.
LONG_ROWS, LONG_CHARS, PIECE_BITS = 1024, 4 << 20, 10
#: Long conversations whose ids are broadcast; more are joined.
BROADCAST_IDS = 100_000
_SPACES = " \t\n\v\f\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: Where a row of this initial leads when it is kept, and where a row re-told as user or assistant (or inserted) leads.
_KEPT = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}, "": {}}
_TOLD = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
ROLES = {_USER: "user", _ASSISTANT: "assistant"}
#: Symbols: rows that must be deleted, then each initial, finished and not.
_INITIALS = ["s", "u", "a", ""]
DELETED, SYMBOLS = 0, 1 + 2 * len(_INITIALS)
Vector = tuple[int, int, int, int]


def symbol(initial: str, truncated: bool) -> int:
    return 1 + 2 * _INITIALS.index(initial if initial in ("s", "u", "a") else "") + truncated


def _edits(sign: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use a row up."""
    yield "D", DROP, state
    if sign != DELETED:
        initial, truncated = _INITIALS[(sign - 1) // 2], (sign - 1) % 2 * UNFINISHED
        if state in _KEPT[initial]:
            yield "K", truncated, _KEPT[initial][state]
        yield "R", RETELL + truncated, _TOLD[state]


def _before(after: Vector, sign: int) -> Vector:
    """What the rest costs from each state before a row, from what it costs behind it."""
    used = [min(cost + after[to] for _, cost, to in _edits(sign, state)) for state in range(4)]
    for _ in range(3):  # two insertions lead through all states
        used = [min(used[state], ADD + used[_TOLD[state]]) for state in range(4)]
    return tuple(used)


def _letters(after: Vector, sign: int, state: int) -> tuple[str, int]:
    """The least letters that use the row up at the least cost, and the state behind it."""
    least = _before(after, sign)
    out = ""
    while True:
        fits = [(letter, to) for letter, cost, to in _edits(sign, state) if cost + after[to] == least[state]]
        if ADD + least[_TOLD[state]] == least[state]:
            fits.append(("I", _TOLD[state]))
        letter, to = min(fits)
        out, state = out + letter, to
        if letter != "I":
            return out, state


#: What is left to insert at the end, by state.
TAIL = {_START: "", _SYSTEM: "II", _USER: "I", _ASSISTANT: ""}
END: Vector = tuple(ADD * len(TAIL[q]) for q in range(4))


class Tables:
    """vectors: all normalised ones (0 is that of a conversation's end); step and block: the vector before a symbol or a block of them; letters: by (vector behind, symbol, state)."""

    def __init__(self, block: int = BLOCK):
        self.size = block
        self.vectors: list[Vector] = [END]
        found = {END: 0}
        steps: list[list[int]] = []
        for v in self.vectors:  # grows while it is walked
            row = []
            for sign in range(SYMBOLS):
                costs = _before(v, sign)
                new = tuple(c - min(costs) for c in costs)
                if new not in found:
                    found[new] = len(self.vectors)
                    self.vectors.append(new)
                row.append(found[new])
            steps.append(row)
        self.step = np.array(steps, np.int16)
        blocks = np.array(list(product(range(SYMBOLS), repeat=block)))
        reached = np.repeat(np.arange(len(steps))[:, None], len(blocks), axis=1)
        for k in reversed(range(block)):
            reached = self.step[reached, blocks[None, :, k]]
        self.block = reached.astype(np.int16)
        self.places = SYMBOLS ** np.arange(block - 1, -1, -1)
        self.letters = [_letters(v, sign, state) for v in self.vectors for sign in range(SYMBOLS) for state in range(4)]

    def _codes(self, signs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return (signs[starts[:, None] + np.arange(self.size)] * self.places).sum(axis=1)

    def behind(self, signs: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The vector behind every row of the pieces that lie between offsets, `ends` being the vectors behind the pieces."""
        lengths = np.diff(offsets)
        many, rest = lengths // self.size, lengths % self.size
        last = np.cumsum(many) - 1  # each piece's last block
        of = np.repeat(np.arange(len(lengths)), many)
        starts = (offsets[:-1] + rest)[of] + self.size * (np.arange(len(of)) - (last - many + 1)[of])
        codes = self._codes(signs, starts)
        at_end = np.zeros(len(of), np.int16)
        state = ends.astype(np.int16)
        by_length = np.argsort(-many, kind="stable")
        for k in range(int(many.max(initial=0))):
            live = by_length[: np.searchsorted(-many[by_length], -k, "left")]
            block = last[live] - k
            at_end[block] = state[live]
            state[live] = self.block[state[live], codes[block]]
        out = np.zeros(len(signs), np.int16)
        for k in reversed(range(self.size)):  # all blocks expanded at once
            out[starts + k] = at_end
            at_end = self.step[at_end, signs[starts + k]]
        for k in range(self.size - 1):  # the rows before the first whole block
            live = np.flatnonzero(rest > k)
            row = offsets[:-1][live] + rest[live] - 1 - k
            out[row] = state[live]
            state[live] = self.step[state[live], signs[row]]
        return out

    def through(self, signs: np.ndarray) -> np.ndarray:
        """The vector before a piece, for every vector behind it."""
        state, rest = np.arange(len(self.vectors)), len(signs) % self.size
        for code in self._codes(signs, np.arange(rest, len(signs), self.size))[::-1]:
            state = self.block[state, code]
        for sign in signs[:rest][::-1]:
            state = self.step[state, sign]
        return state.astype(np.int16)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def damaged(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, times) after the damage that a checksum of conversation and turn deals out: times is 0 for a dropped row and 2 for a repeated one. A null role or text is one space."""
    rows = require(conversations, conversation, turn, role, text)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = rows.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), (F.crc32(F.concat(space(conversation), F.lit(":"), space(turn))) % 20).alias("fate"))
    body = F.when(F.col("fate") <= 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return dealt.select("conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("times"))


#: What the reading of rows needs, in this order: `piece` and `after` (the vector behind it) cut long conversations; `first` is null where it is still to be found.
_COLUMNS = ["conv", "piece", "after", "turn", "role", "text", "times", "blank", "truncated", "first"]
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "position long, role string, text string"
_ORDER = ["conv", "turn", "role", "mark"]


class _Conversation:
    """What has been read of a conversation, row by row in its order. `turns` gets each repaired row, if there is such a list."""

    def __init__(self, conv: object, turns: list[tuple] | None):
        self.conv, self.state, self.initial, self.turns, self.position = conv, _START, None, turns, 0
        self.least = self.most = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.letters: list[str] = []
        self.hash = hashlib.sha256()
        self.seen: set[tuple[str, str]] = set()

    def found(self, turn: int | None, role: str, text: str, times: int, blank: bool, truncated: bool, first: bool | None) -> int:
        """The row's symbol; faults, gaps and roles out of order are counted."""
        if turn is not None and turn != self.most:
            self.distinct, self.most = self.distinct + 1, turn
            self.least = turn if self.least is None else self.least
        initial = role[:1]
        # A repeated row's role follows itself, which is never right.
        self.illegal += (self.initial is not None and self.initial + initial not in ("su", "ua", "au")) + times - 1
        self.initial = initial
        if first is None and not blank:
            first = (role, text) not in self.seen
            self.seen.add((role, text))
        if blank:
            self.blank += times
            return DELETED
        if not first:
            self.duplicate += times
            return DELETED
        self.duplicate += times - 1
        self.truncated += truncated
        return symbol(initial, truncated)

    def tell(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.position else "") + role + ":" + text).encode())
        if self.turns is not None:
            self.turns.append((self.conv, self.position, role, text))
        self.position += 1

    def insert(self) -> None:
        self.state = _TOLD[self.state]
        self.cost += ADD
        self.tell(ROLES[self.state], "")

    def edit(self, letters: str, role: str, text: str, truncated: bool, times: int) -> None:
        for _ in letters[:-1]:
            self.insert()
        if letters[-1] == "D":
            self.cost += DROP
        elif letters[-1] == "K":
            self.state = _KEPT[role[0]][self.state]
            self.cost += UNFINISHED * truncated
            self.tell(role, text)
        else:
            self.state = _TOLD[self.state]
            self.cost += RETELL + UNFINISHED * truncated
            self.tell(ROLES[self.state], text)
        self.cost += DROP * (times - 1)
        self.letters.append(letters + "D" * (times - 1))

    def report(self) -> tuple:
        tail = TAIL[self.state]
        for _ in tail:
            self.insert()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join([*self.letters, tail]), self.hash.hexdigest()


def _reader(schema: pa.Schema, turns: bool):
    """Rows by conversation, piece and place to reports (or repaired turns). Only whole pieces are worked on; of the conversation before them its audit is held, and the texts seen where `first` is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        now: _Conversation | None = None  # the last one whose rows were looked at, and the last one that was edited
        edited: _Conversation | None = None
        out: list[tuple] = []

        def end(conversation: _Conversation) -> None:
            report = conversation.report()
            if not turns:
                out.append(report)

        def work(rows: pa.Table) -> None:
            nonlocal now, edited
            conv, piece, after, *rest = (rows.column(c).to_pylist() for c in _COLUMNS)
            rest = list(zip(*rest))
            offsets, ends, signs, of = [], [], [], []
            for i, row in enumerate(rest):
                fresh = now is None or conv[i] != now.conv
                if fresh:
                    now = _Conversation(conv[i], out if turns else None)
                if fresh or not i or piece[i] != piece[i - 1]:
                    offsets.append(len(signs))
                    ends.append(after[i])
                if row[3]:
                    signs.append(now.found(*row))
                of.append(now)
            behind = iter(t.behind(np.array(signs, np.int64), np.array([*offsets, len(signs)]), np.array(ends)).tolist())
            sign = iter(signs)
            for conversation, (_, role, text, times, _, truncated, _) in zip(of, rest):
                if conversation is not edited:
                    if edited is not None:
                        end(edited)
                    edited = conversation
                if times:
                    letters, _ = t.letters[(next(behind) * SYMBOLS + next(sign)) * 4 + conversation.state]
                    conversation.edit(letters, role, text, truncated, times)

        def given() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()

        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            keys = list(zip(held.column("conv").to_pylist(), held.column("piece").to_pylist()))
            cut = len(keys)
            while cut and keys[cut - 1] == keys[-1]:
                cut -= 1
            if cut:
                work(held.slice(0, cut))
                held = held.slice(cut)
                yield from given()
        if held is not None and len(held):
            work(held)
        if edited is not None:
            end(edited)
        yield from given()

    return run


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _cut(rows: DataFrame, kind: str, bits: int) -> DataFrame:
    """Rows of long conversations with their piece, the vector behind it, and whether they are the first of their role and text. Rows lie in ranges of their order, so that many tasks share a conversation; pieces tell what they make of any vector behind them, and only that is brought together."""
    merged = rows.groupBy("conv", "turn", "role", "mark", "text", "blank", "truncated").agg(F.sum("times").alias("times"))
    earliest = merged.where("times > 0").groupBy("conv", "role", "text").agg(F.min(F.struct("turn")).alias("earliest"))
    earliest = earliest.select(F.col("conv").alias("its"), F.col("role").alias("its_role"), F.col("text").alias("its_text"), "earliest")
    told = merged.join(earliest, _same(merged["conv"], F.col("its")) & (merged["role"] == F.col("its_role")) & (merged["text"] == F.col("its_text")), "left")
    told = told.withColumn("first", (F.col("times") > 0) & F.coalesce(F.struct("turn").eqNullSafe(F.col("earliest")), F.lit(False))).drop("its", "its_role", "its_text", "earliest")
    in_order = told.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER, "text")
    placed = written(in_order.withColumn("place", F.monotonically_increasing_id()), "rows").withColumn("piece", F.shiftright("place", bits))

    initial = F.array_position(F.array(*map(F.lit, _INITIALS[:-1])), F.left("role", F.lit(1)))
    kind_ = F.when(initial == 0, len(_INITIALS) - 1).otherwise(initial - 1)
    sign = F.when(F.col("blank") | ~F.col("first"), DELETED).otherwise(1 + 2 * kind_ + F.col("truncated").cast("int"))
    gathered = placed.groupBy("conv", "piece").agg(F.array_sort(F.collect_list(F.struct("place", sign.cast("int").alias("sign")))).alias("rows"))

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            through = [tables().through(np.array(signs, np.int64)).tobytes() for signs in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(through, pa.binary())], ["conv", "piece", "through"])

    pieces = gathered.select("conv", "piece", F.transform("rows", lambda r: r["sign"]).alias("signs")).mapInArrow(functions, f"conv {kind}, piece long, through binary")
    chains = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("piece", "through"))).alias("pieces"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                after = [0]
                for p in reversed(row[1:]):
                    after.append(int(np.frombuffer(p["through"], np.int16)[after[-1]]))
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(row), batch.column(0).type), pa.array([p["piece"] for p in row]), pa.array(after[::-1], pa.int32())], ["its", "its_piece", "after"])

    ends = chains.mapInArrow(chained, f"its {kind}, its_piece long, after int")
    return placed.join(ends, _same(placed["conv"], ends["its"]) & (placed["piece"] == ends["its_piece"]))


def _done(rows: DataFrame, turns: bool, long_rows: int, long_chars: int, bits: int) -> DataFrame:
    kind = rows.schema["conv"].dataType.simpleString()
    bare = F.rtrim("text", F.lit(_SPACES))
    rows = rows.select("conv", "turn", "role", "text", "times", F.xxhash64("text").alias("mark"), (F.length(bare) == 0).alias("blank"), ((F.length(bare) > 0) & ~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    sums = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = written(sums.where((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select(F.col("conv").alias("its")), "long")
    n = long.count()
    ids = F.broadcast(long) if n <= BROADCAST_IDS else long
    short = rows.join(ids, _same(rows["conv"], ids["its"]), "left_anti") if n else rows
    short = short.withColumn("piece", F.lit(0).cast("long")).withColumn("after", F.lit(0)).withColumn("first", F.lit(None).cast("boolean"))
    parts = [short.repartition("conv").sortWithinPartitions(*_ORDER, "text")]
    if n:
        cut = _cut(rows.join(ids, _same(rows["conv"], ids["its"]), "left_semi"), kind, bits)
        parts.append(cut.repartition("conv").sortWithinPartitions("conv", "place"))
    types = f"conv {kind}, {_TURNS if turns else _REPORT}"
    empty = rows.sparkSession.createDataFrame([], types).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    run = _reader(to_arrow_schema(empty), turns)
    out = [p.select(*_COLUMNS).mapInArrow(run, types) for p in parts]
    return out[0].union(out[1]) if n else out[0]


def report(rows: DataFrame, conversation: str = "conv_id", long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS, piece_bits: int = PIECE_BITS) -> DataFrame:
    """A row a conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; for rows(conv, turn, role, text, times), `times` saying how often a row stands there (see `damaged`).

    Each row's first fault counts: blank, duplicate (role and text have come
    before), truncated (ends with none of .!?). Gaps are turns missing between the least
    and the greatest; `illegal` counts neighbours whose roles' initials aren't su, ua or
    au. The audit holds the initials of the cheapest edits, of equally cheap ones the
    least string; what it makes of the conversation is in `repaired_turns`, and here
    as a hash of its lines role:text.
    Rows go by turn (null first), then role, then a hash of the text. A null
    conversation is one of its own; a role of another initial (or none) can't be kept;
    a conversation without rows (times 0) has zeros, no edits and the hash of nothing; an
    empty table gives an empty result; texts and conversations may be of any length:
    those over `long_rows` rows or `long_chars` characters are cut into pieces, which
    gives the same. The hash and the audit are made in one pass in the rows' order, in
    memory that grows by the audit alone. Runs Spark jobs when it is called, and writes
    the rows of long conversations to the shared folder.
    """
    return _done(rows, False, long_rows, long_chars, piece_bits).withColumnRenamed("conv", conversation)


def repaired_turns(rows: DataFrame, conversation: str = "conv_id", long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS, piece_bits: int = PIECE_BITS) -> DataFrame:
    """The repaired conversations: (id, position, role, text). As `report` otherwise; a conversation of which nothing is left has no rows."""
    return _done(rows, True, long_rows, long_chars, piece_bits).withColumnRenamed("conv", conversation)


def as_rows(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as they are, for `report` and `repaired_turns`; a null role or text is one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return require(conversations, conversation, turn, role, text).select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(1).cast("long").alias("times"))
