"""Conversation structure repair: the cheapest edits that give alternating turns, by a rank-compressed dynamic program."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import parts

#: Costs of the edits; a truncated turn that stays adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What a prefix of the repaired roles ends in: nothing, system, user (assistant is due), assistant (a whole exchange).
EMPTY, SYSTEM, USER, WHOLE = range(4)
#: More insertions in a row only come back to a place that two reach for less.
MOST_INSERTS = 2
#: A turn's class: its role's initial (u, a, s or - for others), and whether it must go (d), stays at a price (t) or is sound.
FAULTS = ["", "blank", "duplicate", "truncated"]
_INSERTED = {EMPTY: USER, SYSTEM: USER, WHOLE: USER, USER: WHOLE}
#: A macro edit is a run of insertions and what becomes of the next turn. No code begins another one, so sequences of codes
#: compare as their audit strings do, and the place in this order stands for the code.
CODES = sorted("I" * k + x for k in range(MOST_INSERTS + 1) for x in "DKR")


@lru_cache(maxsize=None)
def _moves(initial: str, fault: str) -> list[list[tuple[int, int, int]]]:
    """For each state, the (code, cost, next state) that a turn of this class allows."""
    out: list[list[tuple[int, int, int]]] = []
    for start in range(4):
        moves = []
        for number, code in enumerate(CODES):
            state = start
            for _ in code[:-1]:
                state = _INSERTED[state]
            cost, stays = INSERT * (len(code) - 1), TRUNCATED * (fault == "truncated")
            due = _INSERTED[state]
            if code[-1] == "D":
                moves.append((number, cost + DELETE, state))
            elif fault in ("blank", "duplicate"):
                continue
            elif code[-1] == "R":
                moves.append((number, cost + REROLE + stays, due))
            elif initial == "ua"[due == WHOLE]:
                moves.append((number, cost + KEEP + stays, due))
            elif initial == "s" and state == EMPTY:
                moves.append((number, cost + KEEP + stays, SYSTEM))
        out.append(moves)
    return out


Layer = tuple[tuple[int, int, int], ...]  # (state, cost above the layer's least, rank of its audit string), by rank


@lru_cache(maxsize=1 << 16)
def _step(layer: Layer, initial: str, fault: str) -> tuple[Layer, int, tuple[tuple[int, int, int] | None, ...]]:
    """(next layer, what its least cost adds, parent of each state: (state, code)). Of edits of equal cost that end in one state,
    the one with the least audit string stays: by the rank of what it goes on from, then by its code."""
    moves = _moves(initial, fault)
    best: dict[int, tuple[int, int, int, int]] = {}
    for state, cost, rank in layer:
        for code, price, end in moves[state]:
            found = (cost + price, rank, code, state)
            if end not in best or found < best[end]:
                best[end] = found
    least = min(x[0] for x in best.values())
    order = sorted(best, key=lambda end: best[end][1:3])
    parents: list[tuple[int, int] | None] = [None] * 4
    for end, (_, _, code, state) in best.items():
        parents[end] = (state, code)
    return tuple((end, best[end][0] - least, k) for k, end in enumerate(order)), least, tuple(parents)


def cheapest_edits(turns: Iterator[tuple[str, str]]) -> tuple[int, list[str]]:
    """(cost, macro edits) of the cheapest repair of turns given as (role's initial, fault); of equal cost the one with
    the least audit string. One code for each turn, and a run of insertions (maybe empty) at the end.

    A layer of the program has four states at most. No audit string is kept: a layer ranks its states by their strings, which
    the ranks of the layer before and the codes decide, and points at parents; the codes are read off backward at the end.
    A turn costs one shared pointer of memory, and layers that differ in their least cost alone are computed once."""
    layer: Layer = ((EMPTY, 0, 0),)
    total, trail = 0, []
    for initial, fault in turns:
        layer, least, parents = _step(layer, initial if initial in ("u", "a", "s") else "-", fault)
        total += least
        trail.append(parents)
    ends = []
    for state, cost, rank in layer:
        at = state
        for k in range(MOST_INSERTS + 1):
            if at in (EMPTY, WHOLE):
                ends.append((cost + INSERT * k, rank, k, state))
            at = _INSERTED[at]
    cost, _, k, state = min(ends)
    codes = ["I" * k]
    for parents in reversed(trail):
        state, code = parents[state]
        codes.append(CODES[code])
    return total + cost, codes[::-1]


def repaired_turns(codes: list[str], turns: Iterator[tuple[str | None, str | None]]) -> Iterator[tuple[str, int | None, str, str]]:
    """(edit, place of the turn or None, role, text) of what remains, in order; turns: (role, text) of each code but the last."""
    state = EMPTY
    for place, code in enumerate(codes):
        turn = next(turns) if place < len(codes) - 1 else None
        for edit in code:
            if edit == "D":
                continue
            due = _INSERTED[state]
            role, text = ("user", "assistant")[due == WHOLE], ""
            if edit == "K":
                role, text = turn
                due = SYSTEM if role[:1] == "s" else due
            elif edit == "R":
                text = turn[1]
            yield edit, None if edit == "I" else place, role, text
            state = due


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by the CRC-32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2
    takes `.`, `!` and `?` from it, 3 repeats the row, 4 makes its role user. A null is one space in role, text and the hashed string."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    c = c.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return c.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def _own_fault(text: Column) -> Column:
    """0 sound, 1 blank, 3 truncated: what a turn's text alone decides."""
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), 1).when(text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), 0).otherwise(3)


_ROWS = "conv_id long, kind int, turn long, role string, h1 long, h2 long, fault int, again boolean, text string"
_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "conv_id long, place long, edit string, turn long, role string, text string"


class _Conversation:
    """What a task holds of a conversation: some bytes for each turn, and no text."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.count, self.turns, self.illegal = conv_id, [0, 0, 0, 0], [], 0
        self.low = self.high = self.before = None
        self.distinct, self.cost, self.codes = 0, 0, [""]

    def add(self, turn: int | None, role: str, key: tuple, fault: int, again: bool) -> None:
        if turn is not None:
            self.distinct += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        # a text that stands in an earlier turn, or just before in the same one (equal rows of a turn are neighbours)
        fault = 1 if fault == 1 else 2 if again or self.before == (turn, *key) else fault
        self.before = (turn, *key)
        self.illegal += bool(self.turns) and self.turns[-1][0] + role[:1] not in ("su", "ua", "au")
        self.count[fault] += 1
        self.turns.append(_shared(role[:1], FAULTS[fault]))

    def plan(self) -> None:
        self.cost, self.codes = cheapest_edits(iter(self.turns))

    def summary(self, digest: str) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv_id, gaps, *self.count[1:], self.illegal, self.cost, "".join(self.codes), digest)


@lru_cache(maxsize=1 << 12)
def _shared(initial: str, fault: str) -> tuple[str, str]:
    return initial, fault


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows in the order of _ROWS, one at a time, few of them as Python objects."""
    for batch in batches:
        for columns in parts(batch, 8, rows=2000):
            yield from zip(*columns, strict=True)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, Iterator[tuple[str, int | None, str, str, int | None]]]]:
    """Each conversation once its edits are known, with its repaired turns and the turn that each had, which are made as the texts
    stream by. Rows of a conversation come as: a mark (kind 0), its turns without texts (1), and again with texts (2)."""
    rows = _stream(batches)
    row = next(rows, None)
    while row is not None:
        c = _Conversation(row[0])
        while row is not None and row[0] == c.conv_id and row[1] < 2:
            if row[1] == 1:
                c.add(row[2], row[3], row[4:6], row[6], row[7])
            row = next(rows, None)
        c.plan()
        numbers: list[int | None] = [None]

        def texts() -> Iterator[tuple[str, str]]:
            nonlocal row
            while row is not None and row[0] == c.conv_id:  # noqa: B023
                here, row = row, next(rows, None)
                numbers[0] = here[2]  # noqa: B023
                yield here[3], here[8]

        yield c, ((*x, None if x[1] is None else numbers[0]) for x in repaired_turns(c.codes, texts()))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for c, turns in _conversations(batches):
        digest, glue = hashlib.sha256(), ""
        for _, _, role, text, _ in turns:
            digest.update(f"{glue}{role}:{text}".encode("utf-8", "surrogatepass"))
            glue = "\n"
        out.append(c.summary(digest.hexdigest()))
        if len(out) >= 1000 or len(c.codes) > 100_000:
            yield _batch(out, _SUMMARY)
            out = []
    yield _batch(out, _SUMMARY)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for c, turns in _conversations(batches):
        for place, (edit, _, role, text, turn) in enumerate(turns):
            out.append((c.conv_id, place, edit, turn, role, text))
            size += len(text)
            if len(out) >= 2000 or size >= 4 << 20:
                yield _batch(out, _TURNS)
                out, size = [], 0
    yield _batch(out, _TURNS)


def _ordered(rows: DataFrame, marks: DataFrame | None) -> DataFrame:
    """The rows of _ROWS, a conversation's together and in order.

    A duplicate is told by its conversation and 128 bits of role and text: the first turn of each such key comes from a minimum
    with a map-side part, so a row that is repeated without end is one row a task, and a join of narrow rows."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    d = d.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", F.lit(1), "role")})
    key, here = ["conv_id", "h1", "h2"], F.struct(F.col("turn").isNotNull().alias("set"), "turn")  # nulls first
    first = d.groupBy(*key).agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first <> last")
    first = first.select(*[F.col(k).alias(f"k_{k}") for k in key], "first")
    narrow = d.select(*key, "turn", "role", _own_fault(F.col("text")).alias("fault"))
    narrow = narrow.join(first, narrow["conv_id"].eqNullSafe(first["k_conv_id"]) & (narrow["h1"] == first["k_h1"]) & (narrow["h2"] == first["k_h2"]), "left")
    again = F.coalesce(F.col("first") != here, F.lit(False))
    row = lambda **given: [given.get(n, F.lit(None)).cast(k).alias(n) for n, k in (x.split() for x in _ROWS.split(", "))]
    own = {n: F.col(n) for n in (*key, "turn", "role")}
    out = narrow.select(*row(kind=F.lit(1), fault=F.col("fault"), again=again, **own)).unionByName(d.select(*row(kind=F.lit(2), text=F.col("text"), **own)))
    if marks is not None:
        out = out.unionByName(marks.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(*row(kind=F.lit(0), conv_id=F.col("conv_id"))))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(spread, "conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "h1", "h2")


def repair_summaries(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text) and of originals (conv_id): gaps in its turns, faults, role changes that
    do not alternate, the cost of the cheapest repair, its audit string and the SHA-256 of the repaired `role:text` lines.

    Turns go by number, nulls first, then by role and a hash of role and text. A row's first fault counts: blank (no character but
    ASCII white space), duplicate (role and text seen earlier), truncated (no `.`, `!` or `?` at the end). A null role or text
    is one space; an empty role has no initial, so its turn is not kept as it is. Rows with a null conv_id are one conversation. One without rows has zeros, an empty audit and the hash of the empty
    string; no conversations, no rows. Other columns are ignored.

    A task holds some bytes for each turn of a conversation, as its audit string does, and streams its texts, so a very long
    text or a conversation that holds a third of all rows needs no more memory than its row of the result."""
    return _ordered(rows, originals).mapInArrow(_summaries, _SUMMARY)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The repaired turns themselves: (conv_id, place, edit, turn, role, text), place from 0 without gaps; edit K kept, R given another role,
    I inserted (turn null, text empty). Conversations of which nothing stays have no rows; otherwise as repair_summaries."""
    return _ordered(rows, None).mapInArrow(_repaired, _TURNS)


def repair_query(conversations: DataFrame) -> DataFrame:
    """Every original conversation, damaged and repaired."""
    return repair_summaries(damaged(conversations), conversations)
