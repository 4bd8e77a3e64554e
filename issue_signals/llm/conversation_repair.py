"""Conversation repair: faults, and the cheapest edits that make a conversation's roles (s?(ua)+)?.

The rows of a conversation, in order, lead from state to state of the pattern. A row that must go costs
the same on every way, so only the others are steps: each is kept, re-roled or deleted, and rows may be
inserted before it. The costs to the end are a DP from the back. Among the cheapest edits the least
audit is found by ranking the nodes of the optimal arcs by the first letter, then by two, four, eight
... letters of their audits (`least_audits`); the pointers are doubled with the lengths, and the nodes on the path from the start
are those that the doubled pointers reach.

A conversation can hold a third of all rows. Rows that are alike are counted before they move, what
remains is dealt by ranges of (conversation, turn, role, text digest) and cut into segments of at most SEGMENT records. A segment
of a longer conversation is a 4 x 4 matrix of costs between states: the matrices of a conversation give each
segment the costs at its end, and the exits of each segment the state in which the next is entered. So all segments are
solved apart, and only numbers of constant size per segment meet in one task. Texts are shuffled once, to be digested in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issue_signals.llm.common import shared_table, small_batches

WHITE = " \t\n\x0b\x0c\r"
#: A row's damage by crc32 of its place, modulo DAMAGE.
DAMAGE = 20
#: Records in one segment, and rows that are solved at once.
SEGMENT, ROWS = 8_192, 32_768

#: States: nothing yet, after s, after u, after a. An insert leads on within a row's place.
INSERTED = np.array([2, 2, 3, 2])
#: Letters of the audit in ASCII order. What a row's letter leads to, by initial (s u a other), letter and state.
LETTERS = "DIKR"
_NEXT = np.full((4, 4, 4), -1)
_NEXT[:, 0] = np.arange(4)
_NEXT[:, 1] = INSERTED
_NEXT[0, 2, 0] = 1
_NEXT[1, 2, [0, 1, 3]] = 2
_NEXT[2, 2, 2] = 3
_NEXT[:, 3] = INSERTED
#: Costs of the letters; a truncated row that stays costs one more.
COSTS = np.array([3, 2, 0, 2])
_STAYS = np.array([0, 0, 1, 1])
_FAR = 1 << 40
#: Costs from each state to the end of the conversation, and the inserts on that way.
END, END_INSERTS = np.array([0, 4, 2, 0]), (0, 2, 1, 0)
ROLE = {2: "user", 3: "assistant"}
#: Kinds of a record beside its initial: a truncated one, one that must go as a whole.
TRUNCATED, FORCED = 4, 8


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, n (0 to 2: how often the row is there) of every row after the damage."""
    said = conversations.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(name) for c, name in ((role_col, "role"), (text_col, "text"))],
    )
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    said = said.withColumn("kind", F.crc32(place.cast("binary")) % DAMAGE)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return said.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("n"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


#: The order of rows: nulls first, rows of one turn by role and by the digest of the text.
_ORDER = ("conv_id", "turn", "role", "digest")


def records(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, kind, n: the different rows of each conversation, in no order.

    kind: the initial of the role, with the marks TRUNCATED and FORCED (blank, or the same role and text
    at an earlier turn). Of n rows that are alike the later ones are duplicates as well."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    plain = rows.filter("n > 0").select("conv_id", "turn", "role", _digest(), code.alias("code"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"), "n")
    alike = plain.groupBy(*_ORDER).agg(*[F.first(c).alias(c) for c in ("code", "blank", "open")], F.sum("n").alias("n"))
    alike = shared_table(alike, "repair-alike")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = alike.filter("NOT blank").groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"), F.count("*").alias("turns")).filter("turns > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    met = alike.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.coalesce(turn > F.col("first"), F.lit(False))
    marks = F.when(F.col("blank") | later, FORCED).when(F.col("open"), TRUNCATED).otherwise(0)
    return met.select(*_ORDER, (F.col("code") + marks).alias("kind"), "blank", "n")


# One segment at a time -----------------------------------------------------------------------------


def costs_to_end(kinds: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place 0 .. len(kinds) and state the cost to the end; kinds of rows that need not go, end the costs
    after them. end may have more columns, one for each of several ends: (states, ends)."""
    out = np.empty((len(kinds) + 1, *end.shape), np.int64)
    out[-1] = end
    for at in range(len(kinds) - 1, -1, -1):
        code, open_ = int(kinds[at]) & 3, int(kinds[at]) >> 2 & 1
        best = np.full(end.shape, _FAR)
        for letter in (0, 2, 3):
            to = _NEXT[code, letter]
            some = to >= 0
            best[some] = np.minimum(best[some], out[at + 1][to[some]] + COSTS[letter] + open_ * _STAYS[letter])
        for _ in range(2):  # more inserts in one place lead back to a state met before
            best = np.minimum(best, best[INSERTED] + COSTS[1])
        out[at] = best
    return out


def cost_matrix(kinds: np.ndarray) -> np.ndarray:
    """The costs from each state before the rows to each state after them."""
    return costs_to_end(kinds, np.where(np.eye(4, dtype=bool), 0, _FAR))[0]


def least_audits(parts: list[tuple[np.ndarray, np.ndarray, list[int]]]) -> list[list[tuple[str, int]]]:
    """For each part (kinds, costs after its rows, states at its start), by these states, the least audit among the
    cheapest edits and the state at its end.

    The nodes of a part are its places and states. An optimal arc is a letter that costs what the node has
    left over its target's; from one node different letters lead on, so a node's arc of least rank is one. Ranks
    of 2 L letters are those of (L letters, the next L letters)."""
    nodes = np.cumsum([0] + [4 * (len(kinds) + 1) for kinds, *_ in parts])
    target = np.full((nodes[-1], 4), -1)
    for (kinds, end, _), base in zip(parts, nodes):
        left = costs_to_end(kinds, end)
        if not len(kinds):
            continue
        code, open_ = kinds & 3, kinds >> 2 & 1
        to = _NEXT[code].transpose(0, 2, 1)  # place, state, letter
        row = np.arange(len(kinds))[:, None, None]
        place = np.broadcast_to(row + np.array([1, 0, 1, 1]), to.shape)
        cost = COSTS + open_[:, None, None] * _STAYS
        tight = (to >= 0) & (left[place, np.maximum(to, 0)] + cost == left[:-1, :, None]) & (left[:-1, :, None] < _FAR)
        target[base : base + 4 * len(kinds)] = np.where(tight, base + 4 * place + to, -1).reshape(-1, 4)
    has = target >= 0
    ends = ~has.any(axis=1)
    rank = np.where(ends, 0, has.argmax(axis=1) + 1)
    pointer = np.where(ends, np.arange(len(target)), target[np.arange(len(target)), has.argmax(axis=1)])
    doubled, longest = [pointer], 3 * max((len(kinds) for kinds, *_ in parts), default=0) + 1
    for _ in range(max(0, longest - 1).bit_length()):
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[pointer], return_inverse=True)[1]
        pointer = pointer[pointer]
        doubled.append(pointer)
    # the arc of least rank: its letter, and behind it the rank of its target
    arcs = np.where(has, np.arange(4) * (int(rank.max(initial=0)) + 1) + rank[np.maximum(target, 0)], _FAR)
    letter = arcs.argmin(axis=1)
    out = []
    for (_, _, starts), base in zip(parts, nodes):
        found = []
        for state in starts:
            path = np.array([base + state])
            for jump in doubled:
                if ends[path[-1]]:
                    break
                path = np.concatenate([path, jump[path]])
            steps = int(ends[path].argmax())
            found.append(("".join(LETTERS[k] for k in letter[path[:steps]]), int(path[steps] - base) & 3))
        out.append(found)
    return out


# From sorted records to segments -------------------------------------------------------------------

_SEGMENT_FIELDS = (
    "conv_id long, turn long, role string, digest binary, segment long, alone boolean, kinds binary, n array<long>, matrix array<long>, "
    "blank long, duplicate long, truncated long, illegal long, first int, last int, first_turn long, last_turn long, turns long"
)
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _summed(part: list[tuple], segment: int, alone: bool) -> tuple:
    """One row of _SEGMENT_FIELDS from the records of a segment."""
    kinds = np.array([r[4] for r in part], np.uint8)
    n = [r[6] for r in part]
    codes = (kinds & 3).tolist()
    blank = sum(r[6] for r in part if r[5])
    truncated = int(((kinds & TRUNCATED) > 0).sum())
    duplicate = sum(r[6] if k & FORCED else r[6] - 1 for r, k in zip(part, kinds.tolist()) if not r[5])
    illegal = sum(k - 1 for k in n) + sum(pair not in _LEGAL for pair in zip(codes, codes[1:]))
    turns = [r[1] for r in part if r[1] is not None]
    matrix = None if alone else cost_matrix(kinds[(kinds & FORCED) == 0]).ravel().tolist()
    return (*part[0][:4], segment, alone, kinds.tobytes(), n, matrix, blank, duplicate, truncated, illegal, codes[0], codes[-1],
            turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)))


def segments(found: DataFrame, segment_rows: int = SEGMENT) -> DataFrame:
    """The records, dealt by ranges and sorted, as one row for each segment. alone: the segment is surely all of its
    conversation, as others surround it in its task."""
    ranged = found.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        part: list[tuple] = []
        ready: list[tuple] = []
        whole = False  # the conversation of part began in this task, after another, and is in no earlier segment

        def close(alone: bool) -> None:
            nonlocal number, part
            ready.append(_summed(part, number, alone))
            number += 1
            part = []

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*ready), _ARROW)], names=_NAMES)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*_ORDER, "kind", "blank", "n"))):
                if part and row[0] != part[0][0]:
                    close(whole)
                    whole = True
                elif len(part) == segment_rows:
                    close(False)
                    whole = False
                part.append(row)
            if len(ready) >= 500:
                yield emit()
                ready.clear()
        if part:
            close(False)
        if ready:
            yield emit()

    return ranged.mapInArrow(cut, _SEGMENT_FIELDS)


_ARROW = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.int32(), pa.int32(), *[pa.int64()] * 3]
_NAMES = [f.split()[0] for f in _SEGMENT_FIELDS.split(", ")]


def _chained(rows: DataFrame, given: str, step: Callable, start: object, column: str, kind: str, arrow: pa.DataType, backwards: bool) -> DataFrame:
    """segment and what `step` makes of the conversation's segments before it (behind it, backwards), from start."""
    order = F.desc("segment") if backwards else F.asc("segment")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), start
        for batch in batches:
            out = []
            for own, value in zip(batch.column("conv_id").to_pylist(), batch.column(given).to_pylist()):
                if own != conv:
                    conv, state = own, start
                out.append(state)
                state = step(value, state)
            yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(out, arrow)], names=["segment", column])

    return dealt.mapInArrow(run, f"segment long, {column} {kind}")


def _before(matrix: list[int], end: list[int]) -> list[int]:
    return (np.array(matrix).reshape(4, 4) + np.array(end)).min(axis=1).tolist()


def solved(cut: DataFrame) -> DataFrame:
    """segment, entry (the state at its start), audit (the letters of the rows that need not go)."""
    longer = cut.filter("NOT alone")
    ends = shared_table(_chained(longer.select("conv_id", "segment", "matrix"), "matrix", _before, END.tolist(), "end", "array<long>", pa.list_(pa.int64()), True), "repair-ends")
    exits = longer.select("conv_id", "segment", "kinds").join(ends, "segment").select("conv_id", "segment", "kinds", "end").mapInArrow(_all_exits, "conv_id long, segment long, exits array<int>")
    entries = _chained(exits, "exits", lambda exits, state: exits[state], 0, "entry", "int", pa.int32(), False)
    known = ends.join(entries, "segment")
    given = cut.select("segment", "kinds").join(known, "segment", "left")
    given = given.select("segment", "kinds", F.coalesce("end", F.array(*[F.lit(int(c)).cast("long") for c in END])).alias("end"), F.coalesce("entry", F.lit(0)).alias("entry"))
    return given.mapInArrow(_audits, "segment long, entry int, audit string")


def _free(kinds: bytes) -> np.ndarray:
    all_ = np.frombuffer(kinds, np.uint8).astype(np.int64)
    return all_[(all_ & FORCED) == 0]


def _in_groups(batches: Iterator[pa.RecordBatch], entered: bool) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[str, int]]]]]:
    """Parts of the batches of about ROWS rows, with the least audits of each, from the state in which it is entered or from all."""
    for batch in batches:
        sizes = np.cumsum([len(k) for k in batch.column("kinds").to_pylist()])
        low = 0
        while low < len(batch):
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + ROWS)))
            part = batch.slice(low, high - low)
            low = high
            starts = [[e] for e in part.column("entry").to_pylist()] if entered else [[0, 1, 2, 3]] * len(part)
            yield part, least_audits([(_free(k), np.array(e), s) for k, e, s in zip(part.column("kinds").to_pylist(), part.column("end").to_pylist(), starts)])


def _all_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, found in _in_groups(batches, False):
        exits = pa.array([[state for _, state in four] for four in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("segment"), exits], names=["conv_id", "segment", "exits"])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, found in _in_groups(batches, True):
        audit = pa.array([one[0][0] for one in found], pa.string())
        yield pa.RecordBatch.from_arrays([part.column("segment"), part.column("entry"), audit], names=["segment", "entry", "audit"])


# The repaired conversations -----------------------------------------------------------------------

_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_repaired long"


class _Conversation:
    """Counts and digest of one conversation, fed with its segments and rows in order."""

    def __init__(self, conv: int | None):
        self.conv, self.sums, self.last, self.turns, self.ends = conv, [0, 0, 0, 0], None, 0, [None, None]
        self.cost, self.state, self.lines, self.sha = 0, 0, 0, hashlib.sha256()
        self.audit: list[str] = []
        self.segment: dict | None = None
        self.at = self.letter = 0
        self.key: tuple | None = None

    def begin(self, segment: dict) -> None:
        self.segment, self.at, self.letter, self.key = segment, -1, 0, None
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.sums[k] += segment[name]
        if self.last is not None and (self.last, segment["first"]) not in _LEGAL:
            self.sums[3] += 1
        self.last = segment["last"]
        if segment["first_turn"] is not None:
            self.turns += segment["turns"] - (self.ends[1] == segment["first_turn"])
            self.ends = [segment["first_turn"] if self.ends[0] is None else self.ends[0], segment["last_turn"]]

    def line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def insert(self) -> None:
        self.state = int(INSERTED[self.state])
        self.line(ROLE[self.state], "")
        self.audit.append("I")
        self.cost += 2

    def row(self, turn: int | None, role: str, digest: bytes, text: str) -> None:
        if (turn, role, digest) == self.key:
            return  # a copy: its record has been met
        self.key, self.at = (turn, role, digest), self.at + 1
        kind, n = self.segment["kinds"][self.at], self.segment["n"][self.at]
        if not kind & FORCED:
            n -= 1
            letters = self.segment["audit"]
            while letters[self.letter] == "I":
                self.insert()
                self.letter += 1
            letter = letters[self.letter]
            self.letter += 1
            self.audit.append(letter)
            self.state = int(_NEXT[kind & 3, LETTERS.index(letter), self.state])
            if letter == "D":
                self.cost += 3
            else:
                self.cost += (2 if letter == "R" else 0) + (kind >> 2 & 1)
                self.line(ROLE[self.state] if letter == "R" else role, text)
        if n:
            self.audit.append("D" * n)
            self.cost += 3 * n

    def result(self) -> tuple:
        for _ in range(END_INSERTS[self.state]):
            self.insert()
        gaps = self.ends[1] - self.ends[0] + 1 - self.turns if self.ends[0] is not None else 0
        return (self.conv, gaps, *self.sums, self.cost, "".join(self.audit), self.sha.hexdigest(), self.lines)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 7 + [pa.string(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in _RESULT.split(", ")]
    held: _Conversation | None = None
    ready: list[tuple] = []
    for batch in batches:
        for conv, order, turn, role, digest, text, segment in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or held.conv != conv:
                if held is not None:
                    ready.append(held.result())
                held = _Conversation(conv)
            if order == 1:
                held.begin(segment)
            elif order == 2:
                held.row(turn, role, digest, text)
        if len(ready) >= 500:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*ready), kinds)], names=names)
            ready.clear()
    if held is not None:
        ready.append(held.result())
    if ready:
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*ready), kinds)], names=names)


def repaired(rows: DataFrame, segment_rows: int = SEGMENT) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, n as from `damaged`): conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256, n_repaired (rows of the repaired conversation).

    Null roles and texts are one space. Rows of a conversation are taken by turn, nulls first; rows of one turn by
    role and by the digest of their text, so that nothing depends on the order of the table. Repeated
    rows are there as often as they are repeated. A conversation whose rows are all dropped has zeros,
    an empty audit and the digest of the empty string; a null conv_id is a conversation of its own. Very long texts are read once and
    digested as they come; an audit is one cell. An empty table gives no rows."""
    small_batches(rows.sparkSession)
    cut = shared_table(segments(records(rows), segment_rows), "repair-segments")
    cut = cut.join(solved(cut), "segment")
    fields = ["kinds", "n", "audit", "blank", "duplicate", "truncated", "illegal", "first", "last", "first_turn", "last_turn", "turns"]
    heads = cut.select("conv_id", F.lit(1).alias("order"), "turn", "role", "digest", F.lit(None).cast("string").alias("text"), F.struct(*fields).alias("segment"))
    there = F.col("n") > 0
    said = rows.select(
        "conv_id", F.when(there, 2).otherwise(0).alias("order"), F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("role")).alias("role"),
        F.when(there, F.unhex(F.sha2("text", 256))).alias("digest"), F.when(there, F.col("text")).alias("text"), F.lit(None).cast(heads.schema["segment"].dataType).alias("segment"),
    )
    together = heads.unionByName(said).repartition("conv_id").sortWithinPartitions(*_ORDER, "order")
    return together.select("conv_id", "order", "turn", "role", "digest", "text", "segment").mapInArrow(_digested, _RESULT)


def repaired_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`repaired` of the damaged conversations; other columns of the table are not read."""
    return repaired(damaged(conversations, conv_col, turn_col, role_col, text_col))
