"""Conversation repair: the cheapest edits that make roles alternate, by a parallel Viterbi search with rank convergence.

Edits are Keep (0), Rerole to user or assistant (1), Delete (2) and Insert of an empty turn of user or assistant (5). Blank and repeated turns must be
deleted, and a truncated turn that stays costs 5 more. What remains has role initials `(s?(ua)+)?`, which a machine of four states accepts: nothing yet, after
s, after u, after a.

A conversation is cut into chunks of consecutive turns, so one of any length is spread over tasks. Backward costs of the four states at a chunk's start follow from those at
its end. All chunks begin at once, from a speculative end vector of zeros unless they end a conversation. Then fix-up passes give each chunk the start vector of the next one;
a chunk reruns from its end only until its vectors and the earlier ones differ by a constant, after which nothing changes but that constant. Passes go on
until no vector changes. The constants are added up to the cost of a conversation. From the settled vectors every chunk finds the states in which it can be left, and
the least audit is traced from the state in which it is entered.

The next state is settled by state and edit alone, so one state at a time is traced; of equally cheap edits the one whose initial is least in ASCII is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyspan.llm.common import SPACE_CLASS, settle
from tallyspan.operators.ordering import positions

#: Turns of a chunk at most.
CHUNK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, BRIEFED, ASKED, ANSWERED = range(4)
#: Where an added or renamed turn leads to, and which role it has.
_NEXT = (ASKED, ASKED, ANSWERED, ASKED)
_ROLE = ("user", "user", "assistant", "user")
#: Where a kept turn leads to, by the initial of its role.
_KEPT = {"s": {START: BRIEFED}, "u": {START: ASKED, BRIEFED: ASKED, ANSWERED: ASKED}, "a": {ASKED: ANSWERED}}
_INITIALS = "sua-"
FINE, SHORT, GONE = range(3)
Vector = tuple[int, ...]
UNKNOWN: Vector = (0, 0, 0, 0)


def _with_inserts(costs: list[int]) -> Vector:
    for _ in range(3):
        costs = [min(c, INSERT + costs[_NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


#: Backward costs where a conversation ends: it may do so empty or after an assistant.
END: Vector = _with_inserts([0, 1000, 1000, 0])


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a turn in a state: (initial, cost, next state), by initial."""
    initial, fault = _INITIALS[symbol // 3], symbol % 3
    moves = [("D", DELETE, state)]
    if fault != GONE:
        more = TRUNCATED if fault == SHORT else 0
        if state in _KEPT.get(initial, {}):
            moves.append(("K", KEEP + more, _KEPT[initial][state]))
        moves.append(("R", REROLE + more, _NEXT[state]))
    return moves


class Machine:
    """Backward costs and traces; what was found once for a vector and a turn is kept, as few vectors differ by more than a constant."""

    def __init__(self) -> None:
        self._steps: dict[tuple[Vector, int], tuple[Vector, int]] = {}
        self._traces: dict[tuple[Vector, int, int], tuple[str, int]] = {}

    def back(self, after: Vector, symbol: int) -> tuple[Vector, int]:
        """Costs before a turn, least taken off, and what was taken off."""
        if (found := self._steps.get((after, symbol))) is None:
            costs = _with_inserts([min(c + after[t] for _, c, t in _moves(symbol, s)) for s in range(4)])
            least = min(costs)
            found = self._steps[after, symbol] = tuple(c - least for c in costs), least
        return found

    def start(self, symbols: list[int], end: Vector) -> tuple[Vector, int]:
        """Costs before the first turn, with what was taken off on the way."""
        taken = 0
        for symbol in reversed(symbols):
            end, least = self.back(end, symbol)
            taken += least
        return end, taken

    def fix(self, symbols: list[int], old: Vector, new: Vector) -> tuple[Vector | None, int]:
        """The new start vector, None if it is the old one, and by how much more is taken off with the new end than with the old one."""
        more = 0
        for symbol in reversed(symbols):
            old, a = self.back(old, symbol)
            new, b = self.back(new, symbol)
            more += b - a
            if old == new:
                return None, more
        return new, more

    def trace(self, symbol: int, after: Vector, state: int) -> tuple[str, int]:
        """Initials of the least audit of a turn in a state, inserts before it included, and the next state."""
        if (found := self._traces.get((after, symbol, state))) is None:
            before, taken = self.back(after, symbol)
            edits, s = "", state
            while True:
                now = before[s] + taken
                options = [(name, t) for name, c, t in _moves(symbol, s) if c + after[t] == now]
                if INSERT + before[_NEXT[s]] == before[s]:
                    options.append(("I", _NEXT[s]))
                name, s = min(options)
                edits += name
                if name != "I":
                    break
            found = self._traces[after, symbol, state] = edits, s
        return found

    def vectors(self, symbols: list[int], end: Vector) -> list[Vector]:
        """The vector after every turn."""
        found = [end]
        for symbol in reversed(symbols[1:]):
            found.append(self.back(found[-1], symbol)[0])
        return found[::-1]

    def exits(self, symbols: list[int], end: Vector) -> list[int]:
        """The state at the end for every state at the start."""
        after = self.vectors(symbols, end)
        states = [0, 1, 2, 3]
        for symbol, v in zip(symbols, after, strict=True):
            states = [self.trace(symbol, v, s)[1] for s in states]
        return states


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    parts = [c.strip().split(" ") for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in parts]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, parts, strict=True)], names=[n for n, _ in parts])


def _each(function, schema: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = Machine()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            yield _batch([row for x in batch.slice(i, 256).to_pylist() for row in function(machine, x)], schema)


GUESSED = "first bigint, end array<int>, start array<int>, taken bigint"


def _guess(machine: Machine, x: dict) -> list[tuple]:
    end = UNKNOWN if x["more"] else END
    start, taken = machine.start(x["symbols"], end)
    return [(x["first"], end, start, taken)]


def _fixed(machine: Machine, x: dict) -> list[tuple]:
    start, more = machine.fix(x["symbols"], tuple(x["end"]), tuple(x["actual"]))
    return [(x["first"], x["actual"], x["start"] if start is None else start, x["taken"] + more)]


def _exits(machine: Machine, x: dict) -> list[tuple]:
    return [(x["first"], machine.exits(x["symbols"], tuple(x["end"])))]


MARKS = "position bigint, before array<string>, edit string, new_role string, after array<string>"


def _inserted(state: int, times: int) -> tuple[list[str], int]:
    """Roles of so many inserts from a state on, and the state they lead to."""
    roles = []
    for _ in range(times):
        roles.append(_ROLE[state])
        state = _NEXT[state]
    return roles, state


def _marks(machine: Machine, x: dict) -> list[tuple]:
    """For every turn: roles inserted before it, its edit, the role that a rerole gives, roles inserted after it."""
    state, rows = x["entry"], []
    for i, (symbol, v) in enumerate(zip(x["symbols"], machine.vectors(x["symbols"], tuple(x["end"])), strict=True)):
        edits, next_state = machine.trace(symbol, v, state)
        before, at = _inserted(state, len(edits) - 1)
        rows.append([x["first"] + i, before, edits[-1], _ROLE[at] if edits[-1] == "R" else None, []])
        state = next_state
    if not x["more"]:
        rows[-1][4] = _inserted(state, END[state] // INSERT)[0]
    return [tuple(r) for r in rows]


@dataclass(frozen=True)
class Plan:
    """`turns`: the turns in order, with their faults and edits. `costs`: rows (conv_id, cost)."""

    turns: DataFrame
    costs: DataFrame


def _faulty(turns: DataFrame) -> DataFrame:
    """Turns in order, with position, fault (blank, duplicate, truncated or none) and symbol."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"))
    placed = positions(rows, ["conv_id", "turn", "role", "text", F.monotonically_increasing_id()])
    # Texts of a role meet by their digest; the first place of each is found by partial minima, so a text that is everywhere makes no large group.
    first = placed.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("position").alias("position")).select("position", F.lit(True).alias("is_first"))
    ended = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1)
    fault = (F.when(~F.col("text").rlike(f"[^{SPACE_CLASS}]"), "blank").when(F.col("is_first").isNull(), "duplicate")
             .when(~ended.isin(".", "!", "?"), "truncated"))
    initial = F.substring("role", 1, 1)
    symbol = 3 * F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + (
        F.when(F.col("fault") == "truncated", SHORT).when(F.col("fault").isNotNull(), GONE).otherwise(FINE))
    return settle(placed.join(first, "position", "left").withColumn("fault", fault).withColumn("symbol", symbol).drop("is_first"), "turns")


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (conv_id, first, last, symbols, more, previous): chunks of at most `size` turns, whether another follows, and where the one before begins."""
    block = F.floor((F.col("position") - 1) / size)
    symbols = F.transform(F.array_sort(F.collect_list(F.struct("position", "symbol"))), lambda x: x["symbol"].cast("int"))
    chunks = rows.groupBy("conv_id", block.alias("block")).agg(
        F.min("position").alias("first"), F.max("position").alias("last"), symbols.alias("symbols"))
    chunks = settle(chunks.select("conv_id", "first", "last", "symbols"), "chunks")
    ends = chunks.select(F.col("last").alias("l"), F.col("first").alias("previous"), F.col("conv_id").alias("pc"))
    starts = chunks.select(F.col("first").alias("f"), F.col("conv_id").alias("nc"))
    before = (F.col("first") == F.col("l") + 1) & F.col("conv_id").eqNullSafe(F.col("pc"))
    after = (F.col("last") + 1 == F.col("f")) & F.col("conv_id").eqNullSafe(F.col("nc"))
    linked = chunks.join(ends, before, "left").join(starts, after, "left")
    return settle(linked.select("conv_id", "first", "last", "symbols", F.col("f").isNotNull().alias("more"), "previous"), "chunks")


def _converge(chunks: DataFrame) -> DataFrame:
    """Rows (first, end, start, taken) of all chunks with the end vectors that hold."""
    found = settle(chunks.select("first", "symbols", "more").mapInArrow(partial(_each, _guess, GUESSED), GUESSED), "vectors")
    while True:
        next_ = found.select(F.col("first").alias("f"), F.col("start").alias("actual"))
        wrong = chunks.filter("more").select("first", "last", "symbols").join(found, "first").join(next_, F.col("last") + 1 == F.col("f")).filter("actual <> end")
        fixed = settle(wrong.select("first", "symbols", "end", "start", "taken", "actual").mapInArrow(partial(_each, _fixed, GUESSED), GUESSED), "fixed")
        if fixed.isEmpty():
            return found
        found = settle(found.join(fixed.select("first"), "first", "left_anti").unionByName(fixed), "vectors")


def _entries(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows (first, entry): the state in which each chunk is entered.

    The states that a chunk can be left in depend on those it is entered in; where they do not, nothing before matters. What is left is put together over
    twice as many chunks in each pass.
    """
    left = chunks.filter("more").join(vectors, "first").select("first", "symbols", "end")
    exits = settle(left.mapInArrow(partial(_each, _exits, "first bigint, exits array<int>"), "first bigint, exits array<int>"), "exits")
    same = F.forall("exits", lambda s: s == F.col("exits")[0])
    known = chunks.select("first", "previous").join(exits.withColumnRenamed("first", "previous"), "previous", "left")
    known = known.select("first", F.coalesce("exits", F.array(*[F.lit(START)] * 4)).alias("exits"), "previous")
    known = settle(known.withColumn("previous", F.when(~same, F.col("previous"))), "entries")
    while not known.filter("previous is not null").isEmpty():
        other = known.select(F.col("first").alias("previous"), F.col("exits").alias("of"), F.col("previous").alias("before"))
        joined = known.join(other, "previous", "left").select(
            "first", F.when(F.col("of").isNull(), F.col("exits")).otherwise(F.transform("of", lambda s: F.col("exits")[s])).alias("exits"), F.col("before").alias("previous"))
        known = settle(joined.withColumn("previous", F.when(~same, F.col("previous"))), "entries")
    return known.select("first", F.col("exits")[0].alias("entry"))


def plan_repair(turns: DataFrame, chunk: int = CHUNK) -> Plan:
    """The cheapest repair of every conversation.

    Turns are taken by `turn`, nulls first, then by role and text; repeated rows are duplicates of the first. A null role or text is one space, hence such a
    text is blank. A role counts by its first letter; one that is none of s, u and a cannot be kept. A null conv_id is a conversation of its own. Other columns are ignored;
    an empty table gives empty ones. A duplicate has the role and text of an earlier turn of its conversation, a truncated turn does not end in `.`, `!` or `?`
    but for white space; of several faults the first named counts. `turns` has (conv_id, turn, role, text, position, fault, before, edit, new_role, after).
    """
    rows = _faulty(turns)
    chunks = _chunks(rows, chunk)
    vectors = _converge(chunks)
    chunks = chunks.join(vectors, "first")
    costs = chunks.groupBy("conv_id").agg((F.sum("taken") + F.sum(F.when(F.col("previous").isNull(), F.col("start")[START]).otherwise(0))).alias("cost"))
    entries = _entries(chunks.select("conv_id", "first", "last", "symbols", "more", "previous"), vectors)
    traced = chunks.join(entries, "first").select("first", "symbols", "end", "entry", "more")
    marks = settle(traced.mapInArrow(partial(_each, _marks, MARKS), MARKS), "marks")
    return Plan(rows.drop("symbol").join(marks, "position"), settle(costs, "costs"))


class _Report:
    """What is told of one conversation, turn after turn; its repaired text is digested on the way and never held."""

    def __init__(self) -> None:
        self.digest, self.written = hashlib.sha256(), False
        self.audit: list[str] = []
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.initial = 0, None
        self.least = self.most = self.turn = None
        self.turns = 0

    def _write(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.written else "") + f"{role}:{text}").encode())
        self.written = True

    def take(self, turn: int | None, role: str, text: str, fault: str | None, before: list[str], edit: str, new_role: str | None, after: list[str]) -> None:
        if fault:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None:
            self.turns += turn != self.turn
            self.turn = self.most = turn
            self.least = turn if self.least is None else self.least
        self.audit.append("I" * len(before) + edit + "I" * len(after))
        for added in before:
            self._write(added, "")
        if edit != "D":
            self._write(new_role or role, text)
        for added in after:
            self._write(added, "")

    def row(self, key: int | None) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return key, gaps, *self.faults.values(), self.illegal, "".join(self.audit), self.digest.hexdigest()


REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, audit string, repaired_sha256 string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, report = None, None
    for batch in batches:
        done = []
        for conv, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if report is None or conv != key:
                if report is not None:
                    done.append(report.row(key))
                key, report = conv, _Report()
            report.take(*turn)
        if done:
            yield _batch(done, REPORT)
    if report is not None:
        yield _batch([report.row(key)], REPORT)


def report(plan: Plan, conversations: DataFrame) -> DataFrame:
    """One row for every conv_id of `conversations`: rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    A conversation without turns in the plan has zeros, an empty audit and the digest of nothing. Its turns pass one by one, so memory follows its audit, which is
    one letter for each edit.
    """
    rows = plan.turns.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    told = rows.select("conv_id", "turn", "role", "text", "fault", "before", "edit", "new_role", "after").mapInArrow(_report, REPORT)
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    told = told.join(plan.costs.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    told = told.withColumnRenamed("conv_id", "t")
    both = ids.join(told, F.col("conv_id").eqNullSafe(F.col("t")), "left")
    numbers = [F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repaired_turns(plan: Plan) -> DataFrame:
    """The repaired conversations: rows (conv_id, position, part, role, text), in order of position and part; inserted turns have empty texts."""
    def added(roles: str, part: int) -> Column:
        return F.transform(roles, lambda r, k: F.struct((k + part).alias("part"), r.alias("role"), F.lit("").alias("text")))

    own = F.array(F.struct(F.lit(0).alias("part"), F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text")))
    lines = F.concat(added("before", -1000), F.filter(own, lambda _: F.col("edit") != "D"), added("after", 1))
    return plan.turns.select("conv_id", "position", F.explode(lines).alias("x")).select("conv_id", "position", "x.part", "x.role", "x.text")


def damage(turns: DataFrame) -> DataFrame:
    """Rows with the faults of the trial: by checksum of `conv_id:turn` modulo 20, 0 drops a row, 1 empties its text, 2 removes `.!?`, 3 repeats it, 4 makes it the user's.

    Nulls are one space, in the checksum's text too; null turns stay null.
    """
    space = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = rows.withColumn("kind", kind).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n")).drop("n")
