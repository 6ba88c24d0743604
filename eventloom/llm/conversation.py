"""Conversation structure repair: the cheapest edits that give roles of the form `(s?(ua)+)?`, found online.

A conversation's rows are read in order once, as a Viterbi search over four
states: nothing kept, system, user or assistant kept last. The decisions lie in
a tree of backpointers. A node whose last child goes is freed, and as soon as
all surviving states share an ancestor, the edits up to it leave. A state that
another one can imitate for strictly less is no survivor; without that the path
that deletes everything would survive for ever. So memory follows the
unresolved suffix, of which a row takes some bytes: texts are not held here but
joined to the edits afterwards.

Ties go to the ASCII-least edits. For each pair of survivors the first letters
in which their complete unresolved suffixes differ are carried along, so that a
tie costs no walk back, however long the suffix.

Rows are ordered by turn (nulls first), role and text; repeated rows stand next
to each other and all but the first are duplicates. Null roles and texts count
as one space, and a null conversation id is a conversation. Empty texts are
blank. Rows of one conversation pass through one task, as a stream: very long
texts and conversations are never held, except for what a conversation's audit
and unresolved edits take. Extra columns are not looked at; an empty table has
no edits.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\x0b\f\r"
FAULTS = ["blank", "duplicate", "truncated"]

START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state after a row that is made to fit, or put in.
FITTING = [USER, USER, ASSISTANT, USER]
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What a state pays at most to end as another one does: rows put in, or a system row deleted.
IMITATES = {
    START: {SYSTEM: 0, ASSISTANT: 0, USER: INSERT},
    SYSTEM: {START: max(2 * INSERT, DELETE), ASSISTANT: 2 * INSERT, USER: INSERT},
    USER: {START: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {START: DELETE, SYSTEM: 0, USER: INSERT},
}


class Tree:
    """Backpointers with counts of references; slots of freed nodes are used again."""

    def __init__(self):
        self.parent, self.place = array("q", [-1]), array("q", [0])
        self.kids, self.sum = array("q", [0]), array("q", [0])  # number of children and the sum of their slots
        self.letter, self.state = bytearray(1), bytearray(1)
        self.free: list[int] = []
        self.root = 0

    def add(self, parent: int, letter: str, state: int, place: int) -> int:
        fields = (parent, place, 0, 0, ord(letter), state)
        columns = (self.parent, self.place, self.kids, self.sum, self.letter, self.state)
        if self.free:
            at = self.free.pop()
            for column, value in zip(columns, fields):
                column[at] = value
        else:
            at = len(self.parent)
            for column, value in zip(columns, fields):
                column.append(value)
        self.kids[parent] += 1
        self.sum[parent] += at
        return at

    def prune(self, at: int, heads: set[int]) -> None:
        """Free at and its ancestors as far as nothing refers to them."""
        while at != self.root and not self.kids[at] and at not in heads:
            up = self.parent[at]
            self.kids[up] -= 1
            self.sum[up] -= at
            self.free.append(at)
            at = up

    def settled(self, heads: set[int]) -> Iterator[tuple[str, int, int]]:
        """(letter, state, place) of the decisions that all heads share; they leave the tree."""
        while self.kids[self.root] == 1 and self.root not in heads:
            gone, self.root = self.root, self.sum[self.root]
            self.free.append(gone)
            yield chr(self.letter[self.root]), self.state[self.root], self.place[self.root]


def _first_difference(a: str, b: str) -> tuple[str, str]:
    """What is left of two strings after the prefix they share; of different letters the first ones."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    return (a[0], b[0]) if a and b else (a, b)


class Search:
    """The survivors of one conversation: per state its cost and its node, per pair where their suffixes differ."""

    def __init__(self):
        self.tree = Tree()
        self.cost, self.node = {START: 0}, {START: 0}
        self.differ: dict[tuple[int, int], tuple[str, str]] = {}

    def _before(self, one: tuple, other: tuple) -> bool:
        """Whether the way (cost, state before, letters) is better than the other one."""
        if one[0] != other[0]:
            return one[0] < other[0]
        a, b = self._tails(one, other)
        return a < b

    def _tails(self, one: tuple, other: tuple) -> tuple[str, str]:
        a, b = ("", "") if one[1] == other[1] else self.differ[one[1], other[1]]
        return _first_difference(a + one[2], b + other[2])

    def _take(self, ways: dict[int, tuple], place: int) -> Iterator[tuple[str, int, int]]:
        """Make the best ways, one per state, the survivors; what is settled by that leaves."""
        for state in list(ways):
            if any(x in ways and ways[x][0] + more < ways[state][0] for x, more in self.imitated(state)):
                del ways[state]
        differ = {(s, t): self._tails(v, w) for s, v in ways.items() for t, w in ways.items() if s != t}
        old, heads = self.node, {}
        for state, (_, before, letters) in ways.items():
            at, now = old[before], before
            for letter in letters:
                now = state if letter not in "I" else FITTING[now]
                at = self.tree.add(at, letter, now, -1 if letter == "I" else place)
            heads[state] = at
        live = set(heads.values())
        for at in set(old.values()):
            self.tree.prune(at, live)
        self.cost, self.node, self.differ = {s: w[0] for s, w in ways.items()}, heads, differ
        yield from self.tree.settled(live)

    @staticmethod
    def imitated(state: int) -> list[tuple[int, int]]:
        return [(x, more[state]) for x, more in IMITATES.items() if state in more]

    def _with_inserts(self) -> dict[int, tuple]:
        """The best way to every state by rows put in here."""
        ways = {s: (c, s, "") for s, c in self.cost.items()}
        for _ in range(3):
            for state, (cost, before, letters) in list(ways.items()):
                way, to = (cost + INSERT, before, letters + "I"), FITTING[state]
                if to not in ways or self._before(way, ways[to]):
                    ways[to] = way
        return ways

    def row(self, place: int, initial: str, fault: str | None) -> Iterator[tuple[str, int, int]]:
        """Take a row; yields the edits that are settled by it."""
        ways: dict[int, tuple] = {}
        stays = TRUNCATED if fault == "truncated" else 0
        for state, (cost, before, letters) in self._with_inserts().items():
            edits = [("D", state, DELETE)]
            if fault not in ("blank", "duplicate"):
                edits.append(("R", FITTING[state], REROLE + stays))
                if (to := AFTER.get((state, initial))) is not None:
                    edits.append(("K", to, stays))
            for letter, to, price in edits:
                way = (cost + price, before, letters + letter)
                if to not in ways or self._before(way, ways[to]):
                    ways[to] = way
        yield from self._take(ways, place)

    def end(self) -> Iterator[tuple[str, int, int]]:
        """The edits that were still open."""
        ways = self._with_inserts()
        best = None
        for state in (START, ASSISTANT):
            if state in ways and (best is None or self._before(ways[state], ways[best])):
                best = state
        yield from self._take({best: ways[best]}, -1)


def numbered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, place, turn, role, text, fault, illegal): the rows in order, with their first fault.

    One shuffle by conversation serves the order, the search for repeated rows
    and the neighbours' roles.
    """
    named = rows.select(
        rows[conv].alias("conv"), rows[turn].alias("turn"),
        F.coalesce(rows[role].cast("string"), F.lit(" ")).alias("role"), F.coalesce(rows[text].cast("string"), F.lit(" ")).alias("text"),
    ).repartition("conv")
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    known = Window.partitionBy("conv", "role", "_key").orderBy("place")
    last = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    fault = (
        F.when(last == "", "blank").when(F.col("_again") > 1, "duplicate").when(~F.right(last, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    return (
        named.withColumns({"_key": F.sha2("text", 256), "place": F.row_number().over(order).cast("bigint"),
                           "_pair": F.concat(F.lag(initial).over(order), initial)})
        .withColumn("_again", F.row_number().over(known))
        .select("conv", "place", "turn", "role", "text", fault.alias("fault"),
                F.coalesce(~F.col("_pair").isin("su", "ua", "au"), F.lit(False)).alias("illegal"))
    )


def find_edits(rows: DataFrame) -> DataFrame:
    """(conv, at, place, edit, new_role) from rows (conv, place, role, fault): the edits in order.

    edit is K(eep), R(erole), D(elete) or I(nsert); place is null for an insert,
    new_role is null for rows that keep theirs.
    """
    narrow = rows.select("conv", "place", F.substring("role", 1, 1).alias("initial"), "fault")
    narrow = narrow.repartition("conv").sortWithinPartitions("conv", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, conv, at, kind = None, None, 0, None
        out: list[tuple] = []

        def put(edits: Iterator[tuple[str, int, int]]) -> None:
            nonlocal at
            for letter, state, place in edits:
                at += 1
                out.append((conv, at, None if letter == "I" else place, letter, ROLES[state] if letter in "RI" else None))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 5
            out.clear()
            types = [kind, pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["conv", "at", "place", "edit", "new_role"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for b in batches:
            kind = b.schema.field("conv").type
            for own, place, initial, fault in zip(*(b.column(i).to_pylist() for i in range(4))):
                if search is None or own != conv:
                    if search is not None:
                        put(search.end())
                    search, conv, at = Search(), own, 0
                put(search.row(place, initial, fault))
            yield batch()
        if search is not None:
            put(search.end())
            yield batch()

    kind = rows.schema["conv"].dataType.simpleString()
    return narrow.mapInArrow(run, f"conv {kind}, at bigint, place bigint, edit string, new_role string")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edits with the rows they stand for: conv, at, edit, turn, role, text, fault, illegal, cost.

    `edit <> 'D'` are the repaired conversations, ordered by at. role is the
    role after the edit; rows put in have an empty text and a null turn. illegal
    says that the row and the one before it had roles that don't follow each other.
    """
    known = written(numbered(rows, conv, turn, role, text)).alias("r")
    edits = find_edits(known).alias("e")
    same = F.col("e.conv").eqNullSafe(F.col("r.conv")) & (F.col("e.place") == F.col("r.place"))
    stays = F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0)
    cost = F.when(F.col("edit") == "D", DELETE).when(F.col("edit") == "I", INSERT).when(F.col("edit") == "R", REROLE + stays).otherwise(stays)
    return edits.join(known, same, "left").select(
        F.col("e.conv").alias("conv"), "at", "edit", "turn", F.coalesce("new_role", "role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), "fault", F.coalesce("illegal", F.lit(False)).alias("illegal"),
        cost.cast("bigint").alias("cost"),
    )


SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def summaries(edits: DataFrame) -> DataFrame:
    """Per conversation of `repair`: counts of faults, cost, the edits as a string, a digest of what is left."""
    kind = edits.schema["conv"].dataType.simpleString()
    fields = ["conv", "edit", "turn", "role", "text", "fault", "illegal", "cost"]
    sorted_ = edits.repartition("conv").sortWithinPartitions("conv", "at").select(*fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kept, state = [f.split()[0] for f in SUMMARY.split(", ")], None, None

        def closed() -> pa.RecordBatch:
            gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
            values = [state["conv"], gaps, *(state[f] for f in FAULTS), state["illegal"], state["cost"],
                      state["audit"].decode(), state["hash"].hexdigest()]
            types = [kept, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["conv", *names])

        for b in batches:
            kept = b.schema.field("conv").type
            for conv, edit, turn, role, text, fault, illegal, cost in zip(*(b.column(i).to_pylist() for i in range(len(fields)))):
                if state is None or state["conv"] != conv:
                    if state is not None:
                        yield closed()
                    state = dict.fromkeys([*FAULTS, "illegal", "cost", "turns"], 0)
                    state |= {"conv": conv, "low": None, "high": None, "audit": bytearray(), "hash": hashlib.sha256(), "first": True}
                state["audit"] += edit.encode()
                state["cost"] += cost
                state["illegal"] += illegal
                if fault:
                    state[fault] += 1
                if turn is not None and turn != state["high"]:  # turns come in order
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["high"] = turn
                    state["turns"] += 1
                if edit != "D":
                    state["hash"].update(("" if state["first"] else "\n").encode() + f"{role}:{text}".encode())
                    state["first"] = False
        if state is not None:
            yield closed()

    return sorted_.mapInArrow(run, f"conv {kind}, {SUMMARY}")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations with known faults: by a checksum, rows are dropped, emptied, cut, repeated or given another role."""
    known: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(known[0], F.lit(":"), known[1])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(known[3], ".!?", "")).otherwise(known[3])
    role = F.when(kind == 4, "user").otherwise(known[2])
    copies = F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, the cheapest edits and a digest of the repaired turns."""
    conversations = table(spark, sf_dir, "conversations")
    found = summaries(repair(damaged(conversations)))
    every = conversations.select("conv_id").distinct()
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    columns = [f.split()[0] for f in SUMMARY.split(", ")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(nothing.get(c, 0))).alias(c) for c in columns]
    )
