"""Conversation structure repair: survivor-coalescence Viterbi.

A conversation's role initials should read ``(s?(ua)+)?``. Each row is kept, given another role or deleted, and empty
rows may be inserted; the cheapest edits win, of equally cheap ones the letters that sort first. Rows stream through a
Python worker in order, one conversation after another, and four states of the grammar compete. Every survivor is a
node of a backpointer tree whose nodes count their children: a node without any is freed, and as soon as a row has one
live node left, all survivors descend from it and its edits are emitted. Survivors that can't win any more are let go, so
that the rest meet soon: without that, the one that has deleted all rows so far would live on for ever.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States are the last role of the repaired rows: none, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a row with a free choice of role leads to, and the inserts that end a conversation there.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What it costs at most to go on from the first state as from the second: by inserts, by deleting a system row that
#: only the start may keep, or by closing inserts. A survivor dearer than another by more can neither win nor tie.
AS_FROM = {
    (SYSTEM, START): 4, (USER, START): 5, (ASSISTANT, START): 3,
    (START, SYSTEM): 0, (USER, SYSTEM): 2, (ASSISTANT, SYSTEM): 0,
    (START, USER): 2, (SYSTEM, USER): 2, (ASSISTANT, USER): 2,
    (START, ASSISTANT): 0, (SYSTEM, ASSISTANT): 4, (USER, ASSISTANT): 2,
}
#: Bytes of unresolved rows that stay in memory; further ones wait in an unnamed file.
HELD = 8 << 20
WORDLIKE = r"[^\x20\x09-\x0D]"


def _moves() -> dict[tuple[str, bool], list[list[tuple[str, int, int]]]]:
    """For each role initial and whether the row must go: by state, (letters, next state, cost). Two inserts reach
    every state, so more are never the cheapest."""
    found = {}
    for initial in ("s", "u", "a", ""):
        for must_go in (False, True):
            by_state: list[list[tuple[str, int, int]]] = [[] for _ in range(4)]
            for state in range(4):
                at = state
                for inserts in range(3):
                    letters, cost = "I" * inserts, INSERT * inserts
                    by_state[state].append((letters + "D", at, cost + DELETE))
                    if not must_go:
                        by_state[state].append((letters + "R", NEXT[at], cost + REROLE))
                        if initial == "s" and at == START:
                            by_state[state].append((letters + "K", SYSTEM, cost + KEEP))
                        elif initial and initial == ROLE[NEXT[at]][0]:
                            by_state[state].append((letters + "K", NEXT[at], cost + KEEP))
                    at = NEXT[at]
            found[initial, must_go] = by_state
    return found


_MOVES = _moves()


class Node:
    __slots__ = ("up", "letters", "children", "peers")

    def __init__(self, up: Node | None, letters: str, peers: list[Node]):
        self.up, self.letters, self.children, self.peers = up, letters, 0, peers


class Waiting:
    """Rows whose edits aren't settled, first in, first out; beyond ``HELD`` bytes they wait in a file."""

    def __init__(self, held: int = HELD):
        self.held, self.bytes, self.near, self.file, self.read_at, self.filed = held, 0, deque(), None, 0, 0

    def put(self, row: tuple) -> None:
        size = len(row[2]) + len(row[3]) + 64
        if not self.filed and self.bytes + size <= self.held:
            self.near.append((size, row))
            self.bytes += size
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        pickle.dump(row, self.file)
        self.filed += 1

    def take(self) -> tuple:
        if self.near:
            size, row = self.near.popleft()
            self.bytes -= size
            return row
        self.file.seek(self.read_at)
        row = pickle.load(self.file)
        self.read_at = self.file.tell()
        self.filed -= 1
        if not self.filed:
            self.file.close()
            self.file, self.read_at = None, 0
        return row


class Repair:
    """The edits of one conversation. Rows are (turn, fault, role, text); edits (letter, turn, fault, role before,
    role after, text).

    Survivors carry their cost and their rank among the survivors' letters. The letters of a row, inserts before
    it and its own, are no prefix of those of another choice, so of two survivors the one whose parent ranks
    first has the smaller whole string, whatever follows; ranks stand for the complete unresolved suffixes.
    """

    def __init__(self, held: int = HELD):
        self.root = Node(None, "", [])
        self.survivors = {START: (0, 0, self.root)}
        self.layers: deque[list[Node]] = deque()
        self.waiting, self.state = Waiting(held), START

    def push(self, row: tuple) -> Iterator[tuple]:
        _, fault, role, _ = row
        self.waiting.put(row)
        moves = _MOVES[role[:1] if role[:1] in ("s", "u", "a") else "", fault in ("blank", "duplicate")]
        extra = TRUNCATED if fault == "truncated" else 0
        best: dict[int, tuple] = {}
        for state, (cost, rank, node) in self.survivors.items():
            for letters, to, more in moves[state]:
                total = cost + more + (extra if letters[-1] != "D" else 0)
                found = (total, rank, letters, node)
                if to not in best or found[:3] < best[to][:3]:
                    best[to] = found
        costs = {to: found[0] for to, found in best.items()}
        for (one, other), more in AS_FROM.items():
            if one in costs and other in costs and costs[other] > costs[one] + more:
                best.pop(other, None)
        layer: list[Node] = []
        before = [node for _, _, node in self.survivors.values()]
        self.survivors = {}
        for rank, (to, (cost, _, letters, up)) in enumerate(sorted(best.items(), key=lambda x: x[1][1:3])):
            up.children += 1
            node = Node(up, letters, layer)
            layer.append(node)
            self.survivors[to] = (cost, rank, node)
        self.layers.append(layer)
        for node in before:
            self.free(node)
        while self.layers and len(self.layers[0]) == 1:
            yield from self.settle(self.layers.popleft()[0].letters)

    def free(self, node: Node) -> None:
        while node.up is not None and not node.children:
            up, node.up = node.up, None
            node.peers.remove(node)
            up.children -= 1
            node = up

    def settle(self, letters: str) -> Iterator[tuple]:
        for letter in letters[:-1]:
            yield self.inserted()
        turn, fault, role, text = self.waiting.take()
        letter, after = letters[-1], None
        if letter == "K":
            after = role
            self.state = SYSTEM if role[:1] == "s" else NEXT[self.state]
        elif letter == "R":
            self.state = NEXT[self.state]
            after = ROLE[self.state]
        yield letter, turn, fault, role, after, text

    def inserted(self) -> tuple:
        self.state = NEXT[self.state]
        return "I", None, None, None, ROLE[self.state], ""

    def end(self) -> Iterator[tuple]:
        state, (_, _, node) = min(self.survivors.items(), key=lambda x: (x[1][0] + INSERT * CLOSING[x[0]], x[1][1]))
        rest = []
        for _ in self.layers:
            rest.append(node.letters)
            node = node.up
        for letters in reversed(rest):
            yield from self.settle(letters)
        for _ in range(CLOSING[state]):
            yield self.inserted()


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault`` to rows (conv_id, turn, role, text) without null roles and texts: blank, duplicate, truncated
    or null. Rows are dealt by conversation and sorted by turn (nulls first), role and text.

    Role and text are looked for earlier in that order by their SHA-256 and length, in a window that spills.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    same = Window.partitionBy("conv_id", "digest").orderBy(*order)
    digest = F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text").cast("binary"), 256)
    dealt = rows.withColumn("digest", digest).repartition(common.partitions(rows), "conv_id").withColumn("nth", F.row_number().over(same))
    fault = (
        F.when(~F.col("text").rlike(WORDLIKE), "blank")
        .when(F.col("nth") > 1, "duplicate")
        .when(~F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1).isin(".", "!", "?"), "truncated")
    )
    return dealt.withColumn("fault", fault).sortWithinPartitions("conv_id", *order, "nth").select("conv_id", "turn", "role", "text", "fault")


def repaired(conversations: DataFrame, held: int = HELD) -> DataFrame:
    """The edits that repair each conversation, as rows in order: conv_id, step (from 0), edit (K, R, D or I), turn,
    fault, role_before, role (null where deleted) and text. The repaired conversation is the rows with a role.

    Null roles and texts count as one space, a null turn comes first and null ids are one conversation; repeated rows
    and rows that share a turn follow each other by role and text. A row whose role begins with neither s, u nor a
    can't be kept as it is. A conversation's rows meet in one task, as its order asks for, but pass through it in a
    stream: what is held are the rows that several edits still compete for, texts beyond ``held`` bytes in a file.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    schema = StructType([rows.schema["conv_id"], StructField("step", LongType()), StructField("edit", StringType()), StructField("turn", LongType()), *(StructField(n, StringType()) for n in ("fault", "role_before", "role", "text"))])

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        repair, now, step = None, None, 0
        for batch in batches:
            names = ("conv_id", "turn", "fault", "role", "text")
            for conv, *row in zip(*(batch.column(n).to_pylist() for n in names)):
                if repair is None or conv != now:
                    if repair is not None:
                        for edit in repair.end():
                            yield now, step, *edit
                            step += 1
                    repair, now, step = Repair(held), conv, 0
                for edit in repair.push(tuple(row)):
                    yield now, step, *edit
                    step += 1
        if repair is not None:
            for edit in repair.end():
                yield now, step, *edit
                step += 1

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kinds = [first.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4]

        def batch(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=schema.names)

        def all_batches():
            yield first
            yield from batches

        some, size = [], 0
        for edit in edits(all_batches()):
            some.append(edit)
            size += len(edit[-1]) + 64
            if size >= common.BATCH_BYTES:
                yield batch(some)
                some, size = [], 0
        if some:
            yield batch(some)

    return with_faults(rows).mapInArrow(stream, schema)


def digests(edits: DataFrame) -> DataFrame:
    """One row for each conversation of ``repaired``: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256, folded from its edits as they come."""
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = StructType([edits.schema["conv_id"], *(StructField(n, LongType()) for n in counts), StructField("audit", StringType()), StructField("repaired_sha256", StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, one, kind = [], None, None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, step, *edit in zip(*(c.to_pylist() for c in batch.columns)):
                if step == 0:
                    if one is not None:
                        found.append(one.row())
                    one = _Digest(conv)
                one.add(*edit)
            if found:
                yield _as_batch(found, kind, schema)
                found = []
        if one is not None:
            yield _as_batch([one.row()], kind, schema)

    return edits.mapInArrow(fold, schema)


def _as_batch(rows: list[tuple], kind: pa.DataType, schema: StructType) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)


class _Digest:
    def __init__(self, conv):
        self.conv, self.letters, self.hash, self.lines = conv, [], hashlib.sha256(), 0
        self.faults, self.illegal, self.cost = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0
        self.first = self.last = self.initial = None
        self.turns = 0

    def add(self, letter, turn, fault, role_before, role, text):
        self.letters.append(letter)
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[letter] + (TRUNCATED if fault == "truncated" and letter != "D" else 0)
        if letter != "I":
            if fault:
                self.faults[fault] += 1
            initial = role_before[:1]
            if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = initial
            if turn is not None:
                self.turns += turn != self.last
                self.first = turn if self.first is None else self.first
                self.last = turn
        if role is not None:
            self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), nulls of role and text as one space, damaged by crc32 of ``conv_id:turn`` (a
    null as one space) modulo 20: 0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 gives
    it the role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def conversation_report(conversations: DataFrame) -> DataFrame:
    """Every conv_id of ``conversations`` with the digest of its repair after damage; one without rows left has zeros,
    an empty audit and the hash of nothing. A null id is a conversation of its own."""
    empty: dict[str, Column] = {n: F.lit(0).cast("long") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty |= {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    found = digests(repaired(damaged(conversations))).withColumnRenamed("conv_id", "found_id")
    every = conversations.select("conv_id").distinct()
    return every.join(found, every["conv_id"].eqNullSafe(found["found_id"]), "left").select("conv_id", *(F.coalesce(n, v).alias(n) for n, v in empty.items()))
