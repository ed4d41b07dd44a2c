"""Repair of conversation structure: the cheapest edits that make the roles of a conversation alternate.

A conversation is written as a signature, one letter a row for its role and fault. Signatures are read from their ends:
conversations that end alike share the nodes of one automaton, and what it costs to go on from a node, and the first edit
of the best way to do so, is found once for each node and grammar state, however many conversations pass it. A task gets
a range of signatures in the order of their reversed letters, so a node is made when it is first met and forgotten after
the last signature that ends in it; only the nodes of one signature are held.

Rows are sorted over ranges of (conversation, turn), so a conversation of any length is spread over tasks, and each task
cuts it into blocks of bounded size. What is in one place for each conversation is its signature, of one character a
row, as the audit that is asked for is one, and the running hash of its repaired rows, which take each block once, in
order: SHA-256 has no other order.

Letters of a signature: ``s u a o`` for a row whose role begins so (``o``: another role), in capitals where its text is
truncated, ``x`` for a row that must go, being blank or a duplicate.

Grammar states: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row; 0 and 3 may end.

Defined cases: a null conversation id is a conversation of its own, and counts as one space in the hash that damages; a
null turn comes first and counts as one space there; null roles and texts are one space; rows of one turn are ordered by
role, then text, by code points, after damage; rows that repeat are duplicates; turns may have any distance; a role
without a letter has no initial, so it is illegal beside any row; texts are read whole; other columns are ignored; a
conversation without rows after damage has zeros, an empty audit and the hash of the empty string; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialise, split_join, temporary

SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = ("su", "ua", "au")
KEEP_TRUNCATED, REROLE, DELETE, INSERT = 1, 2, 3, 2
#: A block ends with the row that reaches one of these.
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 20
#: By grammar state: the state after a row that is inserted or gets a new role, and that row's role.
NEXT, NEXT_ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: By grammar state: the state after keeping a row of that letter.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Beyond the last row: costs and edits by grammar state.
END = ((0, 4, 2, 0), ("", "I", "I", ""))


def damage(rows: DataFrame) -> DataFrame:
    """ck, turn, role, text, copies: the rows after damage, each hashed by its conversation and turn. ``ck`` tells conversations apart."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat_ws(":", conv, turn)) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    hurt = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.where(kind != 0).select(conversation_key().alias("ck"), "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), hurt.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def conversation_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def faults(damaged: DataFrame) -> DataFrame:
    """Different rows with ``copies`` and ``fault``: b blank, d duplicate of an earlier row, t truncated, or none.

    Equal rows are counted before they move. Earlier rows are found by the first turn of each (conversation, role, text).
    """
    told = materialise(
        damaged.groupBy("ck", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumns(
            {
                "shown": F.rtrim("text", F.lit(SPACE)),
                "said": F.unhex(F.md5(F.concat_ws("\x00", "ck", F.length("role"), "role", "text"))),
                "at": F.struct(F.col("turn").isNotNull().alias("told"), "turn"),
            }
        ).withColumns({"last": F.substring("shown", -1, 1), "blank": F.col("shown") == ""}).drop("shown"),
        "turns",
    )
    worded = told.where(~F.col("blank"))
    first = worded.groupBy("said").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    met = split_join(worded, first.select("said", "first"), "said", "turn", "left", counts=first.select("said", "n"))
    fault = F.when(F.col("at") != F.col("first"), "d").when(~F.col("last").isin(*ENDS), "t").otherwise("")
    shared = ["ck", "turn", "role", "text", "copies"]
    return met.select(*shared, fault.alias("fault")).unionByName(told.where("blank").select(*shared, F.lit("b").alias("fault")))


BLOCK = pa.schema(
    [("ck", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("letters", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
    + [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "least_turn")]
    + [("head", pa.string()), ("tail", pa.string())]
)
BLOCK_SQL = "ck string, part int, block long, letters string, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, least_turn long, head string, tail string"


class Block:
    """Rows of one conversation in order: their letters, the rows that may stay, and counts."""

    def __init__(self, ck: str, number: int):
        self.ck, self.number, self.rows, self.chars = ck, number, 0, 0
        self.letters, self.roles, self.texts = [], [], []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.first_turn = self.last_turn = self.least_turn = self.head = self.tail = None

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: str) -> None:
        initial = role[:1]
        if self.rows == 0:
            self.first_turn, self.head = turn, initial
        else:
            self.counts["illegal"] += self.tail + initial not in LEGAL
        self.counts["illegal"] += copies - 1
        if turn is not None and (self.rows == 0 or turn != self.last_turn):
            self.counts["turns"] += 1
            self.least_turn = turn if self.least_turn is None else self.least_turn
        if fault in ("b", "d"):
            self.counts["blank" if fault == "b" else "duplicate"] += copies
            self.letters.append("x" * copies)
        else:
            letter = initial if initial in ("s", "u", "a") else "o"
            self.letters.append((letter.upper() if fault else letter) + "x" * (copies - 1))
            self.counts["truncated"] += fault == "t"
            self.counts["duplicate"] += copies - 1
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(text)
        self.last_turn, self.tail = turn, initial
        self.rows += 1

    def row(self, part: int) -> dict:
        own = {"ck": self.ck, "part": part, "block": self.number, "letters": "".join(self.letters), "roles": self.roles, "texts": self.texts}
        return own | self.counts | {n: getattr(self, n) for n in ("first_turn", "last_turn", "least_turn", "head", "tail")}


def blocks(rows: DataFrame) -> DataFrame:
    """The rows of every conversation in order, cut into blocks (ck, part, block)."""
    spread = rows.repartitionByRange("ck", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64))
    ordered = spread.sortWithinPartitions("ck", F.col("turn").asc_nulls_first(), "role", "text").select("ck", F.col("turn").cast("long").alias("turn"), "role", "text", "copies", "fault")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, number, done, chars = TaskContext.get().partitionId(), None, 0, [], 0
        for batch in batches:
            for ck, *row in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if now is not None and (now.ck != ck or now.rows >= BLOCK_ROWS or now.chars >= BLOCK_CHARS):
                    done.append(now.row(part))
                    chars += now.chars
                    now, number = None, number + 1
                if now is None:
                    now = Block(ck, number)
                now.add(*row)
                if len(done) >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                    yield pa.RecordBatch.from_pylist(done, BLOCK)
                    done, chars = [], 0
        if now is not None:
            yield pa.RecordBatch.from_pylist([*done, now.row(part)], BLOCK)

    return ordered.mapInArrow(cut, BLOCK_SQL)


def conversations(cut: DataFrame) -> DataFrame:
    """One row for each conversation: its signature and what can be counted without repairing it."""
    own = ("part", "block", "letters", "head", "tail", "first_turn", "last_turn")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")]
    span = F.max("last_turn") - F.min("least_turn") + 1
    grouped = cut.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("b"), *sums, span.alias("span"))

    def seams(holds) -> Column:
        """How many pairs of neighbouring blocks have the property."""
        pairs = F.zip_with("b", F.slice("b", 2, F.size("b")), lambda x, y: F.when(y.isNotNull() & holds(x, y), 1).otherwise(0))
        return F.aggregate(pairs, F.lit(0), lambda n, x: n + x)

    broken = seams(lambda x, y: ~F.concat(x["tail"], y["head"]).isin(*LEGAL))
    again = seams(lambda x, y: x["last_turn"] == y["first_turn"])
    return grouped.select(
        "ck",
        F.concat_ws("", F.transform("b", lambda x: x["letters"])).alias("letters"),
        "blank",
        "duplicate",
        "truncated",
        (F.col("illegal") + broken).alias("illegal"),
        F.coalesce(F.col("span") - (F.col("turns") - again), F.lit(0)).cast("long").alias("gaps"),
    )


def _step(letter: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Costs and first edits by grammar state of a row with ``after`` as the costs behind it; of equal costs the least letter."""
    late, role = KEEP_TRUNCATED if letter.isupper() else 0, letter.lower()
    best = []
    for state in range(4):
        ways = [(DELETE + after[state], "D")]
        if letter != "x":
            ways.append((REROLE + late + after[NEXT[state]], "R"))
            if role in KEPT[state]:
                ways.append((late + after[KEPT[state][role]], "K"))
        best.append(min(ways))
    user, assistant = min(best[2], (INSERT + best[3][0], "I")), min(best[3], (INSERT + best[2][0], "I"))
    inserted = (INSERT + user[0], "I")
    found = (min(best[0], inserted), min(best[1], inserted), user, assistant)
    return tuple(c for c, _ in found), tuple(e for _, e in found)


class SuffixAutomaton:
    """The nodes of the last signature, the end first; a signature keeps those that it shares with the one before.

    Nodes that differ by a constant cost behave alike, so their costs are held relative to the least, and there are few
    kinds of them: each kind is worked out once.
    """

    def __init__(self):
        self._kinds: dict[tuple, tuple] = {}
        self._letters: list[str] = []
        self._nodes: list[tuple] = [(0, *END)]

    def best(self, signature: str) -> tuple[int, str]:
        """The least cost of a signature, and its audit."""
        length = len(signature)
        shared = 0
        while shared < min(length, len(self._letters)) and self._letters[shared] == signature[length - 1 - shared]:
            shared += 1
        del self._letters[shared:], self._nodes[shared + 1 :]
        for letter in signature[: length - shared][::-1]:
            base, after, _ = self._nodes[-1]
            kind = self._kinds.get((letter, after))
            if kind is None:
                costs, edits = _step(letter, after)
                kind = self._kinds[letter, after] = (min(costs), tuple(c - min(costs) for c in costs), edits)
            self._nodes.append((base + kind[0], *kind[1:]))
            self._letters.append(letter)
        base, costs, _ = self._nodes[-1]
        return base + costs[0], self._audit()

    def _audit(self) -> str:
        out, state = [], 0
        for depth in range(len(self._nodes) - 1, -1, -1):
            edits = self._nodes[depth][2]
            while edits[state] == "I":
                out.append("I")
                state = NEXT[state]
            if depth:
                out.append(edits[state])
                state = KEPT[state][self._letters[depth - 1].lower()] if out[-1] == "K" else NEXT[state] if out[-1] == "R" else state
        return "".join(out)


def audits(signatures: DataFrame) -> DataFrame:
    """letters, cost, audit of different signatures: each task has those whose ends are neighbours."""
    ends = F.reverse("letters")
    ordered = signatures.select("letters").repartitionByRange(F.substring(ends, 1, 64)).sortWithinPartitions(ends)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                letters = batch.column("letters").slice(at, 1000)
                found = [automaton.best(x.as_py()) for x in letters]
                yield pa.RecordBatch.from_arrays([letters, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["letters", "cost", "audit"])

    return ordered.mapInArrow(solve, "letters string, cost long, audit string")


class Repair:
    """Applies an audit to the blocks of one conversation, one after the other, and hashes what stays."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.lines = audit, 0, 0, hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> None:
        if self.lines:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())
        self.lines += 1

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._line(NEXT_ROLE[self.state], "")
            self.state, self.at = NEXT[self.state], self.at + 1

    def block(self, letters: str, roles: list[str], texts: list[str]) -> None:
        rows = iter(zip(roles, texts))
        for letter in letters:
            self._insert()
            edit, self.at = self.audit[self.at], self.at + 1
            role, text = next(rows) if letter != "x" else ("", "")
            if edit == "K":
                self._line(role, text)
                self.state = KEPT[self.state][letter.lower()]
            elif edit == "R":
                self._line(NEXT_ROLE[self.state], text)
                self.state = NEXT[self.state]

    def digest(self) -> str:
        self._insert()
        return self.hash.hexdigest()


def repaired_hashes(judged: DataFrame, cut: DataFrame) -> DataFrame:
    """ck, repaired_sha256: a conversation's audit comes before its blocks, and they follow in order, one at a time."""
    none = F.lit(None)
    heads = judged.select("ck", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("block"), F.col("audit").alias("letters"), none.cast("array<string>").alias("roles"), none.cast("array<string>").alias("texts"))
    both = heads.unionByName(cut.select("ck", "part", "block", "letters", "roles", "texts"))
    ordered = both.repartition("ck").sortWithinPartitions("ck", "part", "block")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ck = None, None
        for batch in batches:
            done = []
            for i in range(len(batch)):
                if batch.column("part")[i].as_py() == -1:
                    if now is not None:
                        done.append((ck, now.digest()))
                    ck, now = batch.column("ck")[i].as_py(), Repair(batch.column("letters")[i].as_py())
                else:
                    now.block(*(batch.column(c)[i].as_py() for c in ("letters", "roles", "texts")))
            yield pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], pa.string()) for n in range(2)], names=["ck", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([ck]), pa.array([now.digest()])], names=["ck", "repaired_sha256"])

    return ordered.mapInArrow(follow, "ck string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired rows of every conversation of ``rows`` (conv_id, turn, role, text) after damage."""
    with temporary(rows.sparkSession):
        cut = materialise(blocks(faults(damage(rows))), "blocks")
        told = materialise(conversations(cut), "conversations")
        kinds = materialise(told.groupBy("letters").agg(F.count("*").alias("n")), "signatures")
        judged = materialise(split_join(told, audits(kinds), "letters", "ck", counts=kinds).drop("letters"), "judged")
        known = judged.join(repaired_hashes(judged, cut), "ck")
        every = rows.select("conv_id").distinct().withColumn("ck", conversation_key())
        counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        audit, empty = F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
        return materialise(every.join(known, "ck", "left").select("conv_id", *counts, audit, empty), "repaired", keep=True)
