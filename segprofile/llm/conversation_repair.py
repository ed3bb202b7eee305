"""Cheapest repair of the turns of conversations, with the edits as an audit trail.

Rows of a conversation stand in order of turn (nulls first; rows of one turn by a digest of role and text). A row's
first fault counts: blank (no character but white space), duplicate (role and text seen earlier in the conversation), truncated (does not
end with ``.``, ``!`` or ``?``). Edits turn the rows into a conversation of the form (system? (user assistant)+)?, told by the first letters
of roles: Keep costs 0, Rerole to user or assistant 2, Delete 3 (the only way with blank and duplicate rows), Insert of
an empty user or assistant row 2; truncated rows that stay cost 1 more. Of the cheapest edits those with the least audit string win.

The audit DP holds, for each state of the grammar, the cheapest audit so far. Audits share their prefixes: an audit is a
node that links to the one without its last letter, to an ancestor farther up (a skew-binary ladder, one pointer a node, logarithmic
lifting) and has a rolling hash. Ties are settled by lifting both to one length and searching for the longest common prefix. A
prefix that the hash names is compared before its node is shared, so equal nodes are equal strings and a collision makes
a node of its own. An audit determines its state, so of two cheapest audits of one state neither begins the other, and
the lesser stays the lesser whatever follows.

Faults are found by Spark: first places of equal rows are aggregated and joined, so a hot row splits. Rows then
stream through tasks sorted by conversation, first narrow (letters and flags, for the DP), then whole (texts, to apply the audit):
no conversation's texts are held together. A conversation is edited in one task, as its edits depend on all before them.

Edge cases: null role and text are one space; null turns come first, a null conv_id is a conversation of its own; an
empty role has no letter and is never kept; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segprofile.functions.staging import stage
from segprofile.llm.tables import importable, read

SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: letter that may be kept -> next state, by state
_KEPT = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
#: role that an edit gives, and the state behind it
_GIVEN = (("user", _USER), ("user", _USER), ("assistant", _ASSISTANT), ("user", _USER))
_ACCEPTED = (_START, _ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1  # costs
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79
_ROWS = 4096  # rows handed on at a time


# -- the audit --------------------------------------------------------------------------------


class Audits:
    """Strings that share prefixes. Node 0 is the empty one."""

    def __init__(self, base: int = _BASE, prime: int = _PRIME):
        self.base, self.prime = base, prime
        self.parent, self.jump, self.letter, self.length, self.hash = [0], [0], [""], [0], [0]
        self.named: dict[tuple[int, int], list[int]] = {}

    def grow(self, node: int, letter: str) -> int:
        """The node of a string and one letter more."""
        value, length = (self.hash[node] * self.base + ord(letter)) % self.prime, self.length[node] + 1
        alike = self.named.setdefault((length, value), [])
        for known in alike:
            if self.parent[known] == node and self.letter[known] == letter:
                return known
        new, far = len(self.parent), self.jump[node]
        near_step, far_step = self.length[node] - self.length[far], self.length[far] - self.length[self.jump[far]]
        self.jump.append(self.jump[far] if near_step == far_step else node)
        self.parent.append(node), self.letter.append(letter), self.length.append(length), self.hash.append(value)
        alike.append(new)
        return new

    def prefix(self, node: int, length: int) -> int:
        while self.length[node] > length:
            node = self.jump[node] if self.length[self.jump[node]] >= length else self.parent[node]
        return node

    def less(self, x: int, y: int) -> bool:
        """Whether the string of x is less than that of y."""
        short = min(self.length[x], self.length[y])
        a, b = self.prefix(x, short), self.prefix(y, short)
        if a == b:
            return self.length[x] < self.length[y]
        # nodes of one length have ladders of one shape; go up while the prefixes differ
        while self.parent[a] != self.parent[b]:
            if self.jump[a] != self.jump[b]:
                a, b = self.jump[a], self.jump[b]
            else:
                a, b = self.parent[a], self.parent[b]
        return self.letter[a] < self.letter[b]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(out))


def cheapest(rows: Iterator[tuple[str, bool, bool]], audits: Audits | None = None) -> tuple[int, str]:
    """Cost and audit of rows (first letter of the role, must go, truncated)."""
    known = audits or Audits()
    best: list[tuple[int, int] | None] = [(0, 0), None, None, None]

    def offer(table: list, state: int, cost: int, node: int, letter: str) -> bool:
        old = table[state]
        if old is not None and old[0] < cost:
            return False
        new = known.grow(node, letter)
        if old is not None and old[0] == cost and (old[1] == new or not known.less(new, old[1])):
            return False
        table[state] = (cost, new)
        return True

    def inserted() -> None:
        changed = True
        while changed:
            changed = False
            for state in range(4):
                if best[state] is not None:
                    cost, node = best[state]
                    changed |= offer(best, _GIVEN[state][1], cost + INSERT, node, "I")

    for letter, must_go, truncated in rows:
        inserted()
        then: list[tuple[int, int] | None] = [None] * 4
        for state, held in enumerate(best):
            if held is None:
                continue
            cost, node = held
            offer(then, state, cost + DELETE, node, "D")
            if not must_go:
                more = TRUNCATED * truncated
                if letter in _KEPT[state]:
                    offer(then, _KEPT[state][letter], cost + more, node, "K")
                offer(then, _GIVEN[state][1], cost + REROLE + more, node, "R")
        best = then
    inserted()
    ends = [best[s] for s in _ACCEPTED if best[s] is not None]
    cost = min(c for c, _ in ends)
    found = [node for c, node in ends if c == cost]
    node = found[0]
    for other in found[1:]:
        node = other if known.less(other, node) else node
    return cost, known.text(node)


# -- faults -----------------------------------------------------------------------------------


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in role and text, and a digest of both."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest, letter, blank, truncated and whether the row was seen at an earlier turn."""
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    narrow = stage(
        rows.select(
            "conv_id",
            "turn",
            "digest",
            F.substring("role", 1, 1).alias("letter"),
            (F.rtrim("text", F.lit(SPACES)) == "").alias("blank"),
            (~last.isin(*ENDS)).alias("truncated"),
        )
    )
    # nulls come first, so a null among the turns is the first of them
    first = narrow.groupBy("conv_id", "digest").agg(F.max(F.col("turn").isNull()).alias("from_null"), F.min("turn").alias("first_turn"))
    first = first.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "from_null", "first_turn")
    seen = F.when(F.col("turn").isNull(), False).otherwise(F.col("from_null") | (F.col("turn") > F.col("first_turn")))
    joined = narrow.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")))
    return joined.select("conv_id", "turn", "digest", "letter", "blank", "truncated", seen.alias("seen"))


def _in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """Conversations whole in tasks, their rows in order."""
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _handed_on(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= _ROWS:
            yield batch()
            held.clear()
    if held:
        yield batch()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SUMMARY = "conv_id long, " + "".join(f"{c} long, " for c in _COUNTS) + "audit string"
_NONE = object()


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of rows in order."""

    def conversations() -> Iterator[tuple]:
        conv, rows, turns, counts = _NONE, [], [], []

        def closed() -> tuple:
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            cost, audit = cheapest(rows)
            return conv, gaps, *counts, cost, audit

        before = before_letter = None
        for conv_id, turn, digest, letter, blank, truncated, seen in _each(batches):
            if conv is _NONE or conv_id != conv:
                if conv is not _NONE:
                    yield closed()
                conv, rows, turns, counts, before, before_letter = conv_id, [], [], [0, 0, 0, 0], None, None
            duplicate = seen or before == (turn, digest)
            fault = 0 if blank else 1 if duplicate else 2 if truncated else 3
            if fault < 3:
                counts[fault] += 1
            if before is not None and before_letter + letter not in ("su", "ua", "au"):
                counts[3] += 1
            rows.append((letter, fault < 2, fault == 2))
            if turn is not None:  # first, last, number of distinct ones
                turns = [turns[0], turn, turns[2] + (turn != turns[1])] if turns else [turn, turn, 1]
            before, before_letter = (turn, digest), letter
        if conv is not _NONE:
            yield closed()

    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string())])
    yield from _handed_on(conversations(), schema)


def judge(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation."""
    importable(conversations.sparkSession)
    ordered = _in_order(faults(_rows(conversations)), F.col("turn").asc_nulls_first(), F.col("digest").asc())
    return ordered.mapInArrow(_judged, _SUMMARY)


# -- the repaired rows ------------------------------------------------------------------------


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations, each behind its audit, as the audit has them."""

    def rows() -> Iterator[tuple]:
        conv, audit, at, state, place = _NONE, "", 0, _START, 0

        def given() -> Iterator[tuple]:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                role, state = _GIVEN[state]
                yield conv, place, role, "", "Insert"
                at, place = at + 1, place + 1

        for conv_id, is_row, role, text in _each(batches):
            if not is_row:
                conv, audit, at, state, place = conv_id, text, 0, _START, 0
                yield from given()
                continue
            edit, at = audit[at], at + 1
            if edit == "K":
                state = _KEPT[state][role[:1]]
                yield conv, place, role, text, "Keep"
                place += 1
            elif edit == "R":
                role, state = _GIVEN[state]
                yield conv, place, role, text, "Rerole"
                place += 1
            yield from given()

    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    yield from _handed_on(rows(), schema)


def repair(conversations: DataFrame, judged: DataFrame) -> DataFrame:
    """conv_id, place, role, text, edit of the rows of repaired conversations, in order inside a partition."""
    importable(conversations.sparkSession)
    rows = _rows(conversations).select("conv_id", F.lit(True).alias("is_row"), "role", "text", "turn", "digest")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("digest", "binary"))]
    audits = judged.select("conv_id", F.lit(False).alias("is_row"), F.lit("").alias("role"), F.col("audit").alias("text"), *none)
    ordered = _in_order(audits.union(rows), F.col("is_row").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc())
    return ordered.select("conv_id", "is_row", "role", "text").mapInArrow(_applied, "conv_id long, place long, role string, text string, edit string")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the rows of a conversation as they stream by."""

    def digests() -> Iterator[tuple]:
        conv, total = _NONE, None
        for conv_id, place, role, text in _each(batches):
            if place == 0:
                if conv is not _NONE:
                    yield conv, total.hexdigest()
                conv, total = conv_id, hashlib.sha256()
            total.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if conv is not _NONE:
            yield conv, total.hexdigest()

    yield from _handed_on(digests(), pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())]))


# -- the contract -----------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut short, repeated or given to the user, as crc32 of conv_id:turn says; nulls are one space."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    times = F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    judged = stage(judge(rows))
    digests = repair(rows, judged).drop("edit").mapInArrow(_digested, "conv_id long, sha256 string")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = judged.join(digests.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").withColumnRenamed("conv_id", "_id")
    every = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in _COUNTS]
    empty = hashlib.sha256(b"").hexdigest()
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))
