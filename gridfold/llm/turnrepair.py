"""Conversation structure repair: damage, faults and the cheapest edits back to a legal order of roles.

A legal conversation reads ``(s?(ua)+)?`` in role initials. Every row is kept, re-roled or deleted, and empty
turns may be inserted; of the cheapest ways the one with the ASCII-least audit is taken. Both criteria live in
one integer: the high digits carry the cost, below them ``width`` octal digits hold the audit's letters from
the left, zero where the audit has ended. An edit adds its cost and its digit at its place, so a plain
minimum over integers along the rows (a DAG of row and automaton state) decides cost and tie at once.

Rows are range-partitioned by conversation and turn without their texts and cut into blocks of at most
``BLOCK_ROWS``; a block is reduced to the least weight from each state to each state, and a conversation's
blocks are joined by the same minimum. Two ways through a block have the same number of row letters and end
with one, so neither is the beginning of the other and their order outlasts whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm.common import broadcast_if_small, checkpointed, table

#: Remainders of crc32 that stand for a damage, and the costs of the edits.
DROP, EMPTY, UNSTOP, REPEAT, AS_USER, FATES = 0, 1, 2, 3, 4, 20
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
#: Audit letters in ASCII order; their octal digits are 1 to 4, and 0 pads the end.
LETTERS = "DIKR"
DIGIT = {x: i + 1 for i, x in enumerate(LETTERS)}
TO_LETTERS, TO_DIGITS = str.maketrans("1234", LETTERS), str.maketrans(LETTERS, "1234")
#: States of the automaton by the last role initial; the empty conversation and those ending in ``a`` are legal.
STATES = ("", "s", "u", "a")
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}
LEGAL = {"su", "ua", "au"}
#: Inserted turns that end a conversation legally, by state.
ENDING = ("", "ua", "a", "")
FINE, BLANK, DUPLICATE, CUT = range(4)
BLOCK_ROWS = 512
NO_CONVERSATION = -(1 << 63)
FULL_NAME = {"u": "user", "a": "assistant"}
ORDER = ["turn", "role", "k1", "k2"]


def _edits(initial: str, fault: int) -> list[list[tuple[int, int, int, int]]]:
    """By state: ``(next state, cost, octal digits, letters)`` of what may become of a row.

    At most one insertion before a row can be of use: it reaches every role, and two more lead back. One
    before a deleted row comes no cheaper than after it, and later in the order of audits.
    """
    found = []
    for state in STATES:
        options = [(STATES.index(state), DELETE, DIGIT["D"], 1)]
        targets = [] if fault in (BLANK, DUPLICATE) else [(x, REROLE, "R") for x in "ua"]
        if targets and initial in ("s", "u", "a"):
            targets.append((initial, 0, "K"))
        for role, cost, letter in targets:
            cost += TRUNCATED * (fault == CUT)
            if role in AFTER[state]:
                options.append((STATES.index(role), cost, DIGIT[letter], 1))
            elif role != "s":
                options.append((STATES.index(role), cost + INSERT, 8 * DIGIT["I"] + DIGIT[letter], 2))
        found.append(options)
    return found


EDITS = {(initial, fault): _edits(initial, fault) for initial in ("s", "u", "a", "-") for fault in range(4)}


def least_weights(rows: list[tuple[str, int]], width: int) -> list[list[tuple[int, int] | None]]:
    """From each state to each state: the least weight over all ways through the rows, and its letters.

    ``rows`` are pairs of role initial and fault; ``width`` is at least two letters a row.
    """
    table_: list[list[tuple[int, int] | None]] = [[(0, 0) if i == j else None for j in range(4)] for i in range(4)]
    for initial, fault in rows:
        edits = EDITS[initial if initial in ("s", "u", "a") else "-", fault]
        for i, known in enumerate(table_):
            best: list[tuple[int, int] | None] = [None] * 4
            for before, edit in zip(known, edits, strict=True):
                if before is None:
                    continue
                weight, n = before
                for state, cost, digits, letters in edit:
                    new = weight + (cost << 3 * width) + (digits << 3 * (width - n - letters))
                    if best[state] is None or new < best[state][0]:
                        best[state] = (new, n + letters)
            table_[i] = best
    return table_


def unpacked(weight: int, letters: int, width: int) -> tuple[int, str]:
    """Cost and audit of a weight."""
    digits = (weight & ((1 << 3 * width) - 1)) >> 3 * (width - letters)
    return weight >> 3 * width, f"{digits:o}".translate(TO_LETTERS) if letters else ""


def joined(blocks: list[tuple[list[int], list[str]]], rows: int) -> tuple[int, str]:
    """Cost and audit of a whole conversation from its blocks' tables of costs (-1: no way) and audits."""
    width = 2 * rows + 2
    best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
    for costs, audits in blocks:
        ways = [(i // 4, i % 4, c, int(a.translate(TO_DIGITS) or "0", 8), len(a)) for i, (c, a) in enumerate(zip(costs, audits, strict=True)) if c >= 0]
        after: list[tuple[int, int] | None] = [None] * 4
        for start, state, cost, digits, letters in ways:
            if best[start] is not None:
                weight, n = best[start]
                new = weight + (cost << 3 * width) + (digits << 3 * (width - n - letters))
                if after[state] is None or new < after[state][0]:
                    after[state] = (new, n + letters)
        best = after
    ends = []
    for known, ending in zip(best, ENDING, strict=True):
        if known is not None:
            weight, n = known
            for _ in ending:
                weight, n = weight + (INSERT << 3 * width) + (DIGIT["I"] << 3 * (width - n - 1)), n + 1
            ends.append((weight, n))
    return unpacked(*min(ends), width)


COUNTS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]
BLOCK_SCHEMA = "conv long, part long, number long, " + ", ".join(f"{c} long" for c in COUNTS) + ", low long, high long, first string, last string, costs array<long>, audits array<string>"
BLOCK = pa.schema([("conv", pa.int64()), ("part", pa.int64()), ("number", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("low", pa.int64()), ("high", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _record(conv: int, part: int, number: int, rows: list[tuple[int | None, str, int]]) -> dict:
    faults, initials = [x[2] for x in rows], [x[1] for x in rows]
    turns = [x[0] for x in rows if x[0] is not None]
    width = 2 * len(rows)
    ways = [x for known in least_weights([x[1:] for x in rows], width) for x in known]
    told = [(-1, "") if x is None else unpacked(*x, width) for x in ways]
    return {
        "conv": conv, "part": part, "number": number, "rows": len(rows), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "turns": len(set(turns)),
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "first": initials[0], "last": initials[-1], "costs": [x[0] for x in told], "audits": [x[1] for x in told],
    }


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record for each block of a conversation's rows, which come sorted."""
    part, number, conv, rows, out = TaskContext.get().partitionId(), 0, None, [], []
    for batch in batches:
        for own, turn, initial, fault, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for i in range(n):
                if rows and (own != conv or len(rows) == BLOCK_ROWS):
                    out.append(_record(conv, part, number, rows))
                    number, rows = number + 1, []
                conv = own
                rows.append((turn, initial, fault if i == 0 or fault == BLANK else DUPLICATE))
                if len(out) == 2048:
                    yield pa.RecordBatch.from_pylist(out, schema=BLOCK)
                    out = []
    if rows:
        out.append(_record(conv, part, number, rows))
    yield pa.RecordBatch.from_pylist(out, schema=BLOCK)


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
HEAD_SCHEMA = "conv long, " + ", ".join(f"{c} long" for c in RESULT) + ", audit string"
HEAD = pa.schema([("conv", pa.int64()), *((c, pa.int64()) for c in RESULT), ("audit", pa.string())])


def _settled(conv: int, blocks: list[dict]) -> dict:
    out = {"conv": conv} | {c: sum(x[c] for x in blocks) for c in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(blocks, blocks[1:], strict=False))
    known = [x for x in blocks if x["low"] is not None]
    distinct = sum(x["turns"] for x in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
    out["gaps"] = min(known[-1]["high"] - known[0]["low"] + 1 - distinct, (1 << 63) - 1) if known else 0
    out["cost"], out["audit"] = joined([(x["costs"], x["audits"]) for x in blocks], sum(x["rows"] for x in blocks))
    return out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its sorted blocks."""
    held: list[dict] = []
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            if held and held[0]["conv"] != x["conv"]:
                out.append(_settled(held[0]["conv"], held))
                held = []
            held.append(x)
        yield pa.RecordBatch.from_pylist(out, schema=HEAD)
    if held:
        yield pa.RecordBatch.from_pylist([_settled(held[0]["conv"], held)], schema=HEAD)


class _Hashing:
    """SHA-256 of a repaired conversation, fed row by row."""

    def __init__(self, head: dict):
        self.head, self.audit, self.at, self.state, self.digest = head, head["audit"], 0, "", hashlib.sha256()
        self.begun = False

    def put(self, role: str, text: str, initial: str) -> None:
        self.digest.update((b"\n" if self.begun else b"") + role.encode() + b":" + text.encode())
        self.begun, self.state = True, initial

    def insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role = "a" if self.state == "u" else "u"
            self.put(FULL_NAME[role], "", role)
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.insertions()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.put(role, text, role[:1])
        elif letter == "R":
            new = "a" if self.state == "u" else "u"
            self.put(FULL_NAME[new], text, new)

    def result(self) -> dict:
        self.insertions()
        return self.head | {"repaired_sha256": self.digest.hexdigest()}


OUT = HEAD.append(pa.field("repaired_sha256", pa.string()))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The head of a conversation comes first, then its rows; a row's text is let go once it is hashed."""
    now: _Hashing | None = None
    for batch in batches:
        out = []
        heads, rest = zip(*(c.to_pylist() for c in batch.columns[: len(HEAD)]), strict=True), batch.columns[len(HEAD) :]
        for head, copies, role, text in zip(heads, rest[0].to_pylist(), rest[1].to_pylist(), rest[2], strict=True):
            if copies is None:
                if now is not None:
                    out.append(now.result())
                now = _Hashing(dict(zip(HEAD.names, head, strict=True)))
            else:
                for _ in range(copies):
                    now.row(role, text.as_py())
        yield pa.RecordBatch.from_pylist(out, schema=OUT)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.result()], schema=OUT)


def damaged(turns: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, copies)``: what the damage leaves; nulls of role, text and in the hashed id are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % FATES
    text = F.when(fate == EMPTY, "").when(fate == UNSTOP, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return turns.where(fate != DROP).select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_CONVERSATION)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.when(fate == AS_USER, "user").otherwise(shown("role")).alias("role"), text.alias("text"), F.when(fate == REPEAT, 2).otherwise(1).alias("copies"),
    )


def _keys(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"k1": F.xxhash64("role", "text"), "k2": F.xxhash64(F.lit(1), "text", "role")})


def faulty(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, k1, k2, fault, n)`` of :func:`damaged` rows: equal rows once, with the fault of the first and their number.

    Texts stay behind; ``k1`` and ``k2`` are 128 bits of role and text. A row is a duplicate if the
    conversation has an equal role and text in an earlier turn.
    """
    core = F.rtrim("text", F.lit(BLANKS))
    blank: Column = core == ""
    fault = F.when(blank, BLANK).when(~F.right(core, F.lit(1)).isin(*".!?"), CUT).otherwise(FINE)
    narrow = _keys(rows).select("conv", *ORDER, fault.alias("own"), "copies")
    once = checkpointed(narrow.groupBy("conv", *ORDER, "own").agg(F.sum("copies").alias("n")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = once.groupBy("conv", "k1", "k2").agg(F.min(place).alias("at"), F.count("*").alias("places")).where("places > 1").select("conv", "k1", "k2", "at")
    known = once.join(broadcast_if_small(firsts), ["conv", "k1", "k2"], "left")
    again = (F.col("own") != BLANK) & F.col("at").isNotNull() & (place != F.col("at"))
    return known.select("conv", *ORDER, F.when(again, DUPLICATE).otherwise(F.col("own")).alias("fault"), "n")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every conversation.

    Nulls of role and text, and of id and turn where the damage is drawn, are one space. Null turns come first;
    equal turns go by role and then by the hash of role and text, so repeats stay side by side. Rows without
    ``conv_id`` form one conversation, with a null id in the result. An empty role has no initial and can't be kept. A conversation that the damage leaves empty
    has zeros, an empty audit and the hash of nothing. ``gaps`` ends at the largest long. Other columns are
    ignored; an empty table gives no rows.

    A conversation may have any number of rows: texts are hashed as they stream by in order, and only its
    blocks' audits (up to 16 for each block) meet in one task.
    """
    rows = damaged(turns)
    order = ["conv", *ORDER]
    found = checkpointed(faulty(rows)).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = found.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "n").mapInArrow(_blocks, BLOCK_SCHEMA)
    settled = blocks.repartition("conv").sortWithinPartitions("conv", "part", "number").mapInArrow(_conversations, HEAD_SCHEMA)
    ids = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_CONVERSATION)).alias("conv")).distinct()
    none = {c: F.coalesce(c, F.lit(0)) for c in RESULT} | {"audit": F.coalesce("audit", F.lit(""))}
    heads = ids.join(settled, "conv", "left").withColumns(none)
    keyed = _keys(rows)
    parts = heads.unionByName(keyed.select("conv", *ORDER, "text", "copies"), allowMissingColumns=True)
    parts = parts.repartition("conv").sortWithinPartitions("conv", F.col("copies").isNotNull(), *ORDER).select(*HEAD.names, "copies", "role", "text")
    out = parts.mapInArrow(_hashed, HEAD_SCHEMA + ", repaired_sha256 string")
    return out.select(F.nullif("conv", F.lit(NO_CONVERSATION)).alias("conv_id"), *RESULT, "audit", "repaired_sha256")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least cost, audit and digest of the repair of all ``conversations`` by :func:`repair_conversations`."""
    return repair_conversations(table(spark, sf_dir, "conversations"))
