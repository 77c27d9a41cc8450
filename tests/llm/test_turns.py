"""Conversation repair against brute force: every way of editing, by plain strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gridfold.llm import turnrepair

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        core = text.rstrip(BLANKS)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(initials, marks):
    """(cost, audit) by strings: up to two insertions before every row and at the end."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    gaps = ["", *"ua", *map("".join, itertools.product("ua", repeat=2))]
    best = {"": (0, "")}

    def inserted(known):
        out = {}
        for state, (cost, audit) in known.items():
            for gap in gaps:
                now = state
                for x in gap:
                    now = step[now].get(x) if now is not None else None
                if now is not None:
                    out.setdefault(now, []).append((cost + 2 * len(gap), audit + "I" * len(gap)))
        return out

    for x, mark in zip(initials, marks, strict=True):
        after = {}
        for state, ways in inserted(best).items():
            for cost, audit in ways:
                after.setdefault(state, []).append((cost + 3, audit + "D"))
                if mark not in ("blank", "duplicate"):
                    for to, more, letter in ((x, 0, "K"), ("u", 2, "R"), ("a", 2, "R")):
                        if to in step[state]:
                            after.setdefault(step[state][to], []).append((cost + more + (mark == "truncated"), audit + letter))
        best = {s: min(w) for s, w in after.items()}
    return min(w for s, ways in inserted(best).items() if s in ("", "a") for w in ways)


def every_way(initials, marks):
    """(cost, audit) by listing all edits of a very short conversation and testing the pattern at the end."""
    gaps = ["", *"ua", *map("".join, itertools.product("ua", repeat=2))]
    found = []
    options = []
    for x, mark in zip(initials, marks, strict=True):
        own = [("", 3, "D")]
        if mark not in ("blank", "duplicate"):
            more = int(mark == "truncated")
            own += [(x or "-", more, "K"), ("u", 2 + more, "R"), ("a", 2 + more, "R")]
        options.append([(g + to, 2 * len(g) + c, "I" * len(g) + letter) for g in gaps for to, c, letter in own])
    for way in itertools.product(*options, [(g, 2 * len(g), "I" * len(g)) for g in gaps]):
        if re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in way)):
            found.append((sum(x[1] for x in way), "".join(x[2] for x in way)))
    return min(found)


def repaired(rows, audit):
    rows, out, state = iter(rows), [], ""
    for letter in audit:
        if letter != "I":
            _, _, role, text = next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role, text = "assistant" if state == "u" else "user", text if letter == "R" else ""
        out.append(f"{role}:{text}")
        state = role[:1]
    return "\n".join(out)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        left = sorted(damage(own), key=lambda r: (r[1] is not None, r[1] or 0))
        marks, initials = faults(left), [r[2][:1] for r in left]
        cost, audit = cheapest(initials, marks)
        turns = {r[1] for r in left if r[1] is not None}
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(marks.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(repaired(left, audit).encode()).hexdigest())
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def chats(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "A cut text", "Why? ", " \n", "", None, f"Number {turn}.", "Ends so.\t"])
            rows.append((conv if rng.random() > 0.02 else None, turn if rng.random() > 0.05 or turn else None, role, text))
    seen, out = set(), []
    for r in rows:  # one row for each turn: the order of equal turns is this operator's own
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            out.append(r)
    return out


@pytest.mark.parametrize("block_rows", [512, 2])
def test_repair_by_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(turnrepair, "BLOCK_ROWS", block_rows)
    rows = chats(3, 150, 14)
    assert got(turnrepair.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3))) == expected(rows)


def test_least_weights_against_every_way():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(0, 3)
        initials = [rng.choice(["s", "u", "a", "t", ""]) for _ in range(n)]
        marks = [rng.choice(["", "", "blank", "duplicate", "truncated"]) for _ in range(n)]
        codes = [["", "blank", "duplicate", "truncated"].index(m) for m in marks]
        width = max(1, 2 * n)
        told = [(-1, "") if w is None else turnrepair.unpacked(*w, width) for known in turnrepair.least_weights(list(zip(initials, codes, strict=True)), width) for w in known]
        blocks = [([x[0] for x in told], [x[1] for x in told])]
        assert turnrepair.joined(blocks, n) == every_way(initials, marks) == cheapest(initials, marks)


def test_long_conversation_over_partitions(spark):
    rows = [(7, i, "user" if i % 3 else "assistant", f"Text {i % 900}.") for i in range(6000)] + [(8, 0, "user", "Hi.")]
    assert got(turnrepair.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5))) == expected(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 5, "user", "Hi."), (2, 3, "user", "x" * 2_000_000), (3, -(1 << 63), "user", "A."), (3, (1 << 63) - 1, "assistant", "B.")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(turnrepair.repair_conversations(df)) == expected(rows) | {3: (min(expected(rows)[3][0], (1 << 63) - 1), *expected(rows)[3][1:])}
    clashing = df.select("*", *(F.lit(1).alias(c) for c in ("conv", "k1", "copies", "fault", "n", "part", "audit")))
    assert got(turnrepair.repair_conversations(clashing)) == got(turnrepair.repair_conversations(df))
    assert turnrepair.repair_conversations(df.limit(0)).collect() == []


def test_query_on_the_test_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(turnrepair.op13_turn_repair(spark, d)) == expected(rows)
