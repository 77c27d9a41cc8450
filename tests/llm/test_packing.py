"""Sharding, mixing and chat repair against brute force, and their odd rows."""

import itertools
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from oddities import TEXTS, empty, odd

from gridfold.llm import chat, mixing, sharding


def test_pack_balances_bytes_tokens_and_rows():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 2000, 4000)
    items = np.stack([size, size // rng.integers(4, 9, 4000) + 1, rng.integers(1, 4, 4000)], axis=1).astype(float)
    placed, fitted = sharding.pack(items, 8)
    assert fitted.mean() > 0.99
    for k in range(3):
        sums = np.bincount(placed, items[:, k], 8)
        assert sums.max() / sums.min() < (1.01 if k == 0 else 1.05)


def test_shards(spark):
    rng = random.Random(2)
    texts = ["w " * rng.randrange(1, 200) + str(i) for i in range(600)] + ["the hot text of many copies " * 8] * 500 + ["small group"] * 3
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i]["size"] == len(t.encode()) + 1 and got[i]["text_crc32"] == zlib.crc32(t.encode())
    by = defaultdict(list)
    for r in got.values():
        by[r["shard"]].append(r)
    assert set(by) == set(range(8))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert max(sizes) < 1.05 * min(sizes)
    held = defaultdict(set)
    for i, t in rows:
        held[t].add(got[i]["shard"])
    assert all(len(s) == 1 for t, s in held.items() if "hot" not in t) and len(held[texts[600]]) > 1  # 45 % of all rows: cut


def packed_by_brute_force(items, shards):
    """The dot-product rule item by item, in exact fractions."""
    total = [max(sum(x[k] for x in items), 1) for k in range(3)]
    left = [[Fraction(1, shards)] * 3 for _ in range(shards)]
    out = {}
    share = [[Fraction(x[k], total[k]) for k in range(3)] for x in items]
    for i in sorted(range(len(items)), key=lambda i: (-sum(share[i]), i)):
        room = [s for s in range(shards) if left[s][0] >= share[i][0]]
        dot = lambda s: sum(a * b for a, b in zip(left[s], share[i], strict=True))
        best = max(room, key=lambda s: (dot(s), -s)) if room else max(range(shards), key=lambda s: (left[s][0], -s))
        out[i] = best
        left[best] = [a - b for a, b in zip(left[best], share[i], strict=True)]
    return [out[i] for i in range(len(items))]


def test_pack_follows_the_dot_product_rule():
    rng = np.random.default_rng(4)
    items = rng.integers(1, 10**6, (300, 3))
    assert sharding.pack(items.astype(float), 8)[0].tolist() == packed_by_brute_force(items.tolist(), 8)


@pytest.mark.parametrize(("copies", "spread"), [((100,), {1}), ((60, 60, 60, 110), {1}), ((80,) * 9, {1, 2, 3, 4, 5, 6, 7, 8})])
def test_groups_up_to_a_share_stay_whole(spark, copies, spread):
    rng = random.Random(5)
    texts = [f"copy-of-group-{g:02d} " * 6 for g, n in enumerate(copies) for _ in range(n)]
    texts += [" ".join(str(rng.random()) for _ in range(6)) for _ in range(1000 - len(texts))]
    rows = list(enumerate(texts))
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    shard, held, sizes = {r["doc_id"]: r["shard"] for r in got}, defaultdict(set), defaultdict(int)
    for i, t in rows:
        held[t].add(shard[i])
        sizes[shard[i]] += len(t) + 1
    assert all(len(s) in spread for s in held.values()) and sum(len(s) > 1 for s in held.values()) <= 1
    assert max(sizes.values()) < 1.02 * min(sizes.values())


def test_shards_of_odd_rows(spark):
    got = sharding.shard_documents(odd(spark)).collect()
    assert len(got) == len(TEXTS) and sorted(r["size"] for r in got)[:2] == [1, 1]
    assert sharding.shard_documents(empty(spark)).count() == 0


def weights_by_bisection(totals, target, passes, budget):
    p = np.array([t for t in totals if t > 0], float) / sum(totals)

    def w(a):
        return p**a / (p**a).sum()

    ok = lambda a: -(w(a) * np.log(w(a))).sum() >= target * math.log(len(p)) - 1e-12
    few = lambda a: (budget * w(a) / p).max() <= passes
    lo, hi = 0.0, 1.0
    if ok(1.0):
        a = 1.0
    else:
        for _ in range(30):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        a = lo
    if not few(a):
        lo, hi = a, 1.0
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if few(mid) else (mid, hi)
        a = hi
    return dict(zip([i for i, t in enumerate(totals) if t > 0], w(a), strict=True))


@pytest.mark.parametrize(("totals", "target", "passes", "budget"), [((9000, 500, 300, 200), 0.9, 4.0, 1.0), ((9000, 500, 300, 200), 0.99, 2.0, 1.0), ((100, 100), 0.95, 4.0, 1.0), ((5000, 10, 0), 0.5, 3.0, 0.5)])
def test_weights(spark, totals, target, passes, budget):
    sources = spark.createDataFrame([(str(i), t) for i, t in enumerate(totals)], "source_key string, total long")
    got = {int(r["source_key"]): r for r in mixing.source_weights(sources, target, passes, budget).collect()}
    want = weights_by_bisection(totals, target, passes, budget)
    for i, r in got.items():
        assert r["weight"] == pytest.approx(want.get(i, 0.0), abs=1e-6)
        assert r["quota"] == pytest.approx(want.get(i, 0.0) * budget * sum(totals), abs=1)


def test_mixture_meets_quotas(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 40)
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice("aaaaaaaab") if i % 50 else None) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs.repartition(6), 0.95, 4.0, 1.0).collect()
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.repartition(2), 0.95, 4.0, 1.0).collect()}
    assert {r["doc_id"]: r["copies"] for r in got} == again and len(got) == 800
    totals, mixed, weight = defaultdict(int), defaultdict(int), {}
    for r in got:
        totals[r["source"]] += r["n_tokens"]
        mixed[r["source"]] += r["n_tokens"] * r["copies"]
        weight[r["source"]] = r["weight"]
    assert sum(weight.values()) == pytest.approx(1)
    for s, t in totals.items():
        quota = weight[s] * sum(totals.values())
        assert quota - 60 <= mixed[s] <= quota + 1 and max(r["copies"] for r in got if r["source"] == s) - min(r["copies"] for r in got if r["source"] == s) <= 1


def test_mixture_is_what_the_plan_says(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 25)
    rng = random.Random(9)
    rows = [(i if i % 9 else None, "w " * rng.randrange(0, 30), rng.choice("aaaaaab") if i % 40 else None) for i in range(400)]
    rows += [(5000, "same id and text " * 3, s) for s in "aab"] + [(5001, "repeated row " * 2, "b")] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as taken", "2 as passes").repartition(5)
    count = lambda got: sorted((str(r["doc_id"]), str(r["text_hash"]), str(r["source"]), r["n"]) for r in got)
    want = mixing.mix(docs).groupBy("doc_id", "text_hash", "source").agg(mixing.F.sum("copies").alias("n")).where("n > 0").collect()
    got = mixing.mixture(docs).groupBy("doc_id", mixing.F.xxhash64("text").alias("text_hash"), "source").agg(mixing.F.count("*").alias("n")).collect()
    assert count(got) == count(want) and len({r["copies"] for r in mixing.mix(docs).where("doc_id = 5000").collect()}) > 1


def test_mixing_of_odd_rows(spark):
    assert mixing.mix(odd(spark)).count() == len(TEXTS)
    mixed = mixing.mixture(odd(spark))
    assert mixed.columns == odd(spark).columns
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixture(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [r["copies"] for r in mixing.mix(blank).collect()] == [1, 1]


LEGAL = {0: {1, 2}, 1: {2}, 2: {3}, 3: {2}}


def cheapest(given):
    """The least cost over all role choices, merges and insertions, by trying them all."""
    best = {0: 0}
    for g in given:
        after = {}
        for state, cost in best.items():
            reach = {state: 0}
            for _ in range(4):
                for s, c in list(reach.items()):
                    for n in LEGAL[s]:
                        if n != 1 and reach.get(n, 99) > c + chat.INSERT:
                            reach[n] = c + chat.INSERT
            for role in (1, 2, 3):
                name = 0 if role == g else chat.NAME_UNKNOWN if g == 0 else chat.RELABEL
                options = [cost + c for s, c in reach.items() if role in LEGAL[s]]
                if role == state:
                    options.append(cost + chat.MERGE)
                for c in options:
                    after[role] = min(after.get(role, 999), c + name)
        best = after
    return min(c + {0: 999, 1: 2 * chat.INSERT, 2: chat.INSERT, 3: 0}[s] for s, c in best.items())


def test_repair_is_the_cheapest():
    for n in range(1, 5):
        for given in itertools.product(range(4), repeat=n):
            steps = chat.repair(list(given))
            state, total = 0, 0
            for cost, role, merged, between in steps:
                for r in between:
                    assert r in LEGAL[state]
                    state = r
                assert (merged and role == state) or role in LEGAL[state]
                state, total = role, total + cost
            assert total + {1: 2 * chat.INSERT, 2: chat.INSERT, 3: 0}[state] == cheapest(given)


@pytest.mark.parametrize("parts", [1, 6])
def test_chats_across_partitions(spark, parts):
    rng = random.Random(parts)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "Human", "??", None]), f"t{t}") for t in range(120)] + [(c, t, rng.choice(["user", "assistant"]), f"x{t}") for c in range(2, 30) for t in range(rng.randrange(1, 6))] + [(40, 0, "user", None)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: (r["turn"], r["piece"]))
        given = [chat.ALIASES.get((role or "").lower(), 0) for c, _, role, _ in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert sum(r["cost"] for r in own) == cheapest(given)
        text = "".join(r["rendered"] for r in own)
        turns = text.split(chat.CLOSE)
        assert turns[-1] == "" and all(t.startswith(chat.OPEN) for t in turns[:-1])
        roles = [t[len(chat.OPEN) :].split("\n")[0] for t in turns[:-1]]
        assert roles[-1] == "assistant" and all(b in {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}[a] for a, b in zip(["", *roles], roles, strict=False))
        assert all(x in text for c, _, _, x in rows if c == conv and x)


def test_odd_chats(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a"), (1, 1, "user", "same"), (1, 1, "user", "same"), (2, 0, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 as conv", "2 as part", "3 as piece")
    got = chat.format_chats(turns).collect()
    assert {r["conv_id"] for r in got} == {None, 1, 2}
    assert [r["action"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["piece"])] == ["keep", "merge", "insert"]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_long_texts_stay_out_of_the_range_key(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", chr(97 + t) * 1_000_000) for t in range(6)] + [(2, 0, "user", "a"), (2, 0, "user", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = chat.format_chats(turns).collect()
    own = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["turn"], r["piece"]))
    assert [len(r["rendered"]) > 1_000_000 for r in own] == [True] * 6 and "".join(r["rendered"] for r in own).count("d" * 1_000_000) == 1
    assert sorted((r["turn"], r["piece"], r["action"]) for r in got if r["conv_id"] == 2) == [(0, 0, "keep"), (0, 1, "merge"), (0, 2, "insert")]
