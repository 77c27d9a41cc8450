"""Licence scan and decontamination against brute force, and their odd rows."""

import random
import re

import pytest
from oddities import TEXTS, empty, odd

from gridfold.llm import decontam, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def own_label(label, hit):
    """A label that ends in a dash takes the version of the match."""
    v = re.search(licenses.VERSION, hit)
    return label if not label.endswith("-") else label + (v.group(1).replace(" ", ".") if " " in v.group(1) else v.group(1) + ".0")


def detections(text):
    """All rules on all words, then pairwise suppression."""
    joined = " " + " ".join(words_of(text)) + " "
    found = []
    for rule, (label, _, body, priority, _) in enumerate(licenses.WRITTEN):
        for m in re.finditer(f"(?<= )(?:{body})(?= )", joined):
            start = joined[: m.start()].count(" ") - 1
            found.append((start, start + m.group().count(" "), own_label(label, m.group()), priority, rule))
    better = lambda e, d: e[3] < d[3] or (e[3] == d[3] and (e[:2] != d[:2] or e[4] < d[4]))
    return [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and e != d and better(e, d) for e in found)]


def base(text):
    own = words_of(text)
    hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in hits]
    return (len(own), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in hits})))


PHRASES = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.", "Licensed under CC BY-NC 4.0", "cc by cc by cc-by",
    "This work is licensed under the GNU General Public License, version 3 or later.", "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: GPL-2.0-only", "BSD 3-Clause License", "Copyright (c) 2019 someone",
    "GNU Lesser General Public License v2.1", "Creative Commons Attribution-ShareAlike 4.0 International", "mit der Zeit", "Permission is hereby granted, free of charge, to any person obtaining a copy", "public domain", "occ by general", "Mozilla Public License 2.0", "éCC BY", "CC BYé",
]


def test_scan_by_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice([rng.choice(PHRASES), "word", "the", "été"]) + rng.choice([" ", "\n", ", ", "-"]) for _ in range(rng.randrange(1, 30))) for _ in range(120)] + PHRASES + [t for _, t, *_ in TEXTS]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in licenses.op5_licenses(spark, str(tmp_path)).collect()}
    spans = {r["doc_id"]: r["detections"] for r in licenses.scan(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(t), t[:80]
        want = detections(t)
        assert sorted((d["start"], d["end"], d["label"]) for d in spans[i] or []) == sorted(d[:3] for d in want), t[:200]
        assert r["labels"] == ",".join(sorted({d[2] for d in want} | set(filter(None, r["base_labels"].split(",")))))
        assert 0 <= r["score"] <= 1


def example(parsed, rng, lazy):
    """A string that a parsed expression matches, with branches and repeats drawn at random."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "ANY":
            out += "x"
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += chr(value) if str(kind) == "LITERAL" else chr(rng.randint(*value))
        elif name == "BRANCH":
            out += example(rng.choice(arg[1]), rng, lazy)
        elif name == "SUBPATTERN":
            out += example(arg[-1], rng, lazy)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            times = low if lazy else rng.randint(low, min(high, low + 3))
            # Words of a gap are letters with single spaces.
            out += "".join(example(inner, rng, lazy) for _ in range(times)) + (" " if name == "MIN_REPEAT" and times else "")
        else:
            raise AssertionError(name)
    return out


def test_every_rule_finds_its_own_examples(spark):
    rng, rows = random.Random(3), []
    for rule, (label, keyword, body, *_) in enumerate(licenses.WRITTEN):
        for k in range(4):
            text = " ".join(example(re._parser.parse(body), rng, k == 0).split())
            if not re.fullmatch(body, text):
                continue
            assert f" {keyword}" in f" {text}", (keyword, text)
            rows.append((len(rows), rule, own_label(label, text), text.title() if k % 2 else text))
    assert len({r[1] for r in rows}) == len(licenses.WRITTEN) == len({r[2] for r in licenses.WRITTEN}) > 250
    docs = spark.createDataFrame(rows, "doc_id long, rule int, label string, text string")
    marked = docs.select("doc_id", "rule", licenses._marked(licenses.normalised(licenses.F.col("text")))["rule"].alias("met"), licenses.may_match(licenses.F.lower("text")).alias("stem"))
    assert all(r["rule"] in r["met"] and r["stem"] for r in marked.collect())
    for r in licenses.scan(docs).collect():
        want = {d[:3] for d in detections(r["text"])}
        assert {(d["start"], d["end"], d["label"]) for d in r["detections"]} == want, r["text"]


def test_scan_keeps_columns_and_takes_empty_tables(spark):
    got = licenses.scan(odd(spark))
    assert got.columns == [*odd(spark).columns, "n_words", "words", "detections"] and got.count() == len(TEXTS)
    assert licenses.scan(empty(spark)).count() == 0


def canonical(text):
    """Words and template words, one by one."""
    text = re.sub(r"(?<=[0-9])[.,](?=[0-9])", "", text)
    text = re.sub(r" (?=[A-ZÀ-Þ][a-zß-ÿ])(?<=[a-zß-ÿ0-9,;] )", " ", text)
    own = re.sub(r"[^a-z0-9ªµºÀ-ÖØ-öø-῿-]+", " ", text.lower()).split()
    out = []
    for w in own:
        if re.fullmatch("[0-9][0-9]*", w):
            out.append("#")
        elif out and out[-1] == "#" and w in decontam.UNITS:
            out.append("%")
        else:
            out.append("@" if "" in w and w.startswith("") else w)
    return own, out


def brute_leaks(docs, items):
    found = {}
    for d, text in docs:
        own, t = canonical(text or "")
        for i, item in items:
            y, b = canonical(item or "")
            if len(b) < decontam.LEAST_WORDS:
                continue
            for shift in range(-len(b) + 4, len(t)):
                pairs = [(t[shift + k], b[k], own[shift + k], y[k]) for k in range(len(b)) if 0 <= shift + k < len(t)]
                agree = [p for p in pairs if p[0] == p[1]]
                slots = {(p[2], p[3]) for p in agree if p[0] in "#%@"}
                if len(agree) >= 0.6 * len(b) and len({s[1] for s in slots}) == len(slots):
                    share = len(agree) / len(b)
                    was = found.get((d, i), (0, True))
                    found[d, i] = (max(was[0], share), was[1] and any(a != z for a, z in slots))
    return found


def test_leaks_by_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    say = lambda n: " ".join(rng.choice([*vocabulary, "12", "3.5 kg", "Anna"]) for _ in range(n))
    items = [(i, say(rng.randrange(8, 40)).capitalize() + ".") for i in range(12)]
    docs = []
    for d in range(80):
        text = say(rng.randrange(0, 60))
        if d % 2:
            item = items[d % 12][1]
            text += " " + rng.choice([item, item.replace("12", "77").replace("Anna", "Bert"), item.upper(), item.replace(" ", "$$$ ")]) + " " + say(15)
        docs.append((d, text))
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(docs, items)
    assert set(got) == set(want) and len(want) > 20
    for k, (share, substituted) in want.items():
        assert got[k]["share"] == pytest.approx(share) and got[k]["substituted"] == substituted


def test_slots_must_be_consistent(spark):
    item = [(1, "If a box holds 12 red balls and 12 blue balls, how many balls does Mia find in the box of her aunt?")]
    docs = [(1, item[0][1].replace("12", "40").replace("Mia", "Zoe")), (2, item[0][1].replace("12", "40", 1).replace("12", "41", 1)), (3, "Some other text about a box of balls that has nothing to do with it at all.")]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string")).collect()
    assert [(r["doc_id"], r["substituted"]) for r in got] == [(1, True)]


def found_in(spark, docs, items):
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], r["item_id"]): r for r in got.collect()}


def test_leaks_with_insertions_losses_and_halves(spark):
    rng = random.Random(7)
    say = lambda n: [f"w{rng.randrange(900) + 100}x" for _ in range(n)]
    items = [say(n) for n in (16, 20, 24, 31, 40, 60)]
    docs, want = [], {}
    for i, own in enumerate(items):
        half = len(own) // 2
        for edited in (own[:half] + ["indeed"] + own[half:], own[: half - 1] + own[half:], own[:half] + say(3) + own[half:], *((own[:half], own[half:]) if half >= 20 else ())):
            want[len(docs), i] = sum(w in own for w in edited) / len(own)
            docs.append((len(docs), " ".join(say(rng.randrange(1, 9)) + edited + say(30))))
    docs.append((len(docs), " ".join(w for own in items for w in own[: len(own) // 5])))
    got = found_in(spark, docs, [(i, " ".join(x)) for i, x in enumerate(items)])
    assert set(got) == set(want)
    for k, share in want.items():
        assert got[k]["share"] == pytest.approx(share) and not got[k]["substituted"]


def test_leaks_with_values_of_other_lengths(spark):
    item = [(1, "In the morning a train leaves from Paris for Rome with many people, runs 5 km in ten minutes and comes back to Paris late at night when all is still.")]
    docs = [(1, item[0][1].replace("Paris", "New York")), (2, item[0][1].replace("5 km", "5km")), (3, item[0][1].replace("Paris", "New York", 1).replace("to Paris", "to Old Delhi"))]
    got = found_in(spark, docs, item)
    assert {d: r["substituted"] for (d, _), r in got.items() if r["share"] == 1} == {1: True, 2: False}


def test_leaks_of_dense_edits_at_every_offset(spark):
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(900) + 100}x" for _ in range(n)]
    items, docs = [say(n) for n in (12, 13, 18, 25, 32, 40)], []
    for own in items:
        for every in (5, 6, 7, 8, 9, 10, 12):
            edited = [f"other{i}" if i % every == every - 1 else w for i, w in enumerate(own)]
            docs += [(len(docs) + offset, " ".join(say(offset) + edited + say(9))) for offset in range(5)]
    named = [(i, " ".join(x)) for i, x in enumerate(items)]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(named, "item_id long, text string"))
    want = brute_leaks(docs, named)
    assert {(r["doc_id"], r["item_id"]): pytest.approx(r["share"]) for r in got.collect()} == {k: share for k, (share, _) in want.items()} and len(want) == len(docs)


def test_leaks_of_short_items(spark):
    items = [(1, "What is the capital city of France?"), (2, "Name the largest moon of Saturn."), (3, "Who wrote Hamlet?"), (4, "?!"), (5, "")]
    docs = [
        (1, "Some words before. What is the capital city of France? And words after it."), (2, items[0][1]), (3, "He asked what is the capital town of France, not more."), (4, "name the LARGEST moon of Saturn"),
        (5, "A first line\n  Who wrote Hamlet?\nA last line"), (6, "who wrote hamlet"), (7, "It asks who wrote Hamlet in the end."), (8, ""), (None, "Who wrote Hamlet?"), (9, "?!"),
    ]
    assert {k: (r["share"], r["substituted"]) for k, r in found_in(spark, docs, items).items()} == dict.fromkeys([(1, 1), (2, 1), (4, 2), (5, 3), (6, 3), (None, 3)], (1.0, False))


def test_leaks_in_other_scripts_and_signs(spark):
    item = "a ticket for the old night train costs €12 and a seat in it costs €5 more, so what do we pay?"
    arabic = "يدفع أحمد مبلغ ١٢ دينارا لكل كتاب، ثم يبيع الكتاب إلى صديقه بمبلغ ٢٠ دينارا فكم يربح؟"
    items = [(1, item), (2, arabic)]
    docs = [
        (1, item.replace("12", "40").replace("5", "٧")), (2, item.replace(" ", "　").replace(",", "，").replace("?", "？")), (3, "\ufeff" + item.replace(" and", "😀and").replace(" so", "→so")),
        (4, arabic.replace("١٢", "٣٤")), (5, arabic.replace("،", " ,").replace("؟", "?").replace("١٢", "12")), (6, "\ue000".join(item.split(" "))),
    ]
    got = found_in(spark, docs, items)
    assert {k: (r["share"], r["substituted"]) for k, r in got.items()} == {(1, 1): (1.0, True), (2, 1): (1.0, False), (3, 1): (1.0, False), (4, 2): (1.0, True), (5, 2): (1.0, False), (6, 1): (1.0, False)}


def test_decontamination_of_odd_rows(spark, monkeypatch):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short item"), (4, "the quick brown fox jumps over a lazy dog while rain falls on old stone walls")], "item_id long, text string")
    for most in (500_000, 0):
        monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", most)
        assert [(r["doc_id"], r["item_id"]) for r in decontam.leaks(odd(spark), bench).collect()] == [(6, 4)]
    item = bench.where("item_id = 4")
    unnamed = odd(spark).withColumn("doc_id", decontam.F.when(decontam.F.col("doc_id") != 6, decontam.F.col("doc_id")))
    assert decontam.decontaminate(unnamed, item).count() == len(TEXTS) - 1  # rows without doc_id are searched as well
    monkeypatch.setattr(decontam, "PLACES", 2000)
    assert decontam.leaks(odd(spark), bench).count() == 1
    kept = decontam.decontaminate(odd(spark), bench)
    assert kept.columns == odd(spark).columns and kept.count() == len(TEXTS) - 1
    assert decontam.decontaminate(empty(spark), bench).count() == 0 and decontam.decontaminate(odd(spark), bench.limit(0)).count() == len(TEXTS)
