"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from oddities import LONG, empty, odd

from gridfold.llm import spelling

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    words = words_of(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def variants(seed, letters, n):
    """Documents of words, their one-edit variants and variants of these, of very different counts."""
    rng, rows = random.Random(seed), []
    bases = ["".join(rng.choice(letters) for _ in range(rng.choice([5, 6, 7, 9, 14]))) for _ in range(n)]
    for base in bases:
        own = [base]
        for _ in range(rng.randint(0, 6)):
            w, i = rng.choice(own), rng.randint(0, 5)
            own.append(rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]]))
        for k, w in enumerate(own):
            rows += [w] * rng.choice([4, 5, 6, 30, 160] if k < 3 else [5, 6])
    rng.shuffle(rows)
    return [(i, " ".join(w.upper() if w.isascii() and i % 5 == 0 else w for w in rows[i * 20 : i * 20 + 20])) for i in range(len(rows) // 20 + 1)]


@pytest.mark.parametrize("letters", ["ab", LETTERS])
def test_groups_by_brute_force(spark, letters):
    rows = variants(1, letters, 60 if letters == "ab" else 150)
    want = expected(rows)
    assert len(want) > 100 and sum(w[0] is not None for w in want.values()) > 10
    assert got(spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == want


def test_runs_of_one_letter_and_shared_halves(spark):
    words = ["a" * n for n in range(5, 60)] + ["abcabc" * n for n in range(1, 9)] + ["prefix" + x + "suffix" for x in ["", "a", "b", "ab", "ba", "×", "÷"]]
    rows = [(i, " ".join(words)) for i in range(5)] + [(100 + i, "prefixasuffix " * 40) for i in range(3)]
    assert got(spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_chains_of_forms(spark):
    rows = [(1000 + i, " ".join([w] * n)) for i, (w, n) in enumerate([("abcdef", 4000), ("abcdeg", 700), ("abcdhg", 130), ("abcihg", 26), ("abjihg", 5)])]
    want = expected(rows)
    assert want["abjihg"][1] == "abcdef"
    assert got(spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    text = " ".join(["wordone wordtwo wordsone, xwordone"] * 40) + "l" * 300
    assert sorted(spelling.damaged_runs(5, text.encode())) != []
    counts = Counter()
    for w, n in spelling.damaged_runs(5, text.encode()):
        counts[w] += n
    assert {w: n for w, n in counts.items() if n >= 5} == words_of([(5, text)])


def test_odd_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd(spark).select("doc_id", "text").collect()]
    assert got(spelling.spelling_groups(odd(spark))) == expected(rows)
    assert LONG.count("jumps") == 3000
    assert spelling.spelling_groups(empty(spark)).collect() == []


def test_query_on_the_test_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got(spelling.op11_spelling_variants(spark, d)) == expected(rows)
