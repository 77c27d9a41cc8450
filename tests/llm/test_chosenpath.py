"""The chosen-path join against brute force over all pairs of sets."""

import random

import pytest
from oddities import empty, odd
from pyspark.sql import functions as F

from gridfold.llm import chosenpath, setlinks


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset([b" ".join(words)] if 0 < len(words) < 5 else [b" ".join(words[i : i + 5]) for i in range(len(words) - 4)])


def expected(rows, percent=85):
    """Sorted (doc_id, set size, smallest linked id) of every row."""
    sets = list({shingles(t) for _, t in rows} - {frozenset()})
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a) * percent <= 100 * len(b) and len(b) * percent <= 100 * len(a) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    place = {s: i for i, s in enumerate(sets)}
    least = {}
    for d, t in rows:
        if d is not None and shingles(t):
            r = find(place[shingles(t)])
            least[r] = min(least.get(r, d), d)
    key = lambda d, t: least.get(find(place[shingles(t)])) if shingles(t) else d
    return sorted(((d, len(shingles(t)), key(d, t)) for d, t in rows), key=str)


def got(df):
    rows = df.select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted((tuple(r)[:3] for r in rows), key=str)


def corpus(seed, n, crowd=0):
    """Groups of copies with edits of all sizes, so that similarities lie on both sides of the limit; and a passage in a crowd."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    fresh = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    texts, passage = [], fresh(60)
    for _ in range(n):
        base = fresh(rng.choice([1, 3, 5, 20, 80, 300]))
        texts.append(base)
        for _ in range(rng.randint(0, 5)):
            copy = list(rng.choice(texts[-3:]))
            for _ in range(rng.choice([0, 1, 1, 2, len(copy) // 60])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    for i in range(crowd):  # texts that share a passage and little else
        texts.append(fresh(rng.randint(5, 40)) + passage + fresh(5))
        if i % 9 == 0:
            texts.append(texts[-1] + fresh(2))
    return [(i * 2 + 1, " ".join(t) if i % 5 else " ".join(t).upper()) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [64, 8])
def test_components_by_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(chosenpath, "SMALL", small)
    rows = corpus(1, 120, crowd=60)
    want = expected(rows)
    assert len({c for _, _, c in want}) < len(rows) - 150
    assert got(chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == want


@pytest.mark.parametrize("steps", [0, 1])
def test_crowds_that_no_step_splits(spark, monkeypatch, steps):
    """Texts of one template, pairwise near the limit: joined by their rarest tokens, without a lost link."""
    monkeypatch.setattr(chosenpath, "SMALL", 4)
    monkeypatch.setattr(chosenpath, "STEPS", steps)
    rng = random.Random(3)
    template = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(90):
        own = list(template)
        own[rng.randrange(5, 60) :] = [f"u{i // 2}x{k}" for k in range(8)] + own[60:]
        if i % 2:
            own[-1] = f"end{i}"
        rows.append((i, " ".join(own)))
    calls = []
    rare = chosenpath._by_rare_tokens
    monkeypatch.setattr(chosenpath, "_by_rare_tokens", lambda *a: calls.append(1) or rare(*a))
    assert got(chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)
    assert calls


def test_a_bridge_in_a_crowd_of_near_copies(spark):
    """One large group of near copies costs about one comparison a member, and two groups meet over one text."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.choice([0, 2, 4, 6])):
            own[rng.randrange(400)] = f"n{rng.randrange(60)}"
        rows.append((i, " ".join(own)))
    for i in range(5):  # a chain away from the group: each links with the one before only
        base = base[22:] + [f"c{i}x{k}" for k in range(22)]
        rows.append((1000 + i, " ".join(base)))
    assert got(chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_sets_and_exact_limit(spark):
    a = [f"x{i}" for i in range(104)]  # 100 shingles
    rows = [(1, " ".join(a)), (2, " ".join(a + ["y"] * 17)), (3, " ".join(a + [f"z{i}" for i in range(17)])), (4, " ".join(a + [f"z{i}" for i in range(18)]))]
    assert got(chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_recall_at_the_limit():
    """Of 2,000 pairs at 85 to 87 % nearly all meet in a first node of some tree and pass the comparison of bits."""
    rng = random.Random(6)
    import numpy as np

    met = 0
    for _ in range(2000):
        n = rng.choice([40, 200, 1000])
        lacking = n * 15 // 200
        common = np.array([rng.getrandbits(64) for _ in range(n - lacking)], np.uint64)
        more = [np.array([rng.getrandbits(64) for _ in range(lacking)], np.uint64) for _ in range(2)]
        tokens = chosenpath.minwise(np.concatenate([common, more[0], common, more[1]]), np.array([n, n]))
        first = any(tokens[0, c[0]] == tokens[1, c[0]] for c in chosenpath.CHOICES)
        bits = sum((int(x[0] ^ x[1]) % (1 << 64)).bit_count() for x in chosenpath._bit_rows(tokens))
        met += first and bits <= chosenpath.MOST_BITS
    assert met >= 1998


def test_odd_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd(spark).select("doc_id", "text").collect()]
    assert got(chosenpath.near_duplicates(odd(spark))) == expected(rows)
    assert chosenpath.near_duplicates(empty(spark)).collect() == []
    many = [(None, "one text without id of more than five words")] * 3 + [(None, "one text without id of more than five words indeed it has many more")]
    assert got(chosenpath.near_duplicates(spark.createDataFrame(many, "doc_id long, text string"))) == expected(many)


def test_confirmed_copies_crowded_sets(spark, monkeypatch):
    monkeypatch.setattr(setlinks, "SHARE", 3)
    texts = [" ".join(f"w{(i * k) % 97}" for k in range(60)) for i in range(1, 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = docs.select("doc_id", "text").mapInArrow(chosenpath._print_batches, chosenpath.PRINTS)
    classes = prints.select("k1", "k2", F.col("doc_id").alias("least"), F.col("doc_id").alias("cls"))
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 19)] + [(3, 4)], "a long, b long")
    found = {tuple(r) for r in setlinks.confirmed(pairs, classes, docs, 10).collect()}
    sets = [shingles(t) for t in texts]
    assert found == {(a, b) for a, b in [(i, 0) for i in range(1, 19)] + [(3, 4)] if 100 * len(sets[a] & sets[b]) >= 10 * len(sets[a] | sets[b])}


def test_query_on_the_test_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert got(chosenpath.op12_minhash_dedup(spark, d)) == expected(rows)


def test_sets_are_read_without_a_shuffle_and_once_a_class(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "h i j k l m"), (2, "other words of the same id here"), (None, "n o p q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = docs.select("text").mapInArrow(setlinks._set_batches, "k1 long, k2 long, members array<long>").collect()
    wanted = {0: (1, keys[0]), 1: (2, keys[2]), 2: (None, keys[4])}
    classes = spark.createDataFrame([(c, k["k1"], k["k2"], least) for c, (least, k) in wanted.items()], "cls long, k1 long, k2 long, least long")
    found = setlinks.sets_of(classes, docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["cls"], sorted(r["members"])) for r in found.collect()) == [(c, sorted(k["members"])) for c, (_, k) in wanted.items()]


def edited(rng, base, edits):
    """A copy of a text with words replaced, dropped or inserted."""
    own = list(base)
    for _ in range(edits):
        at, kind = rng.randrange(len(own)), rng.randrange(4)
        own[at : at + (kind != 3)] = [] if kind == 2 else [f"n{rng.randrange(2000)}"]
    return own


def test_pairs_of_a_crowd_of_near_copies_grow_with_its_members(spark, monkeypatch):
    """Copies of one text at 70 to 97 % of it: few pairs are left to compare, and twice the members make no more than about twice the pairs."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.randint(1, 5)))) for i in range(600)]
    counts = []
    rare = chosenpath._by_rare_tokens

    def counted(*a):
        pairs = rare(*a)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(chosenpath, "_by_rare_tokens", counted)
    sums = []
    for n in (300, 600):
        counts.clear()
        assert got(chosenpath.near_duplicates(spark.createDataFrame(rows[:n], "doc_id long, text string"))) == expected(rows[:n])
        assert counts
        sums.append(sum(counts))
    assert sums[0] <= 2 * 300 and sums[1] <= 2 * 600


@pytest.mark.parametrize("sample", [64, 2])
def test_pairs_by_differences_by_brute_force(spark, monkeypatch, sample):
    """Crowds given by hand, whatever their reference: each link across components is found, or follows from links to the centre."""
    monkeypatch.setattr(chosenpath, "SAMPLE", sample)
    rng = random.Random(9)
    bases = [[f"{c}{i}" for i in range(90)] for c in "xyz"]
    bases.append(bases[2][:75] + [f"w{i}" for i in range(15)])  # a crowd of two kinds, alike in part
    bases.append(bases[0][:84] + [f"v{i}" for i in range(6)])  # near another crowd
    texts = []
    for k, base in enumerate(bases):
        for _ in range(40 if k < 3 else 25):
            texts.append((min(k, 2) if k < 4 else 3, edited(rng, rng.choice([base, base, texts[-1][1] if texts else base]), rng.randint(0, 4))))
    texts = list({shingles(" ".join(t)): (c, " ".join(t)) for c, t in texts}.values())
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    prints = docs.select("doc_id", "text").mapInArrow(chosenpath._print_batches, chosenpath.PRINTS)
    classes = chosenpath.written(prints.withColumn("least", F.col("doc_id")).withColumn("cls", F.col("doc_id")))
    nodes = spark.createDataFrame([(i, (1 << 40) + c) for i, (c, _) in enumerate(texts)], "cls long, node long")
    crowds = classes.join(nodes, "cls").withColumn("root", F.col("cls")).select("node", "cls", "root", "n", *chosenpath.BITS)
    crowds = crowds.join(nodes.groupBy("node").agg(F.min("cls").alias("p_cls")), "node")
    found = {(r["a"], r["b"]) for r in chosenpath._by_rare_tokens(crowds, classes, docs).collect()}
    sets = [shingles(t) for _, t in texts]
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    joined = lambda pairs: expected_roots(len(sets), pairs)
    assert joined(found & linked) == joined(linked) and len(set(joined(linked))) > 20
    assert any(texts[i][0] != texts[j][0] for i, j in linked)


def expected_roots(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root
