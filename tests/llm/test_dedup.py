"""SimHash components and line dedup against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from oddities import TEXTS, empty, odd
from pyspark.sql import functions as F

from gridfold.llm import hashing, linededup, nearcopies, setlinks, simhash
from gridfold.llm.components import connected_components


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Smallest id reachable over links of 4 or fewer differing bits, by comparing all pairs."""
    root = {p: p for p in set(prints.values())}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = list(root)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for d, p in prints.items():
        least[find(p)] = min(least.get(find(p), d), d)
    return {d: least[find(p)] for d, p in prints.items()}


def test_components_by_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 40, 120]))]
        texts += [" ".join(base)] + [" ".join(w if rng.random() > 0.02 else rng.choice(words) for w in base) for _ in range(5)]
    rows = [(i * 3, t.upper() if i % 7 == 0 else t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    prints = {i: fingerprint(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == classes(prints)


@pytest.mark.parametrize("crowd", [0, 2, 10_000])
def test_crowded_buckets_lose_no_connection(spark, crowd):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = {b for x in base for b in [x, *(x ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(6))]}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), crowd)
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in edges.collect()]
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in pairs)
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    want = classes({x[0]: x[0] % (1 << 64) for x in signed})
    groups = {}
    for x in signed:
        groups.setdefault(want[x[0]], set()).add(roots.get(x[0], x[0]))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (100, 101), (101, 100)], "a long, b long")
    assert {r["node"]: r["root"] for r in connected_components(edges).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_odd_rows(spark):
    got = simhash.components(odd(spark)).collect()
    assert len(got) == len(TEXTS)
    zero = {r["doc_id"] for r in got if r["fp"] == 0}
    assert zero == {3, 4, 5} and {r["component_id"] for r in got if r["fp"] == 0} == {3}
    kept = nearcopies.drop_near_copies(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 6, 7, 8]
    assert simhash.components(empty(spark)).count() == 0 and nearcopies.drop_near_copies(empty(spark)).count() == 0


def test_majority_over_many_shingles():
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 255, 256, 0, 1000])
    hashes = rng.integers(0, 1 << 63, counts.sum(), dtype=np.int64).astype(np.uint64)
    got = simhash.majority_bits(hashes, counts)
    cut = np.cumsum([0, *counts])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[a:z]) > z - a) for a, z in zip(cut, cut[1:], strict=False)]
    assert got.tolist() == want


def dropped(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(strip))
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_line_dedup_by_brute_force(spark, parts, tmp_path, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", (64 << 20) * (parts > 1))
    rng = random.Random(parts)
    common = ["This line is long enough to count as boilerplate %d" % i for i in range(8)] + ["Éé " * 20, "short"]
    rows = []
    for d in range(150):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"unique line number {rng.random()} of this document" for _ in range(rng.randrange(1, 9))]
        rows.append((d, "\n".join(("  " + x.upper() + "\t") if rng.random() < 0.3 else x for x in [*lines, common[0]])))
    rows += [(200, None), (201, ""), (202, "\n"), (203, (common[1] + "\n") * 400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in linededup.op10_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == dropped(rows)


def test_line_dedup_of_odd_rows(spark):
    line = "A line of more than forty characters that is in many texts"
    rows = [(i, line) for i in range(5)] + [(4, line), (None, line), (9, None), (10, "x\n" + line + "\n" + line + "\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit(1)).withColumn("pos", F.lit(2))
    got = {r["doc_id"]: r for r in linededup.keep_bitmaps(docs).collect()}
    assert set(got) == {0, 1, 2, 3, 4}  # document 10 is the largest; rows without id take no part
    assert linededup.kept_lines(line, bytes(got[0]["keep_bitmap"])) == []
    assert linededup.kept_lines("a\nb", None) == ["a", "b"]
    assert linededup.keep_bitmaps(odd(spark)).count() == 0 and linededup.keep_bitmaps(empty(spark)).count() == 0


def shingle_set(text):
    """Distinct shingles of five words, the whole of a shorter text."""
    own = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def wide(texts):
    """Bits and narrow places of each text by itself, with all counts taken one by one."""
    out = []
    for text in texts:
        raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
        hashes, counts = setlinks.shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert counts[0] == len(hashes) == len(shingle_set(text))
        bits, places = [], []
        for k in range(nearcopies.FIELDS):
            own = [int(h) for h in hashing.mixed(hashes * hashing.PRIME + np.uint64(2 * k + 1))]
            ones = [sum(h >> b & 1 for h in own) for b in range(64)]
            bits += [2 * n > len(own) for n in ones]
            for s in range(2):
                margin = [(abs(2 * n - len(own)), i) for i, n in enumerate(ones[32 * s : 32 * s + 32])]
                places.append([i for _, i in sorted(margin)[: nearcopies.LOOSE]])
        out.append((bits, places))
    return out


def near_classes(rows):
    """The smallest id of each group, by comparing all pairs of texts that share a key of a segment."""
    prints, sets = wide([t for _, t in rows]), [shingle_set(t) for _, t in rows]
    keys = [{(s, tuple(b ^ (i in flipped) for i, b in enumerate(bits[32 * s : 32 * s + 32]))) for s in range(10) for n in range(5) for flipped in itertools.combinations(places[s], n)} for bits, places in prints]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        differ = [a != b for a, b in zip(prints[i][0], prints[j][0], strict=True)]
        a, b = sets[i], sets[j]
        if a == b or (sum(differ) <= nearcopies.MOST_BITS and keys[i] & keys[j] and 100 * len(a & b) >= 80 * len(a | b)):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def edited(rng, words, base, part):
    return " ".join(w if rng.random() > part else rng.choice(words) for w in base)


def test_near_copies_by_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = ["one", "one two three four", "one two three four", "five words are one shingle", "a b " * 40]
    for _ in range(14):
        base = [rng.choice(words) for _ in range(rng.choice([20, 60, 200]))]
        texts += [" ".join(base), " ".join(base).upper()] + [edited(rng, words, base, part) for part in (0.005, 0.01, 0.02, 0.05)]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    got = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"] for r in got if r["stays"]} == set(near_classes(rows).values()) and len(got) == len(rows)


def test_recall_of_near_copies(spark):
    rng = random.Random(5)
    words, rows, pairs = [f"w{i}" for i in range(3000)], [], []
    while len(pairs) < 150:
        base = [rng.choice(words) for _ in range(rng.randrange(40, 300))]
        copy = edited(rng, words, base, rng.choice([0.01, 0.015, 0.02]))
        a, b = shingle_set(" ".join(base)), shingle_set(copy)
        if 0.8 <= len(a & b) / len(a | b) < 1:
            pairs.append(len(rows))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, copy)]
    stays = {r["doc_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["stays"]}
    assert set(pairs) <= stays and sum(p + 1 not in stays for p in pairs) >= 0.9 * len(pairs)


def test_nothing_goes_without_a_link_of_its_own(spark):
    """A crowd of texts of one template at 0.5 to 0.95: only those go that reach a smaller id over links of 0.8."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    base = [rng.choice(words) for _ in range(150)]
    rows = [(i, edited(rng, words, base, rng.choice([0.004, 0.01, 0.03, 0.08]))) for i in range(160)]
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    true = {find(i) for i in range(len(rows))}
    stays = {r["doc_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["stays"]}
    assert true <= stays and len(stays - true) <= 0.1 * len(rows)


def test_a_bridge_in_a_crowd(spark):
    """Two groups of hundreds that only one pair of texts connects: the pair is found."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    other = base[:40] + [f"c{i}" for i in range(260)]
    group = lambda own, tag: [" ".join([*own, f"{tag}{k}"]) for k in range(70)]
    bridge = [" ".join(base[:300]), " ".join(base[:300] + ["x"] * 3)]
    chain = [" ".join(base[: 300 - 20 * k] + [f"d{k}x{i}" for i in range(20 * k)]) for k in range(1, 4)]
    texts = group(base, "p") + group(other, "q") + bridge + chain
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["stays"]} == set(near_classes(rows).values())
