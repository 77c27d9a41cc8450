"""MinHash near-dedup by a chosen-path set similarity join.

Every distinct set of five-word shingles has 64 minwise tokens. In each of ``TREES`` independent trees it takes
a path chosen by some of them: documents that agree in the first chosen token meet in a node; a node of more than
``SMALL`` members branches on, eight ways at a time, by which tokens its members agree in. Similar sets agree often
and stay together, sets that share only a passage fall apart.

In every node the members are first compared with one pivot: in a crowd the member nearest to what most members
agree in, as the original is among its copies, else the one of least hash. What is linked by then needs no more comparing: a node
whose members are in one component is done, in a small node only members of different components are compared, and a
crowded one branches. So a group of n near copies costs about n comparisons. Comparing starts with two bits of each minwise
token and the sizes (at 85 % similarity all but 1 pair in 10^6 passes) and ends on the full sets.

At exactly 85 % two sets miss each other in all trees about once in 10^5 times, more rarely the more alike they are. A crowd whose members
are much alike without being one component, or that has branched and is still a crowd, is joined exactly, by rare tokens
among those in which its members differ from what most of them hold: near copies of one text share by chance little of that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm.common import LOWER_TABLE, broadcast_if_small, spread_join, table, text_blocks, text_or_empty, written
from gridfold.llm.components import merged_components
from gridfold.llm.hashing import mixed
from gridfold.llm.setlinks import confirmed, nearest_pairs, pairs_across, set_keys, sets_of, shingle_sets

PERCENT = 85
TOKENS, TREES, SMALL = 64, 6, 64
#: Tokens a step looks at in a row, ways to choose each, and the most steps below the first node.
LEVELS, WAYS, STEPS = 3, 2, 2
#: Mean number of bits of 64 by which members of a crowd differ from most, up to which branching can't part them.
ALIKE = 10
#: Members of a crowd, about, from which its reference is taken.
SAMPLE = 64
#: Crowds whose references are broadcast.
MOST_REFERENCES = 1_000
#: Differing bits of 128 up to which a pair is compared; expected are 10 at 85 %, with a deviation of 4.
MOST_BITS = 28
MULTIPLIERS = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: For each tree the order in which it chooses tokens; fixed by its number.
CHOICES = [np.random.RandomState(tree).permutation(TOKENS) for tree in range(TREES)]
PRINTS = "doc_id long, n long, k1 long, k2 long, x1 long, x2 long, tokens binary"
BITS = ["x1", "x2"]


def minwise(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``sets x TOKENS``: the least of every multiple of a set's hashes, cut to 32 bits; zeros for an empty set."""
    out = np.zeros((len(counts), TOKENS), np.uint32)
    has = np.flatnonzero(counts)
    if len(has):
        first, buffer = (np.cumsum(counts) - counts)[has], np.empty_like(hashes)
        for i, multiplier in enumerate(MULTIPLIERS):
            np.multiply(hashes, multiplier, out=buffer)
            out[has, i] = np.minimum.reduceat(buffer, first) >> np.uint64(32)
    return out


def _bit_rows(tokens: np.ndarray) -> list[np.ndarray]:
    weights = np.uint64(1) << np.arange(TOKENS, dtype=np.uint64)
    return [((((tokens >> np.uint32(k)) & np.uint32(1)) * weights).sum(axis=1, dtype=np.uint64)).view(np.int64) for k in range(2)]


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for first, last, data, offsets in text_blocks(batch.column("text")):
            hashes, counts = shingle_sets(LOWER_TABLE[data], offsets)
            tokens = minwise(hashes, counts)
            packed = pa.array([x.tobytes() for x in tokens], pa.binary())
            columns = [counts.astype(np.int64), *set_keys(hashes, counts), *_bit_rows(tokens)]
            yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), *map(pa.array, columns), packed], ["doc_id", "n", "k1", "k2", *BITS, "tokens"])


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS).astype(np.uint64)


def _hash_on(nodes: np.ndarray, choice: int, token: np.ndarray) -> np.ndarray:
    return mixed((nodes ^ mixed(token | np.uint64(choice << 32))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def _first_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = _tokens(batch.column("tokens"))
        own = [batch.column(c) for c in ("cls", "n", *BITS)]
        for tree in range(TREES):
            choice = int(CHOICES[tree][0])
            nodes = _hash_on(np.full(len(tokens), tree, np.uint64), choice, tokens[:, choice])
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(np.full(len(tokens), tree, np.int32)), *own], ["node", "tree", "cls", "n", *BITS])


def _branches(depth: int):
    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, tree = _tokens(batch.column("tokens")), batch.column("tree").to_numpy()
            own = [batch.column(c) for c in ("tree", "cls", "n", *BITS)]
            for way in range(WAYS**LEVELS):
                nodes = batch.column("node").to_numpy().view(np.uint64).copy()
                for level in range(LEVELS):
                    place = 1 + (LEVELS * depth + level) * WAYS + way // WAYS**level % WAYS
                    for t in np.unique(tree):
                        at, choice = tree == t, int(CHOICES[t][place])
                        nodes[at] = _hash_on(nodes[at], choice, tokens[at, choice])
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), *own], ["node", "tree", "cls", "n", *BITS])

    return branch


NODES = "node long, tree int, cls long, n long, x1 long, x2 long"


def maybe(left: str, right: str) -> Column:
    """Whether two classes, by columns with a prefix each, can be similar enough."""
    bits = sum((F.bit_count(F.col(f"{left}{x}").bitwiseXOR(F.col(f"{right}{x}"))) for x in BITS), F.lit(0))
    n, m = F.col(f"{left}n"), F.col(f"{right}n")
    return (bits <= MOST_BITS) & (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))


def _centres(crowds: DataFrame) -> DataFrame:
    """By crowded node: the columns of the member nearest to the majority in each bit, and the mean distance; written."""
    ones = [F.sum(F.shiftrightunsigned("x1", i).bitwiseAND(F.lit(1))).alias(f"s{i}") for i in range(64)]
    signed = lambda i: (1 << i) - (1 << 64 if i == 63 else 0)
    most = sum((F.when(2 * F.col(f"s{i}") > F.col("n"), F.lit(signed(i))).otherwise(F.lit(0)) for i in range(64)), F.lit(0))
    majority = written(crowds.groupBy("node").agg(F.count("*").alias("n"), *ones).select("node", most.alias("most")))
    apart = F.bit_count(F.col("x1").bitwiseXOR(F.col("most")))
    order = apart * (1 << 56) + F.shiftrightunsigned(F.xxhash64("cls"), 8)
    pivot = [F.min_by(c, order).alias(f"p_{c}") for c in ("cls", "n", *BITS)]
    return written(spread_join(crowds, majority, "node").groupBy("node").agg(F.avg(apart).alias("apart"), *pivot))


def shared_nodes(rows: DataFrame) -> DataFrame:
    """``rows`` in nodes of several members, with the number of members, the pivot's columns and, in crowds, how far members lie ``apart``; written."""
    kept, order = written(rows), F.xxhash64("cls")
    pivot = [F.min_by(c, order).alias(f"p_{c}") for c in ("cls", "n", *BITS)]
    nodes = written(kept.groupBy("node").agg(F.count("*").alias("members"), *pivot).where("members > 1"))
    small = spread_join(kept, nodes.where(F.col("members") <= SMALL), "node").withColumn("apart", F.lit(None).cast("double"))
    sizes = nodes.where(F.col("members") > SMALL).select("node", "members")
    if sizes.isEmpty():
        return written(small)
    crowds = written(kept.join(broadcast_if_small(sizes), "node"))
    return written(small.unionByName(spread_join(crowds, _centres(crowds), "node")))


def _with_pivots(shared: DataFrame) -> DataFrame:
    return shared.where((F.col("cls") != F.col("p_cls")) & maybe("", "p_")).select(F.col("cls").alias("a"), F.col("p_cls").alias("b"))


def _unsettled(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of nodes in several components, with their ``root``; written."""
    known = written(shared.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    several = known.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("node")
    return written(spread_join(known, written(several), "node"))


def _within(members: DataFrame, key: str) -> DataFrame:
    """Pairs of members that share a key, are in different components and can be similar enough."""
    columns = ("cls", "root", "n", *BITS)
    left = members.select(key, *(F.col(c).alias(f"l_{c}") for c in columns))
    right = members.select(key, *(F.col(c).alias(f"r_{c}") for c in columns))
    met = left.join(right, [key]).where("l_cls < r_cls and l_root <> r_root").where(maybe("l_", "r_"))
    return met.select(F.col("l_cls").alias("a"), F.col("r_cls").alias("b"))


def _crowded(crowds: DataFrame) -> DataFrame:
    """Members of crowded nodes once each, with a ``crowd``: the least component of the pivots of their nodes; written."""
    pivots = crowds.where("cls = p_cls").select("node", F.col("root").alias("crowd"))
    return written(crowds.join(broadcast_if_small(pivots), "node").groupBy("cls", "root", "n", *BITS).agg(F.min("crowd").alias("crowd")))


def _ranked(rows: DataFrame) -> DataFrame:
    """Of ``(cls, token, held)`` each class with its tokens ``sorted`` by how often they are held, rare ones first."""
    return rows.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("sorted"))


def _side(placed: DataFrame, tag: str, *key: str) -> DataFrame:
    return placed.select(*key, *(F.col(c).alias(f"{tag}{c}") for c in placed.columns if c not in key))


def _pairs_with_bits(met: DataFrame) -> DataFrame:
    bits = sum((F.bit_count(F.col(f"l_{x}").bitwiseXOR(F.col(f"r_{x}"))) for x in BITS), F.lit(0))
    return met.select(F.least("l_cls", "r_cls").alias("a"), F.greatest("l_cls", "r_cls").alias("b"), bits.alias("bits"))


def _references(members: DataFrame, sets: DataFrame) -> DataFrame:
    """By crowd: the ``reference``, tokens that most of about ``SAMPLE`` members hold.

    Pairs are exact by any reference; one near to most members leaves little to compare.
    """
    sizes = members.groupBy("crowd").agg(F.ceil(F.count("*") / SAMPLE).alias("every"))
    chosen = members.join(sizes, "crowd").where(F.pmod(F.xxhash64("cls"), "every") == 0).select("cls", "crowd")
    taken = chosen.groupBy("crowd").agg(F.count("*").alias("taken"))
    held = sets.join(chosen, "cls").select("crowd", F.explode("members").alias("token")).groupBy("crowd", "token").agg(F.count("*").alias("held"))
    return held.join(taken, "crowd").where("2 * held > taken").groupBy("crowd").agg(F.collect_list("token").alias("reference"))


def _inside_crowds(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, bits)`` across components of one crowd, exactly, by where sets differ from the crowd's reference.

    With p percent and ``D`` the tokens in which a set of n differs from the reference, its slack is ``(100 + p) |D| - (100 - p) n``.
    Two sets are similar enough if and only if twice ``100 + p`` times the size of their common ``D`` reaches the sum of their slacks.
    So all whose slack and the least one sum up to nothing link to the class of least slack, one pair each. Of any other pair, one has a larger slack:
    it shares tokens of ``D``, the more the farther both lie from the reference, and at least all of ``|D|`` but
    ``(100 - p) n / p``; so they meet in one of the rarest, with enough of ``D`` ahead. What copies share by chance doesn't meet.
    """
    reference = broadcast_if_small(_references(members, sets), MOST_REFERENCES)
    known = sets.join(broadcast_if_small(members), "cls").join(reference, "crowd", "left")
    known = known.withColumn("reference", F.coalesce("reference", F.array().cast("array<long>")))
    apart = F.concat(F.array_except("members", "reference"), F.array_except("reference", "members"))
    apart = written(known.select("crowd", "cls", "root", "n", *BITS, apart.alias("apart")))
    told = apart.withColumn("differing", F.size("apart").cast("long")).drop("apart")
    told = told.withColumn("slack", (100 + PERCENT) * F.col("differing") - (100 - PERCENT) * F.col("n"))
    centre = told.groupBy("crowd").agg(F.min(F.struct("slack", "cls", "root")).alias("centre"))
    centre = centre.select("crowd", *(F.col(f"centre.{c}").alias(f"p_{c}") for c in ("slack", "cls", "root")))
    told = told.join(broadcast_if_small(centre), "crowd")
    certain = told.where("cls <> p_cls and root <> p_root and slack + p_slack <= 0")
    certain = certain.select(F.least("cls", "p_cls").alias("a"), F.greatest("cls", "p_cls").alias("b"), F.lit(0).alias("bits"))
    twice = 2 * (100 + PERCENT)
    always = F.col("differing") - F.floor((100 - PERCENT) * F.col("n") / PERCENT)
    nearer = F.greatest(F.ceil((F.col("slack") + F.greatest(F.col("slack"), 1 - F.col("p_slack"))) / twice), always)
    farther = F.greatest(F.lit(1), F.ceil((F.col("slack") + F.col("p_slack")) / twice), always)
    early = lambda least: F.greatest(F.lit(0), F.col("differing") - least + 1).cast("int")
    placed = told.withColumns({"first": early(nearer), "second": F.when(F.col("slack") > -F.col("p_slack"), early(farther)).otherwise(0)})
    rows = apart.select("cls", F.explode("apart").alias("token"))
    ranked = _ranked(rows.join(rows.groupBy("token").agg(F.count("*").alias("held")), "token")).join(placed, "cls")
    own = ("crowd", "cls", "root", "n", "differing", "slack", "first", "second", *BITS)
    placed = ranked.select(*own, F.posexplode(F.slice("sorted", F.lit(1), F.greatest("first", "second"))).alias("place", "at"))
    placed = written(placed.withColumn("token", F.col("at.token")).drop("at"))
    ahead = 1 + F.least(F.col("l_differing") - F.col("l_place") - 1, F.col("r_differing") - F.col("r_place") - 1)
    enough = twice * ahead >= F.col("l_slack") + F.col("r_slack")
    ordered = F.struct("l_slack", "l_cls") < F.struct("r_slack", "r_cls")
    sizes = 100 * F.least("l_n", "r_n") >= PERCENT * F.greatest("l_n", "r_n")
    key = ("crowd", "token")
    met = _side(placed.where("place < first"), "l_", *key).join(_side(placed.where("place < second"), "r_", *key), list(key))
    return certain.union(_pairs_with_bits(met.where(ordered & sizes & enough & (F.col("l_root") != F.col("r_root")))))


def _between_crowds(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, bits)`` across crowds, exactly: what is similar enough shares a rare token early enough.

    Tokens are ordered by their frequency among the crowds. A set of n meets larger ones by its first
    ``n - ceil(170 n / 185) + 1`` tokens, smaller ones by its first ``n - ceil(85 n / 100) + 1``; and at their first common
    token enough tokens must lie ahead in both.
    """
    rows = written(sets.select("cls", F.explode("members").alias("token")))
    ranked = _ranked(spread_join(rows, written(rows.groupBy("token").agg(F.count("*").alias("held"))), "token"))
    least = lambda share: F.ceil(F.size("sorted") * share[0] / share[1]).cast("int")
    early = F.slice("sorted", F.lit(1), F.size("sorted") - least((PERCENT, 100)) + 1)
    index = F.size("sorted") - least((2 * PERCENT, 100 + PERCENT)) + 1
    placed = ranked.select("cls", index.alias("index"), F.posexplode(early).alias("place", "at")).select("cls", "index", "place", F.col("at.token").alias("token"))
    placed = written(placed.join(members, "cls"))
    several = placed.groupBy("token").agg(F.min("crowd").alias("low"), F.max("crowd").alias("high")).where("low < high").select("token")
    placed = placed.join(several, "token", "left_semi")
    ahead = 1 + F.least(F.col("l_n") - F.col("l_place") - 1, F.col("r_n") - F.col("r_place") - 1)
    enough = (100 + PERCENT) * ahead >= PERCENT * (F.col("l_n") + F.col("r_n"))
    smaller = F.struct("l_n", "l_cls") < F.struct("r_n", "r_cls")
    fits = smaller & (F.col("l_crowd") != F.col("r_crowd")) & (100 * F.col("l_n") >= PERCENT * F.col("r_n")) & enough
    return _pairs_with_bits(_side(placed.where("place < index"), "l_", "token").join(_side(placed, "r_", "token"), "token").where(fits))


def _by_rare_tokens(crowds: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(a, b, bits)`` across components of crowds, exactly: within a crowd by what sets differ in, and across crowds; written."""
    members = _crowded(crowds)
    sets = sets_of(classes.join(members.select("cls"), "cls", "left_semi").select("cls", "k1", "k2", "least"), docs)
    pairs = _inside_crowds(members, sets)
    if members.select("crowd").distinct().count() > 1:
        pairs = pairs.union(_between_crowds(members, sets))
    return written(pairs.distinct())


def set_components(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, root)`` of all classes with a link, ``root`` the smallest class reachable.

    ``classes`` are written, with ``cls, k1, k2, least, n, x1, x2, tokens``, and none is empty.
    """
    spark, depth = classes.sparkSession, 0
    shared = shared_nodes(classes.select("cls", "n", *BITS, "tokens").mapInArrow(_first_nodes, NODES))
    pairs = written(_with_pivots(shared).distinct())
    roots = spark.createDataFrame([], "node long, root long")
    pending = None
    while True:
        if not pairs.isEmpty():
            fresh = confirmed(pairs, classes, docs, PERCENT)
            if not fresh.isEmpty():
                roots = merged_components(roots, fresh)
        wanted = []
        if pending is not None:
            wanted.append(pairs_across(pending, roots))
            pending = None
        if shared is not None:
            open_, shared = _unsettled(shared, roots), None
            crowds = open_.where(F.col("members") > SMALL)
            wanted.append(_within(open_.where(F.col("members") <= SMALL), "node"))
            parting = (F.col("apart") > ALIKE) & F.lit(depth < STEPS)
            tight, loose = written(crowds.where(~parting)), written(crowds.where(parting))
            if not tight.isEmpty():
                # First each class with its nearest; what that puts into one component needs no comparing later.
                pending = _by_rare_tokens(tight, classes, docs)
                wanted.append(nearest_pairs(pending))
            if not loose.isEmpty():
                told = loose.select("node", "tree", "cls", "n", *BITS).join(classes.select("cls", "tokens"), "cls")
                shared = shared_nodes(told.mapInArrow(_branches(depth), NODES))
                wanted.append(_with_pivots(shared))
                depth += 1
        if not wanted:
            return roots
        pairs = written(reduce(DataFrame.union, wanted).distinct())
        if shared is None and pending is None and pairs.isEmpty():
            return roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Documents link if their sets of distinct five-word shingles (A-Z lower-cased; of fewer words the whole
    sequence) have a Jaccard similarity of 0.85 or more; ``component_id`` is the smallest ``doc_id`` reachable.
    Texts without words, and null ones, have no shingle and link with nothing, not even each other. Rows that share a
    ``doc_id`` are rows of their own. ``kept`` marks rows whose id is the component's; a row without ``doc_id`` has
    that of its component, if any, and is kept only where its component has none. Other columns aren't read; an empty table gives no rows.
    """
    prints = written(text_or_empty(docs, "doc_id").mapInArrow(_print_batches, PRINTS))
    first = [F.first(c).alias(c) for c in ("n", *BITS, "tokens")]
    classes = prints.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), *first)
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()))
    roots = set_components(classes, docs)
    named = written(classes.select("cls", "k1", "k2", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")))
    # All copies share a class, and a large group of near copies a root: both may be hot.
    placed = written(spread_join(named.select("root", "k1", "k2"), least, "root").select(F.struct("k1", "k2").alias("key"), "component_id"))
    rows = prints.select("doc_id", "n", F.struct("k1", "k2").alias("key"))
    found = spread_join(rows.where("n > 0"), placed, "key").select("doc_id", "n", "component_id")
    found = found.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of all ``documents`` by :func:`near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"))
