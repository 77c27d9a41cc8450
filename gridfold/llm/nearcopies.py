"""Near copies at a similarity of 0.8, by SimHash and Hamming balls over the least certain bits.

A text's distinct five-word shingles set 320 bits by majority, cut into ten segments of 32. Two texts of
Jaccard similarity s agree in a bit with probability ``1 - acos(2s / (1 + s)) / pi``: at 0.8 they differ in
48 of 320 bits, nearly always in bits that one of the two decided by a narrow majority. Of each segment the
ball over its ``LOOSE`` narrowest bits is enumerated, 16 keys; texts that share a key and differ in at most
``MOST_BITS`` are compared on their whole sets of shingles, and link from 80 % similarity on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import LOWER_TABLE, broadcast_if_small, spread_join, text_blocks, text_or_empty, written
from gridfold.llm.components import merged_components
from gridfold.llm.hashing import PRIME, mixed
from gridfold.llm.setlinks import confirmed, nearest_pairs, pairs_across, set_keys, shingle_sets
from gridfold.llm.simhash import bit_counts

FIELDS, SEGMENT, LOOSE = 5, 32, 4
SEGMENTS = FIELDS * 64 // SEGMENT
#: Similarity in percent, and differing bits up to which sets are compared: those expected at 0.8 and 2.5 deviations.
PERCENT, MOST_BITS = 80, 64
#: Classes from which a component is large: its members are compared with those of small ones, from the others' side.
LARGE = 32
#: Classes whose keys a task lists and counts.
KEYED = 8192
#: Long columns that hold the places of the narrowest bits, three segments in each.
PACKED = -(-SEGMENTS // 3)
BITS = [f"b{i}" for i in range(FIELDS)]
PLACES = [f"p{i}" for i in range(PACKED)]


def wide_fingerprints(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``texts x FIELDS`` words of bits, and ``texts x PACKED`` words with five bits for each narrow place."""
    bits, margins = np.zeros((len(counts), FIELDS), np.uint64), np.zeros((len(counts), FIELDS * 64), np.int64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k in range(FIELDS):
        ones = bit_counts(mixed(hashes * PRIME + np.uint64(2 * k + 1)), counts)
        bits[:, k] = ((2 * ones > counts[:, None]) * weights).sum(axis=1, dtype=np.uint64)
        margins[:, 64 * k : 64 * k + 64] = np.abs(2 * ones - counts[:, None])
    narrow = np.argsort(margins.reshape(len(counts), SEGMENTS, SEGMENT), axis=2, kind="stable")[:, :, :LOOSE].astype(np.uint64)
    packed = np.zeros((len(counts), PACKED), np.uint64)
    for s in range(SEGMENTS):
        for j in range(LOOSE):
            packed[:, s // 3] |= narrow[:, s, j] << np.uint64(5 * (LOOSE * (s % 3) + j))
    return bits, packed


def segment_keys(bits: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """``texts x keys`` of all segments: a segment's number above its 32 bits, narrow ones in every combination."""
    out = []
    subsets = np.arange(1 << LOOSE)
    for s in range(SEGMENTS):
        own = (bits[:, s // 2] >> np.uint64(32 * (s % 2))) & np.uint64(0xFFFFFFFF)
        mask = np.zeros((len(bits), 1 << LOOSE), np.uint64)
        for j in range(LOOSE):
            place = (packed[:, s // 3] >> np.uint64(5 * (LOOSE * (s % 3) + j))) & np.uint64(31)
            mask ^= np.where((subsets >> j) & 1, np.uint64(1) << place[:, None], np.uint64(0))
        out.append((own[:, None] ^ mask) | np.uint64(s << 32))
    return np.concatenate(out, axis=1)


PRINTS = "doc_id long, n long, k1 long, k2 long, " + ", ".join(f"{c} long" for c in [*BITS, *PLACES])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for first, last, data, offsets in text_blocks(batch.column("text")):
            hashes, counts = shingle_sets(LOWER_TABLE[data], offsets)
            wide = np.concatenate(wide_fingerprints(hashes, counts), axis=1).view(np.int64)
            columns = [counts.astype(np.int64), *set_keys(hashes, counts), *(np.ascontiguousarray(c) for c in wide.T)]
            yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), *map(pa.array, columns)], ["doc_id", "n", "k1", "k2", *BITS, *PLACES])


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls, columns = batch.column(0).to_numpy(), np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1).view(np.uint64)
        for rows in np.array_split(np.arange(len(columns)), -(-len(columns) // 1024) or 1):
            keys = segment_keys(columns[rows, :FIELDS], columns[rows, FIELDS:])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(cls[rows], keys.shape[1]))], ["key", "cls"])


def set_classes(prints: DataFrame) -> DataFrame:
    """One row for each different shingle set, with a number ``cls`` and the smallest ``doc_id`` as ``least``; written."""
    first = [F.first(c).alias(c) for c in ("n", *BITS, *PLACES)]
    return written(prints.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), *first).withColumn("cls", F.monotonically_increasing_id()))


def distance(left: str, right: str, fields: list[str] = BITS) -> Column:
    """Differing bits of two fingerprints, in columns with a suffix each."""
    return sum((F.bit_count(F.col(f"{c}{left}").bitwiseXOR(F.col(f"{c}{right}"))) for c in fields), F.lit(0))


def _suffixed(rows: DataFrame, suffix: str, *columns: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{c}{suffix}") for c in columns))


def _candidates(met: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs of classes ``(a, b)`` that differ in at most ``MOST_BITS`` bits; written."""
    known = broadcast_if_small(classes.select("cls", *BITS))
    both = met.distinct().join(_suffixed(known, "_l", "cls", *BITS), F.col("a") == F.col("cls_l")).join(_suffixed(known, "_r", "cls", *BITS), F.col("b") == F.col("cls_r"))
    return written(both.where(distance("_l", "_r") <= MOST_BITS).select("a", "b"))


def class_roots(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``(node, root)`` of all classes with a link: a Jaccard similarity of ``PERCENT`` or more that a shared key has brought together.

    In every key the members are first compared with one of them, the one of least number; of what is in one component
    by then no pair needs comparing. Where a key holds several components, every pair across them is compared, however
    many members it has.
    """
    roots = classes.sparkSession.createDataFrame([], "node long, root long")
    # A task counts few enough keys to need no spill; numbers of classes are in no order of texts, so the least is as good a pivot as any.
    tasks = 1 + classes.count() // KEYED
    keyed = classes.where("n > 0").select("cls", *BITS, *PLACES).repartition(tasks).mapInArrow(_key_batches, "key long, cls long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("cls").alias("low"), F.max("cls").alias("high"))
    sizes = written(sizes.where("low < high"))
    several = sizes.where("members > 2").select("key", F.col("low").alias("pivot"))
    inside = written(keyed.join(broadcast_if_small(several.select("key")), "key", "left_semi"))
    members = written(spread_join(inside, several, "key"))
    twos = sizes.where("members = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    pairs = _candidates(twos.union(members.where("cls <> pivot").select("cls", "pivot")), classes)
    if pairs.isEmpty():
        return roots
    roots = merged_components(roots, confirmed(pairs, classes, docs, PERCENT))
    # Pairs across components: of a small one with any, and of two large ones, which few keys hold.
    large = roots.groupBy("root").count().where(F.col("count") >= LARGE).select("root", F.lit(True).alias("large"))
    named = roots.withColumnRenamed("node", "cls").join(broadcast_if_small(large), "root", "left")
    known = members.select("key", "cls").join(broadcast_if_small(named), "cls", "left")
    known = known.withColumns({"root": F.coalesce("root", "cls"), "large": F.coalesce("large", F.lit(False))})
    known = written(known.join(broadcast_if_small(classes.select("cls", *BITS)), "cls"))
    bigs = known.where("large")
    several = written(bigs.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"))
    met = _across_components(known.where("not large"), known).union(_across_components(*[spread_join(bigs, several, "key")] * 2))
    further = written(met.groupBy("a", "b").agg(F.min("bits").alias("bits")))
    # First each class with its nearest; what that puts into one component needs no comparing later.
    for chosen in (nearest_pairs, lambda pairs: pairs_across(pairs, roots)):
        pairs = written(chosen(further))
        if not pairs.isEmpty():
            roots = merged_components(roots, confirmed(pairs, classes, docs, PERCENT))
    return roots


def _across_components(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(a, b, bits)`` of members that share a key, are in different components and differ in at most ``MOST_BITS`` bits."""
    columns = ("key", "cls", "root", *BITS)
    bits = distance("_l", "_r")
    shared = (F.col("key_l") == F.col("key_r")) & (F.col("root_l") != F.col("root_r")) & (bits <= MOST_BITS)
    met = _suffixed(left, "_l", *columns).join(_suffixed(right, "_r", *columns), shared)
    return met.select(F.least("cls_l", "cls_r").alias("a"), F.greatest("cls_l", "cls_r").alias("b"), bits.alias("bits"))


def near_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, stays)`` for every row of ``docs``; written.

    ``n`` is the number of distinct shingles; ``stays`` marks the rows with the smallest ``doc_id`` of their group of
    linked classes, and rows without ``doc_id``. Texts without words form one class. An empty table gives no rows.
    """
    prints = written(text_or_empty(docs, "doc_id").mapInArrow(_fingerprint_batches, PRINTS))
    classes = set_classes(prints)
    roots = class_roots(classes, docs)
    named = classes.select("cls", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = written(named.groupBy("root").agg(F.min("least").alias("doc_id")).where("doc_id is not null").select("doc_id", F.lit(True).alias("stays")))
    found = prints.select("doc_id", "n").join(least, "doc_id", "left")
    return written(found.select("doc_id", "n", (F.col("doc_id").isNull() | F.coalesce("stays", F.lit(False))).alias("stays")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the smallest ``doc_id``.

    Rows without a ``doc_id`` can't be told apart by id and all stay. Where several rows carry the id that
    stays, one of them stays. Up to a count of ids that go, they are broadcast, and texts are not shuffled.
    """
    told = near_copies(docs)
    gone = told.where(~F.col("stays")).select("doc_id").distinct()
    kept = docs.join(broadcast_if_small(gone), "doc_id", "left_anti")
    twice = told.where("stays and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.isEmpty():
        twice = broadcast_if_small(twice)
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(docs.columns)
