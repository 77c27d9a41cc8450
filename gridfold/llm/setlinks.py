"""Sets of word shingles: their hashes, classes of equal sets, and the exact test of candidate pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import LOWER_TABLE, broadcast_if_small, text_blocks, written
from gridfold.llm.hashing import PRIME, mixed, span_hashes, window_hashes, words

SHINGLE = 5
KEY_SALTS = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Pairs that meet one copy of a set; a set in more of them is copied.
SHARE = 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of a block of lower-cased texts, text by text, and how many each has.

    A text of one to four words has one shingle, the whole of it; a text without words has none.
    """
    starts, ends, cuts = words(data, offsets)
    own = span_hashes(data, starts, ends)
    n = np.diff(cuts)
    windows = window_hashes(own, SHINGLE)
    owner = np.repeat(np.arange(len(n)), n)[: len(windows)]
    inside = np.arange(len(windows)) + SHINGLE <= cuts[owner + 1]
    owner, windows = owner[inside], windows[inside]
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    short = np.zeros(len(few), np.uint64)
    for k in range(SHINGLE - 1):
        has = n[few] > k
        short[has] = short[has] * PRIME + own[cuts[few[has]] + k]
    owner, windows = np.concatenate([owner, few]), np.concatenate([windows, mixed(short)])
    order = np.lexsort((windows, owner))
    owner, windows = owner[order], windows[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (windows[1:] != windows[:-1])
    return windows[fresh], np.bincount(owner[fresh], minlength=len(n))


def set_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, which equal sets share; zero for an empty one."""
    has = np.flatnonzero(counts)
    first = (np.cumsum(counts) - counts)[has]
    out = []
    for salt in KEY_SALTS:
        key = np.zeros(len(counts), np.uint64)
        if len(has):
            key[has] = np.add.reduceat(mixed(hashes ^ salt), first)
        out.append(key.view(np.int64))
    return out[0], out[1]


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in text_blocks(batch.column("text")):
            hashes, counts = shingle_sets(LOWER_TABLE[data], offsets)
            k1, k2 = set_keys(hashes, counts)
            ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            members = pa.ListArray.from_arrays(ends, pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), members], ["k1", "k2", "members"])


def sets_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``(cls, members)``: the shingle hashes of classes ``(cls, k1, k2, least)``, read again from their smallest document; written.

    Sets stay where they are read: only of rows that share an id and a text all but one have to go.
    """
    kept = written(wanted)
    ids = broadcast_if_small(kept.where("least is not null").select(F.col("least").alias("doc_id")).distinct())
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = texts.join(ids, "doc_id", "left_semi").select("text")
    if not kept.where("least is null").isEmpty():
        chosen = chosen.union(texts.where("doc_id is null").select("text"))
    sets = chosen.mapInArrow(_set_batches, "k1 long, k2 long, members array<long>")
    found = written(sets.join(broadcast_if_small(kept.select("cls", "k1", "k2")), ["k1", "k2"]).select("cls", "members"))
    if found.groupBy("cls").count().where("count > 1").isEmpty():
        return found
    return written(found.groupBy("cls").agg(F.first("members").alias("members")))


def alike(percent: int, common: Column, left: Column, right: Column) -> Column:
    """Whether two sets of these sizes with so many members in common are similar enough."""
    return 100 * common >= percent * (left + right - common)


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of ``(a, b)`` pairs of classes those whose whole sets have a Jaccard similarity of ``percent`` or more; written.

    ``pairs`` are distinct and written, ``classes`` have ``cls, k1, k2, least``. A class may be the ``b`` of any
    number of pairs: its set is copied for every ``SHARE`` of them, so pairs of one class spread over tasks.
    """
    both = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    sets = sets_of(both.join(classes.select("cls", "k1", "k2", "least"), "cls"), docs)
    crowded = pairs.groupBy("b").count().where(F.col("count") > SHARE)
    crowded = broadcast_if_small(crowded.select("b", F.ceil(F.col("count") / SHARE).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    dealt = pairs.join(crowded, "b", "left").select("a", "b", F.pmod(F.hash("a"), copies).alias("copy"))
    left = sets.select(F.col("cls").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("cls").alias("b"), F.col("members").alias("right")).join(crowded, "b", "left")
    right = right.select("b", "right", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    met = left.join(broadcast_if_small(dealt), "a").join(right, ["b", "copy"])
    common = F.size(F.array_intersect("left", "right")).cast("long")
    return written(met.where(alike(percent, common, F.size("left"), F.size("right"))).select("a", "b"))


def nearest_pairs(pairs: DataFrame) -> DataFrame:
    """Of ``(a, b, bits)`` each class with the one that it seems nearest to."""
    both = pairs.select("a", "b", "bits").union(pairs.select("b", "a", "bits"))
    best = both.groupBy("a").agg(F.min_by("b", F.col("bits") * (1 << 56) + F.shiftrightunsigned(F.xxhash64("b"), 8)).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def pairs_across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Of ``(a, b)`` those in different components."""
    known = broadcast_if_small(roots)
    for c in ("a", "b"):
        pairs = pairs.join(known.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    return pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
