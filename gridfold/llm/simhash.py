"""SimHash near-dedup by multi-index hashing over Hamming balls.

The 64-bit fingerprints are cut into two segments of 32 bits. Two fingerprints at ``4`` or fewer
differing bits differ in at most two bits of the upper segment or at most one of the lower. Every
distinct fingerprint enumerates the ball of radius one around its upper segment; two whose balls meet
are within two bits there. For the lower segment one side enumerates its ball of radius one and fetches
the table's exact matches. Keys of 32 bits keep chance matches far below one per fingerprint, so the
work grows with the number of distinct fingerprints; every match is verified on all 64 bits.

A bucket of more than ``CROWD`` fingerprints is not paired up. Its members enumerate the ball of radius
two around the whole fingerprint instead: two of them link exactly if these balls meet, so hanging
each on the smallest that shares a centre keeps every connection with rows in proportion to the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm.common import LOWER_TABLE, checkpointed, spread_join, table, text_blocks, text_or_empty
from gridfold.llm.components import connected_components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Members from which a bucket takes the way that pairs nobody up.
CROWD = 512
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of every 4-word shingle of a lower-cased text; fewer words: of the whole sequence."""
    words = text.split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - SHINGLE].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]


def bit_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``documents x 64``: how many of a document's hashes have each bit; ``counts`` says how many hashes each has."""
    ones = np.zeros((len(counts), 64), np.int64)
    has = np.flatnonzero(counts)
    if not len(has):
        return ones
    first = np.cumsum(counts[has]) - counts[has]
    pieces = -(-counts[has] // 255)  # a byte lane holds sums up to 255
    owner = np.cumsum(pieces) - pieces
    cut = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(owner, pieces))
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, cut)
        ones[has, bit::8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), owner, axis=0)
    return ones


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each document; ``hashes`` of all documents in a row, ``counts`` how many each has."""
    over = 2 * bit_counts(hashes, counts) > counts[:, None]
    return (over * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [np.zeros(0, np.uint64)]
        for first, last, data, offsets in text_blocks(batch.column("text")):
            lowered, cuts = LOWER_TABLE[data].tobytes(), offsets.tolist()
            hashes, counts = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = shingle_hashes(lowered[a:b])
                hashes += own
                counts.append(len(own))
            prints.append(majority_bits(np.array(hashes, np.uint64), np.array(counts, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(prints).view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``: the 64 bits as a signed long, one row for every row of ``docs``.

    Null and empty texts have fingerprint zero. Repeated rows give repeated rows; other columns of
    ``docs`` are not read.
    """
    return text_or_empty(docs, "doc_id").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _flips(bits: range, radius: int) -> list[int]:
    """Masks of at most ``radius`` of the given bits, as signed longs."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    one = [1 << b for b in bits]
    two = [a | b for i, a in enumerate(one) for b in one[:i]] if radius > 1 else []
    return [signed(x) for x in [0, *one, *two]]


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``(a, b)`` pairs of distinct fingerprints (column ``fp``) that connect all that differ in 4 or fewer bits.

    Outside crowded buckets these are all such pairs; within them, a connected subset.
    """
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    ball = F.array(*map(F.lit, _flips(range(32), 1)))
    high = distinct.select("fp", F.explode(ball).alias("mask")).select("fp", upper.bitwiseXOR(F.col("mask")).alias("key"))
    near = distinct.select("fp", F.explode(ball).alias("mask")).select("fp", lower.bitwiseXOR(F.col("mask")).alias("key"))
    at = distinct.select("fp", lower.alias("key"))
    crowds = lambda rows, seg: rows.groupBy("key").count().where(F.col("count") > crowd).select(F.lit(seg).alias("seg"), "key")
    full = checkpointed(crowds(high, 0).union(crowds(near, 1)))
    crowded = not full.isEmpty()

    def outside(rows: DataFrame, seg: int) -> DataFrame:
        return rows.join(full.where(f"seg = {seg}").select("key"), "key", "left_anti") if crowded else rows

    def matched(left: DataFrame, right: DataFrame, seg: int, order: str) -> DataFrame:
        left, right = outside(left, seg).select("key", F.col("fp").alias("a")), right.select("key", F.col("fp").alias("b"))
        return left.join(right, (left["key"] == right["key"]) & F.expr(order) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")

    found = matched(high, high, 0, "a < b").union(matched(near, at, 1, "a <> b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if crowded:
        within = [rows.join(full.where(f"seg = {seg}"), "key", "left_semi").select("fp") for seg, rows in enumerate((high, near))]
        members = within[0].union(within[1]).distinct()
        wide = F.array(*map(F.lit, _flips(range(64), 2)))
        centres = members.select("fp", F.explode(wide).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("key"))
        least = centres.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
        found = found.union(centres.join(least, "key").where("a <> fp").select("a", F.col("fp").alias("b")))
    return found.distinct()


def components(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of 4 or fewer differing bits, null
    only where no row of the component has a ``doc_id``. Texts without words have fingerprint zero and
    link like any other. An empty table gives no rows.
    """
    prints = checkpointed(fingerprints(docs))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(classes.select("fp")))
    named = checkpointed(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # All copies of a text share a fingerprint, and a large component shares a root: both may be hot keys.
    placed = checkpointed(spread_join(named.select("root", "fp"), least, "root").select("fp", "component_id"))
    return spread_join(prints, placed, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document by :func:`components`."""
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
