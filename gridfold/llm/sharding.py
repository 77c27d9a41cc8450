"""Sharding as vector bin packing of bytes, tokens and rows.

Rows of equal text form a group. Groups of at least one part in ``BUCKETS`` of any total are items of
their own (at most three times ``BUCKETS`` of them can exist); all others fall into cells by size class
and text hash, so the list of items that the packing sees has a fixed bound at every input size. Items
go, largest first, to the shard whose residual capacity has the highest dot product with the item among
those whose bytes still fit. Only a group that no shard can hold is cut into pieces by document id: one
larger than a shard's share, or one whose bytes fit nowhere beside the larger groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfold.llm.common import checkpointed, count_words, table

SHARDS, BUCKETS, CLASSES, RUN_ROWS = 8, 2048, 24, 10_000
#: Pieces of a group that no shard can hold, for each shard.
PIECES = 8
BLANKS = r"\x20\x09-\x0D"


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32, tokens, k1, k2, class, bucket)`` of every row; null texts count as empty."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        count_words(F.col("text"), BLANKS).alias("tokens"),
        F.xxhash64("text").alias("k1"),
        F.xxhash64(F.lit(1), "text").alias("k2"),
    )
    size_class = F.least(F.floor(F.log2("size")), F.lit(CLASSES - 1)).cast("int")
    return rows.withColumns({"class": size_class, "bucket": F.pmod("k1", F.lit(BUCKETS)).cast("int")})


def pack(items: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each item, and whether its bytes fitted there; ``items`` has bytes, tokens and rows.

    The shares are of the totals of ``items``; an item that fits nowhere goes where most bytes are left.
    """
    return _packed(items, np.maximum(items.sum(axis=0), 1), shards)


def _packed(items: np.ndarray, total: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    share = items / total
    left = np.full((shards, items.shape[1]), 1.0 / shards)
    placed, fitted = np.zeros(len(items), np.int64), np.ones(len(items), bool)
    for i in np.lexsort((np.arange(len(items)), -share.sum(axis=1))):
        fits = left[:, 0] >= share[i, 0]
        fitted[i] = fits.any()
        score = np.where(fits, left @ share[i], -np.inf) if fitted[i] else left[:, 0]
        placed[i] = int(np.argmax(score))
        left[placed[i]] -= share[i]
    return placed, fitted


def _vectors(items: list) -> np.ndarray:
    return np.array([[x["size"], x["tokens"], x["n"]] for x in items], float).reshape(-1, 3)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, tokens, shard, slot)``, one row for every row of ``docs``.

    Shards have nearly equal ``size`` sums and tokens and rows as near as the packing allows; rows of equal
    text share a shard unless their group exceeds a shard's share of bytes, tokens or rows, or its bytes
    fit into no shard beside the larger groups. ``slot`` counts the rows of a shard from 0 without gaps. Null
    texts count as empty ones; repeated rows are packed like any other; rows without ``doc_id`` come first
    in their run. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = checkpointed(measured(docs))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    total = rows.agg(*sums).first()
    if not total["n"]:
        return rows.select("doc_id", "size", "text_crc32", "tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    groups = checkpointed(rows.groupBy("k1", "k2", "class", "bucket").agg(*sums))
    large = (F.col("n") > 1) & ((F.col("size") * BUCKETS > total["size"]) | (F.col("tokens") * BUCKETS > F.lit(total["tokens"])) | (F.col("n") * BUCKETS > total["n"]))
    cells = groups.where(~large).groupBy("class", "bucket").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).collect()  # at most CLASSES * BUCKETS
    whole = sorted(groups.where(large).collect(), key=lambda x: (x["k1"], x["k2"]))  # at most 3 * BUCKETS groups
    everything = np.maximum(_vectors([total])[0], 1)
    over = (_vectors(whole) * shards > everything).any(axis=1)
    kept = [x for x, cut in zip(whole, over, strict=True) if not cut]
    fitted = _packed(_vectors(kept), everything, shards)[1]
    halved = [(x["k1"], x["k2"]) for x, cut in zip(whole, over, strict=True) if cut] + [(x["k1"], x["k2"]) for x, fits in zip(kept, fitted, strict=True) if not fits]
    whole = [x for x, fits in zip(kept, fitted, strict=True) if fits]

    pieces = PIECES * shards
    piece = F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).cast("int")
    cut = F.broadcast(spark.createDataFrame(halved, "k1 long, k2 long"))
    parts = rows.join(cut, ["k1", "k2"]).groupBy("k1", "k2", piece.alias("piece")).agg(*sums).collect() if halved else []
    items = [((x["k1"], x["k2"], 0), x) for x in whole] + [((x["k1"], x["k2"], x["piece"]), x) for x in parts] + [((x["class"], x["bucket"], -1), x) for x in cells]
    items.sort(key=lambda x: x[0])
    placed, _ = pack(_vectors([x for _, x in items]), shards)
    # The two tables that follow are bounded by BUCKETS, CLASSES and shards, whatever the input.
    places = spark.createDataFrame([(*key, int(s)) for (key, _), s in zip(items, placed, strict=True)], "u1 long, u2 long, u3 int, shard int")
    known = spark.createDataFrame([(x["k1"], x["k2"], 1) for x in whole] + [(*x, pieces) for x in halved], "k1 long, k2 long, pieces int")

    in_cell = F.col("pieces").isNull()
    unit = rows.join(F.broadcast(known), ["k1", "k2"], "left").select(
        "doc_id", "size", "text_crc32", "tokens",
        F.when(in_cell, F.col("class").cast("long")).otherwise(F.col("k1")).alias("u1"),
        F.when(in_cell, F.col("bucket").cast("long")).otherwise(F.col("k2")).alias("u2"),
        F.when(in_cell, F.lit(-1)).when(F.col("pieces") == 1, F.lit(0)).otherwise(piece).alias("u3"),
    )
    runs = -(-total["n"] // (shards * RUN_ROWS))
    unit = unit.join(F.broadcast(places), ["u1", "u2", "u3"]).withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = unit.groupBy("shard", "run").count().select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    numbered = unit.withColumn("at", F.row_number().over(within))
    return numbered.join(starts, ["shard", "run"]).select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("start") + F.col("at") - 1).alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of ``documents`` by :func:`shard_documents`, under the law ``bytes``."""
    found = shard_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
