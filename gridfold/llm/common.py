"""What the operators of this subpackage share: table access, checkpoints, and Arrow text buffers.

Texts reach the Python operators as Arrow batches. :func:`text_blocks` hands them on as one byte
array with offsets, cut so that a block stays near ``BLOCK_BYTES`` however long the texts are; a
single longer text forms a block of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
#: A-Z and a-z, for lower-casing ASCII letters only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte table that lower-cases A-Z.
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32
#: True for the bytes of white space: 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only on a local master, where none is set (tests), a temporary folder is made and set; on a cluster
    executors could not read it, so there a missing setting raises ``ValueError``.
    """
    known = spark.conf.get("spark.checkpoint.dir", "")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known and now.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridfold-checkpoint-"))
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known or now.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for results that joins use again round by round.

    A checkpoint keeps the estimated size of its plan, which such rounds multiply without end until planning
    stalls; a table has the size of its files. The order of rows and partitions is lost.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int = 2_000_000) -> DataFrame:
    """``df`` of a few narrow columns, checkpointed, with a broadcast hint if it has at most ``most`` rows.

    Beyond it the join shuffles.
    """
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= most else kept


def spread_join(rows: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``unique``, which has one row for each ``key``, also where few keys hold most rows.

    The keys of over one row in 1,000, so at most 1,000 of them, are joined by broadcast where their rows
    lie; only the others meet by shuffle. Both sides are read more than once, so callers checkpoint them.
    """
    hot = rows.groupBy(key).count().where(F.col("count") * 1000 > rows.count()).select(key)
    near = checkpointed(unique.join(F.broadcast(checkpointed(hot)), key))
    others = rows.join(F.broadcast(near.select(key)), key, "left_anti").join(unique, key)
    return rows.join(F.broadcast(near), key).unionByName(others)


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(col, UPPER, LOWER)


def count_words(text: Column, between: str) -> Column:
    """The number of words of a text; ``between`` lists the characters between words as in a character class.

    Every word with what follows becomes one letter, which is cheaper than to extract the words to count them.
    """
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{between}]+[{between}]*", "x")
    return (F.length(marks) - F.length(F.rtrim(marks, F.lit("x")))).cast("long")


def hash_slot(key: str, slots: int) -> Column:
    """Remainder of crc32 of the key as text, as the hold-out rules use it."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % slots


def text_blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first, last, bytes, offsets)`` over a string column; offsets start at 0 and nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def text_or_empty(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``text`` with null as empty; other columns are pruned from the scan."""
    return df.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
