"""Line dedup over range-partitioned line hashes, returning compressed keep bitmaps.

Every line that counts becomes a row of hashes: 128 bits of its key, the document and the position. The
rows are range-partitioned on key, document and position and sorted within partitions, so a key that a
third of all documents hold spreads over as many partitions as its rows fill, and one pass over a sorted
partition meets each key's documents from the largest id down. Runs that cross a partition border are
settled from two summary rows for each partition, which is all that reaches the driver. Texts never
enter this shuffle; the result is one bitmap for each document that loses lines.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm.common import checkpointed, lower_ascii, table

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Bytes of all bitmaps, with 64 for each row, up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
BLANKS = " \t\n\x0b\x0c\r"


def line_rows(docs: DataFrame) -> DataFrame:
    """``(h1, h2, doc_id, text_hash, pos)`` of every line with a key of at least 40 code points."""
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", lower_ascii(F.btrim("line", F.lit(BLANKS))).alias("key")).where(F.char_length("key") >= LEAST_CHARS)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_hash", "pos")


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)])


def _new(rows: np.ndarray) -> np.ndarray:
    """True where a row's key differs from the row before; the first is True."""
    out = np.ones(rows.shape[1], bool)
    out[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    return out


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the first and the last run of a partition: key, number of documents, largest and smallest document."""
    runs: list[list[int]] = []
    for batch in batches:
        rows = _columns(batch)
        if not rows.shape[1]:
            continue
        starts = _new(rows)
        fresh = np.ones(rows.shape[1], bool)
        fresh[1:] = starts[1:] | (rows[2, 1:] != rows[2, :-1])
        at = np.flatnonzero(starts)
        counts = np.add.reduceat(fresh.astype(np.int64), at)
        last = np.append(at[1:], rows.shape[1]) - 1
        for i in sorted({0, len(at) - 1}):
            run = [int(rows[0, at[i]]), int(rows[1, at[i]]), int(counts[i]), int(rows[2, at[i]]), int(rows[2, last[i]])]
            if i == 0 and runs and runs[-1][:2] == run[:2]:
                runs[-1][2] += run[2] - (runs[-1][4] == run[3])
                runs[-1][4] = run[4]
            else:
                runs.append(run)
        if len(runs) > 2:
            runs = [runs[0], runs[-1]]
    part = TaskContext.get().partitionId()
    if runs:
        runs = [runs[0], runs[-1]] if len(runs) > 1 else runs
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(runs)), *(pa.array(list(x), pa.int64()) for x in zip(*runs, strict=True))], ["part", "h1", "h2", "docs", "largest", "smallest"])


def border_runs(ends: list) -> dict[tuple[int, int], tuple[int, int]]:
    """Of each key that is in several partitions: its number of documents and the largest one."""
    met: dict[tuple[int, int], list] = {}
    for x in sorted(ends, key=lambda x: x["part"]):
        if (key := (x["h1"], x["h2"])) in met:
            was = met[key]
            was[0] += x["docs"] - (was[2] == x["largest"])
            was[2], was[3] = x["smallest"], True
        else:
            met[key] = [x["docs"], x["largest"], x["smallest"], False]
    return {k: (v[0], v[1]) for k, v in met.items() if v[3]}


def _dropper(borders: dict[tuple[int, int], tuple[int, int]]) -> Callable:
    def settle(rows: np.ndarray) -> np.ndarray:
        """Rows of whole local runs whose line goes."""
        starts = _new(rows)
        at = np.flatnonzero(starts)
        run = np.cumsum(starts) - 1
        fresh = np.ones(rows.shape[1], bool)
        fresh[1:] = starts[1:] | (rows[2, 1:] != rows[2, :-1])
        docs, largest = np.add.reduceat(fresh.astype(np.int64), at), rows[2, at].copy()
        for i in {0, len(at) - 1} if borders else ():
            if (known := borders.get((int(rows[0, at[i]]), int(rows[1, at[i]])))) is not None:
                docs[i], largest[i] = known
        return rows[2:, (docs[run] >= LEAST_DOCS) & (rows[2] != largest[run])]

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)  # the run that may go on in the next batch, undecided
        going: tuple[int, int, int] | None = None  # a run known to go, and its largest document

        def out(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32))], ["doc_id", "text_hash", "pos"])

        for batch in batches:
            rows = _columns(batch)
            if going is not None:
                same = (rows[0] == going[0]) & (rows[1] == going[1])
                yield out(rows[2:, same & (rows[2] != going[2])])
                rows = rows[:, ~same]
            if not rows.shape[1]:
                continue
            going = None
            rows = np.concatenate([held, rows], axis=1)
            cut = int(np.flatnonzero(_new(rows))[-1])
            if cut:
                yield out(settle(rows[:, :cut]))
            held = rows[:, cut:]
            docs, largest = borders.get((int(held[0, 0]), int(held[1, 0])), (1 + int((np.diff(held[2]) != 0).sum()), int(held[2, 0])))
            if docs >= LEAST_DOCS:
                yield out(held[2:, held[2] != largest])
                going, held = (int(held[0, 0]), int(held[1, 0]), largest), held[:, :0]
        if held.shape[1]:
            yield out(settle(held))

    return drop


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for places in batch.column("places"):
            gone = np.array(places.as_py(), np.int64)
            keep = np.ones(int(gone.max()) // 8 * 8 + 8, bool)
            keep[gone] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(maps, pa.binary())], ["doc_id", "text_hash", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, keep_bitmap)`` of every document that loses lines.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least 40 code
    points that at least 5 documents hold lose all lines but those in the document with the largest id.
    The bitmap has one bit for each line, 1 to keep it, packed from the highest bit of each byte and
    zlib-compressed; it ends with the byte of the last line that goes, and later lines stay. ``text_hash`` tells rows
    apart that share a ``doc_id``; these count as one document. Rows without a ``doc_id`` take no part.
    Null, empty and short texts lose nothing; an empty table gives no rows.
    """
    order = ["h1", "h2", F.desc("doc_id"), "text_hash", "pos"]
    # Range partitioning reads its input twice, to sample and to deal: of the hashes, not of the texts.
    rows = checkpointed(checkpointed(line_rows(docs.select("doc_id", "text"))).repartitionByRange(*order).sortWithinPartitions(*order))
    ends = rows.mapInArrow(_ends, "part long, h1 long, h2 long, docs long, largest long, smallest long").collect()  # two rows a partition
    gone = rows.mapInArrow(_dropper(border_runs(ends)), "doc_id long, text_hash long, pos int")
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_list("pos").alias("places")).mapInArrow(_pack, "doc_id long, text_hash long, keep_bitmap binary")


def kept_lines(text: str | None, keep_bitmap: bytes | None) -> list[str]:
    """The lines of a text that its bitmap keeps."""
    lines = (text or "").split("\n")
    if keep_bitmap is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep_bitmap), np.uint8)).tolist()
    return [x for x, bit in zip(lines, bits, strict=False) if bit] + lines[len(bits) :]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, sha = [], [], []
        for text, bitmap in zip(batch.column("text"), batch.column("keep_bitmap"), strict=True):
            text = text.as_py() or ""
            kept = kept_lines(text, bitmap.as_py())
            n_lines.append(text.count("\n") + 1)
            n_dropped.append(n_lines[-1] - len(kept))
            sha.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``keep_bitmap``, null where no line goes.

    Bitmaps of up to ``BROADCAST_BYTES`` together are broadcast; beyond it the join shuffles the texts.
    """
    kept = checkpointed(bitmaps)
    size = kept.agg(F.coalesce(F.sum(F.length("keep_bitmap") + 64), F.lit(0))).first()[0]
    kept = F.broadcast(kept) if size <= BROADCAST_BYTES else kept.hint("shuffle_hash")
    return docs.withColumn("text_hash", F.xxhash64("text")).join(kept, ["doc_id", "text_hash"], "left")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and digest of what :func:`keep_bitmaps` leaves of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = with_bitmaps(docs, keep_bitmaps(docs))
    return joined.select("doc_id", "text", "keep_bitmap").mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP10_SQL = r"""
with lines as (
  select d.doc_id, u.pos, u.line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from documents d, lateral (
    select unnest(string_split(coalesce(d.text, ''), chr(10))) as line,
           unnest(range(len(string_split(coalesce(d.text, ''), chr(10))))) as pos) u),
common as (
  select key, max(doc_id) as largest from lines where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (
  select l.doc_id, l.pos, l.line, c.key is not null and l.doc_id <> c.largest as gone from lines l left join common c on l.key = c.key)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
