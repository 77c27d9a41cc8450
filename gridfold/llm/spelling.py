"""Spelling variants: words one edit apart, found by a frontier of states that walks a distributed trie.

The vocabulary forms two tries, one over prefixes and one over suffixes, as one table of nodes with their
edges. Of an edit one side is intact: every word starts at the node of its first half and looks for edits
behind it, and at the node of its second half and looks for edits before it, so no state branches near
the root where the trie is dense. A state is (word, direction, position, node, edits). Level by level the
frontier is joined with the node table: the word's own letter leads on, any other edge is a replaced or an
inserted letter, once. An edge knows the letters behind it, which prunes states that can't go on, and a
branch that holds a single word is a leaf, which ends a walk at once. Deletions are insertions seen from
the other word. What ends with one edit is a pair of neighbours, confirmed on the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm.common import LOWER_TABLE, checkpointed, spread_join, table, text_blocks, text_or_empty
from gridfold.llm.hashing import span_hashes

#: Shortest word, least occurrences, share of damaged runs, and how much commoner a form is.
LEAST_CHARS, LEAST_COUNT, DAMAGE, COMMONER = 6, 5, 199, 5
#: Runs that can be words; shorter ones lose letters at most.
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_CHARS},}}")
OTHER = re.compile("[^a-zÀ-ÿ]")
#: Distinct words a task holds before it hands counts on, and characters of a text read at once.
MOST_HELD, PIECE = 400_000, 1 << 20
#: Tries begin at the shortest half of a word. No letter of a word is the end mark.
LEAST_DEPTH, END = LEAST_CHARS // 2, "$"
SUFFIX_SALT = np.uint64(0xA5A5A5A5C3C3C3C3)
LOWER = bytes(LOWER_TABLE)


def damaged_runs(doc_id: int | None, text: bytes) -> Iterator[tuple[str, int]]:
    """Words of at least ``LEAST_CHARS`` letters of a text after the damage, with their number; null ids are the empty string."""
    lowered = text.translate(LOWER).decode(errors="replace")
    seed, begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), 0
    while begin < len(lowered):
        cut = OTHER.search(lowered, begin + PIECE)  # a run stays whole
        end = cut.start() if cut else len(lowered)
        for run, n in Counter(RUN.findall(lowered, begin, end)).items():
            h = zlib.crc32(run.encode(), seed)
            if h % DAMAGE == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= LEAST_CHARS:
                yield run, n
        begin = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            for word, n in damaged_runs(doc_id, text.as_buffer().to_pybytes()):
                counts[word] += n
            if len(counts) >= MOST_HELD:
                yield out()
                counts.clear()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of every word of at least 5 occurrences in all rows; counts are summed in the tasks first."""
    counted = text_or_empty(docs, "doc_id").mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a block of words, and where each word begins and ends among them."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    places = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=places[1:])
    return points, places[offsets[:-1]], places[offsets[1:]]


def _text(points: np.ndarray) -> pa.Array:
    return pa.array(list(points.astype(np.uint32).tobytes().decode("utf-32-le")), pa.string())


EDGE_NAMES = ["node", "letter", "child", "following", "word", "ends"]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both tries' edges of every word: node, letter, child, the letter behind it, the word, and whether it ends at the child."""
    for batch in batches:
        for first, last, data, offsets in text_blocks(batch.column("word")):
            points, begin, end = _letters(data, offsets)
            size = np.maximum(end - begin - LEAST_DEPTH, 0)
            owner = np.repeat(np.arange(len(size)), size)
            depth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + LEAST_DEPTH
            a, b, ends = begin[owner], end[owner], depth + 1 == (end - begin)[owner]
            padded = np.append(points, np.uint32(ord(END)))
            whole, marks = span_hashes(points, begin, end), pa.array([END] * len(size), pa.string())
            for nodes in (whole, whole ^ SUFFIX_SALT):  # a word that ends at a node passes it too
                own = pa.array(nodes.view(np.int64))
                yield pa.RecordBatch.from_arrays([own, marks, own, marks, batch.column("word").slice(first, last - first), pa.array(np.zeros(len(size), bool))], EDGE_NAMES)
            words = batch.column("word").slice(first, last - first).take(pa.array(owner))
            for nodes, letter, child, after in (
                (span_hashes(points, a, a + depth), a + depth, span_hashes(points, a, a + depth + 1), a + depth + 1),
                (span_hashes(points, b - depth, b) ^ SUFFIX_SALT, b - depth - 1, span_hashes(points, b - depth - 1, b) ^ SUFFIX_SALT, b - depth - 2),
            ):
                following = padded[np.where(ends, len(points), after)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), _text(points[letter]), pa.array(child.view(np.int64)), _text(following), words, pa.array(ends)], EDGE_NAMES)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two states that every word starts in."""
    for batch in batches:
        for first, last, data, offsets in text_blocks(batch.column("word")):
            points, begin, end = _letters(data, offsets)
            half = (end - begin) // 2
            words = batch.column("word").slice(first, last - first)
            for backward, done, node in ((False, half, span_hashes(points, begin, begin + half)), (True, end - begin - half, span_hashes(points, begin + half, end) ^ SUFFIX_SALT)):
                yield pa.RecordBatch.from_arrays([words, pa.array(np.full(len(words), backward)), pa.array(done.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(np.zeros(len(words), bool))], ["word", "backward", "done", "node", "edited"])


def trie(words: DataFrame) -> DataFrame:
    """``(node, out)``: every node that at least two words pass, with its edges, at most one a letter.

    An edge has its letter, the child (null where a single word is behind it), all letters behind it (``$`` if a
    word ends there), and the word behind it if it is single, else the word that ends at the child.
    """
    rows = words.select("word").mapInArrow(_edges, "node long, letter string, child long, following string, word string, ends boolean")
    edges = rows.groupBy("node", "letter").agg(
        F.count("*").alias("passing"), F.min("child").alias("child"), F.array_join(F.collect_set("following"), "").alias("following"),
        F.max("word").alias("single"), F.max(F.when(F.col("ends"), F.col("word"))).alias("ending"),
    )
    alone = F.col("passing") == 1
    entry = F.struct("letter", F.when(~alone, F.col("child")).alias("child"), "following", F.when(alone, F.col("single")).otherwise(F.col("ending")).alias("word"))
    nodes = edges.groupBy("node").agg(F.collect_list(F.when(F.col("letter") != END, entry)).alias("out"), F.sum("passing").alias("passing"))
    return nodes.where("passing > 1").select("node", "out")


def _letter(at: Column) -> Column:
    """The letter after ``at`` consumed ones, from the state's side; the end mark behind the last."""
    size = F.char_length("word")
    place = F.when(F.col("backward"), size - at).otherwise(at + 1)
    return F.when(at < size, F.substring(F.col("word"), place, F.lit(1))).otherwise(F.lit(END))


def step(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """States after one more edge; ``found`` is a word that may be one edit from ``word``, and ends a state."""
    done, edited, size = F.col("done"), F.col("edited"), F.char_length("word")
    at = frontier.withColumns({"now": _letter(done), "then": _letter(done + 1)}).join(nodes, "node")

    def moves(e: Column) -> Column:
        same = e["letter"] == F.col("now")
        onward = F.instr(e["following"], F.col("then")) > 0
        ahead = F.when(same, ~edited | onward).otherwise(~edited & (F.col("now") != END) & onward)
        extra = ~same & ~edited & (F.instr(e["following"], F.col("now")) > 0)
        move = lambda ok, to, changed: F.struct(ok.alias("ok"), to.alias("to"), changed.alias("changed"), e["child"].alias("child"), e["word"].alias("other"))
        return F.array(move(ahead, done + 1, edited | ~same), move(extra, done, F.lit(True)))

    moved = at.select("word", "backward", F.inline(F.filter(F.flatten(F.transform("out", moves)), lambda m: m["ok"])))
    ended = F.col("child").isNull() | (F.col("changed") & (F.col("to") == size))
    out = moved.select("word", "backward", F.col("to").alias("done"), F.when(~ended, F.col("child")).alias("node"), F.col("changed").alias("edited"), F.when(ended, F.col("other")).alias("found"))
    return out.where((F.col("node").isNotNull() | F.col("found").isNotNull()) & (F.col("found").isNull() | (F.col("found") != F.col("word"))))


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near)`` for every ordered pair of words (column ``word``, distinct) one edit apart.

    Walks end after as many levels as two words share letters in a row behind a half. Every level is
    checkpointed. A word has at most 90 letters for each of its places as neighbours.
    """
    nodes, frontier, found = checkpointed(trie(words)), words.select("word").mapInArrow(_starts, "word string, backward boolean, done int, node long, edited boolean"), []
    while True:
        reached = checkpointed(step(frontier, nodes))
        found.append(reached.where("found is not null").select(F.least("word", "found").alias("a"), F.greatest("word", "found").alias("b")))
        frontier = reached.where("node is not null").drop("found")
        if frontier.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = checkpointed(pairs.distinct().where(F.levenshtein("a", "b", 1) == 1))
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select("b", "a"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``(word, form, root)``: the last word reached over ``form``, by pointer jumping.

    A form is at least five times as common as its word, so chains are short and end.
    """
    hops = checkpointed(forms.select("word", "form", F.col("form").alias("root")))
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = checkpointed(spread_join(hops, further, "root").select("word", "form", F.col("next").alias("root")))
        if jumped.isEmpty():
            return hops
        hops = checkpointed(hops.join(jumped.select("word"), "word", "left_anti").unionByName(jumped))


def spelling_groups(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``docs``.

    Words are runs of letters after the damage (:func:`damaged_runs`), of at least 6 code points and 5 occurrences over
    all rows, repeated rows included. ``form`` is the commonest word one edit away, ties to the smallest, if it is
    at least five times as common; ``root`` follows forms to the last. Null and empty texts have no words; a null
    ``doc_id`` counts as the empty string; other columns aren't read. An empty table gives no rows.
    """
    words = checkpointed(vocabulary(docs))
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    rank = F.struct(-F.col("near_n"), F.col("near"))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(rank).alias("best"))
    known = checkpointed(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n")))
    common = F.col("near_n") >= COMMONER * F.col("n")
    forms = known.where(common).select("word", F.col("near").alias("form"))
    out = known.join(with_roots(forms), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(F.col("form").isNotNull(), F.col("near_n")).alias("form_n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, root and neighbours of every word of all ``documents`` by :func:`spelling_groups`."""
    return spelling_groups(table(spark, sf_dir, "documents"))
