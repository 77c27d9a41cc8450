"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every slot of a hashed vocabulary has a sparse random index vector: +1 in one dimension, -1 in another. A
first pass over all texts adds, for every token, the index vectors of its neighbours to its slot's context
vector; each task sums its own share, the shares are added up by slices of the vocabulary, and the
bounded result becomes the word vectors. A document is the mean of its tokens' vectors together with the
mean weighted by rarity and the likeness of neighbouring tokens. A two-layer network is fitted to a bounded sample of labelled rows,
its logits divided by a temperature fitted on rows kept out, and a last pass scores every text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm.common import hash_slot, table, text_blocks, text_or_empty
from gridfold.llm.hashing import span_hashes
from gridfold.llm.training import labelled_sample, sigmoid, temperature

#: Labelled rows of either label that the fit may use; one in five of them sets the temperature.
FIT_ROWS = 1500
BITS, DIMS, REACH, SLICES, SHRINK = 13, 32, 2, 16, 8
#: Inputs of the network.
WIDTH = 2 * DIMS + 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 64, 0.01, 1e-4
#: Byte classes: 0 white space, 1 small letters and all beyond ASCII, 2 capitals, 3 digits, 4 and up one for each sign.
CLASS = np.arange(256) + 4
CLASS[list(b" \t\n\x0b\x0c\r")] = 0
CLASS[97:123] = CLASS[128:] = 1
CLASS[65:91], CLASS[48:58] = 2, 3
CLASS = CLASS.astype(np.int16)
#: A capital before small letters belongs to their token.
JOINED = np.array([2, 1])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary slots of the tokens of a block, and cuts: text i has tokens cuts[i] to cuts[i + 1].

    A token is a run of bytes of one class: letters (with a leading capital), capitals, digits, or one sign.
    """
    kind = CLASS[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) & ~((kind[1:] == JOINED[1]) & (kind[:-1] == JOINED[0]))
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    solid = kind[starts] != 0
    starts, ends = starts[solid], ends[solid]
    slots = (span_hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    return slots, np.searchsorted(starts, offsets)


def index_dimensions() -> tuple[np.ndarray, np.ndarray]:
    """The positive and the negative dimension of every slot's index vector."""
    rng = np.random.default_rng(17)
    plus = rng.integers(0, DIMS, 1 << BITS)
    return plus, (plus + rng.integers(1, DIMS, 1 << BITS)) % DIMS


def context_sums(slots: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Slots x (dimensions, and the count) sums over a block; neighbours are at most ``REACH`` tokens apart."""
    plus, minus = index_dimensions()
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    up, down = [], []
    for far in range(1, REACH + 1):
        same = owner[far:] == owner[:-far]
        left, right = slots[:-far][same], slots[far:][same]
        up += [left * DIMS + plus[right], right * DIMS + plus[left]]
        down += [left * DIMS + minus[right], right * DIMS + minus[left]]
    size = DIMS << BITS
    sums = np.bincount(np.concatenate(up), minlength=size) - np.bincount(np.concatenate(down), minlength=size)
    return np.concatenate([sums.reshape(-1, DIMS), np.bincount(slots, minlength=1 << BITS)[:, None]], axis=1)


SUMS = pa.schema([("slice", pa.int32()), ("sums", pa.binary())])


def _slices(total: np.ndarray) -> pa.RecordBatch:
    parts = np.split(total, SLICES)
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.astype(np.int64).tobytes() for p in parts], pa.binary())], schema=SUMS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << BITS, DIMS + 1), np.int64)
    for batch in batches:
        for _, _, data, offsets in text_blocks(batch.column("text")):
            total += context_sums(*tokens(data, offsets))
    yield _slices(total)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(part.as_buffer(), np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], schema=SUMS)


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Word vectors of all slots, of length 1 or 0, and each slot's part of all tokens, from all texts."""
    counted = text_or_empty(docs).mapInArrow(_count, "slice int, sums binary")
    added = counted.repartition(SLICES, "slice").mapInArrow(_add, "slice int, sums binary")
    total = np.zeros((SLICES, (1 << BITS) // SLICES * (DIMS + 1)))
    for row in added.collect():  # SLICES rows of 135 KB, at any input
        total[row["slice"]] = np.frombuffer(row["sums"], np.int64)
    total = total.reshape(-1, DIMS + 1)
    damped = np.sign(total[:, :DIMS]) * np.sqrt(np.abs(total[:, :DIMS]))
    norm = np.sqrt((damped**2).sum(axis=1, keepdims=True))
    return (damped / np.maximum(norm, 1e-9)).astype(np.float32), total[:, DIMS] / max(total[:, DIMS].sum(), 1)


def pooled(vectors: np.ndarray, rare: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x ``WIDTH``: mean vector, mean vector by rarity, likeness of next tokens, log of their number.

    Means are shrunk as if ``SHRINK`` more tokens had a vector of zeros.
    """
    slots, cuts = tokens(data, offsets)
    out = np.zeros((len(offsets) - 1, WIDTH), np.float32)
    has = np.flatnonzero(np.diff(cuts))
    if len(has):
        at, n = cuts[has], np.diff(cuts)[has, None]
        weight = rare[slots]
        own = vectors[slots]
        alike = np.zeros(len(slots), np.float32)
        alike[1:] = (own[1:] * own[:-1]).sum(axis=1)
        alike[at] = 0
        out[has, :DIMS] = np.add.reduceat(own, at, axis=0) / (n + SHRINK)
        out[has, DIMS : 2 * DIMS] = np.add.reduceat(own * weight[:, None], at, axis=0) / (np.add.reduceat(weight, at) + SHRINK / 4)[:, None]
        out[has, -2] = np.add.reduceat(alike, at) / (n[:, 0] + SHRINK)
        out[has, -1] = np.log1p(n[:, 0]) / 5
    return out


def network_logits(net: dict, x: np.ndarray) -> np.ndarray:
    return (np.tanh((x - net["mean"]) / net["scale"] @ net["w"] + net["b"]) @ net["v"] + net["c"])[:, 0]


def train(x: np.ndarray, y: np.ndarray, seed: int = 9) -> dict[str, np.ndarray]:
    """A two-layer network fitted by Adam to class-balanced log loss, and its temperature."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    net = {"w": rng.normal(0, width**-0.5, (width, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), "c": np.zeros(1)}
    fixed = {"mean": x.mean(axis=0) if len(x) else np.zeros(width), "scale": (x.std(axis=0) if len(x) else np.zeros(width)) + 1e-3, "temperature": 1.0}
    if len(y) < 20 or y.min() == y.max():
        net["v"][:], net["c"][:] = 0, 2.0 if not len(y) or y.mean() >= 0.5 else -2.0
        return net | fixed
    held = np.arange(len(y)) % 5 == 0
    xt, yt = (x[~held] - fixed["mean"]) / fixed["scale"], y[~held]
    first, second, step = {k: 0.0 for k in net}, {k: 0.0 for k in net}, 0
    for _ in range(EPOCHS):
        for own in np.array_split(rng.permutation(len(yt)), -(-len(yt) // BATCH)):
            step += 1
            h = np.tanh(xt[own] @ net["w"] + net["b"])
            error = (sigmoid((h @ net["v"] + net["c"])[:, 0]) - yt[own])[:, None] / len(own)
            back = error @ net["v"].T * (1 - h * h)
            grad = {"w": xt[own].T @ back, "b": back.sum(axis=0), "v": h.T @ error, "c": error.sum(axis=0)}
            for k, g in grad.items():
                g = g + DECAY * net[k]
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g * g
                net[k] = net[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    fixed["temperature"] = temperature(network_logits(net | fixed, x[held]), y[held])
    return net | fixed


def _scorer(model) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, rare, net = model.value
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, data, offsets in text_blocks(batch.column("text")):
                scores.append(sigmoid(network_logits(net, pooled(vectors, rare, data, offsets)) / net["temperature"]))
            own = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own), pa.array((own >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return score


def classify(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``docs``; ``allowed`` marks label rows that may be learned.

    ``score`` is the probability of label 1 in a balanced sample. Null and empty texts are scored like any
    other, with no tokens. Without enough labels of both kinds all texts score alike. Texts of over
    100,000 bytes are scored whole, but their labels never enter the fit. ``fit_rows`` bounds
    the labelled rows of either label in the fit; the word vectors come from all texts.
    """
    vectors, part = word_vectors(docs)
    rare = (1e-4 / (1e-4 + part)).astype(np.float32)
    texts, y = labelled_sample(docs, labels, "quality", fit_rows, allowed)
    x = np.concatenate([np.zeros((0, WIDTH), np.float32), *(pooled(vectors, rare, data, offsets) for _, _, data, offsets in text_blocks(texts))])
    model = docs.sparkSession.sparkContext.broadcast((vectors, rare, train(x.astype(np.float64), y)))  # 1 MB, set by BITS and DIMS
    return text_or_empty(docs, "doc_id").mapInArrow(_scorer(model), "doc_id long, score double, predicted int")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by :func:`classify`; rows without ``doc_id`` have no label, so they are held out."""
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), hash_slot("doc_id", 3) != 1)
    return found.select("doc_id", F.coalesce(hash_slot("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", "predicted")
