"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``SPAN`` bytes in both directions, labels every byte position, and a document's
probability is the mean over all positions of all its windows. It is trained in numpy by backpropagation
through time on windows of a bounded sample of labelled texts, and scores Arrow batches: windows of many
documents run side by side, so a long document costs what its bytes cost and memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfold.llm.common import checkpointed, hash_slot, table, text_blocks, text_or_empty

#: Labelled rows of each language and windows of each text that the fit may use.
FIT_ROWS, FIT_WINDOWS = 300, 12
SPAN, HIDDEN, EPOCHS, BATCH, RATE, SIDE = 64, 12, 14, 256, 0.012, 2048
#: Chosen rows up to which they are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Least score at which the filter keeps a document.
LEAST_SCORE = 0.4
UNDETERMINED = "und"
PAD = 256  # the input after the end of a text


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``SPAN`` x windows inputs of all texts in turn, the text of each window, and its number of bytes."""
    size = np.diff(offsets)
    count = -(-size // SPAN)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[owner] + nth * SPAN
    length = np.minimum(offsets[owner + 1] - start, SPAN)
    at = start[None, :] + np.arange(SPAN)[:, None]
    known = data.astype(np.int16)[np.minimum(at, max(len(data) - 1, 0))] if len(data) else np.zeros(at.shape, np.int16)
    return np.where(np.arange(SPAN)[:, None] < length[None, :], known, np.int16(PAD)), owner, length


def fresh_network(classes: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Tables of input contributions (gates in rows: update, reset, candidate), recurrent and output weights."""
    net = {}
    for side in ("f", "b"):
        net[f"x{side}"] = rng.normal(0, 0.3, (PAD + 1, 3 * HIDDEN))
        net[f"u{side}"] = rng.normal(0, 0.4 / HIDDEN**0.5, (2 * HIDDEN, HIDDEN))
        net[f"c{side}"] = rng.normal(0, 0.8 / HIDDEN**0.5, (HIDDEN, HIDDEN))
    net["o"], net["ob"] = rng.normal(0, 0.3, (classes, 2 * HIDDEN)), np.zeros((classes, 1))
    return {k: v.astype(np.float32) for k, v in net.items()}


def _run(net: dict, side: str, inputs: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states ``steps x HIDDEN x windows`` in reading order of the given side."""
    x, u, c = net[f"x{side}"], net[f"u{side}"], net[f"c{side}"]
    half = np.float32(0.5)
    h = np.zeros((HIDDEN, inputs.shape[1]), np.float32)
    states = np.empty((len(inputs), *h.shape), np.float32)
    for t in range(len(inputs)) if side == "f" else range(len(inputs) - 1, -1, -1):
        given = x[inputs[t]].T
        gates = np.tanh((u @ h + given[: 2 * HIDDEN]) * half) * half + half  # the logistic function
        z, r = gates[:HIDDEN], gates[HIDDEN:]
        new = np.tanh(c @ (r * h) + given[2 * HIDDEN :])
        if trace is not None:
            trace.append((t, h, z, r, new))
        h = h + z * (new - h)
        states[t] = h
    return states


def position_probabilities(net: dict, inputs: np.ndarray) -> np.ndarray:
    """Probabilities ``steps x classes x windows`` of every position."""
    both = np.concatenate([_run(net, "f", inputs), _run(net, "b", inputs)], axis=1)
    scores = net["o"] @ both + net["ob"]
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    return scores / scores.sum(axis=1, keepdims=True)


def gradients(net: dict, inputs: np.ndarray, length: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss over all positions, back through time on both sides."""
    traces: dict[str, list] = {"f": [], "b": []}
    states = {s: _run(net, s, inputs, traces[s]) for s in "fb"}
    both = np.concatenate([states["f"], states["b"]], axis=1)
    scores = net["o"] @ both + net["ob"]
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    error = scores / scores.sum(axis=1, keepdims=True)
    error[:, y, np.arange(len(y))] -= 1
    error *= (np.arange(SPAN)[:, None] < length[None, :])[:, None, :] / np.float32(length.sum())
    grad = {"o": np.einsum("tkb,thb->kh", error, both, optimize=True), "ob": error.sum(axis=(0, 2))[:, None]}
    down = net["o"].T @ error
    for s, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
        gx = np.zeros((3 * HIDDEN, SPAN, len(y)), np.float32)
        gu, gc = np.zeros_like(net[f"u{s}"]), np.zeros_like(net[f"c{s}"])
        dh = np.zeros((HIDDEN, len(y)), np.float32)
        for t, h, z, r, new in reversed(traces[s]):
            dh = dh + down[t, part]
            dn = dh * z * (1 - new * new)
            drh = net[f"c{s}"].T @ dn
            dzr = np.concatenate([dh * (new - h) * z * (1 - z), drh * h * r * (1 - r)])
            gx[: 2 * HIDDEN, t], gx[2 * HIDDEN :, t] = dzr, dn
            gu += dzr @ h.T
            gc += dn @ (r * h).T
            dh = dh * (1 - z) + drh * r + net[f"u{s}"].T @ dzr
        flat, by = gx.reshape(3 * HIDDEN, -1), inputs.ravel()
        grad[f"x{s}"] = np.stack([np.bincount(by, g, PAD + 1) for g in flat], axis=1).astype(np.float32)
        grad[f"u{s}"], grad[f"c{s}"] = gu, gc
    return grad


def train(inputs: np.ndarray, length: np.ndarray, y: np.ndarray, classes: int, epochs: int = EPOCHS, seed: int = 5) -> dict[str, np.ndarray]:
    """A network fitted by Adam to windows and the class of each."""
    rng = np.random.default_rng(seed)
    net = fresh_network(classes, rng)
    first, second, step = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}, 0
    rounds = -(-len(y) // BATCH)
    for epoch in range(epochs):
        for own in np.array_split(rng.permutation(len(y)), rounds):
            step += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * step / (epochs * rounds + 1)))
            grad = gradients(net, inputs[:, own], length[own], y[own])
            norm = max(1.0, sum(float((g * g).sum()) for g in grad.values()) ** 0.5)
            for k, g in grad.items():
                g = g / norm
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def document_probabilities(net: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``texts x classes`` mean probabilities over the positions of each text; zeros for empty texts."""
    classes = len(net["ob"])
    total = np.zeros((classes, len(offsets) - 1))
    inputs, owner, length = windows_of(data, offsets)
    for a in range(0, len(owner), SIDE):
        own = slice(a, a + SIDE)
        p = position_probabilities(net, inputs[:, own])
        p *= (np.arange(SPAN)[:, None] < length[None, own])[:, None, :]
        sums = p.sum(axis=0)
        for k in range(classes):
            total[k] += np.bincount(owner[own], sums[k], len(offsets) - 1)
    return (total / np.maximum(np.diff(offsets), 1)).T


def fit(docs: DataFrame, allowed: Column, fit_rows: int = FIT_ROWS) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and a network, from ``text`` and ``lang`` of at most ``fit_rows`` allowed rows of each language.

    The rows are those with the smallest hash of ``doc_id``; of each text up to ``FIT_WINDOWS`` windows spread
    over the whole of it are used.
    """
    known = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id"))
    chosen = checkpointed(known.withColumn("_rank", rank).where(F.col("_rank") <= fit_rows).select("doc_id", F.col("lang").alias("_lang")))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    places = F.sequence(F.lit(0), F.lit(FIT_WINDOWS - 1))
    cut = F.transform(places, lambda i: F.substring(F.col("text"), F.floor(i * F.length("text") / FIT_WINDOWS).cast("int") + 1, F.lit(SPAN)))
    rows = docs.select("doc_id", "text", "lang").join(chosen, "doc_id").where(F.col("lang") == F.col("_lang")).select("doc_id", "lang", F.array_distinct(cut).alias("cuts"))
    got = rows.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id", "lang", "cuts").collect()
    languages = sorted({x["lang"] for x in got})
    pieces = [(c.encode()[:SPAN], languages.index(x["lang"])) for x in got for c in x["cuts"] if c]
    if not pieces:
        return languages, {}
    data = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8)
    inputs, owner, length = windows_of(data, np.cumsum([0, *(len(p) for p, _ in pieces)]))
    return languages, train(inputs, length, np.array([y for _, y in pieces])[owner], len(languages))


def _predicted(model, text: pa.Array, has_letter: pa.Array) -> tuple[list[str], np.ndarray]:
    languages, net = model.value
    found = [np.zeros((0, len(languages)))]
    for _, _, data, offsets in text_blocks(text):
        found.append(document_probabilities(net, data, offsets) if net else np.zeros((len(offsets) - 1, len(languages))))
    p, letters = np.concatenate(found), np.array(has_letter.to_pylist(), bool) & bool(net)
    best = p.argmax(axis=1) if p.shape[1] else np.zeros(len(p), int)
    score = np.where(letters, np.minimum(p[np.arange(len(p)), best], 1.0), 0.0) if p.shape[1] else np.zeros(len(p))
    return [languages[k] if ok else UNDETERMINED for k, ok in zip(best, letters, strict=True)], score


def _predictor(model) -> Callable:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = _predicted(model, batch.column("text"), batch.column("has_letter"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return predict


def _sieve(model, least: float) -> Callable:
    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            lang, score = _predicted(model, batch.column(n - 1), batch.column(n - 2))
            keep = np.array([x != UNDETERMINED for x in lang], bool) & (score >= least)
            yield batch.select(range(n - 2)).filter(pa.array(keep))

    return sieve


HAS_LETTER = r"\p{L}"


def identify(docs: DataFrame, allowed: Column, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row of ``docs``.

    ``allowed`` marks rows whose ``lang`` may be learned; ``lang`` and ``doc_id`` take no part in a prediction.
    Null, empty and letterless texts are ``und`` with score 0, and so is every text where nothing could be
    learned. ``score`` is the mean probability of the language over all byte positions.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, allowed, fit_rows))  # some 100 KB, set by HIDDEN
    rows = text_or_empty(docs, "doc_id").withColumn("has_letter", F.col("text").rlike(HAS_LETTER))
    return rows.mapInArrow(_predictor(model), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, allowed: Column, least: float = LEAST_SCORE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is determined with a score of ``least`` or more.

    Null, empty and letterless texts go. The filter runs in one pass, without a join.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, allowed, fit_rows))
    rows = docs.withColumn("_gridfold_letter", F.coalesce(F.col("text").rlike(HAS_LETTER), F.lit(False))).withColumn("_gridfold_text", F.coalesce(F.col("text"), F.lit("")))
    return rows.mapInArrow(_sieve(model, least), docs.schema)


def learnable(docs_key: str = "doc_id") -> Column:
    """Rows outside the hold-out fold: those whose crc32 of the id as text leaves a remainder by 5."""
    return hash_slot(docs_key, 5) != 0


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by :func:`identify`; rows without ``doc_id`` are never learned from, so held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, learnable()).select("doc_id", F.coalesce(~learnable(), F.lit(True)).alias("held_out"), "lang_pred", "score")
