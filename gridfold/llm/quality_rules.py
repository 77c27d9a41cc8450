"""Quality rules: base rules and a hashed n-gram logistic regression with calibrated probability.

Character n-grams (of code points) and word n-grams of a text fall into hashed slots; a text's logit is the sum, over the n-gram
families, of the (smoothed) mean weight of its n-grams. The weights are fitted by AdaGrad on a bounded sample of
labelled rows, the probability is calibrated on rows kept out of the fit, and the verdict compares it
with a fixed threshold. Scoring and base rules share one pass over Arrow batches, with no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridfold.llm.common import table, text_blocks, text_or_empty
from gridfold.llm.hashing import PRIME, code_points, mixed, ngram_slots, span_hashes, spread, window_hashes, words
from gridfold.llm.training import labelled_sample, platt, sigmoid

#: Labelled rows of either label that the fit may use; one in five of them calibrates.
FIT_ROWS = 1500
BITS, CHARS, WORDS, EPOCHS, BATCH, RATE = 17, (3, 5), (1, 2), 8, 32, 1.0
#: Added to a text's number of n-grams, so that a few n-grams alone don't decide.
SMOOTH = 30
#: A text is kept from this calibrated probability on; rejecting takes clear evidence.
THRESHOLD = 0.3
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEAT = 10, 5, 20
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True


def repeated_words(text: bytes) -> int:
    """Words that stand in a window of 5 words found twice or more."""
    own = text.split()
    windows = list(zip(*(own[i:] for i in range(REPEAT_WINDOW)), strict=False))
    counts = Counter(windows)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + REPEAT_WINDOW - max(i, upto)
            upto = i + REPEAT_WINDOW
    return covered


def base_counts(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Five rows of counts of each text: words, code points in words, symbols, repeated lines, repeated words."""
    begin, end = offsets[:-1], offsets[1:]
    solid = np.ones(len(data), bool)
    solid[np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))] = False
    counts = np.zeros((5, len(begin)), np.int64)
    counts[0] = np.diff(cuts)
    counts[1] = spread(solid & ((data & 0xC0) != 0x80), begin, end)
    counts[2] = spread(IS_SYMBOL[data], begin, end)
    for i in np.flatnonzero(spread(data == 10, begin, end)):
        lines = [x for x in data[begin[i] : end[i]].tobytes().split(b"\n") if x.strip()]
        counts[3, i] = len(lines) - len(set(lines))
    # Windows that may repeat are found by hash; the texts that have any are counted word by word.
    windows = window_hashes(hashes, REPEAT_WINDOW)
    owner = np.repeat(np.arange(len(begin)), counts[0])[: len(windows)]
    inside = np.arange(len(windows)) + REPEAT_WINDOW <= cuts[owner + 1]
    owner, windows = owner[inside], mixed(windows[inside] + owner[inside].astype(np.uint64) * PRIME)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    for i in np.unique(owner[np.isin(windows, twice)]) if len(twice) else ():
        counts[4, i] = repeated_words(data[begin[i] : end[i]].tobytes())
    return counts


def families(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each n-gram family: slots of all n-grams in a row, and where each text's own begin and end."""
    points, at = code_points(data, offsets)
    for k, n in enumerate(CHARS):
        yield ngram_slots(points, n, BITS) + (k << BITS), at[:-1], np.maximum(at[:-1], at[1:] - n + 1)
    for k, n in enumerate(WORDS, len(CHARS)):
        yield (window_hashes(hashes, n) >> np.uint64(64 - BITS)).astype(np.int32) + (k << BITS), cuts[:-1], np.maximum(cuts[:-1], cuts[1:] - n + 1)


def logits(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.full(len(offsets) - 1, float(weights[-1]))
    for slots, begin, end in families(data, offsets, hashes, cuts):
        total += spread(weights[slots], begin, end) / (end - begin + SMOOTH)
    return total


def fit(texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights (the last is the intercept) and the slope and shift of the calibration."""
    size = (len(CHARS) + len(WORDS)) << BITS
    weights = np.zeros(size + 1, np.float32)
    if len(y) < 20 or y.min() == y.max():
        weights[-1] = 4.0 if not len(y) or y.mean() >= 0.5 else -4.0
        return weights, 1.0, 0.0
    square = np.full(size + 1, 1e-8, np.float32)
    rng = np.random.default_rng(3)
    held = np.arange(len(y)) % 5 == 0
    balance = np.where(y > 0.5, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def prepared(rows: np.ndarray) -> Iterator[tuple]:
        for first, last, data, offsets in text_blocks(texts.take(pa.array(rows)), 1 << 30):
            starts, ends, cuts = words(data, offsets)
            yield rows[first:last], data, offsets, span_hashes(data, starts, ends), cuts

    train = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(train), -(-len(train) // BATCH)):
            for own, *block in prepared(rows):
                error = (sigmoid(logits(weights, *block)) - y[own]) * balance[own] / len(own)
                slope = np.zeros(size + 1)
                for slots, begin, end in families(*block):
                    n = end - begin
                    at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
                    slope += np.bincount(slots[at], np.repeat(error / (n + SMOOTH), n), size + 1)
                slope[-1] = error.sum()
                met = np.flatnonzero(slope)
                square[met] += slope[met] ** 2
                weights[met] -= RATE * slope[met] / np.sqrt(square[met])
    z = np.concatenate([logits(weights, *block) for rows in np.array_split(np.flatnonzero(held), max(1, held.sum() // 64)) for _, *block in prepared(rows)])
    return weights, *platt(z, y[held])


def _scorer(model) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, slope, shift = model.value
        for batch in batches:
            counts, scores = [np.zeros((5, 0), np.int64)], [np.zeros(0)]
            for _, _, data, offsets in text_blocks(batch.column("text")):
                starts, ends, cuts = words(data, offsets)
                hashes = span_hashes(data, starts, ends)
                counts.append(base_counts(data, offsets, hashes, cuts))
                scores.append(sigmoid(slope * logits(weights, data, offsets, hashes, cuts) + shift))
            n, own = np.concatenate(counts, axis=1), np.concatenate(scores)
            failed = (n[0] < LEAST_WORDS) | (100 * n[4] > MOST_REPEAT * n[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, n), pa.array(failed), pa.array(~failed & (own >= THRESHOLD)), pa.array(own)], OUT)

    return score


OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality)``.

    One row for every row of ``docs``. Null and empty texts have zero counts and fail the base rules, as does
    any text of fewer than 10 words or with over 20 % of its words in repeated windows. ``quality`` is the
    calibrated probability. Without enough labels of both kinds every text that passes the base rules
    is kept, or none if all labels are 0. ``fit_rows`` bounds the labelled rows of either label in the fit.
    Texts of over 100,000 bytes are scored whole, but never enter the fit.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(*labelled_sample(docs, labels, "quality", fit_rows)))  # 2 MB, set by BITS
    return text_or_empty(docs, "doc_id").mapInArrow(_scorer(model), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document by :func:`judge`."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
