"""Quality rules: base rules on words, then logistic regression on hashed word and character n-grams, calibrated.

Base figures of a text, over its words (maximal runs outside 0x20 and 0x09 to 0x0D): word count, code points in words,
characters that are symbols, lines equal to an earlier line, and words in 3-word windows found twice or more.
The model's features are the shares of hashed word 1- and 2-grams (lower case) and of character 4-grams (of the text as it
stands); its raw score becomes a probability by Platt scaling on a fold that it has not learned from. A document is kept
if no base rule fails it and its probability reaches `keep_at`.

Defined results: null and empty texts have zero figures and fail the base rules; without labels of both kinds the
probability is the share of label 1 with one row of each kind added; repeated rows get equal results.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm import blocks as B
from llm.labelled import Adam, collected, sample, sigmoid

BITS, MAX_ROWS, KEEP_AT, SCALE = 18, 3000, 0.25, 50.0
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
DIM = 3 << BITS
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_NOT_NEWLINE = np.zeros(256, bool)
_NOT_NEWLINE[10] = True
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = ", ".join(f"{x} long" for x in ("doc_id", *BASE_COLUMNS)) + ", base_failed boolean, kept boolean, probability double"


class Model(NamedTuple):
    """probability = sigmoid(a * (bias + mean weights of the three kinds of n-grams) + b)."""

    weights: np.ndarray
    bias: float
    a: float
    b: float


def _by_text(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number: whether its text has an equal one elsewhere, and whether an equal one comes before."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]  # lexsort is stable: the first of equals is the earliest
    return twice, later


def base_figures(block: B.Block, words: B.Words) -> np.ndarray:
    """A row of BASE_COLUMNS for each text. Words and lines are told apart by their bytes."""
    data, starts = block.data, block.starts
    n_words = np.diff(words.first)
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
    chars = B.sums_by_text(leads[words.end] - leads[words.begin], words.first)
    symbols = B.sums_by_text(_SYMBOL[data].astype(np.int64), starts)
    lines = B.find_words(data, starts, _NOT_NEWLINE)
    with_word = np.searchsorted(words.begin, lines.end) > np.searchsorted(words.begin, lines.begin)
    line_docs = lines.docs()
    _, later = _by_text(B.word_codes(data, lines)[0], line_docs)
    dup_lines = B.sums_by_text((later & with_word).astype(np.int64), lines.first)
    grams, gram_first = B.exact_grams(B.word_codes(data, words)[0], words.first, 3)
    gram_docs = np.repeat(np.arange(block.rows), np.diff(gram_first))
    twice, _ = _by_text(grams, gram_docs)
    covered = np.zeros(words.first[-1] + 3, bool)
    at = np.flatnonzero(twice)
    at = at - gram_first[gram_docs[at]] + words.first[gram_docs[at]]
    for k in range(3):
        covered[at + k] = True
    return np.stack([n_words, chars, symbols, dup_lines, B.sums_by_text(covered[: words.first[-1]].astype(np.int64), words.first)], axis=1)


def ngram_features(block: B.Block, words: B.Words, prefix: np.ndarray, low_hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature of every n-gram, first n-gram of every text), for words, word pairs and character 4-grams."""
    shift = np.uint64(64 - BITS)
    pairs, pair_first = B.ngram_hashes(low_hashes, words.first, 2)
    lead = np.flatnonzero((block.data & 0xC0) != 0x80)
    ends = np.append(lead, len(block.data))
    first = np.searchsorted(lead, block.starts)
    grams = np.maximum(np.diff(first) - 3, 0)
    gram_first = np.concatenate([[0], np.cumsum(grams)])
    at = np.arange(gram_first[-1]) + np.repeat(first[:-1] - gram_first[:-1], grams)
    chars = B.span_hashes(prefix, lead[at], ends[at + 4])
    return [((low_hashes >> shift).astype(np.int64), words.first), ((pairs >> shift).astype(np.int64) + (1 << BITS), pair_first), ((chars >> shift).astype(np.int64) + (2 << BITS), gram_first)]


def _prepared(block: B.Block) -> tuple[B.Words, np.ndarray, np.ndarray]:
    words = B.find_words(block.data, block.starts)
    prefix = B.prefix_hashes(block.data)
    return words, prefix, B.word_hashes(B.LOWER[block.data], words)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", max_rows: int = MAX_ROWS, steps: int = 60) -> Model:
    """Learns on at most max_rows labelled documents by full-batch Adam; every fifth row only calibrates."""

    def per_row(batch):
        for block in B.blocks(batch.column(batch.schema.get_field_index(text))):
            words, prefix, hashes = _prepared(block)
            kinds = ngram_features(block, words, prefix, hashes)
            for row in range(block.rows):
                index, value = [], []
                for feature, first in kinds:
                    i, n = np.unique(feature[first[row] : first[row + 1]], return_counts=True)
                    index.append(i)
                    value.append(SCALE * n / max(1, n.sum()))
                yield np.concatenate(index), np.concatenate(value)

    y, starts, index, value = collected(sample(documents, labels, label, max_rows), [text], per_row)
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(DIM, np.float32), float(np.log(share / (1 - share))), 1.0, 0.0)
    doc = np.repeat(np.arange(len(y)), np.diff(starts))
    calibrates = np.arange(len(y)) % 5 == 0 if min(y.sum(), len(y) - y.sum()) >= 20 else np.zeros(len(y), bool)
    weight = np.where(calibrates, 0, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y))
    weights, bias = np.zeros(DIM), np.zeros(1)
    moves = Adam(0.02), Adam(0.05)
    raw = lambda: bias[0] + np.bincount(doc, value * weights[index], len(y))
    for _ in range(steps):
        error = (sigmoid(raw()) - y) * weight
        moves[0].step(weights, np.bincount(index, value * error[doc], DIM) + 1e-6 * weights)
        moves[1].step(bias, np.array([error.sum()]))
    rows = calibrates if calibrates.any() and 0 < y[calibrates].sum() < calibrates.sum() else np.ones(len(y), bool)
    x, t = raw()[rows], y[rows]
    t = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))  # Platt's targets
    loss = lambda ab: np.logaddexp(0, -(z := ab[0] * x + ab[1])) @ t + np.logaddexp(0, z) @ (1 - t) + 5e-4 * (ab[0] - 1) ** 2
    ab = np.array([1.0, 0.0])
    for _ in range(50):  # Newton's method for two parameters, each step halved until it lowers the loss
        p = sigmoid(ab[0] * x + ab[1])
        g = np.array([((p - t) * x).sum() + 1e-3 * (ab[0] - 1), (p - t).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]]), g)
        while loss(ab - step) > loss(ab) and abs(step).max() > 1e-9:
            step /= 2
        ab = ab - step
    return Model((SCALE * weights).astype(np.float32), float(bias[0]), float(ab[0]), float(ab[1]))


def judge(documents: DataFrame, model: Model, keep_at: float = KEEP_AT, text: str = "text") -> DataFrame:
    """RESULT for every row of documents, in Arrow batches."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def per_batch(batches):
        model = shared.value
        for batch in batches:
            figures, probability = [np.zeros((0, 5), np.int64)], [np.zeros(0)]
            for block in B.blocks(batch.column(1)):
                words, prefix, low_hashes = _prepared(block)
                figures.append(base_figures(block, words))
                raw = np.full(block.rows, model.bias)
                for feature, first in ngram_features(block, words, prefix, low_hashes):
                    raw += B.sums_by_text(model.weights[feature].astype(np.float64), first) / np.maximum(np.diff(first), 1)
                probability.append(sigmoid(model.a * raw + model.b))
            f, p = np.concatenate(figures), np.concatenate(probability)
            failed = (f[:, 0] < MIN_WORDS) | (100 * f[:, 4] > MAX_REPEAT_PERCENT * f[:, 0])
            columns = [batch.column(0), *(pa.array(f[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & (p >= keep_at)), pa.array(p)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE_COLUMNS, "base_failed", "kept", "probability"])

    return documents.select("doc_id", text).mapInArrow(per_batch, RESULT)
