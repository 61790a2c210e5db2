"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]),
so all pairwise interactions cost time linear in a document's features. A document's words (lower case) hash to BUCKETS
features whose values are their shares of the document; STATISTICS are real-valued features; each metadata column adds one
hashed feature for its value (numbers by their power of two). Labels, language, source and ids are no inputs.

Fitted on the driver on at most `max_rows` labelled documents (a parameter), scored in Arrow batches on the executors.
Defined results: null and empty texts are scored from their statistics alone; without labels of both kinds every document
gets the share of label 1, with one row of each kind added; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import blocks as B
from llm.labelled import Adam, collected, sample, sigmoid

BUCKETS, FACTORS, MAX_ROWS, THRESHOLD = 1 << 16, 8, 6000, 0.3
STATISTICS = ("log_words", "mean_word_length", "distinct_share", "repeated_pair_share", "upper_share", "symbol_share", "digit_share", "lines_per_word", "repeated_line_share", "lone_symbol_share", "letter_share")
DIM = BUCKETS + len(STATISTICS)
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>!@^~=+_\\{}[]"))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_LETTER |= _UPPER
_NOT_NEWLINE = np.zeros(256, bool)
_NOT_NEWLINE[10] = True


class Machine(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def _repeated(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of each text's hashes equal an earlier one of the same text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(np.uint64)
    keys = np.sort(B.mix(hashes ^ (doc * B.BASE)) >> np.uint64(24) | (doc << np.uint64(40)))
    same = np.concatenate([[0], (keys[1:] == keys[:-1]).astype(np.int64)]) if len(keys) else np.zeros(0, np.int64)
    return B.sums_by_text(same, first)  # keys of one text stay in its range, as the text leads the key


def statistics(block: B.Block, words: B.Words, hashes: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text, all of moderate size."""
    data, starts = block.data, block.starts
    count = np.diff(words.first).astype(float)
    some = np.maximum(count, 1)
    lengths = words.end - words.begin
    letters = np.maximum(B.sums_by_text(_LETTER[data].astype(np.int64), starts), 1)
    characters = np.maximum(B.sums_by_text(lengths, words.first), 1)
    share = lambda table, of: B.sums_by_text(table[data].astype(np.int64), starts) / of
    lines = B.find_words(data, starts, _NOT_NEWLINE)
    line_hashes = B.word_hashes(data, lines)
    n_lines = np.maximum(np.diff(lines.first), 1)
    pairs, pair_first = B.ngram_hashes(hashes, words.first, 2)
    alone = ((lengths == 1) & _SYMBOL[data[words.begin]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    return np.stack([
        np.log1p(count) / 8, B.sums_by_text(lengths, words.first) / some / 8, 1 - _repeated(hashes, words.first) / some,
        _repeated(pairs, pair_first) / some, share(_UPPER, letters), np.minimum(5 * share(_SYMBOL, characters), 2), 5 * share(_DIGIT, characters),
        np.minimum(5 * n_lines / some, 2), _repeated(line_hashes, lines.first) / n_lines, B.sums_by_text(alone, words.first) / some,
        B.sums_by_text(_LETTER[data].astype(np.int64), starts) / characters,
    ], axis=1)


def _metadata(batch: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    """The hashed feature of every row's value in each column."""
    out = np.zeros((batch.num_rows, len(columns)), np.int64)
    for k, name in enumerate(columns):
        column = batch.column(batch.schema.get_field_index(name))
        if pa.types.is_integer(column.type) or pa.types.is_floating(column.type):
            x = column.cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
            code = np.where(x < 0, 63, np.floor(np.log2(np.maximum(np.nan_to_num(x), 0) + 1))).astype(np.uint64)
        else:
            text = column.cast(pa.string())
            data, offsets = B.text_buffers(text)
            code = B.span_hashes(B.prefix_hashes(data), offsets[:-1], offsets[1:])
        out[:, k] = (B.mix(code + np.uint64((k + 1) * int(B.BASE) % (1 << 64))) % np.uint64(BUCKETS)).astype(np.int64)
    return out


def features(batch: pa.RecordBatch, text: str, metadata: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of the batch: row starts, feature indices (ascending in a row's words) and values."""
    extra = _metadata(batch, metadata)
    for block in B.blocks(batch.column(batch.schema.get_field_index(text))):
        low = block._replace(data=B.LOWER[block.data])
        words = B.find_words(block.data, block.starts)
        hashes = B.word_hashes(low.data, words)
        doc, n = words.docs(), np.diff(words.first)
        keys, counts = np.unique((doc.astype(np.uint64) << np.uint64(16)) | (hashes >> np.uint64(48)), return_counts=True)
        at = (keys >> np.uint64(16)).astype(np.int64)
        stats = statistics(block, words, hashes)
        rows = np.arange(block.rows)
        doc_all = np.concatenate([at, np.repeat(rows, stats.shape[1]), np.repeat(rows, extra.shape[1])])
        index = np.concatenate([(keys & np.uint64(BUCKETS - 1)).astype(np.int64), np.tile(np.arange(BUCKETS, DIM), block.rows), extra[block.first : block.first + block.rows].ravel()])
        value = np.concatenate([counts / np.maximum(n[at], 1), stats.ravel(), np.full(extra.shape[1] * block.rows, 0.2)])
        order = np.argsort(doc_all, kind="stable")
        yield np.searchsorted(doc_all[order], np.arange(block.rows + 1)), index[order], value[order].astype(np.float32)


def raw_scores(machine: Machine, starts: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid, and sum_i v_if x_i, both from sums over each row's own features."""
    vx = machine.factors[index] * value[:, None]
    first = B.sums_by_text(vx.astype(np.float64), starts)
    second = B.sums_by_text((vx.astype(np.float64) ** 2).sum(axis=1), starts)
    linear = B.sums_by_text(machine.linear[index].astype(np.float64) * value, starts)
    return machine.bias + linear + 0.5 * ((first**2).sum(axis=1) - second), first


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", metadata: tuple[str, ...] = (), where: Column | None = None, max_rows: int = MAX_ROWS, epochs: int = 12, updates: int = 240, seed: int = 7) -> Machine:
    """Learns the machine by Adam on mini-batches of at most max_rows labelled documents; `where` filters label rows.

    It passes `epochs` times over the rows, and more often where that makes fewer than `updates` steps.
    """

    def per_row(batch):
        for starts, index, value in features(batch, text, metadata):
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield index[a:b], value[a:b]

    y, starts, index, value = collected(sample(documents, labels, label, max_rows, where), [text, *metadata], per_row)
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 1) / (len(y) + 2)
        return Machine(float(np.log(share / (1 - share))), np.zeros(DIM, np.float32), np.zeros((DIM, FACTORS), np.float32))
    rng = np.random.default_rng(seed)
    bias = np.zeros(1)
    linear, factors = np.zeros(DIM), rng.normal(0, 0.05, (DIM, FACTORS))
    steps = [Adam(0.05), Adam(0.05), Adam(0.02)]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    batches = max(1, min(len(y) // 32, 4), len(y) // 512)
    for _ in range(max(epochs, -(-updates // batches))):
        for rows in np.array_split(rng.permutation(len(y)), batches):
            n = starts[rows + 1] - starts[rows]
            local = np.concatenate([[0], np.cumsum(n)])
            at = np.arange(local[-1]) + np.repeat(starts[rows] - local[:-1], n)
            i, x, doc = index[at], value[at], np.repeat(np.arange(len(rows)), n)
            raw, vx = raw_scores(Machine(bias[0], linear, factors), local, i, x)
            error = (sigmoid(raw) - y[rows]) * weight[rows] / len(rows)
            ex = error[doc] * x
            steps[0].step(bias, np.array([error.sum()]))
            grad = np.zeros((DIM, FACTORS))
            for f in range(FACTORS):
                grad[:, f] = np.bincount(i, ex * (vx[doc, f] - factors[i, f] * x), DIM)
            steps[1].step(linear, np.bincount(i, ex, DIM) + 1e-5 * linear)
            steps[2].step(factors, grad + 1e-4 * factors)
    return Machine(float(bias[0]), linear.astype(np.float32), factors.astype(np.float32))


def batch_scores(machine: Machine, batch: pa.RecordBatch, text: str, metadata: tuple[str, ...]) -> np.ndarray:
    parts = [sigmoid(raw_scores(machine, *found)[0]) for found in features(batch, text, metadata)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(documents: DataFrame, machine: Machine, text: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score) for every row of documents."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def per_batch(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch_scores(shared.value, batch, text, metadata), pa.float64())], ["doc_id", "score"])

    return documents.select("doc_id", text, *metadata).mapInArrow(per_batch, "doc_id long, score double")


def keep(documents: DataFrame, machine: Machine, threshold: float = THRESHOLD, text: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """The rows of documents, all columns, that score at least threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def per_batch(batches):
        for batch in batches:
            yield batch.filter(pa.array(batch_scores(shared.value, batch, text, metadata) >= threshold))

    return documents.mapInArrow(B.trimmed(per_batch), documents.schema)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; rows in fold 0 are held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 5
