"""Whole texts as byte blocks: numpy views of Arrow string columns, with words and hashes found for all texts at once.

A block is a run of rows of one Arrow batch. Its texts lie end to end in one byte array, so that words, n-grams and hashes
of thousands of documents come from a handful of numpy passes. Blocks hold at most MAX_BYTES of text (a longer text is a
block of its own), which bounds memory whatever the batch holds. A null text counts as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import secrets
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_BYTES = 1 << 19
#: Seeds of hashes that only choose features and candidates. Fixed, so that every task of every run agrees. Where equal hashes are
#: taken for equal words, keyed_hashes() or word_codes() give them.
SEED, BASE = 0x5EED, np.uint64(0x9E3779B97F4A7C15)

_rng = np.random.default_rng(SEED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Block(NamedTuple):
    """data: bytes of all texts; starts: where each text begins, with the end of the last one behind."""

    first: int
    rows: int
    data: np.ndarray
    starts: np.ndarray


class Words(NamedTuple):
    """Begin and end of every word in the block's bytes, and the first word of every text (one entry more than texts)."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


#: What workers keep for tasks to come, by the operator that fills it.
KEPT: dict[str, list[dict]] = {}


def trimmed(per_task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """per_task, for operators that follow others in a session. Workers outlive their tasks: before it, what other operators keep in
    this worker goes, and after it freed memory goes back to the machine, which allocators would hold on to."""

    def run(batches):
        for name, held in KEPT.items():
            if name != keeps:
                for x in held:
                    x.clear()
        try:
            yield from per_task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets of a string column without copying its texts; nulls become empty."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, max_bytes: int = MAX_BYTES) -> Iterator[Block]:
    """The column's texts in order, as blocks of at most max_bytes or of one text."""
    data, offsets = text_buffers(column)
    row, n = 0, len(column)
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1)
        last = min(last, n)
        yield Block(row, last - row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        row = last


def lowered(data: np.ndarray) -> np.ndarray:
    """LOWER[data], by arithmetic on bytes."""
    return data | ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def _outside(data: np.ndarray, space: np.ndarray) -> np.ndarray:
    """~space[data]; a few bytes are told apart faster by comparing than by a table."""
    values = np.flatnonzero(space)
    if not 0 < len(values) <= 8:
        return ~space[data]
    out = data != values[0]
    for x in values[1:]:
        out &= data != x
    return out


def find_words(data: np.ndarray, starts: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes outside `space` (by default 0x20 and 0x09 to 0x0D) that lie in one text."""
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64))
    word = _outside(data, space)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1] | edge[1:n]
    closes[:-1] &= ~word[1:] | edge[1:n]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(begin, end, np.searchsorted(begin, starts))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0..n-1 modulo 2^64, and their inverses."""
    if len(_powers[0]) < n:
        size = max(n, MAX_BYTES + (1 << 16))
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, base in enumerate((BASE, inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j]-H[i] = hash of bytes i..j-1 times BASE^i; one entry more than bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][:-1], out=out[1:], dtype=np.uint64)
    return out


def span_hashes(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings begin..end-1: equal strings get equal hashes wherever they lie."""
    return mix((prefix[end] - prefix[begin]) * powers(len(prefix))[1][begin])


def gathered(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    """The byte strings begin..end-1 as an Arrow array."""
    size = end - begin
    offsets = np.concatenate([[0], np.cumsum(size)])
    raw = data[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def word_codes(data: np.ndarray, words: Words) -> tuple[np.ndarray, pa.StringArray]:
    """Each word's place among the different words of the block, and those words: told apart by their bytes, not by hashes."""
    coded = gathered(data, words.begin, words.end).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())


def drawn_key() -> bytes:
    """A secret for keyed_hashes(): drawn on the driver for one run of an operator, whose tasks get it with their code."""
    return secrets.token_bytes(16)


#: The prime field of keyed hashes, and bytes of a word that are summed at once.
FIELD, PIECE = (1 << 61) - 1, 1 << 20
_tables: dict[bytes, np.ndarray] = {}


def _key_powers(key: bytes, n: int) -> np.ndarray:
    """Powers of the key's number in FIELD, low 32 bits and the rest, (2, n or more). A worker keeps those of its last keys."""
    held = _tables.get(key)
    if held is None or held.shape[1] < n:
        if len(_tables) > 4:
            _tables.clear()
        base, out, size = key_number(key), [1], min(PIECE, max(256, 1 << (n - 1).bit_length()))
        for _ in range(size - 1):
            out.append(out[-1] * base % FIELD)
        whole = np.array(out, np.uint64)
        held = _tables[key] = np.stack([whole & np.uint64(0xFFFFFFFF), whole >> np.uint64(32)])
    return held


def key_number(key: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=16).digest(), "little") % (FIELD - (1 << 32)) + (1 << 32)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(FIELD)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(FIELD), x - np.uint64(FIELD), x)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs that begin at starts; running sums may wrap, those of a run do not."""
    total = np.cumsum(x, out=x)
    last = total[np.append(starts[1:], len(x)) - 1]
    last[1:] -= last[:-1].copy()
    return last


def keyed_hashes(data: np.ndarray, words: Words, key: bytes) -> np.ndarray:
    """Hashes of words as polynomials over a prime field, at a secret point: two different words of at most L bytes share one with a
    probability under L / 2^60, whoever wrote them, and n words under n^2 L / 2^61."""
    size = words.end - words.begin
    if not len(size):
        return np.zeros(0, np.uint64)
    offsets = np.cumsum(size) - size
    # counting on from byte to byte of the words, with a step where a word begins
    place = np.ones(offsets[-1] + size[-1], np.int64)
    at = place.copy()
    place[offsets[1:]] -= size[:-1]
    at[offsets[1:]] += words.begin[1:] - words.end[:-1]
    place[0], at[0] = 0, words.begin[0]
    np.cumsum(place, out=place)
    value = data[np.cumsum(at, out=at)].astype(np.uint64)
    value += np.uint64(1)
    longest, starts = int(size.max()), offsets
    if longest > PIECE:  # long words are summed in pieces
        pieces = -(-size // PIECE)
        owner = np.repeat(np.arange(len(size)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, place = offsets[owner] + number * PIECE, place % PIECE
    low, high = _key_powers(key, min(longest, PIECE))
    low, high = (_sums(value * x[place], starts) for x in (low, high))
    # high * 2^32 + low, where 2^61 is 1
    out = _reduced(_reduced(low) + (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)))
    if longest > PIECE:
        step, first = pow(key_number(key), PIECE, FIELD), np.cumsum(pieces) - pieces
        for k in np.flatnonzero(pieces > 1).tolist():
            parts = out[first[k] : first[k] + pieces[k]].tolist()
            out[first[k]] = sum(x * pow(step, j, FIELD) for j, x in enumerate(parts)) % FIELD
        out = out[first]
    return mix(out)


#: Bytes of a number of limb_hashes, and the longest words that it cuts into such numbers.
LIMB, LIMBED = 4, 32
_LIMB_MASKS = np.array([(1 << 8 * k) - 1 for k in range(LIMB + 1)], np.uint32)


def limb_hashes(data: np.ndarray, words: Words, key: bytes) -> np.ndarray:
    """Hashes of words as keyed_hashes gives them, with less work: polynomials whose coefficients are a word's length and its bytes,
    LIMB at a time. Words over LIMBED bytes, of which there are few, have the hashes that keyed_hashes gives under a key of their own."""
    size = words.end - words.begin
    out = size.astype(np.uint64)
    padded = np.zeros(len(data) + LIMB, np.uint8)
    padded[: len(data)] = data
    limbs = np.ndarray(len(data) + 1, np.dtype("<u4"), padded, strides=(1,))
    base = factor = key_number(key)
    at = np.flatnonzero(size <= LIMBED)
    for k in range(0, LIMBED, LIMB):
        at = at[size[at] > k]
        if not len(at):
            break
        value = (limbs[words.begin[at] + k] & _LIMB_MASKS[np.minimum(size[at] - k, LIMB)]).astype(np.uint64)
        low, high = value * np.uint64(factor & 0xFFFFFFFF), value * np.uint64(factor >> 32)
        # high * 2^32 + low, where 2^61 is 1
        total = out[at] + (low & np.uint64(FIELD)) + (low >> np.uint64(61)) + (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32))
        out[at] = (total & np.uint64(FIELD)) + (total >> np.uint64(61))
        factor = factor * base % FIELD
    out = mix(_reduced(out))
    long = np.flatnonzero(size > LIMBED)
    if len(long):
        out[long] = keyed_hashes(data, Words(words.begin[long], words.end[long], np.array([0, len(long)])), key + b"long")
    return out


def exact_grams(codes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of n consecutive words in one text, equal only for equal words, and the first n-gram of every text."""
    gram_first = np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - (n - 1), 0))])
    if len(codes) < n:
        return np.zeros(0, np.int64), gram_first * 0
    different = int(codes.max()) + 1
    acc, most, last = codes[: len(codes) - n + 1], different, len(codes) - n + 1
    for k in range(1, n):
        if most * different >= 1 << 62:  # numbers would not fit: those that occur are numbered anew
            acc = np.unique(acc, return_inverse=True)[1]
            most = int(acc.max()) + 1
        acc, most = acc * different + codes[k : last + k], most * different
    at = np.arange(gram_first[-1]) + np.repeat(first[:-1] - gram_first[:-1], np.diff(gram_first))
    return acc[at], gram_first


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """Hashes for features of models, where two words may share one."""
    return span_hashes(prefix_hashes(data), words.begin, words.end)


def ngram_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words in one text, and the first n-gram of every text."""
    counts = np.diff(first)
    grams = np.maximum(counts - (n - 1), 0)
    total = len(hashes)
    gram_first = np.concatenate([[0], np.cumsum(grams)])
    if total < n:
        return np.zeros(0, np.uint64), gram_first * 0
    acc = hashes[: total - n + 1].copy()
    for k in range(1, n):
        acc = acc * BASE + hashes[k : total - n + 1 + k]
    at = np.arange(gram_first[-1]) + np.repeat(first[:-1] - gram_first[:-1], grams)
    return mix(acc[at]), gram_first


def distinct(keys: np.ndarray) -> np.ndarray:
    """Ascending distinct values; a plain sort is the fastest way to them for integers."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for every i; 0 for an empty run. Works along the first axis."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def texts_of(block: Block) -> list[str]:
    raw = block.data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(block.starts[:-1].tolist(), block.starts[1:].tolist(), strict=True)]
