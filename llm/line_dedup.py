"""Line dedup by an exact set-similarity join: of lines whose word sets are similar, only the earliest stays.

A line's set is its distinct words (A-Z lower-cased). A line is removed if an earlier line of the corpus, in the order of
(doc_id, line), has 100 * intersection >= percent * union; all lines with a word are judged, and all on the input, removed
or not.

1. Rarity: occurrences of all words of all texts, counted in 2^24 hash buckets and kept as their logarithm. Any order that
   all lines share keeps the join exact; this one puts rare words first.
2. Lines with equal sets form classes; only the earliest of a class takes part in the join, the others are removed. Sets
   so small that only an equal one can match (1 and 2 words at 75 %) are settled here and have no postings. Sets are equal
   if the 128-bit digests of their 64-bit word hashes are; these are keyed by a secret of the run.
3. Prefix filter: two lines that match share a word among the first n - ceil(t n) + 1 of each, rarest first. Words that
   occur once in the corpus, or in one prefix, need no posting.
4. Words in the prefixes of very many lines: two lines that match share a second word too, one place further at most. Such
   a word is posted as its pairs with the words behind it in the prefix and one more, so that no list of a common word
   gathers in one task.
5. Postings of a word meet in the order of lines. Pairs pass the length filter, the positional filter (words left behind
   the shared one must suffice for the overlap needed) and a filter on parity maps of 64 bits, or 128 or 256 for lines of
   many words, whose differing bits are a lower bound of the sets' symmetric difference.
6. A line is compared with its NEAREST earlier candidates of each shared word first, so that a group of near copies costs
   a few comparisons a line. Lines that this leaves undecided are compared with all their other candidates.
7. Jaccard similarity is verified on the whole lines, after a second look at maps of WIDE bits that spares most of them.

Tables of hash buckets only order words and spare postings that meet nothing. Where a corpus fills them, up to
n - ceil(t n) + 1 postings of 37 bytes a line are shuffled, at 75 % about 1.6 times the text before compression.

Defined results: null and empty texts stay as they are; blank lines stay; rows with equal doc_id share their removals by
line number; rows without doc_id stay as they are. A document whose lines all go stays as a row with what is left.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm import blocks as B
from llm.tables import groups, near, release, stored, with_rows, without_rows, workspace

PERCENT = 75
RARITY_BITS, KEY_BITS, CODE_BITS = 24, 41, 6
CHUNK_LINES, CHUNK_PAIRS, PART_POSTINGS, HELD_POSTINGS, WIDE, LONG = 1 << 17, 1 << 18, 200_000, 1 << 17, 512, 64
NARROW_ROWS, NARROW_BYTES, MAPPED_ROWS = 1 << 13, 1 << 22, 1 << 11
#: Candidates of a line and word that are verified at once; prefixes of how many lines make a word common.
NEAREST, COMMON = 4, 1 << 14
_NOT_NEWLINE = np.zeros(256, bool)
_NOT_NEWLINE[10] = True
LINES = "high long, low long, doc_id long, line int, lead boolean, n int, common int, parity long, wide binary, words binary"
PAIRS = "doc_id long, line int, doc_x long, line_x int, others long"


def _read(column: pa.Array, key: bytes):
    for block in B.blocks(column):
        data = B.lowered(block.data)
        words = B.find_words(data, block.starts)
        yield block, data, words, B.limb_hashes(data, words, key)


class Prefixes(NamedTuple):
    """Of the buckets of prefix words: a bit whether postings are wanted, and which hold the words of very many lines."""

    bits: np.ndarray
    common: np.ndarray


def _code(count):
    return np.clip(np.ceil(2 * np.log2(np.maximum(count, 1))), 1, (1 << CODE_BITS) - 1).astype(np.uint8)


def _table(rows: DataFrame, buckets_of, least: int = 2, text: bool = False) -> np.ndarray:
    """Codes of 2^RARITY_BITS buckets, one byte each at any size: 0 under `least`, else growing with the count's logarithm.

    buckets_of(batch) yields arrays of buckets; batches are joined to larger ones unless rows are of text. A task hands on its counts as one row for each 2^16 buckets.
    """

    def count(batches):
        counts = np.zeros(1 << RARITY_BITS, np.uint16)  # up to 65,535 in a task, which the code cannot tell from more
        for batch in batches if text else _wider(batches):
            for buckets in buckets_of(batch):
                bucket, n = np.unique(buckets, return_counts=True)
                counts[bucket] = np.minimum(counts[bucket] + n, 65_535)
        for chunk, part in enumerate(counts.reshape(-1, 1 << 16)):
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], ["chunk", "buckets", "counts"])

    def unite(batches):
        for chunk, buckets, counts in groups(batches, 1):
            total = np.zeros(1 << 16, np.int64)
            for at, n in zip(buckets, counts, strict=True):
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint16)
            codes = np.where(total >= least, _code(total), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(chunk[:1].astype(np.int32)), pa.array([codes.tobytes()], pa.binary())], ["chunk", "codes"])

    dealt = rows.mapInArrow(B.trimmed(count), "chunk int, buckets binary, counts binary").repartition("chunk").sortWithinPartitions("chunk")
    found = dealt.mapInArrow(B.trimmed(unite), "chunk int, codes binary").toArrow()
    table = np.zeros((1 << (RARITY_BITS - 16), 1 << 16), np.uint8)
    for chunk, codes in zip(found["chunk"].to_pylist(), found["codes"].to_pylist(), strict=True):
        table[chunk] = np.frombuffer(codes, np.uint8)
    return table.ravel()


def _prefixes(rows: DataFrame, least: int = 2) -> Prefixes:
    """Of rows(words): prefix words, the last one of each list excepted, that lie in `least` lists or more."""
    codes = _table(rows, _prefix_buckets, least)
    return Prefixes(np.packbits(codes > 0, bitorder="little"), np.flatnonzero(codes >= _code(COMMON)))


def has_bit(packed: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return (packed[positions >> 3] >> (positions & 7).astype(np.uint8) & 1).astype(bool)


def word_rarity(documents: DataFrame, text: str, key: bytes) -> Broadcast:
    """Codes of the occurrences of all words of all texts."""

    def buckets(batch):
        for *_, hashes in _read(batch.column(0), key):
            yield (hashes >> np.uint64(64 - RARITY_BITS)).astype(np.uint32)

    return documents.sparkSession.sparkContext.broadcast(_table(documents.select(text), buckets, text=True))


def _short_bucket(words: np.ndarray) -> np.ndarray:
    """Buckets of the 32-bit words of postings."""
    return (B.mix(words.view(np.uint32).astype(np.uint64)) >> np.uint64(64 - RARITY_BITS)).astype(np.uint32)


def _prefix_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All words, of four bytes each, of the lists in a batch's last column end to end, and how many each has."""
    lists = batch.column(batch.num_columns - 1).cast(pa.binary())
    offsets = np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, lists.offset * 4) if len(lists) else np.zeros(1, np.int32)
    total = int(offsets[-1] - offsets[0])
    return np.frombuffer(lists.buffers()[2], np.int32, total // 4, int(offsets[0])) if total else np.zeros(0, np.int32), np.diff(offsets) // 4


def _wider(batches):
    """Batches of narrow rows joined to some of NARROW_ROWS rows or NARROW_BYTES or more, which spares calls."""
    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= NARROW_ROWS or size >= NARROW_BYTES:
            yield pa.concat_batches(held)
            held, n, size = [], 0, 0
    if n:
        yield pa.concat_batches(held)


def _prefix_buckets(batch: pa.RecordBatch):
    words, counts = _prefix_words(batch)
    proper = np.ones(len(words), bool)
    proper[np.cumsum(counts)[counts > 0] - 1] = False
    yield _short_bucket(words[proper])


def line_words(block: B.Block, data: np.ndarray, words: B.Words, hashes: np.ndarray, rarity: np.ndarray):
    """Chunks of lines: (lines' documents, numbers in their document, first word of each, hashes and codes of their distinct words).

    A line's words are in the order of their rarity codes, the rarest first, and of equal ones by KEY_BITS of their hashes.
    """
    lines = B.find_words(data, block.starts, _NOT_NEWLINE)
    doc = lines.docs()
    number = np.arange(len(doc)) - lines.first[doc]
    code = rarity[(hashes >> np.uint64(64 - RARITY_BITS)).astype(np.int64)].astype(np.uint64)
    key = (code << np.uint64(KEY_BITS)) | (hashes & np.uint64((1 << KEY_BITS) - 1))
    opens = np.append(np.searchsorted(words.begin, lines.begin), len(key))  # each line's first word
    for low in range(0, len(doc), CHUNK_LINES):
        high = min(low + CHUNK_LINES, len(doc))
        part = slice(opens[low], opens[high])
        keys = np.repeat(np.arange(high - low).astype(np.uint64) << np.uint64(KEY_BITS + CODE_BITS), np.diff(opens[low : high + 1])) | key[part]
        order = np.argsort(keys)
        keys, whole = keys[order], hashes[part][order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (whole[1:] != whole[:-1])
        keys, whole = keys[new], whole[new]
        first = np.concatenate([[0], np.cumsum(np.bincount((keys >> np.uint64(KEY_BITS + CODE_BITS)).astype(np.int64), minlength=high - low))])
        yield doc[low:high], number[low:high], first, whole, (keys >> np.uint64(KEY_BITS)) & np.uint64((1 << CODE_BITS) - 1)


def _parities(bits: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(bits) + 1, np.uint64)
    np.bitwise_xor.accumulate(bits, out=total[1:])
    return total[first[1:]] ^ total[first[:-1]]


def _maps(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """Parity of each line's words in 64 bits, and what lines of many words carry besides: over LONG the rest of 128 bits, over
    2 * LONG that of 256. The maps of half the bits are the halves' difference.
    """
    h = B.mix(words)
    bit, n = np.uint64(1) << (h & np.uint64(63)), np.diff(first)
    wide: list[bytes | None] = [None] * len(n)
    many = np.flatnonzero(n > LONG)
    if len(many):
        inside = np.repeat(n > LONG, n)
        own, word, ends = bit[inside], h[inside] >> np.uint64(6) & np.uint64(3), np.concatenate([[0], np.cumsum(n[many])])
        maps = np.stack([_parities(np.where(word == k, own, np.uint64(0)), ends) for k in range(3)], axis=1)
        half = maps[:, 0] ^ maps[:, 2]
        for k, (i, size) in enumerate(zip(many.tolist(), n[many].tolist(), strict=True)):
            wide[i] = (half[k] if size <= 2 * LONG else maps[k]).tobytes()
    return _parities(bit, first), wide


def line_sets(documents: DataFrame, text: str, rarity: Broadcast, percent: int, key: bytes) -> DataFrame:
    """LINES: digest of every line's set, its place, size, parity map and the words that can meet others: those of its prefix
    and one more. Of equal sets at hand only the first is `lead` and has them.
    """

    def per_batch(batches):
        for batch in batches:
            ids = batch.column(0)
            for block, data, words, hashes in _read(batch.column(1), key):
                for doc, number, first, whole, codes in line_words(block, data, words, hashes, rarity.value):
                    n = np.diff(first)
                    digest = np.zeros((len(n), 2), np.int64)
                    for k, mixed in enumerate((B.mix(whole + B.BASE), B.mix(whole ^ B.BASE))):
                        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
                        digest[:, k] = (sums[first[1:]] - sums[first[:-1]]).view(np.int64)
                    chosen = np.flatnonzero(n > 0)
                    order = chosen[np.lexsort((number[chosen], ids.fill_null(0).to_numpy(zero_copy_only=False)[block.first + doc[chosen]], digest[chosen, 1], digest[chosen, 0]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (digest[order[1:]] != digest[order[:-1]]).any(axis=1)
                    lead = np.zeros(len(n), bool)
                    lead[order[new]] = True
                    parity, wide = _maps(whole, first)
                    parity = parity.view(np.int64)
                    prefix = n - -(-n * percent // 100) + 1
                    place = np.arange(len(whole)) - np.repeat(first[:-1], n)
                    again = codes > 0  # words that occur once come first and meet nothing
                    meets = lead & (100 * n >= percent * (n + 1))  # smaller sets match equal ones only
                    useful = (place <= np.repeat(prefix, n)) & again & np.repeat(meets, n)
                    counts, common = (B.sums_by_text(x.astype(np.int64), first) for x in (useful, again))
                    short = (whole[useful] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    offsets = np.concatenate([[0], np.cumsum(4 * counts[chosen])]).astype(np.int32)
                    lists = pa.BinaryArray.from_buffers(pa.binary(), len(chosen), [None, pa.py_buffer(offsets), pa.py_buffer(short)])
                    rows = ids.slice(block.first, block.rows).take(pa.array(doc[chosen]))
                    wide = [wide[k] if leads else None for k, leads in zip(chosen.tolist(), lead[chosen].tolist(), strict=True)]
                    columns = [pa.array(digest[chosen, 0].copy()), pa.array(digest[chosen, 1].copy()), rows, pa.array(number[chosen].astype(np.int32)), pa.array(lead[chosen]), *(pa.array(x.astype(np.int32)) for x in (n[chosen], common[chosen])), pa.array(parity[chosen]), pa.array(wide, pa.binary()), lists]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in LINES.split(", ")])

    return documents.select("doc_id", text).where("doc_id IS NOT NULL").mapInArrow(B.trimmed(per_batch), LINES)


#: A posting: a prefix word, its line's place, sizes (the line's words, and how many from this one on occur again) and map.
_POSTING = np.dtype([("word", "<i4"), ("line", "<i4"), ("n", "<i4"), ("left", "<i4"), ("doc", "<i8"), ("parity", "<i8"), ("open", "i1")])


def postings_of(lines: DataFrame, wanted: Broadcast, common_words: Broadcast, parts: int) -> DataFrame:
    """(part, postings) of all prefix words of lines that are wanted, packed column by column.

    Every word belongs to one part, and so does every pair that stands for a common word. lines has doc_id, line, n, common,
    parity, open (whether it looks for partners), wide, words.
    """

    def per_partition(batches):
        held, size = [], 0
        for batch in _wider(batches):
            words, counts = _prefix_words(batch)
            bucket = _short_bucket(words).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), counts)
            ends = np.repeat(np.cumsum(counts), counts)
            at = np.arange(len(words))
            keep = np.flatnonzero((at < ends - 1) & has_bit(wanted.value.bits, bucket))
            common_ones = common_words.value.common
            often = np.append(common_ones, -1)[np.searchsorted(common_ones, bucket[keep])] == bucket[keep]
            # a common word goes out once with each of the words behind it
            lone, several = keep[~often], keep[often]
            n = ends[several] - 1 - several
            second = np.repeat(several + 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            several = np.repeat(several, n)
            pair = B.mix((words[several].view(np.uint32).astype(np.uint64) << np.uint64(32)) | words[second].view(np.uint32)) & np.uint64(0xFFFFFFFF)
            word = np.concatenate([words[lone], pair.astype(np.uint32).view(np.int32)])
            keep = np.concatenate([lone, several])
            row, place = row[keep], keep - (ends - np.repeat(counts, counts))[keep]
            doc, line, n, common, parity, is_open = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            wide = np.zeros((batch.num_rows, 3), np.uint64)
            for k in np.flatnonzero(batch.column(6).is_valid().to_numpy(zero_copy_only=False)).tolist():
                x = batch.column(6)[k].as_py()
                wide[k, : len(x) // 8] = np.frombuffer(x, np.uint64)
            held.append((word, line[row], n[row], common[row] - place, doc[row], parity[row], is_open[row], wide[row]))
            size += len(row)
            if size >= HELD_POSTINGS:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held) -> pa.RecordBatch:
        *columns, wide = (np.concatenate(c) for c in zip(*held, strict=True))
        part = (_short_bucket(columns[0]) % np.uint32(parts)).astype(np.uint32)
        order = np.argsort(part, kind="stable")
        part, wide = part[order], wide[order]
        columns = [c[order].astype(_POSTING[name]) for c, name in zip(columns, _POSTING.names, strict=True)]
        bounds = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part)) if len(part) else np.zeros(1, int)
        blobs, sizes = [], columns[2]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own, n = wide[a:b], sizes[a:b]
            blobs.append(b"".join([np.uint32(b - a).tobytes(), *(c[a:b].tobytes() for c in columns), own[(n > LONG) & (n <= 2 * LONG), 0].tobytes(), own[n > 2 * LONG].tobytes()]))
        return pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "postings"])

    return lines.select("doc_id", "line", "n", "common", "parity", "open", "wide", "words").mapInArrow(B.trimmed(per_partition), "part int, postings binary")


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    """Columns of all postings of a part, and their wide maps, zero where a line has none."""
    columns = [[] for _ in [*_POSTING.names, "wide"]]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.uint32, 1)[0]), 4
        for k, name in enumerate(_POSTING.names):
            columns[k].append(np.frombuffer(blob, _POSTING[name], n, at))
            at += n * _POSTING[name].itemsize
        size, wide = columns[2][-1], np.zeros((n, 3), np.uint64)
        some, most = np.flatnonzero((size > LONG) & (size <= 2 * LONG)), np.flatnonzero(size > 2 * LONG)
        wide[some, 0] = np.frombuffer(blob, np.uint64, len(some), at)
        wide[most] = np.frombuffer(blob, np.uint64, 3 * len(most), at + 8 * len(some)).reshape(-1, 3)
        columns[-1].append(wide)
    return [np.concatenate(c) for c in columns]


def _apart(n: np.ndarray, parity: np.ndarray, wide: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the widest maps that both lines of a pair have: at most the sizes' symmetric difference."""
    folded = (parity[a] ^ parity[b]).view(np.uint64)
    out = np.bitwise_count(folded).astype(np.int64)
    shorter = np.minimum(n[a], n[b])
    k = np.flatnonzero((shorter > LONG) & (shorter <= 2 * LONG))
    halves = [np.where(n[r] > 2 * LONG, wide[r, 0] ^ wide[r, 2], wide[r, 0]) for r in (a[k], b[k])]
    half = halves[0] ^ halves[1]
    out[k] = np.bitwise_count(half).astype(np.int64) + np.bitwise_count(half ^ folded[k])
    k = np.flatnonzero(shorter > 2 * LONG)
    rest = wide[a[k]] ^ wide[b[k]]
    out[k] = np.bitwise_count(rest).sum(axis=1, dtype=np.int64) + np.bitwise_count(np.bitwise_xor.reduce(rest, axis=1) ^ folded[k])
    return out


def _group_pairs(columns: list[np.ndarray], percent: int, every: bool):
    """Pairs (later line, earlier line) of postings of equal words that pass all filters.

    With `every` all pairs that pass are returned, else the NEAREST of each line and word, and how many others passed.
    """
    word, line, n, left, doc, parity, is_open, wide = columns
    order = np.argsort(word.astype(np.int64) << 32 | n)
    word, line, n, left, doc, parity, is_open, wide = (c[order] for c in (word, line, n.astype(np.int64), left, doc, parity, is_open, wide))
    # of one word's postings in order of size, those before that are large enough
    new = np.concatenate([[True], word[1:] != word[:-1]])
    group = np.cumsum(new) - 1
    place = group * (int(n.max(initial=0)) + 1) + n  # ascends
    low = np.searchsorted(place, group * (int(n.max(initial=0)) + 1) - (-n * percent // 100))
    before = np.arange(len(word)) - low
    total = np.concatenate([[0], np.cumsum(before)])
    done = 0
    while done < len(word):
        until = max(done + 1, int(np.searchsorted(total, total[done] + CHUNK_PAIRS, "right")) - 1)
        rows = np.arange(done, until)
        a = np.repeat(rows, before[rows])
        b = a - 1 - (np.arange(len(a)) - np.repeat(total[rows] - total[done], before[rows]))
        done = until
        both = n[a] + n[b]
        need = -(-percent * both // (100 + percent))
        ok = np.flatnonzero(np.minimum(left[a], left[b]) >= need)  # holds at the rarest word that a matching pair shares
        a, b, spare = a[ok], b[ok], (both - 2 * need)[ok]
        apart = _apart(n, parity, wide, a, b)
        ok = np.flatnonzero(apart <= spare)
        a, b, apart = a[ok], b[ok], apart[ok]
        later = (doc[a] > doc[b]) | (doc[a] == doc[b]) & (line[a] > line[b])
        y, x = np.where(later, a, b), np.where(later, b, a)
        ok = np.flatnonzero((is_open[y] > 0) & ((doc[x] != doc[y]) | (line[x] != line[y])))
        x, y, apart = x[ok], y[ok], apart[ok]
        others = np.zeros(len(y), np.int64)
        if not every and len(y):
            order = np.lexsort((line[x], doc[x], apart, y))
            x, y = x[order], y[order]
            head = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
            n_own = np.diff(np.append(head, len(y)))
            near_ones = np.flatnonzero(np.arange(len(y)) - np.repeat(head, n_own) < NEAREST)
            others = np.repeat(np.maximum(n_own - NEAREST, 0), n_own)[near_ones]
            x, y = x[near_ones], y[near_ones]
        if len(y):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[y], line[y], doc[x], line[x], others)], [c.split()[0] for c in PAIRS.split(", ")])


def candidate_pairs(postings: DataFrame, percent: int, every: bool) -> DataFrame:
    """PAIRS from packed postings; all postings of a word meet in its part."""

    def per_partition(batches):
        for _, blobs in groups(batches, 1):
            yield from _group_pairs(_unpacked(blobs), percent, every)

    return postings.repartition("part").sortWithinPartitions("part").mapInArrow(B.trimmed(per_partition), PAIRS)


def _distinct(row: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((words, row))
    row, words = row[order], words[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (words[1:] != words[:-1])
    return row[new], words[new]


def verified(pairs: DataFrame, documents: DataFrame, text: str, percent: int, key: bytes) -> DataFrame:
    """(doc_id, line) of pairs (doc_id, line, doc_x, line_x), a stored table, whose whole lines reach the threshold."""
    ends = pairs.select("doc_id", "line").union(pairs.select("doc_x", "line_x")).groupBy("doc_id").agg(F.collect_set("line").alias("__wanted"))

    def pick(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            offsets, wanted = lists.offsets.to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
            offsets = offsets - offsets[0]
            for block in B.blocks(batch.column(1)):
                lines = B.find_words(block.data, block.starts, _NOT_NEWLINE)
                low, high = offsets[block.first], offsets[block.first + block.rows]
                doc = np.repeat(np.arange(block.rows), np.diff(offsets[block.first : block.first + block.rows + 1]))
                number = wanted[low:high]
                inside = number < np.diff(lines.first)[doc]  # of rows with one id only some may have the line
                doc, number = doc[inside], number[inside]
                at = lines.first[doc] + number
                found = B.gathered(block.data, lines.begin[at], lines.end[at])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(block.first + doc)), pa.array(number), found, wide_maps(found)], ["doc_id", "line", "content", "map"])

    def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of each row's distinct words, by row."""
        parts = [(block.first + words.docs(), h) for block, _, words, h in _read(column.cast(pa.string()), key)]
        return _distinct(*(np.concatenate(c) for c in zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def wide_maps(column: pa.Array) -> pa.BinaryArray:
        """How many distinct words each row has, and their parity in WIDE bits."""
        row, words = sets(column)
        n, bit = np.bincount(row, minlength=len(column)), (B.mix(words) & np.uint64(WIDE - 1)).astype(np.int64)
        out = np.zeros((len(column), 4 + WIDE // 8), np.uint8)
        out[:, :4] = n.astype("<u4").view(np.uint8).reshape(-1, 4)
        for low in range(0, len(column), MAPPED_ROWS):
            rows = min(MAPPED_ROWS, len(column) - low)
            part = slice(*np.searchsorted(row, [low, low + rows]))
            bits = np.bincount((row[part] - low) * WIDE + bit[part], minlength=rows * WIDE) & 1
            out[low : low + rows, 4:] = np.packbits(bits.astype(np.uint8).reshape(rows, WIDE), axis=1)
        return pa.BinaryArray.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.py_buffer(out)])

    def sieve(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (4, 5))
            both = sum(np.ascontiguousarray(m[:, :4]).view("<u4")[:, 0].astype(np.int64) for m in (a, b))
            apart = np.bitwise_count(a[:, 4:] ^ b[:, 4:]).sum(axis=1, dtype=np.int64)
            good = pa.array(apart <= both - 2 * -(-percent * both // (100 + percent)))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in range(4)], ["doc_id", "line", "doc_x", "line_x"])

    def verify(batches):
        for batch in batches:
            (row_a, a), (row_b, b) = sets(batch.column(2)), sets(batch.column(3))
            either = np.bincount(_distinct(np.concatenate([row_a, row_b]), np.concatenate([a, b]))[0], minlength=batch.num_rows)
            both = np.bincount(row_a, minlength=batch.num_rows) + np.bincount(row_b, minlength=batch.num_rows) - either
            good = 100 * both >= percent * either
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["doc_id", "line"])

    with workspace(documents.sparkSession):
        asked = with_rows(documents.select("doc_id", text), stored(ends, "line-dedup-wanted"), ["doc_id"], "1 + size(__wanted) / 4").select("doc_id", text, "__wanted")
        content = asked.mapInArrow(B.trimmed(pick), "doc_id long, line int, content binary, map binary")
        content = stored(content.dropDuplicates(["doc_id", "line"]), "line-dedup-content")
        maps, content = content.select("doc_id", "line", "map"), content.select("doc_id", "line", "content")
        mapped = pairs.select("doc_id", "line", "doc_x", "line_x").join(maps, ["doc_id", "line"]).withColumnRenamed("map", "map_y").join(maps.toDF("doc_x", "line_x", "map_x"), ["doc_x", "line_x"])
        pairs = stored(mapped.select("doc_id", "line", "doc_x", "line_x", "map_y", "map_x").mapInArrow(B.trimmed(sieve), "doc_id long, line int, doc_x long, line_x int"), "line-dedup-sieved")
        release(documents.sparkSession)
        joined = pairs.join(content, ["doc_id", "line"]).withColumnRenamed("content", "y").join(content.toDF("doc_x", "line_x", "x"), ["doc_x", "line_x"])
        return stored(joined.select("doc_id", "line", "x", "y").mapInArrow(B.trimmed(verify), "doc_id long, line int").distinct(), "line-dedup-matched", keep=True)


def removed_lines(documents: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, line) of every line to remove; lines that hold a character are numbered from 0 in each document."""
    spark = documents.sparkSession
    share = spark.sparkContext.broadcast
    with workspace(spark):
        key = B.drawn_key()  # equal hashes are taken for equal words, so texts must not be able to aim at them
        rarity = word_rarity(documents, text, key)
        lines = stored(line_sets(documents, text, rarity, percent, key), "line-dedup-lines")
        rarity.destroy()
        earliest = F.lag(F.lit(1)).over(Window.partitionBy("high", "low").orderBy("doc_id", "line")).isNull()
        classes = lines.where("lead").withColumn("first", earliest).where("first").drop("first", "lead")
        classes = stored(classes, "line-dedup-classes")
        release(spark)
        useful = share(_prefixes(classes.select("words")))
        parts = 64 + (classes.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // (4 * PART_POSTINGS)
        pairs = candidate_pairs(postings_of(classes.withColumn("open", F.lit(1)), useful, useful, parts), percent, False)
        pairs = stored(pairs.groupBy("doc_id", "line", "doc_x", "line_x").agg(F.max("others").alias("others")), "line-dedup-pairs")
        release(spark)
        matched = verified(pairs, documents, text, percent, key)
        undecided = stored(pairs.where("others > 0").select("doc_id", "line").distinct().join(matched, ["doc_id", "line"], "left_anti"), "line-dedup-undecided")
        if not undecided.isEmpty():
            marked = classes.join(near(undecided.withColumn("open", F.lit(1))), ["doc_id", "line"], "left").withColumn("open", F.coalesce("open", F.lit(0)))
            sought = share(_prefixes(marked.where("open = 1").select("words"), least=1))
            more = candidate_pairs(postings_of(marked, sought, useful, parts), percent, True)
            more = stored(more.select("doc_id", "line", "doc_x", "line_x").distinct().join(pairs, ["doc_id", "line", "doc_x", "line_x"], "left_anti"), "line-dedup-more")
            release(spark)
            matched = matched.unionByName(verified(more, documents, text, percent, key))
        release(spark)
        decided = classes.select("high", "low", "doc_id", "line").join(matched.withColumn("near", F.lit(True)), ["doc_id", "line"], "left")
        decided = decided.select("high", "low", F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line"), F.coalesce("near", F.lit(False)).alias("near"))
        found = lines.select("high", "low", "doc_id", "line").join(decided, ["high", "low"])
        found = stored(found.where("near OR doc_id <> first_doc OR line <> first_line").select("doc_id", "line").distinct(), "line-dedup-removed", keep=True)
        return found


def n_lines(text: Column) -> Column:
    """How many lines of a text hold a character. Where no line is empty, newlines are counted, which is faster than splitting."""
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    some_empty = F.startswith(text, F.lit("\n")) | F.endswith(text, F.lit("\n")) | F.contains(text, F.lit("\n\n")) | (text == "")
    return F.when(text.isNull(), 0).when(some_empty, F.size(F.array_remove(F.split(text, "\n"), ""))).otherwise(breaks + 1).cast("long")


def without_lines(documents: DataFrame, removed: DataFrame, text: str = "text", figures: bool = False) -> DataFrame:
    """documents with their removed lines cut out of the text, and n_chars, if there is one, set to the new length.

    With figures it is (doc_id, n_lines, n_removed, kept) instead; n_lines counts lines that hold a character. Texts that
    keep all their lines do not go through Python.
    """
    rows = stored(removed.groupBy("doc_id").agg(F.collect_set("line").alias("__removed")), "line-dedup-removed-of")
    joined = with_rows(documents, rows, ["doc_id"], "1 + size(__removed) / 4").select(*documents.columns, "__removed")
    others = without_rows(documents, rows, ["doc_id"]).select(documents.columns)
    at, schema = documents.columns.index(text), documents.schema

    def kept(batches):
        for batch in batches:
            texts, lists = [], batch.column(batch.num_columns - 1).to_pylist()
            for block in B.blocks(batch.column(at)):
                lines = B.find_words(block.data, block.starts, _NOT_NEWLINE)
                doc = np.repeat(np.arange(block.rows), [len(x) for x in lists[block.first : block.first + block.rows]])
                number = np.array([k for x in lists[block.first : block.first + block.rows] for k in x], np.int64)
                inside = number < np.diff(lines.first)[doc]
                gone = (lines.first[doc] + number)[inside]
                begin, end = lines.begin[gone], lines.end[gone]
                final = end == block.starts[np.searchsorted(block.starts, begin, "right")]  # no newline ends it: the one before goes with it
                cut = np.zeros(len(block.data) + 1, np.int8)
                np.add.at(cut, begin, 1)
                np.add.at(cut, np.where(final, end, end + 1), -1)
                out = np.cumsum(cut[:-1], dtype=np.int8) == 0
                stops = np.concatenate([[0], np.cumsum(out)])[block.starts]
                raw = block.data[out].tobytes()
                for row in range(block.rows):
                    left = raw[stops[row] : stops[row + 1]]
                    texts.append(left.decode("utf-8", "replace"))
                for row in np.unique(doc[inside][final]).tolist():
                    k = block.first + row
                    texts[k] = texts[k].removesuffix("\n")
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    if figures:
        rest = others.select("doc_id", n_lines(F.col(text)).alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.col(text).alias("kept"))
        counted = joined.select("doc_id", text, n_lines(F.col(text)).alias("__n"), F.size("__removed").cast("long").alias("__gone"), "__removed")
        at, schema = 1, counted.drop("__removed").schema
        return counted.mapInArrow(B.trimmed(kept), schema).toDF("doc_id", "kept", "n_lines", "n_removed").select("doc_id", "n_lines", "n_removed", "kept").unionByName(rest)
    changed = joined.mapInArrow(B.trimmed(kept), schema)
    if "n_chars" in documents.columns and text != "n_chars":
        changed = changed.withColumn("n_chars", F.length(text).cast(schema["n_chars"].dataType)).select(documents.columns)
    return changed.unionByName(others)
