"""Suffix-array dedup: removes every byte covered by a string of LENGTH bytes that also starts earlier in the corpus.

Earlier: in a document of smaller doc_id, or in the same document before. Strings are judged on the input.

1. Equal texts: only the document with the least id takes part; the others are covered whole. Equal means equal MD5.
2. Anchors: each window of LENGTH bytes belongs to the leftmost of its GRAM-byte strings with the least hash. Equal windows
   have equal anchors in the same place, so equal windows meet wherever their anchors meet. Consecutive windows of one
   anchor are a run, about 33 windows on average.
3. Descriptions of runs, a few numbers each, meet by their anchors. Of runs with equal bytes, by their hashes, all but the
   earliest are covered. A run whose anchor no other run has has no equal. What is left, different runs of one anchor, is
   asked for its bytes.
4. Of an anchor's runs, windows that agree with no other in the bytes nearest to the anchor have no equal and end here.
   Where several different runs stay, a Burrows-Wheeler transform is built over the runs of many anchors, and
   intervals expand breadth first: an interval of suffixes that share l bytes, extended backward by each byte before it,
   gives intervals that share l + 1; the right ends not seen before are where the common prefix is l. So common prefixes
   come in increasing value. It stops at LENGTH: suffixes with no end between them share LENGTH bytes or more.
5. Of windows that share LENGTH bytes the earliest stays; the bytes of the others are removed.

An anchor that very many different runs have (a short common passage in ever new surroundings) is hot: its runs go on as
single windows, each under its own hash, so that no task holds all of them. Descriptions of equal runs collapse before they
are shuffled, in buffers of HELD_RUNS. No table of fixed size takes part, so the work grows with the text alone: about 39
bytes of description for 33 bytes of text, and bytes only for runs that may have an equal.

Defined results: null and empty texts have no bytes and lose none; of rows with equal doc_id and equal text all count as one
document, and with different texts the one with the smaller MD5 comes first; rows without doc_id come before all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import blocks as B
from llm.packed import PACKED, batch_of, columns_of
from llm.tables import groups, near, release, stored, with_rows, without_rows

#: A string of 36 bytes seldom occurs twice by chance, even in text of little variety; shorter ones do.
LENGTH, GRAM = 100, 36
#: Parts that the windows of an anchor are taken in.
PARTS = 4
#: Positions of one pass are numbered in 24 bits below 40 bits of hash.
PASS_WINDOWS = 1 << 22
POOL_BYTES, BLOCK_BYTES = 1 << 17, 1 << 19
#: Runs that a task describes at once, and bytes of text for each part that descriptions are dealt to.
HELD_RUNS, PART_BYTES = 1 << 18, 24 << 20
#: An anchor is hot with more different runs in a buffer, or in all.
HOT_HERE, HOT = 256, 1024
RUNS = "anchor long, doc_id long, high long, start int, windows int, place int, content binary"
SPANS = "doc_id long, high long, begin int, end int"
ASKED = "doc_id long, high long, covered binary, wanted binary"
NO_ID = -(1 << 63)
#: A run as described; state is 0, or COVERED, WANTED or SPLIT (wanted as single windows) where that is settled.
_RUN = np.dtype([("anchor", "<u8"), ("whole", "<u8"), ("doc", "<i8"), ("high", "<i8"), ("start", "<i4"), ("windows", "u1"), ("place", "u1"), ("state", "u1")])
_ASKED = np.dtype([("anchor", "<u8"), ("start", "<i4"), ("windows", "u1"), ("place", "u1"), ("state", "u1")])
_SPAN = np.dtype([("begin", "<i4"), ("end", "<i4")])
OPEN, COVERED, WANTED, SPLIT = range(4)
#: A second row of the same document, to be left out.
TWIN = 255


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, its place, first window, number of windows) of every run in a block, by places in its bytes."""
    n, width = len(data), length - GRAM + 1
    out = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    for low in range(0, max(0, n - length + 1), PASS_WINDOWS):
        part = data[low : low + PASS_WINDOWS + length - 1]
        prefix = B.prefix_hashes(part)
        begin = np.arange(len(part) - GRAM + 1)
        grams = B.span_hashes(prefix, begin, begin + GRAM)
        least = (grams & np.uint64(0xFFFFFFFFFF000000)) | begin.astype(np.uint64)
        size = 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        owner = (least & np.uint64(0xFFFFFF)).astype(np.int64)  # of each window of the pass
        window = np.arange(low, low + len(owner))
        doc = np.searchsorted(starts, window, "right") - 1
        inside = starts[doc + 1] - window >= length
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new & inside)
        ends = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
        out.append((grams[owner[at]], owner[at] + low, window[at], ends - at + 1))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _dealt(values: np.ndarray, parts: int) -> np.ndarray:
    """Anchors are least hashes, so small numbers: mixed again, they spread over all parts."""
    return (B.mix(values.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def settled(columns: list[np.ndarray], hot: int) -> np.ndarray:
    """States of runs, the columns of _RUN: of equal runs all but the earliest are COVERED, and of anchors with different runs the
    earliest of each WANTED, or SPLIT if there are more than `hot` or one is SPLIT already. Others keep their state. A run that
    is there twice with one place, as rows of a document repeat, is a TWIN the second time.
    """
    anchor, whole, doc, high, start, windows, place, state = columns
    state = state.copy()
    order = np.argsort(anchor)
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = anchor[order[1:]] == anchor[order[:-1]]
    some = order[same[1:] | same[:-1]]  # runs that share their anchor
    some = some[np.lexsort((start[some], high[some], doc[some], windows[some], place[some], whole[some], anchor[some]))]
    if not len(some):
        return state
    differ = lambda *cs: np.concatenate([[True], np.any([c[some[1:]] != c[some[:-1]] for c in cs], axis=0)])
    new_anchor, new_run = differ(anchor), differ(anchor, whole, place, windows)
    group = np.cumsum(new_anchor) - 1
    several = np.bincount(group, new_run)[group]
    split = np.bincount(group, state[some] == SPLIT)[group] > 0
    head = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
    twin = ~new_run & np.all([c[some] == c[some[head]] for c in (doc, high, start)], axis=0)
    state[some] = np.where(twin, TWIN, np.where(~new_run, COVERED, np.where(split | (several > hot), SPLIT, np.where(several > 1, WANTED, state[some]))))
    return state


def described(documents: DataFrame, text: str, parts: int) -> DataFrame:
    """PACKED _RUN of documents(doc_id, high, text), each anchor's in its part; runs that are settled go anywhere."""

    def packed(held) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        state = settled([*columns, np.zeros(len(columns[0]), np.uint8)], HOT_HERE)
        anchor, doc, start = columns[0], columns[2], columns[4]
        # different runs here may be all there are, or not: their part tells; of a hot anchor one goes there for all
        hot = np.flatnonzero(state == SPLIT)
        sign = hot[np.unique(anchor[hot], return_index=True)[1]]
        own = np.flatnonzero(state != TWIN)
        rows = np.concatenate([own, sign])
        state = np.concatenate([np.where(state == WANTED, OPEN, state)[own], np.full(len(sign), SPLIT)])
        spread = (state != OPEN) & (np.arange(len(rows)) < len(own))
        part = np.where(spread, _dealt(doc[rows] + start[rows], parts), _dealt(anchor[rows], parts))
        settled_here = np.where(spread, state + 4, state)  # the part that they go to hands these on
        return batch_of(part, [*(c[rows] for c in columns), settled_here], _RUN)

    def per_partition(batches):
        held, size = [], 0
        for batch in batches:
            ids, high = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for block in B.blocks(batch.column(2), BLOCK_BYTES):
                anchor, place, window, count = anchors(block.data, block.starts)
                row = np.searchsorted(block.starts, window, "right") - 1
                whole = B.span_hashes(B.prefix_hashes(block.data), window, window + count - 1 + LENGTH)
                held.append((anchor, whole, ids[block.first + row], high[block.first + row], (window - block.starts[row]).astype(np.int32), count.astype(np.uint8), (place - window).astype(np.uint8)))
                size += len(anchor)
                if size >= HELD_RUNS:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    return documents.select("doc_id", "high", text).mapInArrow(per_partition, PACKED)


def asked(descriptions: DataFrame, parts: int) -> DataFrame:
    """ASKED for every document that has covered runs (packed _SPAN) or runs whose bytes are wanted (packed _ASKED)."""

    def per_anchor(batches):
        for _, blobs in groups(batches, 1):
            columns = columns_of(blobs, _RUN)
            handed_on = columns[-1] >= 4
            state = np.where(handed_on, columns[-1] - 4, OPEN)
            own = np.flatnonzero(~handed_on)
            found = settled([c[own] for c in columns], HOT)
            signs = columns[-1][own] == SPLIT  # not runs themselves
            state[own] = np.where(signs, OPEN, found)
            rows = np.flatnonzero((state != OPEN) & (state != TWIN))
            columns = [c[rows] for c in columns[:-1]] + [state[rows]]
            columns[0], columns[1] = np.where(columns[-1] == COVERED, 0, columns[0]), np.zeros(len(rows), np.uint64)
            yield batch_of(_dealt(columns[2] ^ columns[3], parts), columns, _RUN)

    def per_document(batches):
        for _, blobs in groups(batches, 1):
            columns = columns_of(blobs, _RUN)
            order = np.lexsort((columns[4], columns[3], columns[2]))
            anchor, _, doc, high, start, windows, place, state = (c[order] for c in columns)
            spans, runs = np.zeros(len(order), _SPAN), np.zeros(len(order), _ASKED)
            spans["begin"], spans["end"] = start, start + windows.astype(np.int32) - 1 + LENGTH
            for name, c in (("anchor", anchor), ("start", start), ("windows", windows), ("place", place), ("state", state)):
                runs[name] = c
            bounds = [*np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (high[1:] != high[:-1])])).tolist(), len(doc)]
            gone = state == COVERED
            pick = lambda rows, mask: [rows[a:b][mask[a:b]].tobytes() or None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[bounds[:-1]]), pa.array(high[bounds[:-1]]), pa.array(pick(spans, gone), pa.binary()), pa.array(pick(runs, ~gone), pa.binary())], ["doc_id", "high", "covered", "wanted"])

    by_part = lambda df: df.repartition("part").sortWithinPartitions("part")
    return by_part(by_part(descriptions).mapInArrow(per_anchor, PACKED)).mapInArrow(per_document, ASKED)


def runs(wanted: DataFrame) -> DataFrame:
    """RUNS of wanted(doc_id, high, text, wanted). Equal windows of a hot anchor collapse here: only the earliest at hand has content."""

    def per_batch(batches):
        for batch in batches:
            ids, highs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            lists = batch.column(3).to_pylist()
            for block in B.blocks(batch.column(2), BLOCK_BYTES):
                mine = [np.frombuffer(x, _ASKED) for x in lists[block.first : block.first + block.rows]]
                row, run = np.repeat(np.arange(block.rows), [len(x) for x in mine]), np.concatenate(mine)
                doc, high, raw = ids[block.first + row], highs[block.first + row], block.data.tobytes()
                whole = np.flatnonzero(run["state"] == WANTED)
                begin = block.starts[row[whole]] + run["start"][whole]
                end = begin + run["windows"][whole].astype(np.int64) - 1 + LENGTH
                yield _rows(run["anchor"][whole], doc[whole], high[whole], run["start"][whole], run["windows"][whole], run["place"][whole], [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
                hot = np.flatnonzero(run["state"] == SPLIT)
                if len(hot):
                    n = run["windows"][hot].astype(np.int64)
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    hot = np.repeat(hot, n)
                    start, place = run["start"][hot] + step, np.maximum(run["place"][hot].astype(np.int64) - step, 0)
                    begin = block.starts[row[hot]] + start
                    key = B.span_hashes(B.prefix_hashes(block.data), begin, begin + LENGTH)
                    order = np.lexsort((start, high[hot], doc[hot], key))
                    again, twin = np.zeros(len(order), bool), np.zeros(len(order), bool)
                    again[1:] = key[order[1:]] == key[order[:-1]]
                    twin[1:] = again[1:] & np.all([c[order[1:]] == c[order[:-1]] for c in (doc[hot], high[hot], start)], axis=0)
                    order, again = order[~twin], again[~twin]
                    content = [None if c else raw[a : a + LENGTH] for c, a in zip(again.tolist(), begin[order].tolist(), strict=True)]
                    spread = np.where(again, B.mix(doc[hot][order].view(np.uint64) + start[order].astype(np.uint64)), key[order])
                    yield _rows(spread, doc[hot][order], high[hot][order], start[order], np.ones(len(order)), place[order], content)

    def _rows(anchor, doc, high, start, windows, place, content) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(doc), pa.array(high), *(pa.array(np.asarray(c).astype(np.int32)) for c in (start, windows, place)), pa.array(content, pa.binary())], [x.split()[0] for x in RUNS.split(", ")])

    return wanted.mapInArrow(per_batch, RUNS)


def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first `length` symbols at least, by doubling."""
    n, size = len(symbols), 1
    rank = symbols.astype(np.int64)
    while True:
        following = np.zeros(n, np.int64)
        following[: max(0, n - size)] = rank[size:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + following
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        size *= 2
        if size >= length or n and new.all():
            return order


def shared_prefix_classes(symbols: np.ndarray, separators: int, length: int) -> np.ndarray:
    """A number for each suffix, equal for suffixes that share their first `length` symbols.

    Symbols under `separators` each occur once. Bounded interval expansion on the Burrows-Wheeler transform.
    """
    n = len(symbols)
    order = suffix_order(symbols, length)
    bwt = symbols[order - 1]
    sorted_bwt = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)  # where the suffix one symbol longer stands
    back[sorted_bwt] = np.arange(n)
    change = np.concatenate([[True], bwt[1:] != bwt[:-1]])
    run = np.cumsum(change) - 1
    run_start = np.flatnonzero(change)
    run_end = np.append(run_start[1:], n) - 1
    first = symbols[order]
    low = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    high = np.append(low[1:], n)
    ends = np.zeros(n + 1, bool)
    ends[high] = True
    wide = int(symbols.max(initial=0)) + 1
    for _ in range(1, length):  # intervals share one symbol at first; ends of common prefixes under `length` are set
        parts = run[high - 1] - run[low] + 1
        owner = np.repeat(np.arange(len(low)), parts)
        at = run[low][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, last = np.maximum(run_start[at], low[owner]), np.minimum(run_end[at], high[owner] - 1)
        symbol = bwt[begin]
        real = symbol >= separators
        owner, begin, last, symbol = owner[real], begin[real], last[real], symbol[real]
        key = owner * wide + symbol
        by = np.argsort(key, kind="stable")
        key = key[by]
        head = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        tail = np.append(head[1:], True) if len(key) else head
        new_low, new_high = back[begin[by][head]], back[last[by][tail]] + 1
        unseen = ~ends[new_high]
        low, high = new_low[unseen], new_high[unseen]
        ends[high] = True
        if not len(low):
            break
    classes = np.empty(n, np.int64)
    classes[order] = np.concatenate([[0], np.cumsum(ends[1:n])]) if n else 0
    return classes


def covered_windows(pool: list[tuple[tuple[int, int, int], int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """SPANS of a pool of different runs ((doc_id, high, start), windows, content): all but the earliest of equal windows."""
    sizes = np.array([len(c) for _, _, c in pool])
    n = len(pool)
    symbols = np.empty(int(sizes.sum()) + n, np.int64)
    firsts = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"".join(c for _, _, c in pool), np.uint8).astype(np.int64) + n
    text = np.ones(len(symbols), bool)
    text[firsts + sizes] = False
    symbols[text] = raw
    symbols[firsts + sizes] = np.arange(n)
    classes = shared_prefix_classes(symbols, n, length)
    windows = np.array([w for _, w, _ in pool])
    owner = np.repeat(np.arange(n), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = np.array([p for p, _, _ in pool])
    order = np.lexsort((place[owner, 2] + offset, place[owner, 1], place[owner, 0], classes[firsts[owner] + offset]))
    found = classes[firsts[owner] + offset][order]
    later = np.zeros(len(owner), bool)
    later[order[1:]] = found[1:] == found[:-1]
    edge = np.concatenate([[True], owner[1:] != owner[:-1]])
    opens = np.flatnonzero(later & (edge | ~np.concatenate([[False], later[:-1]])))
    closes = np.flatnonzero(later & (np.append(edge[1:], True) | ~np.append(later[1:], False)))
    begin = place[owner[opens], 2] + offset[opens]
    end = place[owner[closes], 2] + offset[closes] + length
    return [(int(place[o, 0]), int(place[o, 1]), int(a), int(b)) for o, a, b in zip(owner[opens], begin, end, strict=True)]


def by_context(seen: dict[bytes, tuple[tuple[int, int, int], int, int]]) -> tuple[list, list]:
    """(SPANS, groups of runs) of the different runs of one anchor, the earliest first; only runs of one group can share windows.

    Windows are taken in PARTS by how far the anchor lies behind their start. All windows of a part share the bytes around
    the anchor that each of them has; runs in whose shared bytes no other run agrees have no equal window there.
    """
    spans, together = [], []
    width = LENGTH - GRAM + 1
    for part in range(PARTS):
        near, far = width * part // PARTS, width * (part + 1) // PARTS
        alike: dict[bytes, dict[bytes, tuple[tuple[int, int, int], int]]] = {}
        for content, ((doc, high, start), windows, place) in seen.items():
            first, last = max(0, place - far + 1), min(windows - 1, place - near)
            if first > last:
                continue
            runs_here = alike.setdefault(content[place - near : place + GRAM + width - far], {})
            own = content[first : last + LENGTH]
            if own in runs_here:
                spans.append((doc, high, start + first, start + last + LENGTH))
            else:
                runs_here[own] = (doc, high, start + first), last - first + 1
        together += [[(place, n, c) for c, (place, n) in runs_here.items()] for runs_here in alike.values() if len(runs_here) > 1]
    return spans, together


def covered(found: DataFrame) -> DataFrame:
    """SPANS of bytes that windows of RUNS cover which have an earlier equal."""

    def per_partition(batches):
        anchor, out, pool, held = None, [], [], 0
        seen: dict[bytes, tuple[tuple[int, int, int], int, int]] = {}

        def close(last: bool) -> None:
            nonlocal out, pool, held
            if len(seen) > 1:
                spans, together = by_context(seen)
                out += spans
                for group in together:
                    pool += group
                    held += sum(len(c) for *_, c in group)
                    if held >= POOL_BYTES:
                        out += covered_windows(pool)
                        pool, held = [], 0
            if pool and last:
                out += covered_windows(pool)
                pool, held = [], 0

        for batch in batches:
            for a, doc, high, start, windows, place, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if content is None or content in seen and a == anchor:  # rows come in order: what was seen is earlier, or a twin
                    if content is not None and seen[content][0] == (doc, high, start):
                        continue
                    out.append((doc, high, start, start + windows - 1 + LENGTH))
                    continue
                if a != anchor:
                    close(False)
                    anchor, seen = a, {}
                seen[content] = (doc, high, start), windows, place
            if out:
                yield spans_of(out)
                out = []
        close(True)
        if out:
            yield spans_of(out)

    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "high", "start")
    return dealt.mapInArrow(per_partition, SPANS)


def spans_of(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "high", "begin", "end"])


def _keyed(documents: DataFrame, text: str, versions: bool) -> DataFrame:
    """doc_id, high and the text; with versions high tells texts of one doc_id apart, else it is 0."""
    content = F.coalesce(text, F.lit(""))
    high = F.conv(F.substring(F.md5(content.cast("binary")), 2, 15), 16, 10).cast("long") if versions else F.lit(0).cast("long")
    return documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), high.alias("high"), content.alias(text))


def removed_spans(documents: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, bool]:
    """(documents' digests, spans, versions): rows (doc_id, high, low, n_bytes, whole_sha256, copy), for each document that loses
    bytes (doc_id, high, covered, spans), packed _SPAN and a list of spans, not merged, and whether some doc_id has several texts.
    """
    keyed = _keyed(documents, text, True)
    low = F.conv(F.substring(F.md5(F.col(text).cast("binary")), 17, 15), 16, 10).cast("long")
    digests = stored(keyed.select("doc_id", "high", low.alias("low"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(F.col(text).cast("binary"), 256).alias("whole_sha256")), "substring-dedup-digests")
    shared = stored(digests.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "substring-dedup-shared")
    marked = digests.join(near(shared, "3"), ["high", "low"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first")
    versions = not digests.groupBy("doc_id").agg(F.min("high").alias("a"), F.max("high").alias("b"), F.min("low").alias("c"), F.max("low").alias("d")).where("a <> b OR c <> d").isEmpty()
    marked = stored(marked if versions else marked.withColumn("high", F.lit(0).cast("long")), "substring-dedup-marked")
    on = ["doc_id", "high"] if versions else ["doc_id"]
    parts = 32 + (marked.where("NOT copy").agg(F.sum("n_bytes")).first()[0] or 0) // PART_BYTES
    rest = _keyed(documents, text, versions).where(F.octet_length(text) >= LENGTH)
    rest = without_rows(rest, stored(marked.where("copy").select(on).distinct(), "substring-dedup-copies"), on).select("doc_id", "high", text)
    found = stored(asked(described(rest, text, parts), parts), "substring-dedup-asked")
    release(documents.sparkSession)
    wanted = stored(found.where("wanted IS NOT NULL").select(*on, "wanted"), "substring-dedup-wanted")
    texts = with_rows(rest, wanted, on, None).select("doc_id", "high", text, "wanted")
    spans = stored(covered(runs(texts)), "substring-dedup-spans")
    release(documents.sparkSession)
    listed = spans.groupBy("doc_id", "high").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    listed = found.where("covered IS NOT NULL").select("doc_id", "high", "covered").join(listed, ["doc_id", "high"], "full")
    return marked, stored(listed, "substring-dedup-listed"), versions


def without_spans(documents: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept text) of every row of documents.

    Kept bytes that are no UTF-8 by themselves show as U+FFFD in the text; sums and digests are those of the bytes.
    """
    marked, listed, versions = removed_spans(documents, text)
    keyed, on = _keyed(documents, text, versions), ["doc_id", "high"] if versions else ["doc_id"]
    if with_text:
        touched = keyed.join(listed, ["doc_id", "high"], "left")
    else:
        touched = with_rows(keyed, listed if versions else listed.drop("high"), on, None)

    def apply(batches):
        for batch in batches:
            rows = []
            for content, whole, found in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                raw, kept, at, removed, n = content.encode("utf-8", "surrogatepass"), [], 0, 0, 0
                gone = [(s["begin"], s["end"]) for s in found or ()] + (np.frombuffer(whole, _SPAN).tolist() if whole else [])
                for begin, end in merged(sorted(gone)):
                    kept.append(raw[at:begin])
                    removed, n, at = removed + end - begin, n + 1, end
                left = b"".join([*kept, raw[at:]])
                rows.append((removed, n, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if with_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "high", "removed", "spans", "sha256", "kept"])

    changed = touched.select("doc_id", "high", text, "covered", "spans").mapInArrow(apply, "doc_id long, high long, removed long, spans long, sha256 string, kept string").dropDuplicates(["doc_id", "high"])
    rows = marked.join(changed, ["doc_id", "high"], "left")
    gone = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    none = hashlib.sha256(b"").hexdigest()
    columns = [
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(none)).otherwise(F.coalesce("sha256", "whole_sha256")).alias("kept_sha256"),
    ]
    return rows.select(*columns, *([F.when(gone, "").otherwise(F.col("kept")).alias("kept_text")] if with_text else []))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans united where they meet or overlap."""
    out: list[tuple[int, int]] = []
    for begin, end in spans:
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out
