"""Alignment of two tokenizers on the same texts, and how firmly their ids go together over a corpus.

A encodes a space and the text, by a byte-level BPE; B encodes the text, by a SentencePiece model that puts the space there
itself. Tokens are byte strings, so both cut the same bytes. All texts of a block are laid end to end: one bincount over byte
positions marks where A's tokens end and one where B's do. Where both do, a group of tokens ends; every stretch between two
marks of either kind lies in exactly one token of each, and is one link: a pair of token occurrences that overlap. Prefix sums
over the block, read off at the documents' bounds, give every document's figures.

An id pair's count is the number of documents that hold it linked. Texts are encoded once, and their ids kept in the shared
folder, at two bytes each for vocabularies of that size; where tokens end follows from the ids. Counts are summed by Spark. While
there are no more than PAIRS of them they are sent to all tasks as flat arrays; beyond that each document's pairs meet their
counts by a join, and come back to their document. Both ways give the same rows.

Defined results: a text that is null or empty, or that one of the tokenizers does not spell byte for byte (a normaliser changed
it, or it holds the model's own sign for a space), has no tokens and zeros; strings of special tokens inside texts are plain
text; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm import blocks as B
from llm.tables import stored, workspace

#: Bytes of text worked on together; pairs that are sent to all tasks; pairs that a task gathers before it adds up.
CHUNK, PAIRS, HELD = 1 << 19, 1 << 22, 1 << 20
SPACE = "▁"
#: Fixed value: how a byte-level BPE cuts a text before it merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENCODED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokens(NamedTuple):
    """Ids of all texts end to end, where each text's begin, and where each token ends in the bytes of all texts."""

    ids: np.ndarray
    first: np.ndarray
    ends: np.ndarray


class Vocabulary(NamedTuple):
    """size: bytes of each id's token; offsets into content, where they are."""

    size: np.ndarray
    offsets: np.ndarray
    content: np.ndarray


def _vocabulary(tokens: dict[int, bytes]) -> Vocabulary:
    size = np.zeros(max(tokens, default=-1) + 1, np.int64)
    for i, t in tokens.items():
        size[i] = len(t)
    return Vocabulary(size, np.cumsum(size) - size, np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(size))), np.uint8))


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class ByteLevel:
    """A byte-level BPE from a tokenizer file: encode(texts) gives lists of ids, and content the bytes of each id.

    A vocabulary whose ids follow its merges goes through the faster of the two public libraries that know this kind.
    """

    def __init__(self, spec: str):
        rules, signs = json.loads(spec), byte_characters()
        special = {t["id"] for t in rules.get("added_tokens", [])}
        content = {i: bytes(signs[c] for c in t) for t, i in rules["model"]["vocab"].items() if i not in special}
        self.content = _vocabulary(content)
        split = rules.get("pre_tokenizer") or {}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in rules["model"]["merges"]]
        in_order = [rules["model"]["vocab"][m] for m in merges] == list(range(256, 256 + len(merges))) and sorted(content) == list(range(256 + len(merges)))
        if in_order and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not rules.get("normalizer"):
            import tiktoken

            encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={t: i for i, t in content.items()}, special_tokens={}).encode_ordinary
            self.encode = lambda texts: [encode(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_str(spec)
            model.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A SentencePiece model by the same interface."""

    def __init__(self, model: bytes):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        named = lambda i: bytes([int(processor.id_to_piece(i)[3:5], 16)]) if processor.is_byte(i) else processor.id_to_piece(i).replace(SPACE, " ").encode()
        self.content = _vocabulary({i: named(i) for i in range(processor.get_piece_size())})
        self.encode = lambda texts: processor.encode(texts, num_threads=1)


def _spelled(v: Vocabulary, lists: list[list[int]], data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids end to end, tokens of each text, and whether a text's tokens spell its bytes."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter((i for x in lists for i in x), np.int64, counts.sum())
    first = np.concatenate([[0], np.cumsum(counts)])
    fits = B.sums_by_text(v.size[ids], first) == np.diff(starts)
    keep = np.repeat(fits, counts)
    size, at = v.size[ids[keep]], v.offsets[ids[keep]]
    ends = np.cumsum(size)
    raw = v.content[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + size, size)]
    here = np.repeat(fits, np.diff(starts))
    wrong = np.zeros(len(data), np.int64)
    wrong[here] = raw != data[here]
    return ids, counts, fits & (B.sums_by_text(wrong, starts) == 0)


def marked(a: Tokens, b: Tokens) -> np.ndarray:
    """For each byte position 1 where a token of A ends, 2 for B, 3 for both."""
    size = int(a.ends[-1]) if len(a.ends) else 0
    return sum((np.bincount(t.ends - 1, minlength=size) << k).astype(np.int8) for k, t in enumerate((a, b)))


def aligned(block: B.Block, a: ByteLevel, b: Pieces) -> tuple[Tokens, Tokens, np.ndarray]:
    """Tokens of both for every text of the block, with a space before it, and marked() of them. Texts without tokens have no bytes."""
    texts = B.texts_of(block)
    spaced = [(" " + t).encode() if t else b"" for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in spaced])]).astype(np.int64)
    data = np.frombuffer(b"".join(spaced), np.uint8)
    sides = [_spelled(v.content, v.encode(given), data, starts) for v, given in ((a, [" " + t if t else "" for t in texts]), (b, texts))]
    both = sides[0][2] & sides[1][2]
    out = []
    for v, (ids, counts, _) in zip((a, b), sides, strict=True):
        ids, counts = ids[np.repeat(both, counts)], counts * both
        out.append(Tokens(ids, np.concatenate([[0], np.cumsum(counts)]), np.cumsum(v.content.size[ids])))
    return out[0], out[1], marked(*out)


def linked(a: Tokens, b: Tokens, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A id << 32 | B id of every link, and where each text's links begin: a stretch lies in as many tokens as ended before it."""
    ends = np.flatnonzero(marks)
    kind = marks[ends]
    before = [np.cumsum(kind & bit > 0) - (kind & bit > 0) for bit in (1, 2)]
    return a.ids[before[0]] << 32 | b.ids[before[1]], np.searchsorted(ends, np.concatenate([[0], a.ends])[a.first])


def _groups_text(a: Tokens, b: Tokens, marks: np.ndarray, tables: tuple[list[str], list[str]]) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of every text. Each token's word comes with the sign behind it; a table holds words with `,` and then
    with the sign that ends a group's side."""
    cuts = np.flatnonzero(marks == 3)
    group = [np.searchsorted(cuts, t.ends - 1) for t in (a, b)]
    last = [marks[t.ends - 1] == 3 for t in (a, b)]
    order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
    half = len(tables[0]) // 2, len(tables[1]) // 2
    code = np.concatenate([a.ids + half[0] * last[0], b.ids + half[1] * last[1] + len(tables[0])])[order].tolist()
    table = tables[0] + tables[1]
    words = [table[c] for c in code]
    ends = (a.first + b.first).tolist()
    return ["".join(words[low:high])[:-1] for low, high in zip(ends[:-1], ends[1:], strict=True)]


def _tables(a: ByteLevel, b: Pieces) -> tuple[list[str], list[str]]:
    sign = lambda n, ends: [f"{i}," for i in range(n)] + [f"{i}{ends}" for i in range(n)]
    return sign(len(a.content.size), "|"), sign(len(b.content.size), ";")


def alignments(documents: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """documents with a_ids, b_ids and, for each group, how many tokens of A and of B come up to its end: a_ends, b_ends."""
    names = ("a_ids", "b_ids", "a_ends", "b_ends")
    documents = documents.drop(*names)
    spark, at = documents.sparkSession, documents.columns.index(text)
    files = spark.sparkContext.broadcast((open(a_path, encoding="utf-8").read(), open(b_path, "rb").read()))
    schema = T.StructType([*documents.schema.fields, *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in names)])

    def per_batch(batches):
        a, b = ByteLevel(files.value[0]), Pieces(files.value[1])
        for batch in batches:
            for block in B.blocks(batch.column(at), CHUNK):
                x, y, marks = aligned(block, a, b)
                bounds = np.concatenate([[0], x.ends])[x.first]
                cuts = np.flatnonzero(marks == 3)
                first = np.searchsorted(cuts, bounds)
                doc = np.repeat(np.arange(block.rows), np.diff(first))
                columns = [(x.first, x.ids), (y.first, y.ids), *((first, np.searchsorted(t.ends, cuts, "right") - t.first[doc] + 1) for t in (x, y))]
                lists = [pa.ListArray.from_arrays(pa.array(f.astype(np.int32)), pa.array(v.astype(np.int32))) for f, v in columns]
                yield pa.RecordBatch.from_arrays([*(c.slice(block.first, block.rows) for c in batch.columns), *lists], schema.names)

    return documents.mapInArrow(per_batch, schema)


def _encoded(documents: DataFrame, a_path: str, b_path: str, text: str) -> DataFrame:
    """ENCODED: figures and ids of every row of documents; row is a number of its own."""
    files = documents.sparkSession.sparkContext.broadcast((open(a_path, encoding="utf-8").read(), open(b_path, "rb").read()))
    names = [c.split()[0] for c in ENCODED.split(", ")]

    def per_task(batches):
        from pyspark import TaskContext

        a, b = ByteLevel(files.value[0]), Pieces(files.value[1])
        tables, number = _tables(a, b), TaskContext.get().partitionId() << 40
        kinds = [_kind(v.content.size) for v in (a, b)]
        for batch in batches:
            for block in B.blocks(batch.column(1), CHUNK):
                x, y, marks = aligned(block, a, b)
                bounds = np.concatenate([[0], x.ends])[x.first]
                groups = B.sums_by_text((marks == 3).astype(np.int64), bounds)
                links = B.sums_by_text((marks > 0).astype(np.int64), bounds)
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in _groups_text(x, y, marks, tables)]
                raw = [t.ids.astype(k).tobytes() for t, k in zip((x, y), kinds, strict=True)]
                ids = [pa.BinaryArray.from_buffers(pa.binary(), block.rows, [None, pa.py_buffer((t.first * np.dtype(k).itemsize).astype(np.int32)), pa.py_buffer(r)]) for t, k, r in zip((x, y), kinds, raw, strict=True)]
                numbers = np.arange(number, number + block.rows)
                number += block.rows
                columns = [pa.array(numbers), batch.column(0).slice(block.first, block.rows), *map(pa.array, (np.diff(x.first), np.diff(y.first), groups, links)), pa.array(digests, pa.string()), *ids]
                yield pa.RecordBatch.from_arrays(columns, names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(per_task, ENCODED)


def _kind(size: np.ndarray) -> str:
    return "<u2" if len(size) <= 1 << 16 else "<u4"


def _links(batch: pa.RecordBatch, sizes: tuple[np.ndarray, np.ndarray]):
    """(first row, rows, links, where each row's begin) for runs of a batch's rows, whose last two columns are ids of A and B."""
    sides = []
    for column, size in zip(batch.columns[-2:], sizes, strict=True):
        kind = np.dtype(_kind(size))
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        raw = column.buffers()[2]
        ids = np.frombuffer(raw, kind, offsets[-1] // kind.itemsize) if raw is not None and raw.size else np.zeros(0, kind)
        sides.append((ids, offsets // kind.itemsize))
    row, at = 0, sides[0][1]
    while row < batch.num_rows:
        last = min(batch.num_rows, max(row + 1, int(np.searchsorted(at, at[row] + (CHUNK >> 1), "right")) - 1))
        tokens = []
        for (ids, first), size in zip(sides, sizes, strict=True):
            mine = ids[first[row] : first[last]].astype(np.int64)
            tokens.append(Tokens(mine, first[row : last + 1] - first[row], np.cumsum(size[mine])))
        yield row, last - row, *linked(*tokens, marked(*tokens))
        row = last


def _held(links: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different links, and row and place among them of each that a row has."""
    pairs, place = np.unique(links, return_inverse=True)
    held = np.unique(np.repeat(np.arange(len(first) - 1), np.diff(first)) * max(len(pairs), 1) + place)
    return pairs, held // max(len(pairs), 1), held % max(len(pairs), 1)


def pair_counts(encoded: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(pair, count, best): documents that hold each id pair linked, and whether no pair of its A id is in more."""

    def per_task(batches):
        known: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed():
            pairs, place = np.unique(np.concatenate([p for p, _ in known]), return_inverse=True)
            return pairs, np.bincount(place, np.concatenate([d for _, d in known]), len(pairs)).astype(np.int64)

        for batch in batches:
            for _, _, links, first in _links(batch, sizes):
                pairs, _, place = _held(links, first)
                known.append((pairs, np.bincount(place, minlength=len(pairs))))
                size += len(pairs)
                if size > HELD:
                    known = [summed()]
                    size = len(known[0][0])
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in known[0]], ["pair", "docs"])
                        known, size = [], 0
        if known:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in summed()], ["pair", "docs"])

    counts = stored(encoded.select("a", "b").mapInArrow(per_task, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("count")), "align-counts")
    a = F.shiftright("pair", 32)
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))  # a row for each id of A
    return counts.join(highest, a == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def statistics(documents: DataFrame, a_path: str, b_path: str, text: str = "text", most: int = PAIRS) -> DataFrame:
    """RESULT for every row of documents. groups_sha256 is of `a1,a2|b1;a3|b2,b3`, ids of A and B by group; '' without tokens."""
    spark = documents.sparkSession
    names = [c.split()[0] for c in RESULT.split(", ")]
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        sizes = ByteLevel(a.read()).content.size, Pieces(b.read()).content.size
    with workspace(spark):
        encoded = stored(_encoded(documents, a_path, b_path, text), "align-encoded", compression="zstd")
        counts = stored(pair_counts(encoded, sizes), "align-pairs")
        figures = [names[0], *names[1:5], names[7]]
        if counts.count() <= most:
            table = counts.orderBy("pair").toArrow()
            flat = spark.sparkContext.broadcast(tuple(table.column(k).to_numpy() for k in range(3)))

            def by_arrays(batches):
                pairs, count, best = flat.value
                for batch in batches:
                    for row, n, links, first in _links(batch, sizes):
                        at = np.searchsorted(pairs, links)
                        sums = [pa.array(B.sums_by_text(x[at].astype(np.int64), first)) for x in (best, count)]
                        c = [x.slice(row, n) for x in batch.columns[: len(figures)]]
                        yield pa.RecordBatch.from_arrays([*c[:5], *sums, c[5]], names)

            rows = encoded.select(*figures, "a", "b").mapInArrow(by_arrays, RESULT)
        else:

            def asked(batches):
                for batch in batches:
                    numbers = batch.column(0).to_numpy()
                    for row, _, links, first in _links(batch, sizes):
                        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
                        order = np.lexsort((links, of))
                        of, links = of[order], links[order]
                        new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (links[1:] != links[:-1])])) if len(of) else of
                        yield pa.RecordBatch.from_arrays([pa.array(numbers[row + of[new]]), pa.array(links[new]), pa.array(np.diff(np.append(new, len(of))))], ["row", "pair", "times"])

            met = encoded.select("row", "a", "b").mapInArrow(asked, "row long, pair long, times long").join(counts, "pair")
            sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
            rows = encoded.drop("a", "b").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).select(*names)
        return stored(rows, "align-rows", keep=True)
