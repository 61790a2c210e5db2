"""Token ids in binary blocks: patched frame of reference.

File (all integers little-endian):
    magic "TPFR" | u32 version | u64 documents | u64 of them without doc_id, the first ones | u64 ids | u32 blocks
    index: for each block u64 byte offset of the block from the end of the index
    documents: for each i64 doc_id and u64 ids before it in the file (one more entry for the end)
    blocks of BLOCK ids: u32 minimum | u8 width | u16 ids | u16 exceptions | packed deltas | exceptions (u16 place, u32 high bits)

A block subtracts its minimum and packs the deltas at the width that the chosen percentile of them needs; a delta that
needs more keeps its low bits in place and its high bits in the block's exception list. The index of block starts lets a
reader decode any span of ids without the blocks before it.

A run's files hold the documents in ascending doc_id order: file k has the k-th range of ids, and the files' order is in
their names. A null text counts as empty; rows with equal doc_id follow each other; rows without doc_id come first.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import blocks as B
from llm.tables import new_path
from llm.word_table import WordTable

MAGIC, VERSION, BLOCK, PERCENTILE = b"TPFR", 2, 4096, 95
_HEAD, _BLOCK = struct.Struct("<4sIQQQI"), struct.Struct("<IBHH")
#: Documents go to files of at most this many bytes of text, or of one document.
FILE_BYTES = 8 << 20
_TABLES: dict[str, WordTable] = {}
B.KEPT["token_blocks"] = [_TABLES]
_TOKENIZERS: dict[str, tuple] = {}
_CUTTINGS: dict[str, _Cutting | None] = {}
#: A split of words at which `_runs` may cut too, the words that it cuts, by their bytes, and what it cuts them into. Letters outside
#: ASCII are those of U+00C0 to U+024F (bytes C3 to C9) but for U+0130, which lower-cases to a letter and a mark; × and ÷ are none.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_RUN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
_LETTER, _DIGIT, _SIGN, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[0x20, *range(0x09, 0x0E)]], _KIND[0x27] = 0, _ODD
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER
_NO_LETTERS = [x.encode() for x in "×÷İ"]
#: Runs that the tokenizer gets as one text.
RUNS = 1024


def pack_block(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """One block of up to 65,535 unsigned 32-bit ids."""
    ids = ids.astype(np.uint32)
    low = int(ids.min()) if len(ids) else 0
    deltas = ids - np.uint32(low)
    at = min(len(ids) - 1, len(ids) * percentile // 100)
    width = int(np.partition(deltas, at)[at]).bit_length() if len(ids) else 0
    outlier = np.flatnonzero(deltas > np.uint32((1 << width) - 1))
    bits = np.unpackbits(deltas.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    exceptions = np.zeros(len(outlier), np.dtype([("place", "<u2"), ("high", "<u4")]))
    exceptions["place"], exceptions["high"] = outlier, deltas[outlier].astype(np.uint64) >> np.uint64(width)
    return _BLOCK.pack(low, width, len(ids), len(outlier)) + np.packbits(bits.ravel(), bitorder="little").tobytes() + exceptions.tobytes()


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    low, width, n, n_out = _BLOCK.unpack_from(data, at)
    at += _BLOCK.size
    size = -(-n * width // 8)
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    deltas = np.packbits(bits.ravel(), bitorder="little").view("<u4").astype(np.uint64)
    exceptions = np.frombuffer(data, np.dtype([("place", "<u2"), ("high", "<u4")]), n_out, at + size)
    deltas[exceptions["place"]] |= exceptions["high"].astype(np.uint64) << np.uint64(width)
    return (deltas + np.uint64(low)).astype(np.uint32)


def pack_file(doc_ids: np.ndarray, first: np.ndarray, ids: np.ndarray, percentile: int = PERCENTILE, unnamed: int = 0) -> bytes:
    """A file of documents whose ids are ids[first[i]:first[i+1]]; the first `unnamed` of them have no doc_id."""
    packed = [pack_block(ids[k : k + BLOCK], percentile) for k in range(0, len(ids), BLOCK)]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in packed])])[:-1] if packed else np.zeros(0)
    documents = np.zeros(len(first), np.dtype([("id", "<i8"), ("before", "<u8")]))
    documents["id"][:-1], documents["before"] = doc_ids, first
    return _HEAD.pack(MAGIC, VERSION, len(doc_ids), unnamed, len(ids), len(packed)) + starts.astype("<u8").tobytes() + documents.tobytes() + b"".join(packed)


class Reader:
    """Random access to the documents of one file's bytes."""

    def __init__(self, data: bytes):
        magic, version, n_docs, self.unnamed, self.n_ids, n_blocks = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of token blocks")
        self.data, at = data, _HEAD.size
        self.starts = np.frombuffer(data, "<u8", n_blocks, at).astype(np.int64)
        table = np.frombuffer(data, np.dtype([("id", "<i8"), ("before", "<u8")]), n_docs + 1, at + 8 * n_blocks)
        self.doc_ids, self.first = table["id"][:-1], table["before"].astype(np.int64)
        self.base = at + 8 * n_blocks + 16 * (n_docs + 1)

    def span(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end-1 of the file, from the blocks that hold them alone."""
        if begin >= end:
            return np.zeros(0, np.uint32)
        low, high = begin // BLOCK, (end - 1) // BLOCK
        ids = np.concatenate([unpack_block(self.data, self.base + self.starts[k]) for k in range(low, high + 1)])
        return ids[begin - low * BLOCK : end - low * BLOCK]

    def document(self, row: int) -> np.ndarray:
        return self.span(int(self.first[row]), int(self.first[row + 1]))


def _tokenizer(spec: str):
    """The tokenizer, and whether its ids of a text are those of its words (what bytes 0x20 and 0x09 to 0x0D separate) in turn.

    That holds where white space only separates: the pre-tokenizer's pattern takes none into a token, and no added token
    holds any or looks beyond its own characters. White space here is what the normaliser's pattern means by it.
    """
    if spec not in _TOKENIZERS:
        from tokenizers import Tokenizer

        rules = json.loads(spec)
        normalizer = rules.get("normalizer") or {}
        steps = normalizer.get("normalizers", [normalizer])
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = next((s["pattern"].get("Regex", "") for s in splits[:1] if s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert")), "")
        collapses = any(s.get("type") == "Replace" and s["pattern"].get("Regex") == r"\s+" and s.get("content") == " " for s in steps)
        simple = all(t["content"].split() == [t["content"]] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in rules.get("added_tokens", []))
        plain = all(s.get("type") in ("NFC", "Lowercase", "Replace") for s in steps)
        no_space = bool(pattern) and not re.search(r"\\[sSWD]|\s|\.", pattern.replace(r"[^\s\p{L}\p{N}]", ""))
        _TOKENIZERS[spec] = Tokenizer.from_str(spec), collapses and simple and plain and no_space and rules.get("post_processor") is None
    return _TOKENIZERS[spec]


class _Cutting(NamedTuple):
    """Which ids are the last of a run, whether the tokenizer lower-cases, and byte strings whose words stay whole."""

    ends: np.ndarray
    lowers: bool
    whole: list[bytes]


def _cutting(spec: str) -> _Cutting | None:
    """How words may be cut into runs, if they may: where the pre-tokenizer cuts by SPLIT and a BPE model marks the last id of each part."""
    if spec not in _CUTTINGS:
        from tokenizers.pre_tokenizers import ByteLevel

        rules, found = json.loads(spec), None
        model, added, normalizer = rules["model"], rules.get("added_tokens", []), rules.get("normalizer") or {}
        steps = normalizer.get("normalizers", [normalizer])
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        suffix = model.get("type") == "BPE" and model.get("end_of_word_suffix")
        normal = all(s["type"] != "Replace" or s["pattern"].get("Regex") == r"\s+" for s in steps) and not any(t["normalized"] for t in added)
        levels = [s.get("type") for s in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"].get("Regex") == SPLIT and not (splits[1]["add_prefix_space"] or splits[1]["use_regex"])
        whole = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
        if _tokenizer(spec)[1] and suffix and normal and levels and whole and all(c + end in model["vocab"] for c in ByteLevel.alphabet() for end in ("", suffix)):
            ends = np.zeros(1 + max([*model["vocab"].values(), *(t["id"] for t in added)]), bool)
            ends[[k for token, k in model["vocab"].items() if token.endswith(suffix)]] = True
            found = _Cutting(ends, any(s["type"] == "Lowercase" for s in steps), [*_NO_LETTERS, *(t["content"].encode() for t in added)])
        _CUTTINGS[spec] = found
    return _CUTTINGS[spec]


def _places(raw: bytes, part: bytes) -> Iterator[int]:
    at = raw.find(part)
    while at >= 0:
        yield at
        at = raw.find(part, at + 1)


def _runs(cutting: _Cutting, block: B.Block) -> tuple[np.ndarray, B.Words]:
    """The words of a block cut into runs of letters, single digits and runs of signs, as SPLIT cuts them, and the block's bytes with
    A to Z lower-cased if the tokenizer does so: far fewer of them differ than of words.

    Words with other characters, an apostrophe or an added token stay whole and as they are: what is cut has no mark that normalising
    could join to a letter, and no contraction.
    """
    data, words = block.data, B.find_words(block.data, block.starts)
    if not len(words.begin):
        return data, words
    kind, raw = _KIND[data], data.tobytes()
    odd = [np.flatnonzero(kind == _ODD), *(np.fromiter(_places(raw, x), np.int64) for x in cutting.whole)]
    whole = np.zeros(len(words.begin), bool)
    whole[np.searchsorted(words.begin, np.concatenate(odd), "right") - 1] = True
    try:
        raw.decode()
    except UnicodeDecodeError:  # such bytes are replaced by a sign when they are decoded
        whole[:] = True
    opens, cuts = np.zeros(len(data), bool), kind == _DIGIT
    opens[words.begin] = True
    cuts[1:] |= kind[1:] != kind[:-1]
    cuts &= kind != 0
    begin = np.flatnonzero(opens | cuts)
    heads = opens[begin]
    word = np.cumsum(heads) - 1
    if whole.any():
        keep = heads | ~whole[word]
        begin, word = begin[keep], word[keep]
    end = np.minimum(np.append(begin[1:], len(data)), words.end[word])
    if cutting.lowers:
        data, first, size = B.lowered(data), words.begin[whole], (words.end - words.begin)[whole]
        at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        data[at] = block.data[at]
    return data, B.Words(begin, end, np.searchsorted(begin, block.starts))


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int32), *lists]), np.fromiter(map(len, lists), np.int64, len(lists))


def _encoded(tokenizer, texts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _ids_of_runs(tokenizer, cutting: _Cutting, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of runs and of whole words end to end, and how many each has. The tokenizer gets RUNS of the former as one text."""
    single = np.fromiter((_RUN.fullmatch(w) is not None for w in words), bool, len(words))
    runs, others = ([w for w, x in zip(words, single.tolist(), strict=True) if x == kind] for kind in (True, False))
    ids, _ = _flat(_encoded(tokenizer, [" ".join(runs[k : k + RUNS]) for k in range(0, len(runs), RUNS)]))
    last = np.flatnonzero(cutting.ends[ids]) + 1
    if len(last) != len(runs):
        raise ValueError("the tokenizer does not mark the ends of runs")
    if not others:
        return ids, np.diff(last, prepend=0)
    size = np.zeros(len(words), np.int64)
    size[single] = np.diff(last, prepend=0)
    other_ids, size[~single] = _flat(_encoded(tokenizer, others))
    out, of_run = np.empty(size.sum(), np.int32), np.repeat(single, size)
    out[of_run], out[~of_run] = ids, other_ids
    return out, size


def encode(spec: str, block: B.Block, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a block end to end, each with end_id behind, and where each text's begin."""
    tokenizer, by_word = _tokenizer(spec)
    if by_word:
        if spec not in _TABLES:
            _TABLES[spec] = WordTable()
        cutting = _cutting(spec)
        if cutting:
            data, words = _runs(cutting, block)
            plain, sizes = _TABLES[spec].ids(data, words, lambda new: _ids_of_runs(tokenizer, cutting, new))
        else:
            words = B.find_words(block.data, block.starts)
            plain, sizes = _TABLES[spec].ids(block.data, words, lambda new: _flat(_encoded(tokenizer, new)))
        counts = B.sums_by_text(sizes, words.first)
    else:
        plain, counts = _flat(_encoded(tokenizer, B.texts_of(block)))
    first = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int64)
    ids = np.full(first[-1], end_id, np.uint32)
    keep = np.ones(len(ids), bool)
    keep[first[1:] - 1] = False
    ids[keep] = plain
    return ids, first


def write_files(documents: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, percentile: int = PERCENTILE, text: str = "text") -> DataFrame:
    """Writes documents to folder and returns it as (file, content, ids): the stored files, with names in doc_id order, and how many ids each holds.

    Documents are range-partitioned by doc_id and sorted within the ranges; a range makes one or more files.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        spec: Broadcast = documents.sparkSession.sparkContext.broadcast(file.read())

    def per_range(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        unnamed = 0

        def file():
            nonlocal held, number, unnamed
            ids = np.concatenate([x for _, _, x in held])
            sizes = np.concatenate([np.diff(f) for _, f, _ in held])
            data = pack_file(np.concatenate([d for d, _, _ in held]), np.concatenate([[0], np.cumsum(sizes)]), ids, percentile, unnamed)
            row = pa.RecordBatch.from_arrays([pa.array([f"{part:08d}-{number:06d}"]), pa.array([data], pa.binary()), pa.array([len(ids)], pa.int64())], ["file", "content", "ids"])
            held, number, unnamed = [], number + 1, 0
            return row

        size = 0
        for batch in batches:
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            numbers = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for block in B.blocks(batch.column(1)):
                ids, first = encode(spec.value, block, end_id)
                held.append((numbers[block.first : block.first + block.rows], first, ids))
                unnamed += int((~named[block.first : block.first + block.rows]).sum())
                size += len(block.data)
                if size >= FILE_BYTES:
                    yield file()
                    size = 0
        if held:
            yield file()

    files = documents.select("doc_id", text).repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(per_range, "file string, content binary, ids long")
    files.write.option("compression", "uncompressed").parquet(folder)
    return documents.sparkSession.read.schema(files.schema).parquet(folder)


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in files(file, content, ids)."""

    def per_file(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(data)
                ids = reader.span(0, reader.n_ids).astype("<u4").tobytes()
                sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(reader.first[:-1], reader.first[1:], strict=True)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(reader.doc_ids, mask=np.arange(n) < reader.unnamed), pa.array(reader.first[:-1]), pa.array(np.diff(reader.first)), pa.array(sums, pa.int64())], ["file", "doc_id", "within", "n_tokens", "ids_crc32"])

    rows = files.select("file", "content").mapInArrow(per_file, "file string, doc_id long, within long, n_tokens long, ids_crc32 long")
    before = _running(files.select("file", "ids"))
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _running(sizes: DataFrame) -> DataFrame:
    """(file, before): ids in all files with a smaller name. Sums run within the files of a range, then over ranges."""
    from pyspark.sql import Window

    part = sizes.withColumn("part", F.substring("file", 1, 8).cast("int"))
    inside = part.withColumn("inside", F.sum("ids").over(Window.partitionBy("part").orderBy("file")) - F.col("ids"))
    totals = part.groupBy("part").agg(F.sum("ids").alias("ids"))  # a row for each range
    ranges = totals.withColumn("ahead", F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).select("part", "ahead")
    return inside.join(ranges, "part").select("file", (F.col("inside") + F.col("ahead")).alias("before"))


def encoded(spark: SparkSession, documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """documents through files in the shared folder and back."""
    return read_files(write_files(documents, tokenizer_path, new_path(spark, "token-blocks")))
