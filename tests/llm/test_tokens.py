"""Token blocks and SentencePiece encoding: exact round trips, and equality with the public libraries."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm import blocks as B
from llm import pieces, token_blocks
from llm.queries import tokenizer_file

PIECES = tokenizer_file("piece_bpe_32k.model")
SPECIAL = ["", " ", "  a", " a  b   c\n\n x\t\ty ", "日本語 한국어 🎉🎉 ünï \x07 zz", "def f(x):\n        return x   # hi", " " * 40 + "x" + " " * 33, "<|endoftext|> it's <s>", "tab\x0bvt\x0cff nbsp\xa0x\x85y\x1cz"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=300), st.integers(0, 100))
def test_blocks_hold_any_ids(ids, percentile):
    ids = np.array(ids, np.uint32)
    assert (token_blocks.unpack_block(token_blocks.pack_block(ids, percentile)) == ids).all()


def test_outliers_become_exceptions():
    ids = np.arange(1000, dtype=np.uint32) % 16 + 500
    ids[[3, 700]] = 40_000
    packed = token_blocks.pack_block(ids)
    assert len(packed) == token_blocks._BLOCK.size + 500 + 2 * 6 and (token_blocks.unpack_block(packed) == ids).all()


def test_documents_can_be_read_alone():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 3000, 20)
    first, ids = np.concatenate([[0], np.cumsum(sizes)]), rng.integers(0, 49_408, sizes.sum()).astype(np.uint32)
    reader = token_blocks.Reader(token_blocks.pack_file(np.arange(20) * 7, first, ids))
    assert reader.doc_ids.tolist() == (np.arange(20) * 7).tolist()
    assert all((reader.document(k) == ids[first[k] : first[k + 1]]).all() for k in range(20))
    with pytest.raises(ValueError):
        token_blocks.Reader(b"x" * 100)


def test_token_files(spark, documents, rows, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    extra = spark.createDataFrame([(200 + k, t) for k, t in enumerate(SPECIAL)], "doc_id long, text string")
    found = token_blocks.encoded(spark, documents.select("doc_id", "text").union(extra), path).collect()
    tokenizer, texts = Tokenizer.from_file(path), dict([*rows, *((200 + k, t) for k, t in enumerate(SPECIAL))])
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    assert len(found) == len(rows) + len(SPECIAL)
    at = 0
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        at += r.n_tokens
    assert token_blocks.encoded(spark, nothing, path).count() == 0


def test_rows_without_id_come_first_and_stay_without(spark):
    df = spark.createDataFrame([(-1, "one two"), (None, "three"), (-5, "four five six"), (None, None), (3, "")], "doc_id long, text string")
    found = sorted(map(tuple, token_blocks.encoded(spark, df, tokenizer_file("word_bpe_49k.json")).select("start", "doc_id", "n_tokens").collect()))
    assert [i for _, i, _ in found] == [None, None, -5, -1, 3]
    assert [s for s, *_ in found] == [sum(n for *_, n in found[:k]) for k in range(5)]


def test_tokenizers_that_keep_white_space_get_whole_texts():
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec = file.read()
    tokenizer, by_word = token_blocks._tokenizer(spec)
    texts = ["a  b\n c", "", " lead"]
    ids, first = token_blocks.encode(spec, next(B.blocks(pa.array(texts))), 9)
    assert not by_word
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(first)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 9] for t in texts]


def ids_of_words(texts):
    """What token_blocks makes of texts with the word vocabulary, and the library's ids."""
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    found = []
    for block in B.blocks(pa.array(texts)):
        ids, first = token_blocks.encode(spec, block, 1)
        found += [ids[a:b].tolist() for a, b in itertools.pairwise(first)]
    return spec, found, [[*e.ids, 1] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_words_that_differ_in_case_and_signs_share_their_runs():
    token_blocks._TABLES.clear()
    stems = ["".join(x) for x in itertools.product("bdfgklmnp", "aeiouéö", "rst", "aeio")]
    shapes = ["{}", "{}.", "{},", "({})", "{}!?", "{}-{}", "#{}%%", "{}7"]
    texts = [" ".join(f.format(s, s) for f in shapes for s in (x, x[0].upper() + x[1:])) for x in stems]
    spec, found, expected = ids_of_words(texts)
    assert found == expected
    assert token_blocks._TABLES[spec].count <= len(stems) + 10 < len({w for t in texts for w in t.split()}) / 10


PARTS = [*"abzAZéÉßİıſΣςKÅ×÷09٣½.,'\u2019<|>#-_~`^\\", "'s", "'S", "'ll", "\u0301", "\u0338", "\u030a", "W", "A", "=", "漢", "한", "ᄒ", "ᅡ", "🎉", "ǅ", "ɏ", "Ⱥ", "\x07", "\x7f", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "</w>", " ", "\n", "\x0b"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS) | st.characters(codec="utf-8", max_codepoint=0x24F), max_size=12).map("".join), min_size=1, max_size=4))
def test_cut_words_have_the_ids_of_whole_texts(texts):
    _, found, expected = ids_of_words(texts)
    assert found == expected


def test_added_tokens_at_the_seam_of_two_texts():
    _, found, expected = ids_of_words(["x<|endof", "text|>Y", "<|endoftext|>", "<|endoftext", "|>", "caf", "é.", ""])
    assert found == expected


def test_characters_that_may_be_cut_off_are_letters_of_one_form():
    import unicodedata

    for c in map(chr, range(0x80, 0x250)):
        cut = all(token_blocks._KIND[b] == token_blocks._LETTER for b in c.encode()) and c.encode() not in token_blocks._NO_LETTERS
        assert cut == (token_blocks._RUN.fullmatch(c) is not None), c
        assert not cut or unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and unicodedata.category(c.lower())[0] == "L", c


def encoded(model, texts):
    out = []
    for block in B.blocks(pa.array(texts)):
        ids, first = pieces.encode(model, block)
        out += [ids[a:b].tolist() for a, b in itertools.pairwise(first)]
    return out


@pytest.fixture(scope="module")
def model():
    return pieces.load(PIECES)


def test_pieces_are_those_of_the_library(model, rows):
    import sentencepiece

    texts = [t or "" for _, t in rows] + SPECIAL
    assert encoded(model, texts) == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(texts, num_threads=1)


def test_text_comes_back(model, rows):
    texts = [t or "" for _, t in rows] + SPECIAL
    ids = encoded(model, texts)
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    assert pieces.decode(model, np.array(list(itertools.chain(*ids)), np.int64), first).to_pylist() == texts


@settings(max_examples=40, deadline=None)
@given(st.text(st.sampled_from("abehinorst éß漢\n\t "), max_size=40))
def test_any_text(model, text):
    import sentencepiece

    assert encoded(model, [text])[0] == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)


def test_long_words_and_runs_of_spaces(model):
    """Words and runs far longer than any piece, in time that grows with them."""
    import random
    import sentencepiece
    import time

    rng, library = random.Random(3), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["x" * 20_000, "".join(rng.choices("aehinorst", k=30_000)), " " * 9000 + "a" + " " * 31 + "漢" + " " * 17, "漢字かな交じり文" * 900, "é" * 3000 + "🎉" * 3000]
    assert encoded(model, texts) == library.encode(texts, num_threads=1)
    for n in range(1, 70):
        assert encoded(model, [" " * n + w for w in ("", "the", "漢", "🎉", "\n x")]) == library.encode([" " * n + w for w in ("", "the", "漢", "🎉", "\n x")]), n
    began = time.perf_counter()
    encoded(model, ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), " " * 100_000 + "x"])
    assert time.perf_counter() - began < 60


def test_words_swept_alone_equal_words_together(model):
    words = ["▁" + w for t in SPECIAL for w in t.split()] + ["▁international", "x" * 64, "▁" + "ab漢" * 21]
    flat, sizes = pieces.viterbi(model, words)
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [pieces.swept(model, w).tolist() for w in words]


def test_unigram_path_is_the_best_of_all(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as format_of

    with open(PIECES, "rb") as file:
        proto = format_of.ModelProto.FromString(file.read())
    proto.trainer_spec.model_type = format_of.TrainerSpec.UNIGRAM
    rng = np.random.default_rng(2)
    for p in proto.pieces:
        p.score = -float(rng.uniform(1, 20)) / (len(p.piece) ** 0.5)
    (tmp_path / "unigram.model").write_bytes(proto.SerializeToString())
    model = pieces.load(str(tmp_path / "unigram.model"))
    for word in ["▁the", "▁another", "▁international", "▁strengths", "ing"]:
        paths = []
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in itertools.pairwise(at)]
            if all(p in model.scores for p in parts):
                paths.append((sum(model.scores[p][0] for p in parts), parts))
        best = max(paths)[1]
        assert pieces.encode_words(model, [word])[0].tolist() == [model.scores[p][1] for p in best] == pieces.swept(model, word).tolist()


def test_columns_of_ids_and_texts(documents, rows, nothing):
    with_ids = pieces.with_piece_ids(documents, PIECES)
    assert with_ids.columns == [*documents.columns, "piece_ids"] and with_ids.count() == len(rows)
    back = pieces.with_texts(with_ids, PIECES, out="again").select("text", "again").where(F.coalesce("text", F.lit("")) != F.col("again"))
    assert back.count() == 0
    assert pieces.round_trips(documents, PIECES).where("NOT round_trip").count() == 0
    assert pieces.with_piece_ids(nothing, PIECES).count() == 0
