"""Words that polynomial hashes modulo 2^64 cannot tell apart: every operator that takes equal hashes for equal words must."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from llm import blocks as B
from llm import decontamination, line_dedup, near_dedup, pieces, quality_rules, token_blocks
from llm.queries import tokenizer_file
from llm.word_table import WordTable


def twins(n):
    """The Thue-Morse word of n letters and its complement: equal under any odd base."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(params=[1024, 2048])
def pair(request):
    return twins(request.param)


def test_they_are_equal_to_the_plain_hash(pair):
    block = next(B.blocks(pa.array(pair)))
    words = B.find_words(block.data, block.starts)
    assert len(set(B.word_hashes(block.data, words).tolist())) == 1
    assert len(set(B.keyed_hashes(block.data, words, b"k").tolist())) == 2


def test_ids_are_those_of_the_libraries(spark, pair):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    texts = [pair[0], pair[1], "x {} y {} x {}".format(*pair, pair[0])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tokenizer, path = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), tokenizer_file("piece_bpe_32k.model")
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    found = {r.doc_id: r.ids_crc32 for r in token_blocks.encoded(spark, df, tokenizer_file("word_bpe_49k.json")).collect()}
    assert found == {k: crc([*tokenizer.encode(t, add_special_tokens=False).ids, 1]) for k, t in enumerate(texts)}
    rows = {r.doc_id: r for r in pieces.round_trips(df, path).collect()}
    library = SentencePieceProcessor(model_file=path)
    assert all(rows[k].ids_crc32 == crc(library.encode(t)) and rows[k].round_trip for k, t in enumerate(texts))


def test_lines_and_windows_are_different(spark, pair):
    a, b = pair
    text = f"{a}\n{b}\nu v {a}\nu v {b}\n{a}\n"
    block = next(B.blocks(pa.array([text])))
    assert quality_rules.base_figures(block, B.find_words(block.data, block.starts))[0].tolist() == [9, 5 * len(a) + 4, 0, 1, 0]


def test_documents_do_not_link_and_lines_stay(spark, pair):
    tail = " ".join(f"w{k}" for k in range(3))
    df = spark.createDataFrame([(k, f"{tail} {w} end") for k, w in enumerate([*pair, pair[0]])], "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).orderBy("doc_id").collect()] == [(0, 0), (1, 1), (2, 0)]
    lines = spark.createDataFrame([(0, f"{pair[0]}\n{pair[1]}\n{pair[0]}")], "doc_id long, text string")
    assert [tuple(r) for r in line_dedup.removed_lines(lines).collect()] == [(0, 2)]


def test_items_are_not_found_in_their_twins(spark, pair):
    df = spark.createDataFrame([(0, f"end {pair[0]}. {pair[0]}"), (1, f"end {pair[1]}. {pair[1]}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, f"{pair[0]}. {pair[0]}")], "item_id long, text string")
    assert [r.doc_id for r in decontamination.contaminations(df, items).collect()] == [0]


def test_results_of_an_item_do_not_hang_on_the_longest(spark):
    question, answer = " ".join(f"q{k}" for k in range(20)), " ".join(f"a{k}" for k in range(10))
    words = lambda p, n: " ".join(f"{p}{k}" for k in range(n))
    df = spark.createDataFrame([(0, f"{question}. {words('x', 5000)} {answer}"), (1, f"{words('y', 300)} {question}. {answer}")], "doc_id long, text string")
    short = [(0, f"{question}. {answer}"), *((k, f"{words(f'i{k}', 20)}. {words(f'j{k}', 10)}") for k in range(1, 20))]
    longer = [*short, (99, f"{words('z', 5000)}. {words('zz', 10)}")]
    rows = [sorted((r.doc_id, r.item_id, r.question_overlap, r.answer_overlap) for r in decontamination.contaminations(df, spark.createDataFrame(x, "item_id long, text string")).collect()) for x in (short, longer)]
    assert rows[0] == rows[1] == [(1, 0, 1.0, 1.0)]


def test_a_full_table_of_words_starts_anew(monkeypatch):
    from llm import word_table

    monkeypatch.setattr(word_table, "MAX_WORDS", 4)
    table, asked = WordTable(), []

    def encode(words):
        asked.append(list(words))
        return np.concatenate([[len(w), ord(w[0])] for w in words]), np.full(len(words), 2)

    for text in ("a bb a", "ccc a dd", "e ff", "g h i j k l g"):
        block = next(B.blocks(pa.array([text])))
        ids, sizes = table.ids(block.data, B.find_words(block.data, block.starts), encode)
        assert ids.tolist() == [x for w in text.split() for x in (len(w), ord(w[0]))] and (sizes == 2).all()
    assert [sorted(x) for x in asked] == [["a", "bb"], ["ccc", "dd"], ["e", "ff"], ["g", "h", "i", "j", "k", "l"]]


def test_keyed_hashes_are_polynomials_at_a_secret_point(monkeypatch):
    texts = ["a bb ccc \x00 a\x00", "héllo " + "x" * 700, "y" * 64 + " " + "z" * 65]
    expected = None
    for piece in (1 << 20, 64):
        monkeypatch.setattr(B, "PIECE", piece)
        B._tables.clear()
        block = next(B.blocks(pa.array(texts)))
        found = B.keyed_hashes(block.data, B.find_words(block.data, block.starts), b"some key").tolist()
        base = B.key_number(b"some key")
        plain = [sum((c + 1) * pow(base, k, B.FIELD) for k, c in enumerate(w.encode())) % B.FIELD for t in texts for w in t.split(" ")]
        expected = B.mix(np.array(plain, np.uint64)).tolist()
        assert found == expected
    B._tables.clear()


def test_exact_grams_renumber_when_numbers_grow():
    codes, first = np.array([5, 1 << 40, 7, 5, 1 << 40, 7, 5, 1 << 40]), np.array([0, 3, 3, 8])
    grams, gram_first = B.exact_grams(codes, first, 3)
    assert gram_first.tolist() == [0, 1, 1, 4] and grams[0] == grams[1] and len(set(grams.tolist())) == 3


def test_limb_hashes_are_polynomials_of_limbs_and_length():
    texts = ["a", "abcd", "abcde\0", "abcde", "abcde\0\0", "é" * 16, "x" * 32, "x" * 33, "y" * 70]
    block = next(B.blocks(pa.array([" ".join(texts), "abcd"])))
    words = B.find_words(block.data, block.starts)
    found, base = B.limb_hashes(block.data, words, b"some key").tolist(), B.key_number(b"some key")
    limbs = lambda w: [int.from_bytes(w[k : k + B.LIMB], "little") for k in range(0, len(w), B.LIMB)]
    plain = [(len(w) + sum(x * pow(base, k, B.FIELD) for k, x in enumerate(limbs(w), 1))) % B.FIELD for w in (t.encode() for t in texts if len(t.encode()) <= B.LIMBED)]
    assert found[: len(plain)] == B.mix(np.array(plain, np.uint64)).tolist()
    assert found[len(texts)] == found[1] and len(set(found)) == len(texts)
    assert found[len(plain) :][:2] == B.keyed_hashes(block.data, words, b"some keylong")[len(plain) :][:2].tolist()
    assert len(B.limb_hashes(block.data[:0], B.find_words(block.data[:0], np.zeros(2, np.int64)), b"k")) == 0


def test_bytes_are_lowered_and_cut_as_by_tables():
    data = np.arange(256, dtype=np.uint8)
    assert B.lowered(data).tolist() == B.LOWER[data].tolist()
    for chosen in ([10], [32, 9, 10, 11, 12, 13], [], range(0, 256, 3)):
        space = np.zeros(256, bool)
        space[list(chosen)] = True
        words = B.find_words(data, np.array([0, 100, 256]), space)
        runs = [k for k in range(256) if not space[k] and (k in (0, 100) or space[k - 1])]
        assert words.begin.tolist() == runs and words.first.tolist() == [0, sum(k < 100 for k in runs), len(runs)]
