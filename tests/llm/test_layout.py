"""Shards, token alignment and source audit: against brute force, and their rows for nulls, ties, repeats and empty tables."""

import collections
import functools
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm import blocks as B
from llm import sharding, source_audit, token_alignment
from llm.queries import tokenizer_file

A, P = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_the_curve_visits_every_cell_in_steps_of_one(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def _cell(values, bits):
    key = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    return {v: sum(key(w) < key(v) for w in values) * (1 << bits) // len(values) for v in set(values)}


def test_shards_of_rows(spark, documents, rows, nothing):
    odd = documents.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(None, None, None, "ü"), (None, "x", "", None), (None, "x", "", None), (900, "y", "zz", "s")], "doc_id long, text string, lang string, source string"))
    df = sharding.measured(odd.withColumns({c: F.lit("other") for c in ("curve", "law", "shard", "slot", "size", "text_crc32", "n")}))
    found = sharding.sharded(df, 7, bits=4).collect()
    given = [(r.doc_id, r.text, r.lang, r.source) for r in odd.collect()]
    size = [8 + len((t or "").encode()) for _, t, _, _ in given]
    cells = [_cell(column, 4) for column in ([g[2] for g in given], [g[3] for g in given], size)]
    curve = sharding.hilbert_index(np.array([[cells[0][g[2]], cells[1][g[3]], cells[2][s]] for g, s in zip(given, size, strict=True)]), 4).tolist()
    expected = sorted((c, zlib.crc32((g[1] or "").encode()), (g[0] is not None, g[0]), s) for c, g, s in zip(curve, given, size, strict=True))
    got = sorted(found, key=lambda r: (r.shard, r.slot))
    assert [(r.curve, r.text_crc32, (r.doc_id is not None, r.doc_id), r["size"]) for r in got] == expected
    counts = collections.Counter(r.shard for r in found)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1 and {r.law for r in found} == {"rows"}
    for k in counts:
        assert sorted(r.slot for r in found if r.shard == k) == list(range(counts[k]))
    assert sharding.sharded(sharding.measured(nothing)).count() == 0


def test_one_value_in_every_row_does_not_join_shards(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    counts = sharding.sharded(sharding.measured(df), 24).groupBy("shard").count().collect()
    assert len(counts) == 24 and {r["count"] for r in counts} == {41, 42}


def test_a_manifest_lets_filters_skip_shards(spark, tmp_path):
    rows = [(k, "x" * (k * 37 % 3000), ("de", "en", "fr", "es")[k * 7 % 4], f"s{k * 13 % 20:02d}") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    listed = sharding.write_shards(df, str(tmp_path / "shards"), 32)
    stored = spark.read.parquet(str(tmp_path / "shards"))
    assert stored.count() == 4000 and {(r.doc_id, r.text) for r in stored.select("doc_id", "text").collect()} == {r[:2] for r in rows}
    kept = {}
    for dimension, low, high in (("lang", "de", "de"), ("source", "s03", "s04"), ("size", 100, 400), ("size", 2900, None)):
        hit = {r.shard for r in stored.where((F.col(dimension) >= low) & (F.col(dimension) <= high if high else F.lit(True))).select("shard").distinct().collect()}
        may = {r.shard for r in sharding.may_hold(listed, dimension, low, high).collect()}
        assert hit <= may
        kept[dimension] = len(may)
    assert kept["lang"] <= 16 and kept["source"] <= 16 and kept["size"] <= 20  # a sort by one of them would leave all 32 for the others


@functools.cache
def _libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=P)
    a.encode_special_tokens = True
    return a, b


def _aligned(text):
    """Groups [(ids of A, ids of B)] and links [(a, b)] of one text, token by token."""
    a, b = _libraries()
    signs = token_alignment.byte_characters()
    spelled = []
    encoded = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
    for i in encoded[0]:
        spelled.append(bytes(signs[c] for c in a.id_to_token(i)))
    pieces = [b.id_to_piece(i) for i in encoded[1]]
    other = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
    whole = (" " + (text or "")).encode()
    if not text or b"".join(spelled) != whole or b"".join(other) != whole:
        return [], []
    spans = [[(i, end - len(t), end) for i, t, end in zip(ids, tokens, itertools.accumulate(map(len, tokens)), strict=True)] for ids, tokens in zip(encoded, (spelled, other), strict=True)]
    cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups = [([i for i, s, e in spans[0] if low <= s and e <= high], [i for i, s, e in spans[1] if low <= s and e <= high]) for low, high in zip([0, *cuts[:-1]], cuts, strict=True)]
    # a token overlaps those that lie in its own group only
    links, at = [], [0, 0]
    for x, y in groups:
        here = [spans[k][at[k] : at[k] + len(g)] for k, g in enumerate((x, y))]
        at = [at[0] + len(x), at[1] + len(y)]
        links += [(i, j) for i, s, e in here[0] for j, s2, e2 in here[1] if s < e2 and s2 < e]
    return groups, links


TEXTS = ["<|endoftext|> and <s> </s> <unk>", "a▁b", "  two  spaces\n\n\ttab ", "日本語 한국어 🎉🎉 ünï \x07 zz", "it's don't 123,456.78", " ", "\n", "naïve café " * 30, "x" * 700, "ﬁ ① ﷺ é", "tab\x0bvt\x0cff nbsp\xa0x\x85y"]


@pytest.mark.parametrize("most", [token_alignment.PAIRS, 0])
def test_alignment_of_tokens(spark, documents, rows, nothing, most, monkeypatch):
    monkeypatch.setattr(token_alignment, "CHUNK", 3000)
    extra = spark.createDataFrame([(200 + k, t) for k, t in enumerate(TEXTS)] + [(None, "no id")], "doc_id long, text string")
    df = documents.select("doc_id", "text").where("doc_id <> 51 AND doc_id <> 53").union(extra)
    found = token_alignment.statistics(df, A, P, most=most).collect()
    given = [(r.doc_id, r.text) for r in df.collect()]
    known = {t: _aligned(t) for t in {t for _, t in given}}
    counts = collections.Counter(pair for _, t in given for pair in set(known[t][1]))
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    expected = []
    for i, t in given:
        groups, links = known[t]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        expected.append((str(i), sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    assert sorted((str(r[0]), *r[1:]) for r in found) == sorted(expected)
    assert token_alignment.statistics(nothing, A, P, most=most).count() == 0


def test_alignments_give_ids_and_groups(spark, documents):
    df = documents.where("doc_id < 12").withColumn("a_ids", F.lit("clash")).union(spark.createDataFrame([(201, TEXTS[1], "en", "s", 3, *["z"] * 9)], documents.withColumn("a_ids", F.lit("")).schema))
    found = token_alignment.alignments(df, A, P).collect()
    assert len(found) == df.count()
    for r in found:
        groups, _ = _aligned(r.text)
        cut = lambda ids, ends: [ids[low:high] for low, high in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        assert list(zip(cut(r.a_ids, r.a_ends), cut(r.b_ids, r.b_ends), strict=True)) == groups


def test_the_faster_library_gives_the_same_ids(rows):
    from tokenizers import Tokenizer

    with open(A, encoding="utf-8") as f:
        ours = token_alignment.ByteLevel(f.read())
    other = Tokenizer.from_file(A)
    other.encode_special_tokens = True
    texts = [t for _, t in rows if t] + TEXTS
    assert "tiktoken" in repr(ours.encode.__closure__[0].cell_contents.__self__.__class__) and ours.encode(texts) == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]


def _audit(rows, min_docs):
    """divergences() of rows (lang, source, text), pair by pair and term by term."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs = collections.Counter(t for r, w in zip(rows, terms, strict=True) if r[0] == lang for t in set(w))
        kept = [t for t, n in docs.items() if n >= min_docs]
        counts = {s: collections.Counter(t for r, w in zip(rows, terms, strict=True) if r[:2] == (lang, s) for t in w) for s in {r[1] for r in rows if r[0] == lang}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), collections.Counter()))
        for s in counts:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            marks = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, top in (("pair", pairs, None), ("term", marks, 50)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def test_divergence_of_sources(spark, nothing):
    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + k % 26)}{'é' * (k // 26)}" for k in range(90)]
    rows = []
    for k in range(400):
        lang, source = ("en", "en", "en", "de")[k % 4], f"s{min(k % 13, int(rng.integers(0, 13)))}"
        rows.append((lang, source, " ".join(rng.choice(words, 30, p=np.roll(np.arange(1, 91), k % 13) / 4095)) + ". THE the"))
    rows += [(None, None, None), (None, "x", ""), ("en", None, "the"), ("en", "empty", None), ("fr", "a", "un"), ("fr", "b", "deux"), *[rows[0]] * 3]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "lang string, source string, text string, term string, count string").repartition(3)
    assert sorted(tuple(r) for r in source_audit.divergences(df).collect()) == _audit(rows, 30)
    assert sorted(tuple(r) for r in source_audit.divergences(df, min_docs=1, top=50).collect()) == _audit(rows, 1)
    assert source_audit.divergences(nothing).count() == 0


def test_tiles_and_buckets_do_not_change_sums(spark):
    rng = np.random.default_rng(5)
    rows = [("en", f"s{k % 11}", " ".join("t" + chr(97 + c) for c in rng.integers(0, 26, 20))) for k in range(200)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    _, terms = source_audit.shares(df, min_docs=5)
    total = lambda x: {tuple(r)[:3]: r.value for r in x.groupBy("lang", "number", "other").agg(F.sum("value").alias("value")).where("value <> 0").collect()}
    assert total(source_audit._two_sided(terms, 4, 16)) == total(source_audit._two_sided(terms))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é\n"), max_size=12), max_size=6))
def test_codes_tell_words_apart(texts):
    block = next(iter(B.blocks(pa.array(texts, pa.string()))), None)
    if block is not None:
        words = B.find_words(block.data, block.starts)
        codes, found = B.word_codes(block.data, words)
        assert [found[c].as_py() for c in codes] == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
