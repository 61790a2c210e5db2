"""Near-duplicate, line and substring dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import line_dedup, near_dedup, substring_dedup
from llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def linked(a, b, percent=75):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and linked(sets[a], sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(documents, rows):
    expected = brute_components(rows)
    found = near_dedup.near_duplicates(documents).collect()
    assert len(found) == len(rows)
    assert all((r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_copies_that_link_only_through_their_source(spark):
    """A source and copies that are near it, but not each other."""
    words = [f"w{k}" for k in range(200)]
    copy = lambda k: " ".join("x%d_%d" % (k, i) if i % 100 == 3 + k else w for i, w in enumerate(words))
    rows = [(k + 1, copy(k)) for k in range(40)] + [(99, " ".join(words))]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute_components(rows)
    assert all(r.component_id == expected[r.doc_id][1] for r in found) and len({r.component_id for r in found}) == 1


def test_one_of_each_group_stays(documents, rows):
    kept = near_dedup.keep_one(documents)
    assert kept.columns == documents.columns
    expected = brute_components(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in expected.items() if i == c)


def test_texts_of_one_id_stay_apart(spark):
    """Rows of one id with different texts: each has its own links, and its group is named by the least id in it."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (2, a + " x"), (9, b + " tail"), (7, c), (7, c), (8, c)]
    found = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(2, 2), (5, 2), (5, 5), (7, 7), (7, 7), (8, 7), (9, 5)]
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " tail")]
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 1, 3: 1}


def test_estimates_are_near_and_need_no_densification_bias():
    rng = np.random.default_rng(5)
    for size in (4, 12, 200):
        a = rng.integers(1, 1 << 63, (300, size), dtype=np.uint64)
        b = a.copy()
        b[:, : size // 4] = rng.integers(1, 1 << 63, (300, size // 4), dtype=np.uint64)
        flat = lambda x: near_dedup.sketches(np.sort(x, axis=1).ravel(), np.arange(301) * size)
        true = (size - size // 4) / (size + size // 4)
        assert near_dedup.estimated(flat(a), flat(b)).mean() == pytest.approx(true, abs=0.02)


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {r.component for r in components(edges).collect()} == {0}


def brute_lines(rows, percent=75, least=1):
    lines = []
    for i, text in sorted({r for r in rows}, key=lambda r: r[0]):
        number = 0
        for line in (text or "").split("\n"):
            if line:
                lines.append((i, number, frozenset(WORD.findall(line.translate(LOWER)))))
                number += 1
    removed = set()
    for k, (i, n, s) in enumerate(lines):
        if len(s) >= least and any(len(o) >= least and linked(s, o, percent) for *_, o in lines[:k]):
            removed.add((i, n))
    return removed


def test_removed_lines(documents, rows):
    found = {tuple(r) for r in line_dedup.removed_lines(documents).collect()}
    assert found == brute_lines(rows)


def test_lines_of_one_or_two_words(spark, documents, rows):
    found = {tuple(r) for r in line_dedup.removed_lines(documents).collect()}
    assert found == brute_lines(rows) and (4, 0) in found
    short = [(1, "Read more\nmenu\na b c\na b c d\n \t"), (2, "read MORE read\nMenu menu menu\nmore\n漢字漢字\nc b a"), (3, "more read\n漢字漢字\n漢字\nmenu more\nMore"), (None, "menu")]
    found = {tuple(r) for r in line_dedup.removed_lines(spark.createDataFrame(short, "doc_id long, text string")).collect()}
    assert found == brute_lines(short[:3], least=1) == {(1, 3), (2, 0), (2, 1), (2, 4), (3, 0), (3, 1), (3, 4)}


def test_words_are_told_apart_by_their_whole_hash():
    """Two words whose hashes agree in the KEY_BITS of a key, but not above."""
    low = np.uint64(12345)
    rarity = np.zeros(1 << line_dedup.RARITY_BITS, np.uint8)
    block = next(line_dedup.B.blocks(line_dedup.pa.array(["x y\nx"])))
    data = line_dedup.B.LOWER[block.data]
    words = line_dedup.B.find_words(data, block.starts)
    hashes = np.array([low, low | np.uint64(1 << 60), low])
    _, _, first, whole, _ = next(line_dedup.line_words(block, data, words, hashes, rarity))
    assert first.tolist() == [0, 2, 3] and set(whole[:2].tolist()) == set(hashes.tolist()) and whole[2] == low


def test_common_words_are_posted_as_pairs(spark, monkeypatch):
    """Lines made of few words, all of which count as common."""
    import random

    monkeypatch.setattr(line_dedup, "COMMON", 3)
    rng = random.Random(8)
    rows = [(k, "\n".join(" ".join(rng.sample([f"c{i}" for i in range(14)], rng.choice((3, 4, 5, 6, 8, 11)))) for _ in range(6))) for k in range(40)]
    found = {tuple(r) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = brute_lines(rows)
    assert found == expected and 20 < len(expected) < 220


def test_queries_judge_all_lines(spark, monkeypatch):
    import corpus_pipeline
    from llm import queries

    docs = spark.createDataFrame([(1, "Read more"), (2, "read more\nsome other text")], "doc_id long, text string")
    monkeypatch.setattr(queries, "read", lambda *_: docs)
    assert {(r.doc_id, r.n_removed) for r in queries.op7_line_dedup(spark, "").collect()} == {(1, 0), (2, 1)}
    assert {r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()} == {"Read more", "some other text"}


def test_figures_of_the_query(spark, documents, rows):
    """The registered columns against texts cut by hand."""
    removed = brute_lines(rows)
    cleaned = line_dedup.without_lines(documents.select("doc_id", "text"), line_dedup.removed_lines(documents), figures=True)
    found = cleaned.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("kept", F.lit("")).cast("binary")).alias("kept_md5")).collect()
    assert len(found) == len(rows)
    for r in found:
        text = dict(rows)[r.doc_id] or ""
        gone = {n for i, n in removed if i == r.doc_id}
        parts, number = [], 0
        for line in text.split("\n"):
            number += bool(line)
            if not line or number - 1 not in gone:
                parts.append(line)
        assert (r.n_lines, r.n_removed, r.kept_md5) == (number, len(gone), hashlib.md5("\n".join(parts).encode()).hexdigest())


def test_near_lines_in_a_large_group(spark):
    words = [f"v{k}" for k in range(24)]
    rows = [(k, " ".join(w if (i * 7 + k) % 24 > k % 5 else f"q{k}_{i}" for i, w in enumerate(words))) for k in range(60)]
    found = {tuple(r) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_lines(rows)


def test_long_lines(spark):
    """Lines of 40 to 400 words, some changed in up to a sixth of their words, that share a small vocabulary."""
    import random

    rng = random.Random(4)
    vocabulary = [f"t{k}" for k in range(1500)]
    lines = [rng.sample(vocabulary, rng.choice((40, 63, 64, 65, 100, 127, 128, 129, 130, 200, 400))) for _ in range(40)]
    for line in lines[:30]:
        changed = line[:]
        for k in rng.sample(range(len(line)), len(line) // rng.choice((4, 6, 7, 12, 30))):
            changed[k] = rng.choice(vocabulary)
        lines.append(changed[: len(changed) - rng.choice((0, 0, 2, len(line) // 10))])
    rows = [(k // 3, "\n".join(" ".join(line) for line in lines[k : k + 3])) for k in range(0, len(lines), 3)]
    found = {tuple(r) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = brute_lines(rows)
    assert found == expected and 10 < len(expected) < 30


def test_texts_without_their_lines(documents, rows):
    removed = brute_lines(rows)
    out = line_dedup.without_lines(documents, line_dedup.removed_lines(documents))
    assert out.columns == documents.columns and out.count() == len(rows)
    for r in out.collect():
        text = dict(rows)[r.doc_id]
        gone = {n for i, n in removed if i == r.doc_id}
        parts, number = [], 0
        for line in (text or "").split("\n"):
            number += bool(line)
            if not line or number - 1 not in gone:
                parts.append(line)
        assert r.text == ("\n".join(parts) if gone else text) and r.n_chars == (None if text is None else len(r.text))


def brute_spans(rows, length=100):
    out, seen = {}, set()
    for i, text in sorted({r for r in rows}, key=lambda r: r[0]):
        raw, new = (text or "").encode(), set()
        cover = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                cover[k : k + length] = b"\1" * length
            else:
                seen.add(raw[k : k + length])
                new.add(raw[k : k + length])
        left = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        out[i] = (len(raw), sum(cover), sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover)), hashlib.sha256(left).hexdigest())
    return out


def test_substrings(documents, rows):
    expected = brute_spans(rows)
    found = substring_dedup.without_spans(documents).collect()
    assert len(found) == len(rows) and all(tuple(r)[1:] == expected[r.doc_id] for r in found)


def test_repeated_rows_of_a_document_are_one(spark):
    """Rows that repeat as a whole, without any other copy, lose nothing; a copy under a later id is covered."""
    text, other = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(700)), "".join(chr(97 + (k * 31 + k // 5) % 26) for k in range(400))
    rows = [(4, text), (4, text), (6, other + text[100:400]), (5, "z" + other), (5, "z" + other)]
    found = {tuple(r) for r in substring_dedup.without_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == {(i, *x) for i, x in brute_spans(rows).items()}


def test_hot_anchors(spark, monkeypatch):
    """A passage of 60 to 140 bytes in ever new surroundings, whose anchors all count as hot."""
    import random

    monkeypatch.setattr(substring_dedup, "HOT", 2)
    monkeypatch.setattr(substring_dedup, "HELD_RUNS", 30)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = noise(140)
    rows = [(k, noise(rng.randrange(150)) + passage[: rng.choice((60, 99, 100, 120, 140))] + noise(rng.randrange(200))) for k in range(60)]
    for here in (1, 3, 256):
        monkeypatch.setattr(substring_dedup, "HOT_HERE", here)
        found = {tuple(r) for r in substring_dedup.without_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
        assert found == {(i, *x) for i, x in brute_spans(rows).items()}


def test_texts_without_their_spans(documents, rows):
    expected = brute_spans(rows)
    for r in substring_dedup.without_spans(documents, with_text=True).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == expected[r.doc_id][3] or "\ufffd" in r.kept_text


def test_interval_expansion_against_slices():
    rng = np.random.default_rng(3)
    for length in (2, 5, 12):
        texts = [rng.integers(0, 3, 80) for _ in range(4)]
        texts[2][:40] = texts[0][20:60]
        symbols = np.concatenate([np.append(t + 4, k) for k, t in enumerate(texts)])
        classes = substring_dedup.shared_prefix_classes(symbols, 4, length)
        first = np.cumsum([0] + [81] * 3)
        by = {}
        for k, t in enumerate(texts):
            for i in range(81 - length):
                by.setdefault(tuple(t[i : i + length]), set()).add(classes[first[k] + i])
        assert all(len(c) == 1 for c in by.values()) and len({next(iter(c)) for c in by.values()}) == len(by)


def test_empty_tables(nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0 and near_dedup.keep_one(nothing).count() == 0
    assert line_dedup.removed_lines(nothing).count() == 0 and line_dedup.without_lines(nothing, line_dedup.removed_lines(nothing)).count() == 0
    assert substring_dedup.without_spans(nothing).count() == 0


def test_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, None), (1, "a b c d e f")], "doc_id long, text string")
    assert near_dedup.near_duplicates(df).count() == 3 and near_dedup.keep_one(df).count() == 3
    assert line_dedup.without_lines(df, line_dedup.removed_lines(df)).count() == 3
    assert substring_dedup.without_spans(df).where("doc_id IS NULL").count() == 2


def test_lines_are_counted_with_and_without_empty_ones(spark):
    texts = ["", "\n", "a", "a\nb", "a\n\nb", "\na", "a\n", "\n\n\n", " \n ", "é\n𝒳\r\nb", None]
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", line_dedup.n_lines(F.col("text")).alias("n")).collect()
    assert {r.doc_id: r.n for r in found} == {k: sum(x != "" for x in (t or "").split("\n")) for k, t in enumerate(texts)}


def test_prefix_words_travel_as_bytes():
    """Lists of words are packed bytes: as arrays of integers they cost the JVM more than all else in a line's row."""
    assert line_dedup.LINES.split(", ")[-1] == "words binary"
    lists = line_dedup.pa.array([b"", np.array([1, -2], np.int32).tobytes(), b"", np.array([7], np.int32).tobytes()])
    for rows in (lists, lists[1:3], lists[:0]):
        batch = line_dedup.pa.RecordBatch.from_arrays([rows], ["words"])
        words, counts = line_dedup._prefix_words(batch)
        assert words.tolist() == [x for b in rows.to_pylist() for x in np.frombuffer(b, np.int32).tolist()] and counts.tolist() == [len(b) // 4 for b in rows.to_pylist()]
