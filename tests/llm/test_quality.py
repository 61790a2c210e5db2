"""Quality rules, quality classifier and decontamination."""

import collections
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import blocks as B
from llm import decontamination, quality_classifier, quality_rules
from llm.tables import read

DATA = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def small(spark):
    return read(spark, DATA, "documents"), read(spark, DATA, "labels")


def figures(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_figures(documents, rows, small):
    model = quality_rules.fit(*small, max_rows=200, steps=10)
    found = quality_rules.judge(documents, model).collect()
    assert len(found) == len(rows)
    for r in found:
        f = figures(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == f
        assert r.base_failed == (f[0] < 50 or 100 * f[4] > 50 * f[0]) and not (r.base_failed and r.kept)


def test_probabilities_against_ngrams_one_by_one(documents, rows, small):
    """The verdict from n-grams cut and hashed one at a time."""
    B = quality_rules.B
    model = quality_rules.fit(*small, max_rows=200, steps=10)
    shift = np.uint64(64 - quality_rules.BITS)

    def hashed(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return B.span_hashes(B.prefix_hashes(data), np.array([0]), np.array([len(data)]))

    def kinds(text):
        words = [hashed("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)) for w in WORD.findall(text)]
        yield [int(h[0] >> shift) for h in words]
        yield [int(B.mix(a * B.BASE + b)[0] >> shift) + (1 << quality_rules.BITS) for a, b in zip(words, words[1:], strict=False)]
        yield [int(hashed(text[k : k + 4])[0] >> shift) + (2 << quality_rules.BITS) for k in range(len(text) - 3)]

    found = {r.doc_id: r for r in quality_rules.judge(documents, model).collect()}
    for i, text in rows:
        if len(text or "") > 3000:
            continue
        raw = model.bias + sum(float(model.weights[k].astype(float).mean()) for k in kinds(text or "") if k)
        p = quality_rules.sigmoid(model.a * raw + model.b)
        assert found[i].probability == pytest.approx(p, abs=1e-9) and found[i].kept == (not found[i].base_failed and p >= quality_rules.KEEP_AT)


def test_rules_on_an_empty_table_and_clashing_names(spark, nothing, documents, small):
    model = quality_rules.fit(*small, max_rows=200, steps=5)
    assert quality_rules.judge(nothing, model).count() == 0
    clashing = small[0].withColumn("label", F.lit("z")).withColumn("indices", F.lit("z")).withColumn("quality", F.lit("z"))
    assert np.allclose(quality_rules.fit(clashing, small[1], max_rows=200, steps=5).weights, model.weights)


def test_rules_tell_good_from_bad(small):
    documents, labels = small
    out = quality_rules.judge(documents, quality_rules.fit(documents, labels)).join(labels, "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in out]) > 0.98
    good = [r.probability for r in out if r.quality]
    assert min(good) > quality_rules.KEEP_AT and np.mean(good) == pytest.approx(np.mean([r.quality for r in out]), abs=0.1)


def test_machine_on_rows_that_it_has_not_seen(small):
    documents, labels = small
    machine = quality_classifier.fit(documents, labels, metadata=("n_chars",), where=quality_classifier.fold() != 0)
    out = quality_classifier.score(documents, machine, metadata=("n_chars",)).join(labels, "doc_id").where(quality_classifier.fold() == 0).collect()
    assert len(out) > 40 and np.mean([(r.score >= quality_classifier.THRESHOLD) == bool(r.quality) for r in out]) > 0.97


def test_pairwise_identity():
    rng = np.random.default_rng(1)
    machine = quality_classifier.Machine(0.3, rng.normal(size=quality_classifier.DIM), rng.normal(size=(quality_classifier.DIM, quality_classifier.FACTORS)))
    index, value = rng.choice(quality_classifier.DIM, 9, False), rng.normal(size=9)
    direct = 0.3 + machine.linear[index] @ value + sum(machine.factors[index[i]] @ machine.factors[index[j]] * value[i] * value[j] for i in range(9) for j in range(i))
    assert quality_classifier.raw_scores(machine, np.array([0, 9]), index, value)[0][0] == pytest.approx(direct)


def test_scores_of_edge_texts(documents, rows, nothing, small):
    machine = quality_classifier.fit(*small, metadata=("n_chars",), max_rows=300)
    out = quality_classifier.score(documents, machine, metadata=("n_chars",)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 7}) == 1
    assert quality_classifier.keep(documents, machine, metadata=("n_chars",)).columns == documents.columns
    assert quality_classifier.score(nothing, machine, metadata=("n_chars",)).count() == 0


def test_without_labels_of_both_kinds(documents, small):
    none = small[1].limit(0)
    assert {round(r.score, 6) for r in quality_classifier.score(documents, quality_classifier.fit(documents, none)).collect()} == {0.5}
    assert {round(r.probability, 6) for r in quality_rules.judge(documents, quality_rules.fit(documents, none)).collect()} == {0.5}


def brute_scores(items, passage, index):
    """BM25 shares of every item for one passage, term by term."""
    out = np.zeros(len(items))
    for h in np.unique(passage):
        k = np.searchsorted(index.sorted_hashes, h)
        if k < len(index.sorted_hashes) and index.sorted_hashes[k] == h:
            t = index.sorted_terms[k]
            for key in range(index.block_first[t], index.block_first[t + 1]):
                for p in range(index.posting_first[key], index.posting_first[key + 1]):
                    out[index.posting_item[p]] += index.posting_impact[p]
    return out


def test_search_finds_all_that_full_scoring_finds(rows):
    texts = [t for _, t in rows if t and len(t) > 200]
    items = [(k, *decontamination.split_answer(" ".join(t.split()[5:30]))) for k, t in enumerate(texts)]
    index = decontamination.build_index(items)
    hashes, first = decontamination._tokens([t.lower() for t in texts])
    for threshold in (0.2, 0.5, 0.9):
        found = {(b, i): s for b, i, s in zip(*decontamination.search(index, hashes, first, threshold), strict=True)}
        half, expected = index.passage // 2, {}
        for a, b in zip(first[:-1], first[1:], strict=True):
            for k in range(max(1, -(-(b - a) // half) - 1)):
                begin = a + half * k
                scores = brute_scores(items, hashes[begin : min(begin + index.passage, b)], index)
                expected |= {(begin, i): s for i, s in enumerate(scores) if s >= threshold - 1e-9}
        assert found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k]) for k in found)


def test_planted_items(spark, documents, rows, nothing):
    base, long_text = dict(rows)[6], dict(rows)[51]
    items = [(1, " ".join(base.split()[20:60])), (2, "Nothing like it. At all, anywhere"), (3, None), (4, ""), (5, long_text[20_000:20_300].upper())]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminations(documents, table).collect()}
    assert {(6, 1), (7, 1), (8, 1), (50, 1), (51, 5)} <= found
    assert {i for _, i in found} == {1, 5} and not {9, 30, 31} & {d for d, _ in found}
    assert found == {(r.doc_id, r.item_id) for r in decontamination.contaminations(documents, table, slice_chars=150).collect()}
    left = decontamination.clean(documents, table)
    assert left.columns == documents.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in rows if i not in {d for d, _ in found})
    assert decontamination.contaminations(nothing, table).count() == 0 and decontamination.contaminations(documents, table.limit(0)).count() == 0


def test_a_question_without_its_answer_is_no_match(spark, rows):
    """An item whose question is much longer than its answer, so that both together reach any threshold without the answer."""
    words = dict(rows)[9].split()
    question, answer, other = " ".join(words[:30]), " ".join(words[40:46]), " ".join(words[60:110])
    table = spark.createDataFrame([(1, question, answer)], "item_id long, q string, a string")
    texts = [(1, f"{other} {question} {other}"), (2, f"{other} {question} {answer} {other}"), (3, f"{other} {answer} {other}"), (4, f"{question}. {answer}")]
    found = decontamination.contaminations(spark.createDataFrame(texts, "doc_id long, text string"), table, question=F.col("q"), answer=F.col("a"))
    assert sorted(r.doc_id for r in found.collect()) == [2, 4]
    whole = spark.createDataFrame([(1, f"{question}. {answer}")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.contaminations(spark.createDataFrame(texts, "doc_id long, text string"), whole).collect()) == [2, 4]


def test_items_against_every_passage(spark, rows):
    """The whole query against trying every item on every text: items that lie in a text, in part, or not at all."""
    texts = [(i, t) for i, t in rows if t and len(t) < 5000]
    sources = [t.split() for _, t in texts if len(t.split()) > 60]
    items = [(k, " ".join(w[10:30]) + ". " + " ".join(w[30:40])) for k, w in enumerate(sources)] + [(100 + k, " ".join(w[5:20]) + ". " + " ".join(reversed(w[20:30]))) for k, w in enumerate(sources)]
    grams = lambda words: {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
    tokens = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    expected = set()
    for d, t in texts:
        have = grams(tokens(t))
        for i, item in items:
            q, a = (tokens(x) for x in decontamination.split_answer(item))
            asked, answered = grams(q), grams(q[-2:] + a) - grams(q)
            if len(asked & have) >= 0.5 * len(asked) and len(answered & have) >= 0.5 * len(answered):
                expected.add((d, i))
    found = decontamination.contaminations(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), threshold=0.3)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected and len(expected) > 20


def test_question_and_answer_columns(spark, documents, rows):
    words = dict(rows)[9].split()
    table = spark.createDataFrame([(1, " ".join(words[:25]), " ".join(words[25:40]))], "item_id long, q string, a string")
    found = decontamination.contaminations(documents, table, question=F.col("q"), answer=F.col("a")).where("doc_id = 9").first()
    assert found.question_overlap == 1.0 and found.answer_overlap == 1.0


def _plain_features(text, n_chars):
    """Features of the classifier, counted one word, pair and line at a time: {feature: value}."""
    spaces = " \t\n\x0b\x0c\r"
    one_hash = lambda raw: B.word_hashes(np.frombuffer(raw, np.uint8), B.Words(np.array([0]), np.array([len(raw)]), np.array([0, 1])))[0]
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lower = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    raw, n, some = text.encode(), len(words), max(1, len(words))
    size = [len(w.encode()) for w in words]
    again = lambda x: len(x) - len(set(x))
    is_letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    letters, characters = max(1, sum(map(is_letter, raw))), max(1, sum(size))
    symbols = b"#*$%&|<>!@^~=+_\\{}[]"
    lines = [x for x in text.split("\n") if x]
    statistics = [
        np.log1p(n) / 8, sum(size) / some / 8, 1 - again(lower) / some, again(list(zip(lower, lower[1:], strict=False))) / some,
        sum(65 <= b <= 90 for b in raw) / letters, min(5 * sum(b in symbols for b in raw) / characters, 2), 5 * sum(48 <= b <= 57 for b in raw) / characters,
        min(5 * max(1, len(lines)) / some, 2), again(lines) / max(1, len(lines)), sum(len(w) == 1 and w.encode()[0] in symbols for w in words) / some, sum(map(is_letter, raw)) / characters,
    ]
    assert not any(c in spaces for w in words for c in w)
    out = collections.Counter()
    for w in lower:
        out[int(one_hash(w.encode())) >> 48] += 1 / n
    out = {k: [v] for k, v in out.items()} | {quality_classifier.BUCKETS + k: [v] for k, v in enumerate(statistics)}
    code = 63 if n_chars is None or n_chars < 0 else int(np.log2(n_chars + 1))
    own = int(B.mix(np.array([(code + int(B.BASE)) % (1 << 64)], np.uint64))[0]) % quality_classifier.BUCKETS
    out.setdefault(own, []).append(0.2)
    return out


def test_features_and_scores_against_words_one_by_one(spark, documents, rows):
    """Every feature of every edge text, and the machine's score by all pairs of features."""
    rng = np.random.default_rng(2)
    Q = quality_classifier
    machine = Q.Machine(-0.2, rng.normal(0, 0.5, Q.DIM).astype(np.float32), rng.normal(0, 0.3, (Q.DIM, Q.FACTORS)).astype(np.float32))
    texts = [(i, t) for i, t in rows if t is None or len(t) < 6000] + [(300, "A# b 1 1 1\n\nA# b\nA# b"), (301, "# # <\x00> ÄÖ Äö"), (302, "\n\n")]
    df = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in texts], "doc_id long, text string, n_chars long")
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in df.collect()], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64())]))
    expected = [_plain_features(t, None if t is None else len(t)) for _, t in texts]
    at = 0
    for starts, index, value in Q.features(batch, "text", ("n_chars",)):
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            found = {}
            for i, v in zip(index[a:b].tolist(), value[a:b].tolist(), strict=True):
                found.setdefault(i, []).append(v)
            assert found.keys() == expected[at].keys(), texts[at]
            assert all(sorted(found[i]) == pytest.approx(sorted(expected[at][i]), rel=1e-5, abs=1e-6) for i in found), texts[at]
            at += 1
    assert at == len(texts)
    scores = [r.score for r in Q.score(df.coalesce(1), machine, metadata=("n_chars",)).orderBy("doc_id").collect()]
    for s, (_, x) in zip(scores, sorted(zip((i for i, _ in texts), expected, strict=True), key=lambda p: p[0]), strict=True):
        index, value = (np.array(c) for c in zip(*((i, v) for i, vs in x.items() for v in vs), strict=True))
        gram = machine.factors[index].astype(float) @ machine.factors[index].T.astype(float) * np.outer(value, value)
        raw = machine.bias + machine.linear[index].astype(float) @ value + (gram.sum() - np.trace(gram)) / 2
        assert s == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-4)
