"""Benchmark decontamination: a BM25 inverted index of test items, searched by every training passage with block-max WAND.

Index: terms are runs of letters and digits (lower case; all characters beyond ASCII count as letters). A posting holds a
term's BM25 impact on an item, divided by the score of the item's own text, so that a score is the share of an item's
BM25 mass that a passage has, from 0 to 1. Postings are cut into blocks of BLOCK neighbouring items with the largest
impact of each block.

Search: passages cover every whole text, each sharing half of its words with the next. They have the power of two of words
that holds the item, so that some passage has three quarters or more of any item that a text contains: items are indexed by
classes of length, each with passages of its own, and no item's results hang on how long others are. For all passages of an
Arrow batch at once:
 1. WAND pivot: a passage's terms in ascending order of their largest impact; as long as the running sum stays under the
    threshold, no item with only these terms can reach it. Passages whose whole sum stays under it end here.
 2. Only terms from the pivot on fetch blocks. A block stays if its block maxima for these terms, plus the running sum
    before the pivot, reach the threshold. The terms before the pivot follow from the largest impact down, a few at a
    time, each with its maximum in the block in place of its part of that sum; blocks go as soon as they fall short.
 3. Items of the blocks that stay are scored in full over all terms of the passage.
All items at or above the threshold are retrieved; none is capped. They are verified on the passage and the words around
it: shares of the question's and of the answer's distinct n-grams. Both must reach their thresholds; a side without n-grams
of its own counts as found. A question without its answer is no match, nor an answer without its question.

The index is sent to executors in slices of items with at most SLICE_CHARS characters of text, one pass of the documents
for each slice; document frequencies are those of all items, so that slicing changes no score.

Defined results: null and empty texts and items match nothing; an item without a separate answer takes its last sentence
as the answer (with one sentence, its last third); items of fewer than NGRAM words are compared as one n-gram; equal rows
give equal results, one for each doc_id and item_id.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm import blocks as B
from llm.tables import stored, without_ids

MIN_PASSAGE, BLOCK, NGRAM, GROUP_BITS, STEP = 32, 8, 3, 16, 3
K1, BETA = 1.2, 0.75
THRESHOLD, QUESTION, ANSWER = 0.5, 0.5, 0.5
SLICE_CHARS = 8 << 20
FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"
_APART = np.ones(256, bool)
_APART[48:58] = _APART[97:123] = _APART[128:] = False


class Index(NamedTuple):
    items: np.ndarray  # item ids
    passage: int  # words of a passage
    sorted_hashes: np.ndarray  # ascending hashes of the terms
    sorted_terms: np.ndarray  # their numbers
    group_first: np.ndarray  # where each value of the hashes' leading bits begins
    most: np.ndarray  # each term's largest impact, ascending: terms are numbered by it
    block_keys: np.ndarray  # ascending term * n_blocks + block
    block_most: np.ndarray
    block_first: np.ndarray  # of each term, into block_keys
    posting_first: np.ndarray  # of each block key, into postings
    posting_item: np.ndarray
    posting_impact: np.ndarray
    n_blocks: int
    grams: list[tuple[int, np.ndarray, np.ndarray]]  # of each item: n, n-grams of question and of answer


def _tokens(texts: list[str], secret: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of all texts and the first of each."""
    data, starts = B.text_buffers(pc.utf8_lower(pa.array(texts, pa.string())))
    words = B.find_words(data, starts, _APART)
    return B.keyed_hashes(data, words, secret), words.first


def grams_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return np.unique(B.ngram_hashes(hashes, np.array([0, len(hashes)]), n)[0]) if n and len(hashes) >= n else np.zeros(0, np.uint64)


def item_grams(question: np.ndarray, answer: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """n, the item's n-grams that end in the question, and those that end in the answer and are none of the others."""
    n = min(NGRAM, len(question) + len(answer))
    asked = grams_of(question, n)
    return n, asked, np.setdiff1d(grams_of(np.concatenate([question[len(question) - min(len(question), n - 1) :], answer]) if n > 1 else answer, n), asked)


def split_answer(text: str) -> tuple[str, str]:
    """(question, answer): all sentences but the last, and the last; of a single sentence its last third is the answer."""
    ends = [m.end() for m in re.finditer(r"[.!?]+(?=\s)", text.rstrip())]
    if ends:
        return text[: ends[-1]], text[ends[-1] :]
    words = text.split(" ")
    at = len(words) - len(words) // 3
    return " ".join(words[:at]), " ".join(words[at:])


def build_indexes(items: list[tuple[int, str, str]], frequency: dict[int, int] | None = None, n_items: int = 0, mean_length: float = 0.0, secret: bytes = b"") -> list[Index]:
    """An index for each class of length of (item_id, question, answer), with passages of its own: what is found of an item does not
    hang on how long others are. The figures are those of all items if this is a slice."""
    hashes, first = _tokens([f"{q} {a}" for _, q, a in items], secret)
    sizes = np.diff(first)
    if frequency is None:
        doc = np.repeat(np.arange(len(items)), sizes)
        terms, df = np.unique(np.unique(np.stack([hashes.view(np.int64), doc], axis=1), axis=0)[:, 0], return_counts=True)
        frequency = dict(zip(terms.tolist(), df.tolist(), strict=True))
    classes: dict[int, list[tuple[int, str, str]]] = {}
    for item, size in zip(items, sizes.tolist(), strict=True):
        classes.setdefault(1 << max(MIN_PASSAGE - 1, size - 1).bit_length(), []).append(item)
    whole = n_items or max(1, len(items)), mean_length or max(1.0, sizes.mean() if len(sizes) else 1.0)
    return [build_index(classes[passage], frequency, *whole, secret) for passage in sorted(classes)]


def build_index(items: list[tuple[int, str, str]], frequency: dict[int, int] | None = None, n_items: int = 0, mean_length: float = 0.0, secret: bytes = b"") -> Index:
    """Index of (item_id, question, answer), whose passages suit the longest of them."""
    hashes, first = _tokens([f"{q} {a}" for _, q, a in items], secret)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(items)), sizes)
    order = np.lexsort((doc, hashes))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h))).astype(float)
    h, d = h[at], d[at]
    terms, of, df = np.unique(h, return_inverse=True, return_counts=True)
    if frequency is not None:
        df = np.array([frequency[int(t)] for t in terms.view(np.int64)], float)
    n_items, mean_length = n_items or max(1, len(items)), mean_length or max(1.0, sizes.mean() if len(sizes) else 1.0)
    idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
    impact = idf[of] * tf * (K1 + 1) / (tf + K1 * (1 - BETA + BETA * sizes[d] / mean_length))
    own = np.bincount(d, impact, len(items))
    impact /= np.maximum(own[d], 1e-12)
    peaks = np.zeros(len(terms))
    np.maximum.at(peaks, of, impact)
    numbered = np.argsort(peaks, kind="stable")
    number = np.argsort(numbered)
    n_blocks = len(items) // BLOCK + 1
    key = number[of].astype(np.int64) * n_blocks + d // BLOCK
    order = np.argsort(key, kind="stable")
    key, d, impact = key[order], d[order], impact[order]
    keys, posting_first = np.unique(key, return_index=True)
    block_most = np.maximum.reduceat(impact, posting_first) if len(impact) else impact
    block_first = np.searchsorted(keys // n_blocks, np.arange(len(terms) + 1))
    group_first = np.searchsorted((terms >> np.uint64(64 - GROUP_BITS)).astype(np.int64), np.arange((1 << GROUP_BITS) + 1))
    passage = 1 << max(MIN_PASSAGE - 1, int(sizes.max(initial=1)) - 1).bit_length()
    grams = []
    for _, question, answer in items:
        (qh, _), (ah, _) = _tokens([question], secret), _tokens([answer], secret)
        grams.append(item_grams(qh, ah))
    return Index(np.array([i for i, _, _ in items], np.int64), passage, terms, number, group_first, peaks[numbered], keys, block_most, block_first, np.append(posting_first, len(d)), d, impact, n_blocks, grams)


def _expand(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of a table of runs: which of them each member of their runs belongs to, and the member's place."""
    n = first[rows + 1] - first[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    return owner, np.arange(n.sum()) + np.repeat(first[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(rows) else np.zeros(0, np.int64)


def _lookup(index: Index, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes that are terms, and their terms. Terms are grouped by leading bits: most words end there."""
    group = (hashes >> np.uint64(64 - GROUP_BITS)).astype(np.int64)
    at = index.group_first[group]
    n = index.group_first[group + 1] - at
    places, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = np.flatnonzero(n)
    k = 0
    while len(left):
        place = at[left] + k
        hit = index.sorted_hashes[place] == hashes[left]
        places.append(left[hit])
        terms.append(index.sorted_terms[place[hit]])
        k += 1
        left = left[~hit & (n[left] > k)]
    return np.concatenate(places), np.concatenate(terms)


def _find(index: Index, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in block_keys of those keys that are there, and a mask of these."""
    k = np.minimum(np.searchsorted(index.block_keys, keys), len(index.block_keys) - 1)
    hit = index.block_keys[k] == keys
    return k[hit], hit


def search(index: Index, hashes: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of passage, item, score) of all passages of texts, given by word hashes, that reach the threshold."""
    none, n_terms, half = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), len(index.most), index.passage // 2
    at, term = _lookup(index, hashes) if n_terms else none[:2]
    if not len(at):
        return none
    # halves of passages: text d has halves h0[d] onwards, and its passage k is made of its halves k and k + 1
    sizes = np.diff(first)
    halves = -(-sizes // half)
    passages = np.maximum(halves - 1, halves > 0)
    h0, p0 = np.cumsum(halves) - halves, np.cumsum(passages) - passages
    doc = np.searchsorted(first, at, "right") - 1
    key = B.distinct((h0[doc] + (at - first[doc]) // half) * n_terms + term)
    h, term = key // n_terms, key % n_terms
    doc = np.repeat(np.arange(len(sizes)), halves)[h]
    k = h - h0[doc]
    key = B.distinct(np.concatenate([((p0[doc] + j) * n_terms + term)[(j >= 0) & (j < passages[doc])] for j in (k, k - 1)]))
    passage, term = key // n_terms, key % n_terms  # a passage's terms ascend by their largest impact, as they are numbered so
    total = np.concatenate([[0], np.cumsum(index.most[term])])
    p_first = np.searchsorted(passage, np.arange(passages.sum() + 1))
    start = total[p_first[:-1]]
    essential = np.flatnonzero(total[1:] - start[passage] >= threshold - 1e-9)
    if not len(essential):
        return none
    pivot = np.full(len(start), -1)
    pivot[passage[essential[::-1]]] = essential[::-1]
    before = np.where(pivot >= 0, total[pivot] - start, 0)
    # blocks of the terms from the pivot on
    owner, place = _expand(index.block_first, term[essential])
    key = passage[essential][owner] * np.int64(index.n_blocks) + index.block_keys[place] % index.n_blocks
    order = np.argsort(key)
    key, most = key[order], index.block_most[place][order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    pair, reach = key[head], np.add.reduceat(most, head)
    live = reach + before[pair // index.n_blocks] >= threshold - 1e-9
    pair, reach = pair[live], reach[live]
    # terms before the pivot, the largest impacts first: their block maxima take the place of their largest impacts
    p, block = pair // index.n_blocks, pair % index.n_blocks
    place = pivot[p]
    while len(going := np.flatnonzero(place > p_first[p])):
        for _ in range(STEP):
            going = going[place[going] > p_first[p[going]]]
            place[going] -= 1
            k, hit = _find(index, term[place[going]] * np.int64(index.n_blocks) + block[going])
            reach[going[hit]] += index.block_most[k]
        live = reach + total[place] - start[p] >= threshold - 1e-9
        p, block, place, reach = p[live], block[live], place[live], reach[live]
    # full scores of the blocks that stay
    owner, place = _expand(p_first, p)
    k, hit = _find(index, term[place] * np.int64(index.n_blocks) + block[owner])
    owner = owner[hit]
    post_owner, post = _expand(index.posting_first, k)
    item = index.posting_item[post]
    cell = owner[post_owner] * BLOCK + item % BLOCK
    score = np.bincount(cell, index.posting_impact[post], len(p) * BLOCK)
    good = np.flatnonzero(score >= threshold - 1e-9)
    found = p[good // BLOCK]
    doc = np.searchsorted(p0, found, "right") - 1
    while (empty := passages[doc] == 0).any():
        doc = doc - empty
    return first[doc] + half * (found - p0[doc]), block[good // BLOCK] * BLOCK + good % BLOCK, score[good]


def _searched(documents: DataFrame, shared: Broadcast, text: str, threshold: float, secret: bytes) -> DataFrame:
    def per_batch(batches):
        for batch in batches:
            out = []
            ids = batch.column(0)
            for block in B.blocks(pc.utf8_lower(batch.column(1).cast(pa.string()))):
                words = B.find_words(block.data, block.starts, _APART)
                hashes = B.keyed_hashes(block.data, words, secret)
                found: dict[tuple[int, int], tuple[float, float, float, float]] = {}
                for index in shared.value:
                    for begin, item, score in zip(*search(index, hashes, words.first, threshold), strict=True):
                        doc = int(np.searchsorted(words.first, begin, "right")) - 1
                        n, question, answer = index.grams[item]
                        around = grams_of(hashes[max(begin - index.passage, words.first[doc]) : min(begin + 2 * index.passage, words.first[doc + 1])], n)
                        shares = [np.isin(g, around, assume_unique=True).sum() for g in (question, answer)]
                        parts = [s / len(g) if len(g) else 1.0 for s, g in zip(shares, (question, answer), strict=True)]
                        now = (score, *parts, sum(shares) / max(1, len(question) + len(answer)))
                        at = doc, int(index.items[item])
                        found[at] = max(found.get(at, now), now, key=lambda x: (min(x[1], x[2]), *x[::-1]))
                out += [(ids[block.first + doc].as_py(), item, *map(float, x)) for (doc, item), x in found.items()]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(columns)], [x.split()[0] for x in FOUND.split(", ")])

    return documents.select("doc_id", text).mapInArrow(B.trimmed(per_batch), FOUND)


def _term_rows(secret: bytes):
    def per_batch(batches):
        for batch in batches:
            hashes, first = _tokens([x or "" for x in batch.column(0).to_pylist()], secret)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            pairs = np.unique(np.stack([doc.astype(np.int64), hashes.view(np.int64)], axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].copy())], ["term"])

    return per_batch


def contaminations(documents: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", question: Column | None = None, answer: Column | None = None, threshold: float = THRESHOLD, question_share: float = QUESTION, answer_share: float = ANSWER, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """FOUND for every document and item whose passages reach the threshold and hold these shares of the question's and of the answer's n-grams.

    items has item_id and either item_text or columns for question and answer.
    """
    whole = F.concat_ws(" ", question, answer) if question is not None else F.coalesce(F.col(item_text), F.lit(""))
    parts = items.select("item_id", whole.alias("whole"), *([question.alias("question"), answer.alias("answer")] if question is not None else []))
    n_words = F.size(F.split("whole", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))
    n, chars, words = parts.agg(F.count("*"), F.coalesce(F.sum(F.length("whole")), F.lit(0)), F.coalesce(F.avg(n_words), F.lit(0.0))).first()
    slices = max(1, -(-chars // slice_chars))
    found, secret = None, B.drawn_key()  # equal hashes are taken for equal words
    for k in range(slices):
        rows = parts.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k) if slices > 1 else parts
        listed = [(r[0], r[2] or "", r[3] or "") if question is not None else (r[0], *split_answer(r[1])) for r in rows.where("item_id IS NOT NULL").orderBy("item_id").collect()]
        frequency = None
        if slices > 1:
            term = lambda df: df.select("whole").mapInArrow(_term_rows(secret), "term long")
            frequency = {r[0]: r[1] for r in term(parts).groupBy("term").count().join(term(rows).distinct(), "term").collect()}
        shared = documents.sparkSession.sparkContext.broadcast(build_indexes(listed, frequency, n, words, secret))
        part = _searched(documents, shared, text, threshold, secret).where((F.col("question_overlap") >= question_share) & (F.col("answer_overlap") >= answer_share))
        if slices > 1:  # one slice's index at a time
            part = stored(part, "decontamination-slice")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct(F.least("question_overlap", "answer_overlap").alias("both"), "overlap", "score", "question_overlap", "answer_overlap")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.question_overlap", "best.answer_overlap", "best.overlap")


def clean(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of documents, all columns, that no item contaminates."""
    tainted = stored(contaminations(documents, items, **options).select("doc_id").distinct(), "contaminated")
    return without_ids(documents, tainted)
