"""MinHash near-dedup on HyperMinHash sketches.

A document's set is its distinct SHINGLE-word shingles (A-Z lower-cased; with fewer words the whole sequence is the only
one; without words the set is empty and links with nothing). Every set hashes its members to BUCKETS buckets; a register
keeps the least hash of its bucket as a leading-zero count (6 bits) and the MANTISSA bits behind the leading one. Buckets
that no member reaches are filled from further hash passes, so that small sets have full sketches too and any register of
two sets agrees with the probability of their Jaccard similarity J.

1. Equal sets form classes by a 128-bit digest; from here on only a class's least document counts.
2. Registers are banded in ROWS; representatives that share a band meet. A band's members are compared with its hub, the
   member that meets most others over all bands, and not with each other: a group of near copies costs a few comparisons
   a member, and the text that the copies were made from, being nearest to all, is the hub of most of their bands.
3. Where a band holds several components after that, members of different components are compared too, on larger
   sketches and in blocks. With that no pair that shares a band is lost.
4. Before texts move, agreement of the registers, less its expected share of chance collisions, estimates J; pairs whose
   estimate lies MARGIN under the threshold go.
5. Links are confirmed on full sets, as 100 * intersection >= percent * union. Shingles are hashes of their words' hashes, which
   are keyed by a secret of the run: no text can be written to share them with another.

A link at exactly J = 0.75 shares no band with probability (1 - 0.75^4)^40 = 3e-7, at J = 0.8 with 1e-9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import blocks as B
from llm.components import components
from llm.tables import cut, groups, near, release, stored, with_rows, without_ids, workspace

SHINGLE, PERCENT = 5, 75
BUCKETS, ROWS, MANTISSA = 160, 4, 10
#: Six standard deviations of the share of agreeing registers at J = 0.75 and 160 registers, and at 1024.
MARGIN, FINE, FINE_MARGIN, BLOCK_ROWS = 0.2, 1024, 0.082, 2048
SIGNED = "doc_id long, text_hash long, n_shingles long, high long, low long, registers binary"
_VALUE_BITS = 40


def shingle_sets(block: B.Block, key: bytes = b"", n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct 64-bit shingle hashes of every text, and where each text's begin."""
    data = B.LOWER[block.data]
    words = B.find_words(data, block.starts)
    hashes = B.keyed_hashes(data, words, key)
    grams, first = B.ngram_hashes(hashes, words.first, n)
    doc = np.repeat(np.arange(block.rows), np.diff(first))
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            whole[has] = whole[has] * B.BASE + hashes[words.first[short[has]] + k]
        grams, doc = np.concatenate([grams, B.mix(whole ^ counts[short].astype(np.uint64))]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(block.rows + 1))


def sketches(sets: np.ndarray, first: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """HyperMinHash registers, (texts, buckets) of 16 bits: leading zeros above MANTISSA bits. Empty sets keep zeros."""
    n_docs = len(first) - 1
    out, filled = np.zeros((n_docs, buckets), np.uint16), np.zeros((n_docs, buckets), bool)
    open_docs = np.flatnonzero(np.diff(first))
    step = 0
    while len(open_docs):
        sizes = np.diff(first)[open_docs]
        local = np.concatenate([[0], np.cumsum(sizes)])
        h = sets[np.arange(local[-1]) + np.repeat(first[open_docs] - local[:-1], sizes)]
        h = B.mix(h + np.uint64(step * int(B.BASE) % (1 << 64)))
        bucket = (h >> np.uint64(_VALUE_BITS)) % np.uint64(buckets)
        value = h & np.uint64((1 << _VALUE_BITS) - 1)
        doc = np.repeat(np.arange(len(open_docs), dtype=np.uint64), sizes)
        cell = doc * np.uint64(buckets) + bucket
        for low in range(0, len(open_docs), 1 << 13):  # a cell number must fit above the value's bits
            part = slice(*local[[low, min(low + (1 << 13), len(open_docs))]])
            keys = np.sort(((cell[part] - np.uint64(low * buckets)) << np.uint64(_VALUE_BITS)) | value[part])
            cells = (keys >> np.uint64(_VALUE_BITS)).astype(np.int64)
            least = np.ones(len(keys), bool)
            least[1:] = cells[1:] != cells[:-1]
            cells, v = cells[least], (keys[least] & np.uint64((1 << _VALUE_BITS) - 1)).astype(np.float64)
            mantissa, exponent = np.frexp(np.maximum(v, 0.5))  # v = mantissa * 2^exponent, mantissa in [0.5, 1)
            register = ((_VALUE_BITS - exponent).astype(np.uint16) << MANTISSA) | ((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
            row, column = open_docs[low + cells // buckets], cells % buckets
            empty = ~filled[row, column]
            out[row[empty], column[empty]] = register[empty]
            filled[row[empty], column[empty]] = True
        open_docs = open_docs[~filled[open_docs].all(axis=1)]
        step += 1
    return out


def _chance(registers_a: np.ndarray, registers_b: np.ndarray) -> np.ndarray:
    """Share of registers that two disjoint sets are expected to agree in: equal leading zeros, then equal mantissas."""
    za, zb = registers_a >> MANTISSA, registers_b >> MANTISSA
    agree = np.zeros(len(za))
    for z in range(_VALUE_BITS + 2):
        agree += (za == z).mean(axis=1) * (zb == z).mean(axis=1)
    return agree / (1 << MANTISSA)


def estimated(registers_a: np.ndarray, registers_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of agreeing registers, without those that agree by chance."""
    share, chance = (registers_a == registers_b).mean(axis=1), _chance(registers_a, registers_b)
    return np.clip((share - chance) / (1 - chance), 0, 1)


def signatures(documents: DataFrame, text: str = "text", key: bytes = b"") -> DataFrame:
    """SIGNED: a hash of the text, set size, 128-bit digest of the set and registers of every row."""

    def per_batch(batches):
        for batch in batches:
            for block in B.blocks(batch.column(2)):
                sets, first = shingle_sets(block, key)
                registers = sketches(sets, first)
                total = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(np.stack([B.mix(sets ^ B.BASE), B.mix(sets + B.BASE)], axis=1), axis=0, dtype=np.uint64)])
                digest = (total[first[1:]] - total[first[:-1]]).view(np.int64)
                raw = [r.tobytes() for r in registers]
                columns = [*(batch.column(k).slice(block.first, block.rows) for k in range(2)), pa.array(np.diff(first)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "high", "low", "registers"])

    return documents.select("doc_id", F.xxhash64(text).alias("text_hash"), text).mapInArrow(B.trimmed(per_batch), SIGNED)


def _estimate_pairs(pairs: DataFrame) -> DataFrame:
    """a, b, estimate of pairs(a, b, registers_a, registers_b)."""

    def per_batch(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(estimated(a, b))], ["a", "b", "estimate"])

    return pairs.mapInArrow(B.trimmed(per_batch), "a long, b long, estimate double")


def _similarities(pairs: DataFrame, key: bytes) -> DataFrame:
    """a, b, both (size of the intersection), either (of the union) for pairs(a, b, text_a, text_b), on full sets."""

    def per_batch(batches):
        for batch in batches:
            sides = []
            for k in (2, 3):
                sides.append([(s, f) for block in B.blocks(batch.column(k)) for s, f in [shingle_sets(block, key)]])
            sets = [[s[f[i] : f[i + 1]] for s, f in side for i in range(len(f) - 1)] for side in sides]
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)], np.int64)
            either = np.array([len(x) + len(y) for x, y in zip(*sets, strict=True)], np.int64) - both
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both), pa.array(either)], ["a", "b", "both", "either"])

    return pairs.mapInArrow(B.trimmed(per_batch), "a long, b long, both long, either long")


def _texts(documents: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """(node, text) of each of nodes(node, doc_id, text_hash), a stored table."""
    found = with_rows(documents.select("doc_id", F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")), nodes, ["doc_id", "text_hash"], "3")
    return found.select("node", "text").dropDuplicates(["node"])


def with_nodes(classes: DataFrame) -> DataFrame:
    """classes, a stored table, with node: the doc_id of its representative where no other class has the same, else a hash.

    Ids repeat with different texts in faulty tables only; there each text is a node of its own.
    """
    shared = stored(classes.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id"), "near-dedup-repeated")
    if shared.isEmpty():
        return classes.withColumn("node", F.col("doc_id"))
    marked = classes.join(near(shared.withColumn("__shared", F.lit(True))), "doc_id", "left")
    return stored(marked.withColumn("node", F.when(F.col("__shared"), F.xxhash64("high", "low")).otherwise(F.col("doc_id"))).drop("__shared"), "near-dedup-nodes")


def _apart(rest: DataFrame, representatives: DataFrame, documents: DataFrame, text: str, percent: int, key: bytes) -> DataFrame:
    """Pairs (a, b) of different components in a band of rest(band, number, n, node, component) that may be similar enough.

    Members are compared on FINE registers, of which the low byte is kept, and whose error is FINE_MARGIN at most, in blocks
    of at most BLOCK_ROWS: each pair of a band's blocks is one group, so that no task holds more than two blocks of a band,
    whatever its size. A pair counts in the first band that it shares: in an earlier one it was compared with the hub.
    """

    def fine(batches):
        for batch in batches:
            for block in B.blocks(batch.column(1)):
                raw = [r.astype(np.uint8).tobytes() for r in sketches(*shingle_sets(block, key), FINE)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(raw, pa.binary())], ["node", "fine"])

    def group(rows):
        _, low_block, high_block, doc, component, side, number, coarse, fine = rows
        coarse = np.frombuffer(b"".join(coarse), np.uint64).reshape(len(doc), -1)  # a band is one integer
        fine = np.frombuffer(b"".join(fine), np.uint8).reshape(len(doc), -1)
        left, right = np.flatnonzero(side == low_block), np.flatnonzero(side == high_block)
        for low in range(0, len(left), 8):
            i, j = np.repeat(left[low : low + 8], len(right)), np.tile(right, len(left[low : low + 8]))
            ok = (component[i] != component[j]) & (doc[i] < doc[j] if low_block[0] == high_block[0] else doc[i] != doc[j])
            i, j = i[ok], j[ok]
            ok = (coarse[i] == coarse[j]).argmax(axis=1) == number[0]
            i, j = i[ok], j[ok]
            ok = (fine[i] == fine[j]).mean(axis=1) >= percent / 100 - FINE_MARGIN
            i, j = i[ok], j[ok]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[i], doc[j])), pa.array(np.maximum(doc[i], doc[j]))], ["a", "b"])

    def per_partition(batches):
        for rows in groups(batches, 3):
            yield from group(rows)

    wanted = stored(rest.select("node").distinct().join(representatives.select("node", "doc_id", "text_hash"), "node"), "near-dedup-wanted")
    sketched = stored(_texts(documents, wanted, text).mapInArrow(B.trimmed(fine), "node long, fine binary"), "near-dedup-fine")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    dealt = rest.withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("band", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "node", "component", "side", "number")
    dealt = dealt.join(representatives.select("node", "registers").join(sketched, "node"), "node").select("band", "low", "high", "node", "component", "side", "number", "registers", "fine")
    return dealt.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high").mapInArrow(B.trimmed(per_partition), "a long, b long").distinct()


def near_enough(pairs: DataFrame, representatives: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose estimate is not more than MARGIN under the threshold."""
    registers = representatives.select("node", "registers")
    sketched = pairs.join(registers.toDF("b", "registers_b"), "b").join(registers.toDF("a", "registers_a"), "a")
    guessed = _estimate_pairs(sketched.select("a", "b", "registers_a", "registers_b"))
    return guessed.where(F.col("estimate") >= percent / 100 - MARGIN).select("a", "b")


def links(pairs: DataFrame, representatives: DataFrame, documents: DataFrame, text: str, percent: int, key: bytes) -> DataFrame:
    """Those of pairs (a, b) of nodes that link, on full sets of the whole texts."""
    pairs = cut(pairs)
    ids = pairs.select(F.col("b").alias("node")).union(pairs.select(F.col("a").alias("node"))).distinct()
    wanted = stored(ids.join(representatives.select("node", "doc_id", "text_hash"), "node"), "near-dedup-linked")
    texts = stored(_texts(documents, wanted, text), "near-dedup-texts")
    joined = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    exact = _similarities(joined.select("a", "b", "text_a", "text_b"), key)
    result = stored(exact.where(100 * F.col("both") >= percent * F.col("either")).select("a", "b"), "near-dedup-links")
    release(documents.sparkSession)
    return result


def near_duplicates(documents: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of documents.

    component_id is the least doc_id that links reach. Rows with the same doc_id count as one document only where their
    texts are equal too; rows without doc_id get a null component and are kept.
    """
    with workspace(documents.sparkSession):
        key = B.drawn_key()  # equal hashes are taken for equal shingles, so texts must not be able to aim at them
        signed = stored(signatures(documents, text, key), "near-dedup-signatures")
        classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("high", "low").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_hash", "doc_id").alias("text_hash"), F.first("registers").alias("registers"))
        classes = with_nodes(stored(classes, "near-dedup-classes"))
        bands = classes.select("node", F.posexplode(F.expr(f"transform(sequence(0, {BUCKETS // ROWS - 1}), i -> xxhash64(i, substring(registers, 1 + {2 * ROWS} * i, {2 * ROWS})))")).alias("number", "band"))
        shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
        met = cut(bands.join(shared, "band"))
        reach = met.groupBy("node").agg(F.sum("n").alias("reach"))
        ranked = met.select("band", "number", "node").join(reach, "node")
        hubs = ranked.groupBy("band").agg(F.max(F.struct("reach", (-F.col("node")).alias("low"))).alias("top")).select("band", (-F.col("top.low")).alias("hub"))
        members = cut(ranked.select("band", "number", "node").join(hubs, "band"))
        stars = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        first = links(near_enough(stars, classes, percent), classes, documents, text, percent, key)
        found = components(first.select(F.col("a").alias("u"), F.col("b").alias("v")))
        # what a band still holds apart
        placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = placed.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n")).where("c0 < c1 AND n > 2").select("band", "n")
        rest = cut(placed.where("node <> hub").join(several, "band").select("band", "number", "n", "node", "component"))
        second = links(_apart(rest, classes, documents, text, percent, key), classes, documents, text, percent, key)
        found = components(first.unionByName(second).select(F.col("a").alias("u"), F.col("b").alias("v")))
        grouped = stored(classes.select("high", "low", "doc_id", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-dedup-grouped")
        least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        by_class = grouped.join(least, "component").select("high", "low", "component_id")
        rows = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "high", "low").join(by_class, ["high", "low"]).select("doc_id", "n_shingles", "component_id")
        rows = rows.unionByName(signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
        return stored(rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-dedup-rows", keep=True)


def keep_one(documents: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """documents, all columns, with one document of each group: the one of least doc_id. Of equal rows one stays."""
    with workspace(documents.sparkSession):
        rows = near_duplicates(documents, text, percent).where("doc_id IS NOT NULL")
        ids = rows.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1")
        ids = stored(ids.select("doc_id", (~F.col("kept")).alias("gone")), "near-dedup-gone", keep=True)
    return without_ids(documents, ids, repeated=["doc_id", text])
