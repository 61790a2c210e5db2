"""How far the sources of a language differ in their words: distances of all pairs, and the words that mark each source.

Terms are maximal runs of ASCII letters and of characters beyond ASCII, with A-Z lower-cased and nothing else. A language keeps
the V terms in at least MIN_DOCS of its documents. A group (lang, source) gives a kept term that occurs c times in it, of N
occurrences of kept terms, the share p = 1 + floor(UNIT * (c + SMOOTH) / (N + SMOOTH * V)), so that absent terms share one
baseline. All arithmetic is on integers.

The distance of two groups is the sum of f = |p - q| over all kept terms. It is not computed term by term:

1. Every pair starts with V times f of two zero counts.
2. Each group's own terms correct it as if the other group had none: the group's terms are taken together by count, and those
   whose share lies above every baseline of the language as one sum.
3. The inverted index, term to the sources that hold it, gives what is left where *both* hold a term. Sources are tiled, and
   a task takes one pair of tiles and a bucket of terms, and adds up the corrections of pairs that meet there.

What moves between tasks are counts of (lang, source, term) and, for each tile pair and bucket, one row a pair of sources.
Terms that mark a source are ranked by a window whose filter Spark applies before it shuffles.

Defined results: a null text, lang or source counts as ''; repeated rows are documents of their own; a group without terms
takes part in all pairs; a lang with V = 0 has pairs of value 0 and no terms; an empty table gives no rows. Sums stay under
2^63 for up to 9 * 10^9 kept terms of a language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm import blocks as B
from llm.tables import groups, near, stored, workspace

MIN_DOCS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Sources of a tile; postings of a bucket of terms, or as many as a tile has pairs where that is more; rows that a task gathers
#: before it adds up.
TILE, BUCKET_ROWS, HELD_ROWS = 256, 1 << 14, 1 << 19
_APART = np.ones(256, bool)
_APART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
COUNTS = "lang string, source string, term string, count long, docs long"


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """COUNTS of one batch of (lang, source, text)."""
    sides = [batch.column(k).dictionary_encode() for k in range(2)]
    lang, source = (s.indices.to_numpy(zero_copy_only=False).astype(np.int64) for s in sides)
    parts = []
    for block in B.blocks(batch.column(2)):
        words = B.find_words(block.data, block.starts, _APART)
        codes, terms = B.word_codes(B.LOWER[block.data], words)
        per_doc, count = np.unique(words.docs() * len(terms) + codes, return_counts=True)
        doc, code = per_doc // max(len(terms), 1) + block.first, per_doc % max(len(terms), 1)
        group, place = np.unique((lang[doc] * len(sides[1].dictionary) + source[doc]) * len(terms) + code, return_inverse=True)
        code, group = group % max(len(terms), 1), group // max(len(terms), 1)
        at = [group // max(len(sides[1].dictionary), 1), group % max(len(sides[1].dictionary), 1)]
        sums = np.bincount(place, count, len(group)).astype(np.int64), np.bincount(place, minlength=len(group))
        parts.append(pa.table([sides[0].dictionary.take(at[0]), sides[1].dictionary.take(at[1]), terms.take(code), *map(pa.array, sums)], ["lang", "source", "term", "count", "docs"]))
    return pa.concat_tables(parts)


def term_counts(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """COUNTS of documents: occurrences of each term in each group, and documents that hold it."""

    def per_task(batches):
        held: list[pa.Table] = []
        rows = 0

        def summed() -> pa.Table:
            whole = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("count", "sum"), ("docs", "sum")])
            return whole.select(["lang", "source", "term", "count_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "count", "docs"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_counted(batch))
            rows += held[-1].num_rows
            if rows > HELD_ROWS:
                held = [summed()]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held[0].to_batches(max_chunksize=1 << 14)
                    held, rows = [], 0
        if held:
            yield from summed().to_batches(max_chunksize=1 << 14)

    named = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    return named.mapInArrow(per_task, COUNTS).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _share(count, total, kept):
    """p of a count, exact in decimals of 38 digits."""
    return F.expr(f"CAST(1 AS BIGINT) + CAST((CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + {SMOOTH} AS DECIMAL(19,0))) DIV ({total} + {SMOOTH} * {kept}) AS BIGINT)")


def shares(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, terms), stored tables: (lang, source, n, v, p0), one row a group, and (lang, source, term, count, p, p0, q), one
    row a kept term of a group that holds it; q is the language's share."""
    counts = stored(term_counts(documents, text, lang, source), "audit-counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("count").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "all")
    kept = stored(counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "count", "all"), "audit-kept")
    sizes = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("count").alias("n_all"))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    named = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source")))).distinct()
    found = named.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["n", "v", "n_all"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    found = stored(found.withColumn("number", number).withColumn("p0", F.when(F.col("v") > 0, _share("0", "n", "v")).otherwise(0)), "audit-groups")
    placed = kept.join(near(found), ["lang", "source"])
    terms = placed.select("lang", "source", "number", "term", "count", _share("count", "n", "v").alias("p"), "p0", _share("all", "n_all", "v").alias("q"))
    return found, stored(terms, "audit-terms")


def _one_sided(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, number, other, value): corrections by each group's own terms, as if the other had none of them."""
    highest = found.groupBy("lang").agg(F.max("p0").alias("top"))
    counts = terms.groupBy("lang", "number", "p0", "p").agg(F.count("*").alias("n")).join(highest, "lang")
    above = F.col("p") >= F.col("top")
    linear = counts.where(above).groupBy("lang", "number", "p0").agg(F.sum(F.col("n") * F.col("p")).alias("p"), F.sum("n").alias("n"))
    other = found.select("lang", F.col("number").alias("other"), F.col("p0").alias("o0"))
    base = F.col("n") * F.abs(F.col("p0") - F.col("o0"))
    met = linear.join(other, "lang").where("number <> other").select("lang", "number", "other", (F.col("p") - F.col("n") * F.col("o0") - base).alias("value"))
    rest = counts.where(~above).join(other, "lang").where("number <> other")
    return met.unionByName(rest.groupBy("lang", "number", "other").agg(F.sum(F.col("n") * F.abs(F.col("p") - F.col("o0")) - base).alias("value")))


def _corrections(term: np.ndarray, number: np.ndarray, p: np.ndarray, p0: np.ndarray, tiles: tuple[int, int], tile: int) -> tuple[np.ndarray, ...]:
    """(number, other, value) with number < other, added up over postings that are sorted by term; number lies in the first of the
    tiles and other in the second."""
    order = np.lexsort((number, term))
    term, number, p, p0 = (x[order] for x in (term, number, p, p0))
    begins = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    sizes = np.diff(np.append(begins, len(term)))
    ahead = np.repeat(begins + sizes, sizes) - np.arange(len(term)) - 1  # postings of the same term behind each
    total = np.zeros(tile * tile, np.int64)
    ends = np.concatenate([[0], np.cumsum(ahead)])
    low = 0
    while low < len(term):  # pairs of at most about 2^20, or of one posting
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + (1 << 20), "right")) - 1)
        i = np.repeat(np.arange(low, high), ahead[low:high])
        j = i + 1 + np.arange(len(i)) - np.repeat(ends[low:high] - ends[low], ahead[low:high])
        ok = (number[i] // tile == tiles[0]) & (number[j] // tile == tiles[1])
        i, j = i[ok], j[ok]
        value = np.abs(p[i] - p[j]) - np.abs(p[i] - p0[j]) - np.abs(p0[i] - p[j]) + np.abs(p0[i] - p0[j])
        cell = number[i] % tile * tile + number[j] % tile
        # doubles are exact here: at most 2^20 values under 2^32
        total += np.bincount(cell, value, tile * tile).astype(np.int64)
        low = high
    cell = np.flatnonzero(total)
    return tiles[0] * tile + cell // tile, tiles[1] * tile + cell % tile, total[cell]


def _two_sided(terms: DataFrame, tile: int = TILE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(lang, number, other, value) with number < other: corrections where both hold a term, from the inverted index."""
    sized = terms.groupBy("lang").agg(F.count("*").alias("rows"), F.max("number").alias("last"))
    dealt = terms.join(sized, "lang").select(
        "lang", F.xxhash64("term").alias("key"), "number", "p", "p0", F.floor(F.col("number") / tile).cast("int").alias("tile"), F.floor(F.col("last") / tile).cast("int").alias("tiles"),
        F.pmod(F.xxhash64("term", F.lit(1)), F.ceil(F.col("rows") / F.greatest(F.lit(bucket_rows), F.pow(F.least(F.col("last") + 1, F.lit(tile)), F.lit(2))))).cast("int").alias("bucket"), "term",
    )
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles"))))
    dealt = dealt.select("bucket", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), F.xxhash64("lang").alias("of"), "number", "p", "p0", "lang", "term")

    def per_partition(batches):
        for _, low, high, _, number, p, p0, lang, term in groups(batches, 4):
            # names of equal hash are told apart; a group has as many languages as share one, as a rule a single one
            names = np.array(lang, object)
            codes = pa.array(term).dictionary_encode().indices.to_numpy()
            for name in dict.fromkeys(lang):
                mine = np.flatnonzero(names == name)
                i, j, value = _corrections(codes[mine], number[mine].astype(np.int64), p[mine], p0[mine], (int(low[0]), int(high[0])), tile)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(value)], ["lang", "number", "other", "value"])

    keys = ["bucket", "low", "high", "of"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(per_partition, "lang string, number int, other int, value long")


def divergences(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank). Part 'pair': item is another source of the lang, value their distance, all ranks.
    Part 'term': item is a kept term that the group holds with p > q, value p - q, ranks to `top`."""
    with workspace(documents.sparkSession):
        found, terms = shares(documents, text, lang, source, min_docs)
        mine = found.select("lang", "source", "number", "v", "p0")
        other = found.select("lang", F.col("source").alias("item"), F.col("number").alias("other"), F.col("p0").alias("o0"))
        baseline = mine.join(other, "lang").where("number <> other").select("lang", "source", "item", "number", "other", (F.col("v") * F.abs(F.col("p0") - F.col("o0"))).alias("value"))
        both_ways = lambda df: df.unionByName(df.select("lang", F.col("other").alias("number"), F.col("number").alias("other"), "value"))
        moved = both_ways(_one_sided(found, terms)).unionByName(both_ways(_two_sided(terms))).groupBy("lang", "number", "other").agg(F.sum("value").alias("moved"))
        pairs = baseline.join(moved, ["lang", "number", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + F.coalesce("moved", F.lit(0))).alias("value"))
        marks = terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        result = pairs.withColumn("rank", rank).unionByName(marks.withColumn("rank", rank).where(F.col("rank") <= top))
        return stored(result, "audit-rows", keep=True)
