"""Shards along a Hilbert curve: files whose rows are near each other in several metadata dimensions at once.

1. Every dimension is quantised to 2^BITS cells of equal share: the cell of a value is floor(rows with a smaller value *
   2^BITS / rows). Equal values share a cell; a value that holds many rows leaves the cells behind it empty.
2. The cells are coordinates of a point in a cube, and its place on the Hilbert curve through the cube is the row's index.
   Neighbours on the curve are neighbours in the cube, so a run of the curve spans a small range of *every* dimension.
3. Rows are sorted by index, and by the text's checksum and doc_id where it is equal, so that equal texts lie together. Shard
   k of n gets the ranks r with floor(r * n / rows) = k, and the slot is the rank in the shard.

The law is `rows`: the sizes of two shards differ by one row at most, whatever value is frequent: a cut may go through rows of
equal index, and through equal texts. A manifest of each shard's least and greatest values then tells a reader which files a
filter can skip.

Ranks come from a range-partitioned sort: rows of a range have their place in it, and places of earlier ranges are added.
Tasks hold no range; the driver holds a number for each range and at most 2^BITS values a dimension.

Defined results: null metadata is a value of its own before all others; a null text has size 8 and checksum 0; repeated rows are
rows of their own; an empty table gives no rows; columns of documents with names used here are dropped.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.tables import stored, workspace

BITS, SHARDS = 8, 24
DIMENSIONS = ("lang", "source", "size")


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points (rows, dimensions) with coordinates under 2^bits.

    From the highest bit down, the cube that holds a point is mirrored (where a coordinate's bit is set) or has two axes swapped
    (where it is not), which brings the curve inside it to the standard position; a Gray code then orders the sub-cubes.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    if n * bits > 62:
        raise ValueError("the index must fit 62 bits")
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for k in range(n):
            mirrored = (x[k] >> level & 1).astype(bool)
            swap = np.where(mirrored, 0, (x[0] ^ x[k]) & below)
            x[0] ^= np.where(mirrored, below, swap)
            x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            index = index << 1 | (x[k] >> level & 1)
    return index


def placed(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """df, stored, sorted by order over all ranges, with __range and __at, the place in it; and (__range, __n) of all ranges."""
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place)
    ranged = ranged.withColumn("__range", F.shiftright("__place", 33)).withColumn("__at", F.col("__place").bitwiseAND((1 << 33) - 1)).drop("__place")
    kept = stored(ranged, name)
    return kept, kept.groupBy("__range").agg(F.count("*").alias("__n"))


def _with_before(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """kept with __before, the sum of __n over earlier ranges: a number for each range goes through the driver."""
    found = sizes.orderBy("__range").collect()
    totals = np.cumsum([0, *(r["__n"] for r in found)]).tolist()
    known = kept.sparkSession.createDataFrame([(r["__range"], t) for r, t in zip(found, totals, strict=False)], "__range long, __before long")
    return kept.join(F.broadcast(known), "__range")


def cuts(df: DataFrame, dimension: str, rows: int, bits: int = BITS) -> list[tuple[object, int]]:
    """(value, cell), ascending: the first value of every cell that holds one; at most 2^bits of them."""
    values = df.groupBy(F.col(dimension).alias("value")).agg(F.count("*").alias("n"))
    kept, _ = placed(values, ["value"], "shard-values")
    kept = _with_before(kept, kept.groupBy("__range").agg(F.sum("n").alias("__n")))
    inside = F.sum("n").over(Window.partitionBy("__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    cell = F.expr(f"CAST(smaller * {1 << bits} DIV {max(rows, 1)} AS INT)")
    celled = kept.withColumn("smaller", F.coalesce(inside, F.lit(0)) + F.col("__before")).select("value", cell.alias("cell"))
    first = celled.groupBy("cell").agg(F.min(F.struct(F.col("value").isNotNull().alias("some"), "value")).alias("v")).select("cell", "v.value")
    return [(r["value"], r["cell"]) for r in first.orderBy("cell").collect()]


def with_curve(df: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """df with curve, each row's place on the Hilbert curve through its dimensions."""
    df = df.drop("curve")
    rows = df.count()
    known = [cuts(df, d, rows, bits) for d in dimensions]
    at = [df.columns.index(d) for d in dimensions]
    schema = T.StructType([*df.schema.fields, T.StructField("curve", T.LongType())])

    def per_batch(batches):
        for batch in batches:
            cells = np.zeros((batch.num_rows, len(at)), np.int64)
            for k, (c, cut) in enumerate(zip(at, known, strict=True)):
                coded = batch.column(c).dictionary_encode()
                some = [x for x in cut if x[0] is not None]
                keys = [v.encode() if isinstance(v, str) else v for v, _ in some]
                values = coded.dictionary.to_pylist()
                null = next((cell for v, cell in cut if v is None), 0)
                found = [([null] + [cell for _, cell in some])[bisect.bisect_right(keys, v.encode() if isinstance(v, str) else v)] for v in values]
                places = coded.indices.fill_null(len(found)).to_numpy(zero_copy_only=False)
                cells[:, k] = np.array([*found, null])[places]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_index(cells, bits))], schema.names)

    return df.mapInArrow(per_batch, schema)


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with size (bytes of the text and 8) and text_crc32."""
    documents = documents.drop("size", "text_crc32")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return documents.withColumn("size", F.octet_length(whole).cast("long") + 8).withColumn("text_crc32", F.crc32(whole.cast("binary")))


def sharded(df: DataFrame, n: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, ties: tuple[str, ...] = ("text_crc32", "doc_id")) -> DataFrame:
    """df with curve, law ('rows'), shard and slot. All columns move once, by the sort; df may be metadata alone or whole rows."""
    with workspace(df.sparkSession):
        rowed = with_curve(df.drop("law", "shard", "slot"), dimensions, bits)
        # rows that are equal in everything part by where they are read
        rowed = rowed.withColumn("__row", F.monotonically_increasing_id())
        kept, sizes = placed(rowed, ["curve", *ties, "__row"], "shard-rows")
        rows = kept.count()
        ranked = _with_before(kept, sizes).withColumn("__rank", F.col("__before") + F.col("__at"))
        shard = F.expr(f"CAST(__rank * {n} DIV {max(rows, 1)} AS INT)")
        begins = F.expr(f"(CAST(shard AS BIGINT) * {rows} + {n - 1}) DIV {n}")
        out = ranked.withColumn("law", F.lit("rows")).withColumn("shard", shard).withColumn("slot", F.col("__rank") - begins)
        return stored(out.drop("__row", "__range", "__at", "__rank", "__before"), "shards", keep=True)


def write_shards(documents: DataFrame, folder: str, n: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, text: str = "text") -> DataFrame:
    """Writes whole documents to folder/shard=k in the order of their slots, and returns the manifest."""
    with workspace(documents.sparkSession):
        rows = sharded(measured(documents, text), n, dimensions)
        rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
        return manifest(documents.sparkSession.read.schema(rows.schema).parquet(folder), dimensions)


def manifest(shards: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(shard, rows, bytes) and least_x, greatest_x and nulls_x of every dimension x: a row for each shard."""
    spans = [f(d).alias(f"{n}_{d}") for d in dimensions for f, n in ((F.min, "least"), (F.max, "greatest"), (lambda c: F.count_if(F.col(c).isNull()), "nulls"))]
    return shards.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *spans)


def may_hold(listed: DataFrame, dimension: str, low=None, high=None) -> DataFrame:
    """Rows of a manifest whose shard may hold a value from low to high, both included; None leaves a side open."""
    least, greatest = F.col(f"least_{dimension}"), F.col(f"greatest_{dimension}")
    return listed.where((greatest >= F.lit(low) if low is not None else F.lit(True)) & (least <= F.lit(high) if high is not None else F.lit(True)) & least.isNotNull())
