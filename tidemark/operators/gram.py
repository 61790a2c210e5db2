"""Matrices over all pairs of many series, by tiles: sums of products over equal times as matrix products.

Series are dealt to tiles by hash, and times to buckets. A task takes a pair of tiles (upper half only) and a bucket of times, lays the
values out as arrays (times, series), and multiplies. Spark adds the sums of the buckets up. A row is repeated once for each
tile of series, not for each series, and no pair of rows is ever formed.

Sums are those of a join on equal times: repeated rows of a series at a time count as often as they would there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scans

#: Series of a tile, rows of one side of a task, and times that are laid out at once.
TILE, SIDE_ROWS, TIMES = 512, 1 << 17, 2048


def _dealt(df: DataFrame, on: str, key: str, tile: int, side_rows: int) -> DataFrame:
    """(low, high, bucket, side, key, on, value) rows for each pair of tiles; rows without a key or a time meet nothing."""
    df = df.where(F.col(key).isNotNull() & F.col(on).isNotNull())
    series, rows = df.agg(F.count_distinct(key), F.count("*")).first()
    tiles = max(1, -(-series // tile))
    buckets = max(1, -(-rows // (tiles * side_rows)))
    mine = F.pmod(F.xxhash64(key), F.lit(tiles)).cast("int")
    placed = df.withColumn("__tile", mine).withColumn("__bucket", F.pmod(F.xxhash64(on), F.lit(buckets)).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    return placed.withColumn("__low", F.least("__tile", "__other")).withColumn("__high", F.greatest("__tile", "__other")).drop("__other")


def _layers(rows: pd.DataFrame, times: np.ndarray, series: np.ndarray, n: tuple[int, int], layers: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of each layer's values by (time, series)."""
    cell = times * n[1] + series
    return [np.bincount(cell, x, n[0] * n[1]).reshape(n) for x in layers]


def _products(df: DataFrame, on: str, key: str, made, combine, names: list[str], tile: int, side_rows: int) -> DataFrame:
    """(key_i, key_j, names): combine(layers of one side, of the other) -> arrays (series, series) for each name, summed over all times;
    made(rows of a task) -> one layer of values for each row. key_i <= key_j in the order of the tiles and then of the names."""
    dealt = _dealt(df, on, key, tile, side_rows)

    def per_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in scans.runs(frames, ["__low", "__high", "__bucket"]):
            low, high = int(rows["__low"].iloc[0]), int(rows["__high"].iloc[0])
            layers = made(rows)
            times, all_times = pd.factorize(rows[on])
            sides = []
            for t in (low, high):
                at = np.flatnonzero(rows["__tile"].to_numpy() == t)
                codes, known = pd.factorize(rows[key].iloc[at], sort=True)
                sides.append((at, codes, known))
            total = None
            for first in range(0, len(all_times), TIMES):
                laid = []
                for at, codes, known in sides:
                    here = np.flatnonzero((times[at] >= first) & (times[at] < first + TIMES))
                    shape = min(TIMES, len(all_times) - first), len(known)
                    laid.append(_layers(rows, times[at[here]] - first, codes[here], shape, [x[at[here]] for x in layers]))
                part = combine(*laid)
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            i, j = np.nonzero(total[0])
            if low == high:
                i, j = i[i <= j], j[i <= j]
            yield pd.DataFrame({"key_i": sides[0][2][i], "key_j": sides[1][2][j], **{n: x[i, j] for n, x in zip(names, total, strict=True)}})

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["__low", "__high", "__bucket"]
    kind = df.schema[key].dataType.simpleString()
    sums = dealt.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInPandas(per_task, f"key_i {kind}, key_j {kind}, " + ", ".join(f"{n} double" for n in names))
    return sums.groupBy("key_i", "key_j").agg(*(F.sum(n).alias(n) for n in names))


def _both_ways(pairs: DataFrame, value: str, key: str) -> DataFrame:
    """(key_i, key_j, value) in both directions."""
    other = pairs.where("key_i <> key_j").select(F.col("key_j").alias("key_i"), F.col("key_i").alias("key_j"), value)
    return pairs.select("key_i", "key_j", value).unionByName(other).select(F.col("key_i").alias(f"{key}_i"), F.col("key_j").alias(f"{key}_j"), value)


def correlations(df: DataFrame, on: str, value: str, key: str = "symbol", tile: int = TILE, side_rows: int = SIDE_ROWS) -> DataFrame:
    """(key_i, key_j, correlation) of every pair of series that share a time; 0 where a side is constant.

    Values count from their series' mean, so that sums of squares keep their digits; rows without a value meet nothing.
    """
    means = df.groupBy(F.col(key).alias("__of")).agg(F.avg(value).alias("__mean"))
    centred = df.select(key, on, F.col(value).cast("double").alias("__value")).where("__value IS NOT NULL").join(means, F.col(key) == F.col("__of")).select(key, on, (F.col("__value") - F.col("__mean")).alias("__value"))
    made = lambda rows: [np.ones(len(rows)), v := rows["__value"].to_numpy(float), v * v]

    def combine(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        (n, x, xx), (m, y, yy) = a, b
        return [n.T @ m, x.T @ m, n.T @ y, xx.T @ m, n.T @ yy, x.T @ y]

    sums = _products(centred, on, key, made, combine, ["n", "x", "y", "xx", "yy", "xy"], tile, side_rows)
    n, x, y, xx, yy, xy = (F.col(c) for c in ("n", "x", "y", "xx", "yy", "xy"))
    spread, other = xx - x * x / n, yy - y * y / n
    # what rounding leaves of a constant side's spread counts as none
    apart = (spread > 1e-13 * xx) & (other > 1e-13 * yy)
    within = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (xy - x * y / n) / F.sqrt(spread * other)))
    return _both_ways(sums.withColumn("correlation", F.when(apart, within).otherwise(0.0)), "correlation", key)


def agreements(df: DataFrame, on: str, state: str = "state", key: str = "symbol", tile: int = TILE, side_rows: int = SIDE_ROWS) -> DataFrame:
    """(key_i, key_j, agreement): in which share of their common times two series are in equal states. Rows without a state agree
    with none and are in no share."""
    given = df.select(key, on, F.col(state).alias("__state")).where("__state IS NOT NULL")

    def made(rows: pd.DataFrame) -> list[np.ndarray]:
        codes, known = pd.factorize(rows["__state"])
        return [np.ones(len(rows)), *((codes == k).astype(float) for k in range(len(known)))]

    def combine(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        return [a[0].T @ b[0], sum(x.T @ y for x, y in zip(a[1:], b[1:], strict=True))]

    sums = _products(given, on, key, made, combine, ["n", "same"], tile, side_rows)
    return _both_ways(sums.withColumn("agreement", F.col("same") / F.col("n")), "agreement", key)
