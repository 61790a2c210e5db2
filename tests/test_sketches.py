"""Mergeable quantile sketches within their stated error, and resampling of particles as windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numerics as N
from tidemark.operators import statespace as SS
from tidemark.operators import statistics as ST


def test_merged_sketches_keep_ranks(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("symbol"), (F.col("id") % 40).alias("day"), ((F.col("id") * 7919) % 200_003).cast("double").alias("ret"))
    days = ST.quantile_sketches(df, "symbol", "day", k=200)
    whole = ST.sketched_percentiles(ST.merged_sketches(days, "symbol", k=200)).collect()
    assert len(whole) == 3
    for r in whole:
        values = np.sort([x.ret for x in df.where(F.col("symbol") == r.symbol).select("ret").collect()])
        assert r.n == len(values)
        for p in ST.PERCENTILES:
            low, high = (np.searchsorted(values, r[f"p{p:02d}"], side) / len(values) for side in ("left", "right"))
            assert low - ST.rank_error(200) <= p / 100 <= high + ST.rank_error(200)
    assert days.agg(F.max(F.octet_length("sketch"))).first()[0] < 16_000
    assert ST.quantile_sketches(df.limit(0), "symbol").count() == 0


@pytest.mark.parametrize("u", [0.0, 0.3, 0.999])
@pytest.mark.parametrize("block_rows", [7, 10_000])
def test_resampling_by_windows_equals_resampling_in_a_task(spark, u, block_rows):
    """Weights are multiples of 1/1024, so that sums are exact in any order."""
    rng = np.random.default_rng(6)
    weights = {"a": rng.integers(0, 9, 50) / 1024, "b": np.array([0, 0, 5, 0]) / 1024, "zero": np.zeros(5), None: rng.integers(1, 4, 33) / 1024, "one": np.array([0.25])}
    rows = [(s, k, float(x)) for s, w in weights.items() for k, x in enumerate(w)]
    df = spark.createDataFrame(rows, "symbol string, particle int, weight double").repartition(3)
    found = {}
    for r in SS.resampled(df, u, block_rows=block_rows).collect():
        found.setdefault(r.symbol, {})[r.place] = r.particle
    assert set(found) == set(weights) - {"zero"}
    for s, places in found.items():
        w = weights[s]
        assert [places[k] for k in range(len(w))] == N.systematic(w[None], np.array([u]))[0].tolist()
