"""Matrices of pairs of series by tiles, against pairs one at a time."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import gram


@pytest.fixture(scope="module")
def table():
    """Rows of 13 series on shared days, some missing, some without a value, one series constant, one with two rows on a day."""
    rng = np.random.default_rng(3)
    rows = [(f"s{k:02d}", d, float(1e6 + rng.normal()) if k % 5 else 7.0, int(rng.integers(0, 3))) for k in range(13) for d in range(60) if rng.random() < 0.6]
    rows += [("s03", 5, 1e6 + 2.5, 1), ("s03", 5, 1e6 - 1.5, 0), ("lone", 1000, 1.0, 2)]
    frame = pd.DataFrame(rows, columns=["symbol", "day", "value", "state"])
    return frame.astype({"value": object, "state": object}).mask(rng.random(frame.shape) < [0, 0, 0.05, 0.05])


@pytest.mark.parametrize(("tile", "side_rows"), [(512, 1 << 17), (3, 10)])
def test_tiles_equal_pairs(spark, table, tile, side_rows, monkeypatch):
    monkeypatch.setattr(gram, "TIMES", 7)
    rows = [(None if pd.isna(s) else s, int(d), None if pd.isna(v) else float(v), None if pd.isna(x) else int(x)) for s, d, v, x in table.itertuples(index=False)] + [(None, 3, 1.0, 1)]
    df = spark.createDataFrame(rows, "symbol string, day int, value double, state int").repartition(4)
    for matrix, column in ((gram.correlations(df, "day", "value", tile=tile, side_rows=side_rows), "value"), (gram.agreements(df, "day", tile=tile, side_rows=side_rows), "state")):
        name = matrix.columns[-1]
        found = {(r["symbol_i"], r["symbol_j"]): r[name] for r in matrix.collect()}
        given = table[table[column].notna()].astype({column: float})
        both = given.merge(given, on="day", suffixes=("_i", "_j"))
        expected = {}
        for pair, part in both.groupby(["symbol_i", "symbol_j"]):
            x, y = part[f"{column}_i"].to_numpy() - (1e6 if column == "value" else 0), part[f"{column}_j"].to_numpy() - (1e6 if column == "value" else 0)
            expected[pair] = float((x == y).mean()) if column == "state" else float(np.corrcoef(x, y)[0, 1]) if len(x) > 1 and np.ptp(x) and np.ptp(y) else 0.0
        assert found.keys() == expected.keys()
        assert all(found[p] == pytest.approx(expected[p], abs=1e-8) for p in expected)


def test_a_row_is_repeated_once_a_tile(spark):
    """1,000 series in tiles of 100 and 20 days: ten copies of each row go out, not a thousand, and no rows are paired."""
    df = spark.range(20_000).selectExpr("CAST(id % 1000 AS string) AS symbol", "id DIV 1000 AS day", "CAST(id % 7 AS int) AS state")
    assert gram._dealt(df, "day", "symbol", 100, 1 << 17).count() == 200_000
    out = gram.agreements(df, "day", tile=100)
    assert out.count() == 1_000_000 and out.where("symbol_i = symbol_j AND agreement <> 1").count() == 0
    assert "Join" not in gram.agreements(df, "day", tile=100)._jdf.queryExecution().executedPlan().toString()
