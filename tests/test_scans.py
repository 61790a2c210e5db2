"""Series split into blocks of time: every operator gives what it gives for whole series, and scans keep to their order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numerics as N
from tidemark.operators import hmm as H
from tidemark.operators import scans
from tidemark.operators import signals as S
from tidemark.operators import statespace as SS

MODEL = ((0.92, 0.03, 0.05), (0.1, 0.85, 0.05), (0.02, 0.03, 0.95)), (0.5, 0.3, 0.2), (-0.01, 0.0, 0.01), (1e-4, 4e-5, 2e-4)


@pytest.fixture(scope="module")
def df(spark):
    """Series of 600, 7, 1 and 100 rows, one of them without a name, one with gaps in seq."""
    rng = np.random.default_rng(1)
    sizes = {"a": 600, "b": 7, "c": 1, None: 100, "gaps": 60}
    parts = [pd.DataFrame({"symbol": s, "seq": np.arange(1, n + 1) * (9 if s == "gaps" else 1), "ret": rng.normal(0, 0.01, n), "signal": rng.normal(0, 1, n)}) for s, n in sizes.items()]
    made = spark.createDataFrame(pd.concat(parts), "symbol string, seq int, ret double, signal double")
    return made.withColumn("price", 100 + 100 * F.col("ret")).withColumn("extra", F.lit("x")).repartition(5).cache()


OPERATORS = {
    "ewma_volatility": (lambda d, **o: S.ewma_volatility(d, **o), ["variance"]),
    "smooth_signal": (lambda d, **o: S.smooth_signal(d, 0.1, **o), ["smooth"]),
    "smooth_signal_at_once": (lambda d, **o: S.smooth_signal(d, 1.0, **o), ["smooth"]),
    "igarch_scale": (lambda d, **o: S.igarch_scale(d, **o), ["position"]),
    "igarch_scale_from": (lambda d, **o: S.igarch_scale(d, 0.06, 0.0004, **o), ["position"]),
    "infer": (lambda d, **o: H.infer(d, *MODEL, **o), ["prediction", "probs", "ll"]),
    "backward": (lambda d, **o: H.backward(d, MODEL[0], MODEL[2], MODEL[3], **o), ["log_beta"]),
    "posteriors": (lambda d, **o: H.posteriors(d, *MODEL, **o), ["gamma"]),
    "viterbi": (lambda d, **o: H.viterbi(d, *MODEL, **o), ["state", "log_prob"]),
    "kalman_filter": (lambda d, **o: SS.kalman_filter(d, -0.2, 0.5, 2.0, (None, 0.0), ((100.0, 0.0), (0.0, 25.0)), **o), ["level", "trend", "level_var", "trend_var", "ll"]),
    "kalman_filter_from": (lambda d, **o: SS.kalman_filter(d, 0.0, 0.5, 2.0, (99.0, 0.1), ((1.0, 0.2), (0.2, 1.0)), **o), ["level", "trend", "level_var", "trend_var", "ll"]),
}


def _table(frame, columns, order=("symbol", "seq")):
    rows = frame.toPandas().sort_values(list(order)).reset_index(drop=True)
    return rows[list(order)], np.array([[np.concatenate([np.atleast_1d(r[c]) for c in columns])] for _, r in rows.iterrows()], float)


@pytest.mark.parametrize("name", OPERATORS)
def test_blocks_of_time_change_nothing(df, name, monkeypatch):
    monkeypatch.setattr(scans, "WIDTH", 3)  # so that elements are scanned on two levels
    operator, columns = OPERATORS[name]
    whole, split = operator(df), operator(df, block_rows=16)
    assert whole.columns == split.columns == [*df.columns, *columns] and whole.dtypes == split.dtypes
    (rows, x), (rows2, y) = _table(whole, columns), _table(split, columns)
    assert rows.equals(rows2) and np.allclose(x, y, rtol=1e-9, atol=1e-9)


def test_one_step_of_em_over_blocks(df):
    (rows, x), (rows2, y) = (_table(H.m_step(df, *MODEL, block_rows=n), ["start", "A", "mu", "sigma2"], ("symbol", "state")) for n in (10_000, 16))
    assert rows.equals(rows2) and np.allclose(x, y, rtol=1e-9, atol=1e-12)
    obs = np.array([r.ret for r in df.where("symbol = 'a'").orderBy("seq").collect()])
    A, pi, mu, sigma2 = map(np.array, MODEL)
    gamma, xi, _ = N.smoothed(N.emissions(obs, mu, sigma2), A, pi)
    found = H.m_step(df.where("symbol = 'a'"), *MODEL, block_rows=50).orderBy("state").collect()
    for name, k in (("A", 0), ("start", 1), ("mu", 2), ("sigma2", 3)):
        assert np.allclose([r[name] for r in found], N.m_step(obs, gamma, xi)[k])


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("blocks", [1, 2, 5, 23])
def test_scans_combine_in_the_order_of_time(spark, blocks, reverse, monkeypatch):
    monkeypatch.setattr(scans, "WIDTH", 4)
    rows = [(s, k - 7, [float(k)]) for s in ("x", "y") for k in range(blocks)]
    elements = spark.createDataFrame(rows, "symbol string, __block long, __element array<double>").repartition(3)
    joined = lambda a, b: np.concatenate([a, b])
    found = {(r["symbol"], r["__block"]): r["__carry"] for r in scans.prefixes(elements, joined, "symbol", reverse).collect()}
    expected = {(s, k - 7): [float(j) for j in (range(k + 1, blocks) if reverse else range(k))] for s in ("x", "y") for k in range(blocks)}
    assert found == {k: v for k, v in expected.items() if v}


def test_elements_are_associative():
    rng = np.random.default_rng(2)
    f, q = N.discretized(-0.3, 0.4, 1.0)
    obs = rng.normal(size=40)
    parts = [N.gaussian_block(x, f, q, 0.25) for x in np.split(obs, [3, 20, 21])]
    whole = N.gaussian_block(obs, f, q, 0.25)
    left = N.followed(N.followed(N.followed(parts[0], parts[1]), parts[2]), parts[3])
    right = N.followed(parts[0], N.followed(parts[1], N.followed(parts[2], parts[3])))
    for x, y, z in zip(whole, left, right, strict=True):
        assert np.allclose(x, y) and np.allclose(x, z)
    A, _, mu, sigma2 = map(np.array, MODEL)
    log_b = N.emissions(obs * 0.01, mu, sigma2)
    product, scale = N.chained(log_b, A)
    one = np.eye(3)
    for row in log_b:
        one = one @ (np.exp(row)[:, None] * A)
    assert np.allclose(product * np.exp(scale), one, rtol=1e-10)
    best = np.full((3, 3), -np.inf)
    np.fill_diagonal(best, 0)
    for row in log_b:
        best = (best[:, :, None] + (row[:, None] + np.log(A))[None]).max(axis=1)
    assert np.allclose(N.best_chained(log_b, np.log(A)), best)


def test_empty_series(df):
    for operator, columns in OPERATORS.values():
        out = operator(df.limit(0), block_rows=16)
        assert out.columns[-len(columns) :] == columns and out.count() == 0


def test_runs_that_advance_together_move_as_single_ones():
    rng = np.random.default_rng(5)
    A, pi, _, _ = map(np.array, MODEL)
    sizes = np.array([3, 40, 1, 40, 40, 7, 90, 2, 40, 1, 40, 40, 40, 40, 40, 33])
    starts = np.cumsum(sizes) - sizes
    log_b = np.round(rng.normal(size=(sizes.sum(), 3)), 1)  # with ties
    groups = N.together(sizes)
    assert [g.tolist() for g in groups[:-1]] == [[6]] and sorted(np.concatenate(groups).tolist()) == list(range(len(sizes)))
    runs, out = groups[-1], np.full(sizes.sum(), -1)
    back, best = N.stacked_moves(log_b, starts[runs], sizes[runs], np.log(A), np.tile(np.log(pi), (len(runs), 1)))
    N.stacked_paths(back, starts[runs], best.argmax(axis=1), out)
    firsts = N.stacked_firsts(back, np.tile(np.arange(3), (len(runs), 1)))
    for k, run in enumerate(runs):
        part = slice(starts[run], starts[run] + sizes[run])
        moves, last = N.viterbi_moves(log_b[part], np.log(A), np.log(pi))
        assert best[k].tolist() == last and out[part].tolist() == N.traced(moves, last.index(max(last)))
        assert firsts[k].tolist() == [N.traced(moves, j)[0] for j in range(3)]
    whole = np.array([log_b[s : s + 40] for s in starts[sizes == 40]])
    assert N.best_chained(whole, np.log(A)).tolist() == [N.best_chained(x, np.log(A)).tolist() for x in whole]


def test_stacks_hold_whole_runs(monkeypatch):
    monkeypatch.setattr(scans, "BLOCK_ROWS", 5)
    names = [None, None, "a", "a", "a", "a", "a", "a", "a", "b", "c", "c", "d"]
    rows = pd.DataFrame({"symbol": names, "x": range(13)})
    for size in (1, 2, 4, 13):
        found = list(scans.stacks((rows.iloc[k : k + size] for k in range(0, 13, size)), ["symbol"]))
        assert [x for frame, _ in found for x in frame["x"]] == list(range(13))
        assert [[x for x in frame["x"].iloc[starts]] for frame, starts in found] and sum((frame["x"].iloc[starts].tolist() for frame, starts in found), []) == [0, 2, 9, 10, 12]
    assert list(scans.stacks(iter([rows.iloc[:0]]), ["symbol"])) == []
