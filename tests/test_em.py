"""EM over blocks of time and in waves of attempts, against EM of whole series in one task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numerics as N
from tidemark.operators import em
from tidemark.operators import hmm as H
from tidemark.operators import scans


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(7)
    draw = lambda n: np.where(np.cumsum(rng.random(n) < 0.05) % 2, rng.normal(-0.01, 0.02, n), rng.normal(0.01, 0.008, n))
    parts = [pd.DataFrame({"symbol": s, "seq": np.arange(1, n + 1), "ret": draw(n)}) for s, n in (("a", 400), ("b", 50), (None, 90))]
    return spark.createDataFrame(pd.concat(parts), "symbol string, seq int, ret double").repartition(3).cache()


def test_split_series_fit_alike(df, monkeypatch):
    monkeypatch.setattr(scans, "WIDTH", 3)
    options = {"restarts": 3, "max_iter": 4, "tol": 0.5}  # some restarts end early
    order = ["symbol", "restart"]
    whole, split = (f.toPandas().sort_values(order).reset_index(drop=True) for f in (H.fits(df, [2], **options), em.fits_split(df, 2, block_rows=32, **options)))
    assert whole[[*order, "k", "n_iter"]].equals(split[[*order, "k", "n_iter"]]) and whole["n_iter"].nunique() > 1
    assert np.allclose(whole["ll"], split["ll"], rtol=1e-8)
    for c in ("pi", "mu", "sigma2", "history"):
        assert all(np.allclose(x, y, rtol=1e-7, atol=1e-10) for x, y in zip(whole[c], split[c], strict=True))
    assert all(np.allclose(list(x), list(y), atol=1e-8) for x, y in zip(whole["A"].map(lambda a: np.stack(a)), split["A"].map(lambda a: np.stack(a)), strict=True))
    best = {r.symbol: r.ll for r in em.fit_split(df, 2, block_rows=32, **options).collect()}
    assert best == {s: pytest.approx(max(whole.ll[whole.symbol.isna() if s is None else whole.symbol == s])) for s in ("a", "b", None)}


def test_em_works_on_a_part_of_a_series_at_a_time(monkeypatch):
    """Lanes and models in stacks of any size give what whole messages give, rows far from all states included; no array of a
    number for each row and state is held."""
    import tracemalloc

    rng = np.random.default_rng(4)
    obs = np.concatenate([rng.normal(-0.01, 0.02, 700), [30.0, -40.0], rng.normal(0.01, 0.008, 300)])
    for k, steps, stack in ((1, 8, 1 << 18), (2, 8, 60), (3, 30, 1 << 18), (3, 16, 500)):
        monkeypatch.setattr(N, "LANE", steps)
        monkeypatch.setattr(N, "LANES", 1)
        monkeypatch.setattr(N, "WORKING_SET", stack)
        for x in (obs, obs[:700], obs[:steps], obs[: steps + 1], obs[:5]):
            lanes = N.Lanes(np.array_split(x, 3), len(x), 2)
            A, pi, mu, sigma2 = N.started(lanes, k, [[1], [2]])
            gamma, xi, ll = N.smoothed(N.emissions(x, mu, sigma2), A, pi)
            got = N.expectation(lanes, A, pi, mu, sigma2)
            away = x[:, None] - mu[:, None]
            for one, other in zip(got, (ll, gamma[:, 0], gamma.sum(axis=1), (gamma * away).sum(axis=1), (gamma * away**2).sum(axis=1), xi), strict=True):
                assert np.allclose(one, other, rtol=1e-10, atol=1e-12)
            for one, other in zip(N.maximisation(A, mu, *got[1:]), N.m_step(x, gamma, xi), strict=True):
                assert np.allclose(one, other, rtol=1e-9, atol=1e-12)
    monkeypatch.undo()
    rows = 2_500_000
    tracemalloc.start()
    lanes = N.Lanes((rng.normal(0, 1, 400) for _ in range(rows // 400)), rows, 1)
    N.expectation(lanes, *N.started(lanes, 3, [[1]]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * rows  # a series and its messages take a dozen arrays of a number for each row and state
    assert lanes.values(2_400_000, 3_000_000).shape == (100_000,) and lanes.file._rolled


def test_a_series_goes_to_its_fits_as_packed_rows(spark):
    """Rows of a series reach a task as a few rows of many values, and those of a null key are a series."""
    rows = [(s, k + 1, float(x)) for s in (7, None) for k, x in enumerate(np.random.default_rng(s or 9).normal(0, 1, 600))]
    frame = spark.createDataFrame(rows, "symbol long, seq int, ret double").repartition(5)
    packed = scans.packed(frame, "ret", "symbol").collect()
    assert sorted(len(r.obs) for r in packed) == [89, 89, 255, 255, 256, 256]
    found = {(r.symbol, r.restart): r for r in H.fits(frame, [2], restarts=2, max_iter=5).collect()}
    assert len(found) == 4
    for s in (7, None):
        want = N.em(np.array([x for name, _, x in rows if name == s]), 2, N.seed_list(H.seed_of(42, s, 2), 2), 5)
        assert [found[s, k].ll for k in (0, 1)] == pytest.approx([m["ll"] for m in want], rel=1e-12)


def test_a_split_series_is_dealt_by_blocks(df):
    blocks = em.packed(df, block_rows=32).collect()
    assert max(len(r.obs) for r in blocks) <= 32 and sorted(r.ahead for r in blocks if r.symbol == "a") == [0, *range(31, 400, 32)]


def test_attempts_in_waves_equal_attempts_in_turn(df):
    """Fits under a likelihood are refused, so that several waves are needed."""
    limits = {}
    for name in ("a", "b", None):
        obs = np.array([r.ret for r in df.where(F.col("symbol").eqNullSafe(F.lit(name))).orderBy("seq").collect()])
        ll = sorted(m["ll"] for m in N.em(obs, 2, N.seed_list(H.seed_of(5, name, 2), 12), 3))
        limits[len(obs)] = (obs, ll[6], name)
    by_size = sorted((ll, n) for n, (_, ll, _) in limits.items())
    accept = lambda m: any(m["ll"] >= ll and (k + 1 == len(by_size) or m["ll"] < by_size[k + 1][0] / 1.5) for k, (ll, _) in enumerate(by_size))
    found = {r.symbol: r for r in H.fit_retried(df, [2], successes=3, attempts=12, max_iter=3, seed=5, accept=accept).collect()}
    made = H.attempted(df, [2], successes=3, attempts=12, max_iter=3, seed=5, accept=accept)
    waves = {r.symbol: r for r in made.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("accepted").alias("ok"), F.countDistinct("attempt").alias("different")).collect()}
    assert max(r.n for r in waves.values()) > 3
    for obs, _, name in limits.values():
        good, tried = [], 0
        while len(good) < 3 and tried < 12:
            n = min(3 - len(good), 12 - tried)
            good += [m for m in N.em(obs, 2, N.seed_list(H.seed_of(5, name, 2), n, tried), 3) if accept(m)]
            tried += n
        assert found[name].attempts == tried == waves[name].n == waves[name].different and waves[name].ok == len(good)
        assert found[name].ll == pytest.approx(max(m["ll"] for m in good)) and np.allclose(found[name].mu, np.sort(max(good, key=lambda m: m["ll"])["mu"]))


def test_no_usable_attempt_is_an_error(df):
    with pytest.raises(Exception, match="no usable fit in 4 attempts"):
        H.fit_retried(df, [2], successes=2, attempts=4, max_iter=2, accept=lambda m: False).collect()
