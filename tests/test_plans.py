"""Plans on simulated series, whose answers are known or can be worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numerics as N
from tidemark.operators import backtest as BT
from tidemark.operators import hmm as H
from tidemark.operators import prep as P
from tidemark.operators import statespace as SS
from tidemark.operators import statistics as ST
from tidemark.plans import common as C
from tidemark.plans import regimes as R
from tidemark.plans import trends as T

MOVES, START, MEANS, VARIANCES = [[0.95, 0.04, 0.01], [0.03, 0.94, 0.03], [0.02, 0.05, 0.93]], [0.3, 0.4, 0.3], [-0.03, 0.0, 0.04], [1e-4, 6e-5, 1.5e-4]


@pytest.fixture(scope="module")
def regimes(spark):
    df = SS.simulated_regimes(spark, 2, 700, MOVES, START, MEANS, VARIANCES).withColumnRenamed("state", "true")
    return df.withColumn("dt", F.date_add(F.lit("2001-01-01").cast("date"), F.col("seq").cast("int"))).withColumn("seq", F.col("seq").cast("int")).persist()


@pytest.fixture
def daily(monkeypatch, regimes):
    for module in (C, R, T):
        monkeypatch.setattr(module, "daily_log_returns", lambda *_: regimes.drop("true"))


@pytest.fixture
def session(monkeypatch, spark):
    prices = SS.simulated_prices(spark, 3, 160).withColumn("seq", F.col("seq").cast("int")).persist()
    monkeypatch.setattr(T, "session_prices", lambda *_: prices)
    return prices


def test_models_of_each_series_decode_its_states(regimes):
    rows = R.decoded(regimes, 3, 4, 20, 60)
    assert rows.count() == 1400 and rows.where(F.col("state") == F.col("true")).count() > 0.93 * 1400


def test_by_models_equals_the_operators_with_one_model(spark, regimes):
    models = regimes.select("symbol").distinct().crossJoin(spark.createDataFrame([(MOVES, START, MEANS, VARIANCES)], H.MODEL))
    own = C.by_models(regimes, models)
    for c, other in (("prediction", H.infer(regimes, MOVES, START, MEANS, VARIANCES).select("symbol", "seq", F.col("prediction").alias("x"))), ("state", H.viterbi(regimes, MOVES, START, MEANS, VARIANCES).select("symbol", "seq", F.col("state").alias("x")))):
        assert own.join(other, ["symbol", "seq"]).where(F.abs(F.col(c) - F.col("x")) > 1e-12).count() == 0
    path, score = N.viterbi(N.emissions(np.array([r.ret for r in regimes.where("symbol = 's0'").orderBy("seq").collect()]), np.array(MEANS), np.array(VARIANCES)), np.array(MOVES), np.array(START))
    assert H.viterbi(regimes.where("symbol = 's0'"), MOVES, START, MEANS, VARIANCES).agg(F.min("log_prob"), F.max("log_prob")).first() == pytest.approx((score, score))


def test_full_m_step_is_one_step_of_em(regimes):
    got = {r.state: r for r in H.m_step(regimes.where("symbol = 's1'"), MOVES, START, MEANS, VARIANCES).collect()}
    obs = np.array([r.ret for r in regimes.where("symbol = 's1'").orderBy("seq").collect()])
    gamma, xi, _ = N.smoothed(N.emissions(obs, np.array(MEANS), np.array(VARIANCES)), np.array(MOVES), np.array(START))
    A, pi, mu, sigma2 = N.m_step(obs, gamma, xi)
    for k in range(3):
        assert got[k].A == pytest.approx(A[k].tolist()) and (got[k].start, got[k].mu, got[k].sigma2) == pytest.approx((pi[k], mu[k], sigma2[k]))


def test_selection_finds_the_number_of_states(spark, daily):
    chosen = R.model_selection(spark, "", (1, 2, 3, 4)).where("bic_chosen").collect()
    assert len(chosen) == 2 and {r.k for r in chosen} == {3}


def test_training_and_regimes(spark, daily):
    for r in R.training(spark, "").collect():
        assert r.mu == pytest.approx(MEANS[r.state], abs=0.006) and r.sigma == pytest.approx(np.sqrt(VARIANCES[r.state]), rel=0.2) and 3 < r.duration < 60
    shares = R.regime_detection(spark, "").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("pct").alias("pct")).collect()
    assert all(r.n == 700 and r.pct == pytest.approx(100) for r in shares)


def test_votes_beat_holding_where_regimes_last(spark, daily):
    rows = {(r.symbol, r.strategy): r for r in R.backtest_comparison(spark, "").collect()}
    assert len(rows) == 6 and all(rows[s, "vote"].sharpe > rows[s, "hold"].sharpe + 1 for s in ("s0", "s1"))


def test_em_and_gibbs_agree(spark, daily):
    rows = {(r.symbol, r.method): r for r in R.em_and_gibbs(spark, "", 30, 30, 1).collect()}
    for s in ("s0", "s1"):
        em, gibbs = rows[s, "em"], rows[s, "gibbs"]
        assert np.allclose(em.mu, MEANS, atol=0.01) and np.allclose(gibbs.mu, MEANS, atol=0.01)
        assert em.test_ll == pytest.approx(gibbs.test_ll, abs=40) and all(0 < x < 0.01 for x in gibbs.mu_std) and em.mu_std is None


def test_cells_of_the_refinement(spark, daily):
    rows = R.signal_refinement(spark, "", (0.5, 1.0), (0.3, 1.0)).where("symbol = 's0'").collect()
    assert sorted(r.rank for r in rows) == [1, 2, 3, 4] and max(r.sharpe for r in rows) == next(r.sharpe for r in rows if r.rank == 1)
    baseline = next(r for r in rows if r.threshold == 1.0 and r.alpha == 1.0)
    plain = C.regime_signals(C.daily_log_returns(spark, "")).where("symbol = 's0'")
    plain = BT.metrics(BT.backtest(plain.withColumn("signal", F.when(F.col("neutral") < 1, F.col("signal")).otherwise(0.0)))).first()
    assert baseline.sharpe == pytest.approx(plain.sharpe) and {r.part for r in rows} <= {"combined", "baseline", "zone", "smoothing", None}


def test_rolling_windows(spark, daily):
    rows = R.rolling_backtest(spark, "", 12, 6).collect()
    assert {r.level for r in rows} == {"window", "all"} and sum(r.level == "all" for r in rows) == 2
    assert {r.symbol for r in rows if r.level == "window"} >= {"s0#0", "s1#1"}


def test_states_against_states(spark, daily):
    table = R.three_or_four_states(spark, "").collect()
    assert sum(r[f"col_{k}"] for r in table for k in range(4)) == 1400
    for r in R.split_by_states(spark, "").collect():
        assert r.sharpe_change == pytest.approx(r.sharpe_4 - r.sharpe_3)


def test_portfolio_of_two_assets(spark, regimes):
    curves = BT.backtest(regimes.withColumn("signal", F.signum("ret")))
    got = BT.portfolio(curves).first()
    net = curves.groupBy("dt").agg(F.avg("net").alias("x")).orderBy("dt").toPandas()["x"].to_numpy()
    wealth = np.cumprod(1 + net)
    assert got.sharpe == pytest.approx(np.sqrt(252) * net.mean() / net.std()) and got.max_drawdown == pytest.approx(-(wealth / np.maximum.accumulate(wealth) - 1).min())
    signals = {s: np.sign([r.ret for r in regimes.where(F.col("symbol") == s).orderBy("seq").collect()]) for s in ("s0", "s1")}
    assert got.turnover == pytest.approx(np.mean([np.abs(np.diff(x)).mean() for x in signals.values()]))


def test_correlation_of_a_flat_side_is_null(series):
    df = series({"a": [(1.0, 1.0), (2.0, 1.0), (4.0, 1.0)], "b": [(1.0, 3.0), (2.0, 1.0), (3.0, 2.0)]}, "x", "y")
    found = {r.symbol: r.c for r in df.groupBy("symbol").agg(ST.correlation("x", "y").alias("c")).collect()}
    assert found["a"] is None and found["b"] == pytest.approx(-0.5)


def test_both_filters_on_simulated_jumps(spark):
    for r in T.jump_detection(spark, "", 100).collect():
        assert r.hits <= r["true"] and r["false"] <= r.found and r.share_at_jumps > 2 * r.share_elsewhere
        assert 0 < r.rbpf_level_rmse < 0.4 and r.rbpf_level_rmse < r.bootstrap_level_rmse + 0.1


def test_jumps_on_and_off(spark, monkeypatch):
    prices = SS.simulated_prices(spark, 2, 200).withColumn("seq", F.col("seq").cast("int")).withColumnRenamed("price", "close").persist()
    monkeypatch.setattr(T, "daily_log_returns", lambda *_: P.log_returns(prices, "close"))
    rows = T.particle_trading(spark, "", 50).collect()
    assert len(rows) == 2 and all(r.ll_gain == pytest.approx(r.ll - r.ll_without) for r in rows)
    assert len(T.particle_baseline(spark, "", 50).collect()) == 2


def sharpe_by_hand(prices, parameters, n, key, seed, window, alpha, lagged, per_year, cells=None):
    """One filter, signal and backtest of a series, from the numeric kernels alone."""
    scale = prices[0] / 100
    p = {c: np.array([v * (scale if c in ("sigma", "sigma_obs", "sigma_J") else 1)]) for c, v in parameters.items()}
    out = N.rbpf_many(prices, p, n, *SS.prior(prices[:1], p), [seed], T.DT)
    ret, signal = SS.trend_signals(out["mean"][..., 1], prices, window, alpha)
    return float(SS.sharpe_of(ret, signal, 2, lagged, per_year)[0])


def test_two_stage_search(spark, session):
    rows = T.parameter_search(spark, "", (0.1, 1.0), (0.5, 1.5), (-0.2, -1.0), n=4, n_final=10, top=3).collect()
    assert len(rows) == 9 and all(r["rank"] <= 3 for r in rows)
    for s in ("s0", "s1", "s2"):
        own = [r for r in rows if r.symbol == s]
        tested = [r for r in own if r.test_sharpe is not None]
        assert len(tested) == 1 and tested[0].train_sharpe == max(r.train_sharpe for r in own)
    r = next(r for r in rows if r.test_sharpe is not None)
    prices = np.array([x.price for x in session.where(F.col("symbol") == r.symbol).orderBy("seq").collect()])[112:]
    parameters = T.JUMPS_ON | {"sigma": r.sigma, "sigma_obs": r.sigma_obs, "theta": r.theta}
    assert r.test_sharpe == pytest.approx(sharpe_by_hand(prices, parameters, 10, r.symbol, H.seed_of(42, r.symbol, r.grid_idx), 4, 0.06, True, 252))


def test_portfolio_search(spark, session):
    rows = {r.symbol: r for r in T.portfolio_search(spark, "", (0.5, 1.5), (-0.2, -1.0), n=3, n_final=8).collect()}
    assert set(rows) == {"s0", "s1", "s2", "portfolio"} and len({(r.sigma, r.theta) for r in rows.values()}) == 1
    assert rows["portfolio"].test_sharpe == pytest.approx(np.mean([rows[s].test_sharpe for s in ("s0", "s1", "s2")]))
    r = rows["s1"]
    prices = np.array([x.price for x in session.where("symbol = 's1'").orderBy("seq").collect()])[112:]
    assert r.test_sharpe == pytest.approx(sharpe_by_hand(prices, T.JUMPS_ON | {"sigma": r.sigma, "theta": r.theta}, 8, "s1", H.seed_of(42, "s1"), 4, 0.06, False, T.MINUTES_OF_A_YEAR))


def test_contract_search(spark, session):
    grid = {"window": (2, 5), "sigma_obs": (0.1, 1.0), "theta": (-0.2,), "alpha": (0.06,)}
    rows = {r.symbol: r for r in T.contract_search(spark, "", grid, n=3, n_final=8, last_rows=60).collect()}
    assert {"portfolio", "hold"} < set(rows) and rows["hold"].final_nav > 0 and 0 <= rows["hold"].max_drawdown < 1
    held = []
    for s in sorted(set(rows) - {"portfolio", "hold"}):
        prices = np.array([x.price for x in session.where(F.col("symbol") == s).orderBy("seq").collect()])[112:]
        held.append(np.diff(prices) / prices[:-1])
        r = rows[s]
        parameters = T.JUMPS_ON | {"sigma": 0.5, "sigma_obs": r.sigma_obs, "theta": r.theta}
        grid_idx = 2 * (2, 5).index(int(r.window)) + (0.1, 1.0).index(r.sigma_obs)
        assert r.test_sharpe == pytest.approx(sharpe_by_hand(prices, parameters, 8, s, H.seed_of(42, s, grid_idx), int(r.window), r.alpha, True, 252))
    assert rows["hold"].final_nav == pytest.approx(np.prod(1 + np.mean(held, axis=0)))


def test_regimes_against_trends(spark, session):
    rows = T.regimes_against_trends(spark, "", 10).collect()
    assert len(rows) == 9 and {r.strategy for r in rows} == {"regimes", "trend", "hold"} and all(0 <= r.agreement <= 1 for r in rows)
    minutes = T.minute_trends(spark, "", 10).collect()
    assert len(minutes) == 9 and {(r.strategy, r.ll is None) for r in minutes} == {("jumps", False), ("no jumps", False), ("hold", True)}


def test_the_walkthrough_is_one_chain(spark):
    """Steps agree with each other and with what each must hold, on the given tables."""
    data = "/root/testdata/sf0.001"
    found = {}
    for r in R.walkthrough(spark, data).collect():
        found.setdefault(r.step, {})[r.symbol, r.item, r.name] = r.value
    moments = {r.symbol: r for r in ST.moments(C.daily_log_returns(spark, data)).collect()}
    assert {s for s, _, _ in found["exploration"]} == set(moments)
    for s, m in moments.items():
        assert found["exploration"][s, "returns", "std"] == pytest.approx(m["std"])
        chosen = [k for k in range(1, 7) if found["selection"][s, str(k), "bic_chosen"]]
        assert len(chosen) == 1 and found["selection"][s, str(chosen[0]), "bic_gap"] == 0 and all(found["selection"][s, str(k), "bic_gap"] >= 0 for k in range(1, 7))
        means = [found["training"][s, str(k), "mu"] for k in range(3)]
        assert means == sorted(means) and sum(found["training"][s, str(k), "share"] for k in range(3)) == pytest.approx(1)
        rows = sum(found["regimes"][s, str(k), "n"] for k in range(3))
        assert rows == found["selection"][s, "1", "n"] and sum(found["regimes"][s, str(k), "pct"] for k in range(3)) == pytest.approx(100)
        assert found["backtest"][s, "hold", "turnover"] == 0 and {i for n, i, _ in found["backtest"] if n == s} == {"hold", "sign", "vote"}
        ranks = {i: found["refinement"][s, i, "rank"] for n, i, name in found["refinement"] if n == s and name == "rank"}
        assert ranks["combined"] == 1
        if "baseline" in ranks:  # neither zone nor smoothing is the backtest's own vote
            assert found["refinement"][s, "baseline", "sharpe"] == pytest.approx(found["backtest"][s, "vote", "sharpe"], abs=1e-9)


def test_searches_of_plans_run_once(spark):
    """What a plan reads more than once is made once: what is left to run holds at most the last filter."""
    from tidemark.plans import trends

    d = "/root/testdata/sf0.001"
    left = {
        "parameters": trends.parameter_search(spark, d, (0.1,), (0.5,), (-0.2, -0.5), 2, 3, 2),
        "contracts": trends.contract_search(spark, d, {"window": (4,), "sigma_obs": (0.1,), "theta": (-0.1, -0.2), "alpha": (0.06,)}, 2, 3),
        "portfolio": trends.portfolio_search(spark, d, (0.5,), (-0.2,), 2, 3),
    }
    plans = {n: df._jdf.queryExecution().optimizedPlan().toString() for n, df in left.items()}
    assert {n: (p.count("FlatMapGroupsInPandas"), p.count("FlatMapCoGroupsInPandas"), p.count("MapInPandas")) for n, p in plans.items()} == {"parameters": (0, 1, 0), "contracts": (0, 1, 0), "portfolio": (0, 0, 0)}
