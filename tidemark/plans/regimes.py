"""Whole analyses with hidden Markov models: exploration, selection, regimes, backtests and their refinement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import backtest as BT
from tidemark.operators import hmm as H
from tidemark.operators import prep as P
from tidemark.operators import regimes as R
from tidemark.operators import signals as S
from tidemark.operators import statistics as ST
from tidemark.shared import cut
from tidemark.sources import market as M
from tidemark.plans.common import by_models, compared, daily_log_returns, regime_signals, session_prices, strategies

# What the analyses are run with.
THRESHOLDS, ALPHAS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0), (0.1, 0.2, 0.3, 0.5, 0.7, 1.0)
def walkthrough(spark, d):
    """(step, symbol, item, name, value): exploration, choice of K, training, regimes, backtest and refinement as one chain.

    Each step works on what the one before found: the fits of the choice are those of all K, regimes are decoded with the trained
    model, and refinement starts from the backtest's signals. Fits, regimes and signals are checkpointed once and shared.
    """
    df = cut(daily_log_returns(spark, d))

    def long(rows: DataFrame, step: str, item: str | Column) -> DataFrame:
        names = [c for c, kind in rows.dtypes if kind in ("double", "int", "bigint", "boolean") and c not in ("state", "k", "grid_idx")]
        values = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names))).alias("v")
        return rows.select(F.lit(step).alias("step"), "symbol", (F.col(item) if isinstance(item, str) else item).cast("string").alias("item"), values).select("step", "symbol", "item", "v.name", "v.value")

    scored = cut(model_selection(spark, d, tuple(range(1, 7))))
    models = H.fit_retried(df, [3], 10, 150, 200)
    rows = cut(by_models(df, models))
    test = regime_signals(df)
    steps = [
        long(ST.moments(df), "exploration", F.lit("returns")), long(scored, "selection", "k"), long(described(models), "training", "state"),
        long(detected(rows), "regimes", "state"), long(strategies(test), "backtest", "strategy"),
        long(refined(test, THRESHOLDS, ALPHAS).where("part IS NOT NULL"), "refinement", "part"),
    ]
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out


#: Rows of a bar at each frequency; 0 for a whole day.
FREQUENCIES = {"1min": 1, "5min": 5, "15min": 15, "30min": 30, "1h": 60, "1D": 0}
HORIZONS = (2, 5, 10, 15, 20, 30, 60, 120, 240, 390)
ASSETS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
#: (label, series, first day, last day)
CONFIGURATIONS = (
    ("urgent", "1-URGENT", "1992-01-01", "1998-12-31"), ("high", "2-HIGH", "1992-01-01", "1998-12-31"), ("medium", "3-MEDIUM", "1992-01-01", "1998-12-31"),
    ("low", "5-LOW", "1992-01-01", "1998-12-31"), ("urgent early", "1-URGENT", "1992-01-01", "1996-12-31"), ("urgent late", "1-URGENT", "1994-01-01", "1998-12-31"),
)


def exploration(spark, d):
    df = daily_log_returns(spark, d)
    vol = S.ewma_volatility(df).groupBy("symbol").agg(*(f(F.sqrt(252 * F.col("variance"))).alias(f"vol_{n}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))
    return ST.moments(df).join(ST.extremes(df, "dt"), "symbol").join(ST.percentiles(df), "symbol").join(vol, "symbol")


def model_selection(spark, d, ks=tuple(range(1, 11))):
    """AIC and BIC of every number of states, each fitted once with retries; gaps from the best, and which one is chosen."""
    df = daily_log_returns(spark, d)
    n = df.groupBy("symbol").agg(F.count("*").alias("n"))
    scored = H.fit_retried(df, list(ks), 1, 20, 40).select("symbol", "k", "ll", "n_iter").join(n, "symbol")
    w = Window.partitionBy("symbol")
    scored = scored.withColumn("aic", R.aic(F.col("ll"), F.col("k"))).withColumn("bic", R.bic(F.col("ll"), F.col("k"), F.col("n")))
    for c in ("aic", "bic"):
        scored = scored.withColumn(f"{c}_gap", F.col(c) - F.min(c).over(w)).withColumn(f"{c}_chosen", F.row_number().over(w.orderBy(c, "k")) == 1)
    return scored


def training(spark, d):
    return described(H.fit_retried(daily_log_returns(spark, d), [3], 10, 150, 200))


def described(models: DataFrame) -> DataFrame:
    """A row for each state of models: mean, deviation, expected duration and long-run share."""
    states = models.select("symbol", "ll", "n_iter", "attempts", F.posexplode(F.arrays_zip("mu", "sigma2")).alias("state", "m")).select("symbol", "ll", "n_iter", "attempts", "state", "m.mu", F.sqrt("m.sigma2").alias("sigma"))
    return states.join(H.expected_durations(models), ["symbol", "state"]).join(H.stationary(models), ["symbol", "state"])


def decoded(df: DataFrame, k: int, successes: int, attempts: int, max_iter: int, seed: int = 42) -> DataFrame:
    """by_models() of all rows of each series, under a model of the same rows. Checkpointed, as plans read it more than once."""
    return cut(by_models(df, H.fit_retried(df, [k], successes, attempts, max_iter, seed=seed)))


def regime_detection(spark, d):
    return detected(decoded(daily_log_returns(spark, d), 3, 10, 150, 200))


def detected(rows: DataFrame) -> DataFrame:
    return R.state_stats(rows, 3).join(R.average_durations(rows), ["symbol", "state"], "left").join(R.transition_counts(rows), "symbol")


def backtest_comparison(spark, d):
    test = regime_signals(daily_log_returns(spark, d))
    return strategies(test).join(BT.signal_stats(test).select("symbol", F.lit("vote").alias("strategy"), "mean", "std", "long", "short", "flat"), ["symbol", "strategy"], "left")


def posterior_models(draws: DataFrame) -> DataFrame:
    """Models of posterior means of gibbs() draws, states in order, with the deviations of means and variances."""
    long = draws.select("symbol", "state", "mu", "sigma2", "pi", F.posexplode("a").alias("into", "a"))
    moves = long.groupBy("symbol", "state", "into").agg(F.avg("a").alias("a"))
    rows = moves.groupBy("symbol", "state").agg(F.transform(F.array_sort(F.collect_list(F.struct("into", "a"))), lambda x: x["a"]).alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda t, x: t + x)
    rows = rows.withColumn("a", F.transform("a", lambda x: x / total)).join(H.posterior_summary(draws), ["symbol", "state"])
    listed = rows.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("state", "a", "pi_mean", "mu_mean", "sigma2_mean", "mu_std", "sigma2_std"))).alias("s"))
    pick = lambda name, out: F.transform("s", lambda x: x[name]).alias(out)
    models = listed.select("symbol", pick("a", "A"), pick("pi_mean", "pi"), pick("mu_mean", "mu"), pick("sigma2_mean", "sigma2"), pick("mu_std", "mu_std"), pick("sigma2_std", "sigma2_std"))
    return models.withColumn("pi", F.transform("pi", lambda x: x / F.aggregate("pi", F.lit(0.0), lambda t, y: t + y)))


def em_and_gibbs(spark, d, samples=150, burn_in=150, thin=2):
    """EM and Gibbs on training rows; likelihood and backtest of both on test rows, and the posterior's deviations."""
    split = P.train_test_split(daily_log_returns(spark, d), 0.7)
    train, test = split.where("is_train"), split.where("NOT is_train").drop("is_train")
    em = H.fit_retried(train, [3], 3, 40, 120)
    gibbs = posterior_models(H.gibbs(train, 3, samples, burn_in, thin, seed=7))
    out = None
    for name, models in (("em", em), ("gibbs", gibbs)):
        run = by_models(test, models).withColumn("seq", F.row_number().over(P.by_time()))
        ll = run.groupBy("symbol").agg(F.sum("gain").alias("test_ll"))
        one = BT.metrics(BT.backtest(run)).join(ll, "symbol").join(models.select("symbol", "mu", "sigma2"), "symbol").withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.join(gibbs.select("symbol", F.lit("gibbs").alias("method"), "mu_std", "sigma2_std"), ["symbol", "method"], "left")


def multi_asset(spark, d, assets=ASSETS):
    """(kind, a, b, value): assets aligned to common days, each with its own model; agreement of states and correlation of signals
    for each pair, and metrics of each asset, of their equal-weight portfolio and of holding it.
    """
    prices = P.inner_align(M.daily(spark, d), list(assets))
    test = regime_signals(P.log_returns(P.sequenced(prices, "dt"), "close"), 3, 2, 40, 120)
    curves = BT.backtest(test)
    held = BT.backtest(test.withColumn("signal", F.lit(1.0)), 0)
    metrics = BT.metrics(curves).unionByName(BT.portfolio(curves)).unionByName(BT.portfolio(held).withColumn("symbol", F.lit("hold")))
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("b"), F.col(c).alias("value")) for c in ("sharpe", "annualized_return", "max_drawdown", "turnover")))).alias("m")
    rows = metrics.select(F.lit("metric").alias("kind"), F.col("symbol").alias("a"), values).select("kind", "a", "m.b", "m.value")
    for kind, matrix, value in (("agreement", R.agreement_matrix(test, "dt"), "agreement"), ("correlation", R.correlation_matrix(test, "dt", "signal"), "correlation")):
        rows = rows.unionByName(matrix.select(F.lit(kind).alias("kind"), F.col("symbol_i").alias("a"), F.col("symbol_j").alias("b"), F.col(value).alias("value")))
    return rows


#: Successes, attempts and iterations of fits with three and four states.
_BY_STATES = {3: (2, 30, 100), 4: (1, 12, 50)}


def three_or_four_states(spark, d):
    """Cross table of the most likely states of all rows under three and under four states."""
    df = daily_log_returns(spark, d)
    three, four = (decoded(df, k, *_BY_STATES[k], seed=42 + 1000 * (k - 3)).select("symbol", "dt", F.col("state").alias(f"s{k}")) for k in (3, 4))
    return R.crosstab(three.join(four, ["symbol", "dt"]), "s3", "s4", [0, 1, 2, 3])


def split_by_states(spark, d):
    """Backtests of three and of four states on test rows, and what the fourth changes."""
    df = daily_log_returns(spark, d)
    three, four = (BT.metrics(BT.backtest(regime_signals(df, k, *_BY_STATES[k], seed=5042 + 1000 * (k - 3)))) for k in (3, 4))
    names = ("sharpe", "annualized_return", "max_drawdown", "turnover")
    both = three.join(four.select("symbol", *(F.col(c).alias(f"{c}_4") for c in names)), "symbol")
    return both.select("symbol", *(F.col(c).alias(f"{c}_3") for c in names), *(f"{c}_4" for c in names), *((F.col(f"{c}_4") - F.col(c)).alias(f"{c}_change") for c in names[:2]))


def rolling_backtest(spark, d, initial_months=60, step_months=6):
    """Expanding windows: each (series, window) has its own fit. Metrics of each window, and of all windows' rows one after the other."""
    rows = R.expanding_windows(daily_log_returns(spark, d), "dt", initial_months, step_months)
    keyed = rows.withColumn("symbol", F.concat_ws("#", "symbol", "window_id")).select("symbol", "dt", "seq", "ret", "part")
    models = H.fit_retried(keyed.where("part = 'train'"), [3], 1, 20, 80, seed=123)
    test = by_models(keyed.where("part = 'test'").drop("part"), models).withColumn("seq", F.row_number().over(P.by_time()))
    whole = test.withColumn("symbol", F.element_at(F.split("symbol", "#"), 1)).withColumn("seq", F.row_number().over(Window.partitionBy("symbol").orderBy("dt")))
    out = None
    for level, df in (("window", test), ("all", whole)):
        own = BT.metrics(BT.backtest(df))
        held = BT.metrics(BT.backtest(df.withColumn("signal", F.lit(1.0)), 0)).select("symbol", F.col("sharpe").alias("benchmark_sharpe"), F.col("max_drawdown").alias("benchmark_drawdown"))
        one = own.join(held, "symbol").withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    return out


def signal_refinement(spark, d, thresholds=THRESHOLDS, alphas=ALPHAS):
    """No-trade thresholds by smoothing factors: metrics and rank of every cell of each series. Chosen on test rows.

    part names the cells of the comparison: baseline (neither), combined (the best cell), zone and smoothing (its one half).
    """
    return refined(regime_signals(daily_log_returns(spark, d)), thresholds, alphas)


def refined(test: DataFrame, thresholds, alphas) -> DataFrame:
    grid = F.array(*(F.struct(F.lit(len(alphas) * i + j).alias("grid_idx"), F.lit(float(t)).alias("threshold"), F.lit(float(a)).alias("alpha")) for i, t in enumerate(thresholds) for j, a in enumerate(alphas)))
    cells = test.select("symbol", "seq", "ret", "signal", "neutral", F.explode(grid).alias("g")).select("symbol", "seq", "ret", "signal", "neutral", "g.*")
    cells = cells.withColumn("signal", F.when(F.col("neutral") < F.col("threshold"), F.col("signal")).otherwise(0.0))
    cells = cells.withColumn("cell", F.concat_ws("#", "symbol", "grid_idx"))

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable")
        a, s = float(rows["alpha"].iloc[0]), rows["signal"].to_numpy(float)
        return rows[["cell", "symbol", "grid_idx", "threshold", "alpha", "seq", "ret"]].assign(signal=np.clip(S.linear_recurrence(s[0], 1 - a, a * s[1:]), -1, 1))

    smoothed = cells.drop("neutral").groupBy("cell").applyInPandas(smooth, "cell string, symbol string, grid_idx int, threshold double, alpha double, seq int, ret double, signal double")
    scored = BT.metrics(BT.backtest(smoothed, key="cell"), "cell", "symbol", "grid_idx", "threshold", "alpha").drop("cell")
    w = Window.partitionBy("symbol")
    scored = scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc_nulls_last("sharpe"), "grid_idx")))
    best = {c: F.max(F.when(F.col("rank") == 1, F.col(c))).over(w) for c in ("threshold", "alpha")}
    own = lambda c: F.col(c) == best[c]
    none = {c: F.col(c) == 1.0 for c in best}
    part = F.when(F.col("rank") == 1, "combined").when(none["threshold"] & none["alpha"], "baseline").when(own("threshold") & none["alpha"], "zone").when(none["threshold"] & own("alpha"), "smoothing")
    return scored.withColumn("part", part)


def configured(spark, d, configurations=CONFIGURATIONS) -> DataFrame:
    """Metrics of the vote and of holding for each configuration: a series and a span of days, fitted on its own first part."""
    every = F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in zip(("label", "series", "first", "last"), row, strict=True))) for row in configurations))
    prices = M.daily(spark, d).withColumn("c", F.explode(F.filter(every, lambda x: x["series"] == F.col("symbol"))))
    prices = prices.where((F.col("dt") >= F.col("c.first").cast("date")) & (F.col("dt") <= F.col("c.last").cast("date"))).select(F.col("c.label").alias("symbol"), "dt", "close")
    test = regime_signals(P.log_returns(P.sequenced(prices, "dt"), "close"), 3, 2, 30, 100)
    return compared(test, {"vote": (F.col("signal"), 5), "hold": (F.lit(1.0), 0.0)})


def robustness(spark, d):
    rows = configured(spark, d)
    vote = rows.where("strategy = 'vote'").select("symbol", "sharpe", "max_drawdown")
    hold = rows.where("strategy = 'hold'").select("symbol", F.col("sharpe").alias("benchmark_sharpe"), F.col("max_drawdown").alias("benchmark_drawdown"))
    return R.window_summary(vote.join(hold, "symbol"))


def autocorrelation(spark, d):
    """(symbol, kind, at, value) of session log returns: first autocorrelation, Ljung-Box and its p-value, signal to noise and yearly
    deviation at six frequencies; variance ratios at ten horizons; the minutes of the largest and least mean absolute return.
    """
    rets = P.log_returns(session_prices(spark, d)).withColumn("day", F.to_date("ts")).select("symbol", "seq", "ts", "day", "ret")

    def long(df: DataFrame, symbol: str, at: Column, *kinds: str) -> DataFrame:
        structs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("value")) for k in kinds))).alias("v")
        return df.select(F.col(symbol).alias("symbol"), at.cast("string").alias("at"), structs).select("symbol", "v.kind", "at", "v.value")

    # six frequencies are six series of each symbol in one table, which is sorted once for all lags
    frames = ST.sums_at(rets, FREQUENCIES, "day")
    lags = ST.acf(frames, 30, key="series")
    n = F.col("n")
    first = F.max(F.when(F.col("lag") == 1, F.col("acf"))).alias("acf1")
    tests = lags.where("lag > 0").groupBy("series", "n").agg(first, (n * (n + 2) * F.sum(F.when(F.col("lag") < n, F.col("acf") ** 2 / (n - F.col("lag"))))).alias("ljung_box"))
    tests = tests.withColumn("p_value", ST.chi2_tail(F.col("ljung_box"), 30))
    deviation, bars = F.stddev_pop("ret"), F.create_map(*(F.lit(x) for pair in ST.BARS_PER_YEAR.items() for x in pair))
    noise = frames.groupBy("series").agg(F.try_divide(F.abs(F.avg("ret")), deviation).alias("snr"), deviation.alias("__d")).withColumn("annual_vol", F.col("__d") * F.sqrt(F.element_at(bars, F.col("series.freq")).cast("double")))
    rows = long(tests, "series.symbol", F.col("series.freq"), "ljung_box", "p_value", "acf1").unionByName(long(noise, "series.symbol", F.col("series.freq"), "snr", "annual_vol"))
    rows = rows.unionByName(long(ST.variance_ratios(rets, HORIZONS), "symbol", F.col("horizon"), "variance_ratio"))
    return rows.unionByName(long(ST.peaks(ST.seasonality(rets)), "symbol", F.lit("minute"), "peak", "trough"))


PLANS = {
    "plan_exploration": exploration, "plan_model_selection": model_selection, "plan_training": training, "plan_regime_detection": regime_detection,
    "plan_backtest_comparison": backtest_comparison, "plan_em_and_gibbs": em_and_gibbs, "plan_multi_asset": multi_asset,
    "plan_three_or_four_states": three_or_four_states, "plan_split_by_states": split_by_states, "plan_rolling_backtest": rolling_backtest,
    "plan_walkthrough": walkthrough, "plan_signal_refinement": signal_refinement, "plan_configurations": configured, "plan_robustness": robustness, "plan_autocorrelation": autocorrelation,
}
