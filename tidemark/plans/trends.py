"""Whole analyses with filters of level and trend: simulations, baselines, searches over parameters and portfolios.

Standard deviations with `scaled` are percentages of the first price that a filter sees. Sessions have 390 minutes, and a
step of the filter is one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import backtest as BT
from tidemark.operators import hmm as H
from tidemark.operators import prep as P
from tidemark.operators import regimes as R
from tidemark.operators import signals as S
from tidemark.operators import statespace as SS
from tidemark.operators import statistics as ST
from tidemark.plans.common import by_models, compared, daily_log_returns, session_prices
from tidemark.shared import cut

# What the analyses are run with.
DT, MINUTES_OF_A_YEAR, COST_BPS = 1 / 390, 252 * 390, 2
PATHS = {"theta": -0.2, "sigma": 0.3, "sigma_obs": 0.3, "lambda_J": 0.05, "mu_J": 0.0, "sigma_J": 2.0}
JUMPS_ON = {"theta": -0.2, "sigma": 0.35, "sigma_obs": 35.0, "lambda_J": 5.0, "mu_J": 0.0, "sigma_J": 6.0}
JUMPS_OFF = {"theta": -0.2, "sigma": 3.5, "sigma_obs": 35.0, "lambda_J": 0.0, "mu_J": 0.0, "sigma_J": 0.0}
THETAS = (-0.05, -0.1, -0.2, -0.5, -1.0, -2.0)
SIGMAS = (0.005, 0.02, 0.05, 0.15, 0.5, 1.5, 3.5)
SIGMAS_OBS = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 5.0, 35.0)
CONTRACT_GRID = {"window": (4, 15, 30, 60, 120, 240, 390), "sigma_obs": (0.01, 0.1, 1.0, 5.0, 35.0), "theta": (-0.1, -0.2, -0.5, -1.0), "alpha": (0.01, 0.06)}


def jump_detection(spark, d, n: int = 200):
    """Simulated paths with jumps: those found by the filter's trend against the true ones, errors of both filters, and the share of
    particles that jumped at true jumps and elsewhere.
    """
    paths = SS.simulated(spark, 4, 300, PATHS)
    filtered = {kind: SS.particle_filters(paths, PATHS, n, kind, value="obs") for kind in ("rbpf", "bootstrap")}
    found = S.jumps(filtered["rbpf"], "trend").where("is_jump").select("symbol", "seq")
    true = paths.where("jumped").select("symbol", "seq")
    count = lambda df, name: df.groupBy("symbol").agg(F.count("*").alias(name))
    parts = [count(true, "true"), count(found, "found"), count(R.jump_hits(true, found), "hits"), count(R.jump_false_positives(true, found), "false")]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "symbol", "full")
    out = out.na.fill(0)
    error = lambda a, b: F.sqrt(F.avg((F.col(a) - F.col(b)) ** 2))
    for kind, df in filtered.items():
        share = [F.avg(F.when(F.col("jumped") == flag, F.col("jump_share"))).alias(name) for flag, name in ((True, "share_at_jumps"), (False, "share_elsewhere"))] if kind == "rbpf" else []
        out = out.join(df.groupBy("symbol").agg(error("level", "x1").alias(f"{kind}_level_rmse"), error("trend", "x2").alias(f"{kind}_trend_rmse"), *share), "symbol")
    return out


def filtered_on_test(df: DataFrame, kind: str = "rbpf", n: int = 200, fraction: float = 0.7, price: str = "price", jumps: bool = True) -> DataFrame:
    """Filter of log prices over each series' test rows and the row before them, by moments of its own training rows.

    A series of fewer than 3 training rows has no moments and no rows here.
    """
    split = P.train_test_split(df, fraction).withColumn("log_price", F.log(price))
    moments = ST.langevin_moments(split.where("is_train"))
    moments = moments if jumps else moments.withColumn("lambda_J", F.lit(0.0))
    bridge = split.withColumn("__next", F.lead("is_train").over(P.by_time())).where("NOT is_train OR NOT __next").drop("__next", "is_train")
    return SS.particle_filters(bridge.join(moments, "symbol"), None, n, kind, value="log_price", level_var=1.0)


def _traded_daily(filtered: DataFrame) -> DataFrame:
    """Metrics of the soft sign of the trend's changes, and the filter's log-likelihood."""
    ll = filtered.groupBy("symbol").agg(F.sum("ll").alias("ll"))
    return BT.metrics(BT.backtest(S.soft_sign(filtered, "trend", 0.001))).join(ll, "symbol")


def particle_baseline(spark, d, n: int = 200):
    """Bootstrap filter with parameters by moments of each series' training rows, traded on its test rows."""
    return _traded_daily(filtered_on_test(daily_log_returns(spark, d), "bootstrap", n, price="close"))


def particle_trading(spark, d, n: int = 200):
    """Rao-Blackwellised filters with and without jumps, traded on test rows, and what jumps add to the log-likelihood."""
    df = daily_log_returns(spark, d)
    on, off = (_traded_daily(filtered_on_test(df, "rbpf", n, price="close", jumps=jumps)) for jumps in (True, False))
    names = ("sharpe", "annualized_return", "max_drawdown", "turnover", "ll")
    both = on.join(off.select("symbol", *(F.col(c).alias(f"{c}_without") for c in names)), "symbol")
    return both.withColumn("ll_gain", F.col("ll") - F.col("ll_without"))


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test prices, each numbered from 1."""
    rows = P.train_test_split(df, 0.7)
    test = rows.where("NOT is_train").withColumn("seq", F.row_number().over(P.by_time()))
    return rows.where("is_train").drop("is_train"), test.drop("is_train")


def regimes_against_trends(spark, d, n: int = 100):
    """Hidden Markov model and filter on the same test rows: metrics of both and of holding, correlation and agreement of their signals."""
    train, test = _split(session_prices(spark, d))
    models = H.fit(P.simple_returns(train), 3, 10, 200)
    rows = SS.traded(test.select("symbol", "seq", "price"), JUMPS_ON, n, dt=DT, scaled=True).withColumnRenamed("signal", "trend_signal").select("symbol", "seq", "ret", "trend_signal", "n_eff")
    both = by_models(rows, models).withColumnRenamed("signal", "vote")
    named = {"regimes": (F.col("vote"), COST_BPS), "trend": (F.col("trend_signal"), COST_BPS), "hold": (F.lit(1.0), 0.0)}
    about = both.groupBy("symbol").agg(ST.correlation("vote", "trend_signal").alias("correlation"), F.avg((F.signum("vote") == F.signum("trend_signal")).cast("double")).alias("agreement"), F.avg("n_eff").alias("n_eff"), F.sum("gain").alias("regime_ll"))
    return compared(both, named).join(about, "symbol")


def minute_trends(spark, d, n: int = 100):
    """The filter on session prices with and without jumps, from fixed parameters: metrics, and log-likelihoods."""
    _, test = _split(session_prices(spark, d))
    out = None
    for name, parameters in (("jumps", JUMPS_ON), ("no jumps", JUMPS_OFF)):
        rows = SS.traded(test.select("symbol", "seq", "price"), parameters, n, dt=DT, scaled=True)
        named = {name: (F.col("signal"), COST_BPS)} | ({"hold": (F.lit(1.0), 0.0)} if name == "jumps" else {})
        one = compared(rows, named).join(rows.groupBy("symbol").agg(F.sum("ll").alias("ll")), "symbol")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ll", F.when(F.col("strategy") != "hold", F.col("ll")))


def parameter_search(spark, d, sigmas_obs=SIGMAS_OBS, sigmas=SIGMAS, thetas=THETAS, n: int = 20, n_final: int = 100, top: int = 10):
    """Every grid point on training rows with few particles, the best `top` of each series again with more, and its best one on test rows."""
    train, test = _split(session_prices(spark, d))
    grid = R.parameter_grid(spark, sigma_obs=list(sigmas_obs), sigma=list(sigmas), theta=list(thetas))
    options = {"dt": DT, "scaled": True, "alpha": 0.06, "cost_bps": COST_BPS}
    first = SS.evaluated(train, grid, JUMPS_ON, n, **options).withColumnRenamed("sharpe", "train_sharpe_fast")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc_nulls_last("train_sharpe_fast"), "grid_idx"))
    listed = cut(first.withColumn("rank", rank).where(F.col("rank") <= top))  # read three times below
    cells = listed.select("symbol", "grid_idx", "sigma_obs", "sigma", "theta")
    again = SS.evaluated(train, cells, JUMPS_ON, n_final, **options).select("symbol", "grid_idx", F.col("sharpe").alias("train_sharpe"))
    ranked = cut(listed.join(again, ["symbol", "grid_idx"]))
    best = R.best_by(ranked, "train_sharpe", "rank", "symbol").select("symbol", "grid_idx")
    final = SS.evaluated(test, cells.join(best, ["symbol", "grid_idx"]), JUMPS_ON, n_final, **options).select("symbol", "grid_idx", F.col("sharpe").alias("test_sharpe"))
    return ranked.join(final, ["symbol", "grid_idx"], "left")


def portfolio_search(spark, d, sigmas=SIGMAS, thetas=THETAS, n: int = 5, n_final: int = 100, least_rows: int = 20):
    """One grid point for all series, the one of the best mean Sharpe ratio on training rows; each series' ratio on test rows, and the
    mean of their wealth curves aligned at the end.
    """
    train, test = _split(P.min_history(session_prices(spark, d), least_rows))
    grid = R.parameter_grid(spark, sigma=list(sigmas), theta=list(thetas))
    options = {"dt": DT, "scaled": True, "alpha": 0.06, "cost_bps": COST_BPS, "lagged": False, "per_year": MINUTES_OF_A_YEAR}
    scores = SS.evaluated(train, grid, JUMPS_ON, n, **options)
    mean = scores.groupBy("grid_idx", "sigma", "theta").agg(F.avg("sharpe").alias("train_sharpe"))
    best = R.top_k(mean, "train_sharpe", 1, "grid_idx").first()  # of as many rows as the grid has points
    parameters = JUMPS_ON | ({"sigma": best["sigma"], "theta": best["theta"]} if best else {})
    rows = cut(SS.traded(test.select("symbol", "seq", "price"), parameters, n_final, dt=DT, scaled=True).select("symbol", "seq", "ret", "signal"))
    own = _unlagged(rows)
    curve = own.withColumn("wealth", F.product(1 + F.col("net")).over(P.by_time().rowsBetween(Window.unboundedPreceding, 0)))
    nav = P.ended_means(curve, "wealth", 1.0).withColumnRenamed("mean", "net")
    ends = nav.agg(F.min_by("net", "back").alias("final_nav"), F.min("net").alias("least_nav")).withColumn("symbol", F.lit("portfolio"))
    ratio = own.groupBy("symbol").agg(BT.sharpe(F.col("net"), MINUTES_OF_A_YEAR).alias("test_sharpe"), F.count("*").alias("rows"))
    whole = ratio.agg(F.avg("test_sharpe").alias("test_sharpe"), F.max("rows").alias("rows")).withColumn("symbol", F.lit("portfolio")).join(ends, "symbol")
    out = ratio.unionByName(whole, allowMissingColumns=True)
    chosen = {"grid_idx": "int", "sigma": "double", "theta": "double", "train_sharpe": "double"}
    return out.select("*", *(F.lit(best[c] if best else None).cast(kind).alias(c) for c, kind in chosen.items()))


def _with_parameters(test: DataFrame, cells: DataFrame, fixed: dict[str, float]) -> DataFrame:
    """test(symbol, seq, price) with each series' parameters: its own in cells, else those of JUMPS_ON and fixed."""
    own = [c for c in cells.columns if c not in ("symbol", "grid_idx")]
    rows = test.select("symbol", "seq", "price").join(cells.select("symbol", *own), "symbol")
    for name, value in ({**JUMPS_ON, **fixed}).items():
        rows = rows if name in own else rows.withColumn(name, F.lit(float(value)))
    return rows


def _unlagged(rows: DataFrame) -> DataFrame:
    """rows with net: the signal on its own row's return, after costs on its changes."""
    change = F.abs(F.col("signal") - F.coalesce(F.lag("signal").over(P.by_time()), F.lit(0.0)))
    return rows.withColumn("net", F.col("signal") * F.col("ret") - change * COST_BPS / 1e4)


def contract_search(spark, d, grid=None, n: int = 3, n_final: int = 100, last_rows: int = 100_000, least_rows: int = 20):
    """Each series' own best grid point on its last training rows; those with a positive ratio (else the best five) on test rows, and the
    portfolio of their mean returns aligned at the end, with that of holding.
    """
    train, test = _split(P.min_history(session_prices(spark, d), least_rows))
    grid = R.parameter_grid(spark, **{k: list(v) for k, v in (grid or CONTRACT_GRID).items()})
    base = JUMPS_ON | {"sigma": 0.5}
    options = {"dt": DT, "scaled": True, "cost_bps": COST_BPS}
    found = SS.evaluated(P.tail_slice(train, last_rows), grid, base, n, **options).withColumnRenamed("sharpe", "train_sharpe")
    best = cut(P.survivors(R.best_by(found, "train_sharpe", "grid_idx", "symbol"), "train_sharpe", 5, "symbol"))
    cells = best.select("symbol", "grid_idx", "window", "sigma_obs", "theta", "alpha")
    tested = SS.evaluated(test, cells, base, n_final, **options).select("symbol", F.col("sharpe").alias("test_sharpe"))
    own = best.join(tested, "symbol", "left").select("symbol", "window", "sigma_obs", "theta", "alpha", "train_sharpe", "test_sharpe")
    traded = SS.traded(_with_parameters(test, cells, {"sigma": 0.5}), None, n_final, dt=DT, scaled=True)
    rows = cut(_unlagged(traded.select("symbol", "seq", "ret", "signal")).select("symbol", "seq", "ret", "net"))
    out = own.withColumn("final_nav", F.lit(None).cast("double")).withColumn("max_drawdown", F.lit(None).cast("double"))
    for name, value in (("portfolio", "net"), ("hold", "ret")):
        mean = P.ended_means(rows, value, 0.0).withColumnRenamed("mean", "net")
        curve = mean.select(F.lit(name).alias("symbol"), (-F.col("back")).alias("seq"), "net")  # one row for each time
        curve = BT.drawdowns(curve.withColumn("cumulative", F.product(1 + F.col("net")).over(P.by_time().rowsBetween(Window.unboundedPreceding, 0))))
        ends = curve.groupBy("symbol").agg(BT.sharpe(F.col("net"), MINUTES_OF_A_YEAR).alias("test_sharpe"), F.max_by("cumulative", "seq").alias("final_nav"), (-F.min("drawdown")).alias("max_drawdown"))
        out = out.unionByName(ends, allowMissingColumns=True)
    return out


PLANS = {
    "plan_jump_detection": jump_detection, "plan_particle_baseline": particle_baseline, "plan_particle_trading": particle_trading,
    "plan_regimes_against_trends": regimes_against_trends, "plan_minute_trends": minute_trends, "plan_parameter_search": parameter_search,
    "plan_portfolio_search": portfolio_search, "plan_contract_search": contract_search,
}
