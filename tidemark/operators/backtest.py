"""Backtests, performance metrics and portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prep import by_time
from tidemark.operators.statistics import correlation

YEAR, MINUTES = 252, 390


def backtest(df: DataFrame, cost_bps: float | Column = 5, signal: str = "signal", value: str = "ret", key: str = "symbol") -> DataFrame:
    """df with lagged (the signal before), net return after costs on changes of lagged, and cumulative wealth. Costs may be a column.

    One exchange and one sort serve all columns, and further ones over the same window.
    """
    if not isinstance(cost_bps, Column) and cost_bps < 0:
        raise ValueError("costs must not be negative")
    w = by_time(key)
    before = lambda n: F.coalesce(F.lag(signal, n).over(w), F.lit(0.0))
    out = df.withColumn("lagged", before(1)).withColumn("__lagged2", before(2))
    out = out.withColumn("net", F.col("lagged") * F.col(value) - F.abs(F.col("lagged") - F.col("__lagged2")) * (cost_bps / 1e4)).drop("__lagged2")
    return out.withColumn("cumulative", F.product(1 + F.col("net")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def sharpe(r: Column, per_year: float = YEAR) -> Column:
    deviation = F.stddev_pop(r)
    return F.when(deviation == 0, 0.0).otherwise(F.sqrt(F.lit(float(per_year))) * F.avg(r) / deviation)


def compounded(r: Column) -> Column:
    """Product of 1 + r, rounded to a double once: a running product sticks at the last few doubles above 0, so that it hangs on the order."""
    x = 1 + r
    size = F.exp(F.sum(F.when(x == 0, 0.0).otherwise(F.log(F.abs(x)))))
    return F.when(F.count_if(x == 0) > 0, 0.0).otherwise(F.when(F.count_if(x < 0) % 2 == 1, -size).otherwise(size))


def annualized_return(r: Column) -> Column:
    return F.pow(compounded(r), F.lit(float(YEAR)) / F.count(r)) - 1


def drawdowns(df: DataFrame, curve: str = "cumulative", key: str = "symbol") -> DataFrame:
    """df with drawdown from the curve's maximum so far, which begins with its first value."""
    peak = F.max(curve).over(by_time(key).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("drawdown", F.col(curve) / peak - 1)


def turnovers(df: DataFrame, signal: str = "signal", key: str = "symbol") -> DataFrame:
    """df with change: the absolute change of the signal as given, not lagged; null in the first row."""
    return df.withColumn("change", F.abs(F.col(signal) - F.lag(signal).over(by_time(key))))


def metrics(curve: DataFrame, *keys: str) -> DataFrame:
    """A row of metrics for each series of a backtest."""
    keys = keys or ("symbol",)
    full = turnovers(drawdowns(curve, key=keys[0]), key=keys[0])
    net = F.col("net")
    return full.groupBy(*keys).agg(sharpe(net).alias("sharpe"), annualized_return(net).alias("annualized_return"), (-F.min("drawdown")).alias("max_drawdown"), F.coalesce(F.avg("change"), F.lit(0.0)).alias("turnover"))


def portfolio(curves: DataFrame, on: str = "dt", key: str = "symbol") -> DataFrame:
    """One row of metrics of the equal-weight portfolio of all series of a backtest; turnover is the mean over the whole signal matrix."""
    net = equal_weight(curves, on).withColumn(key, F.lit("portfolio")).withColumn("seq", F.row_number().over(by_time(key, on)))
    net = drawdowns(net.withColumn("cumulative", F.product(1 + F.col("net")).over(by_time(key).rowsBetween(Window.unboundedPreceding, 0))), key=key)
    own = net.groupBy(key).agg(sharpe(F.col("net")).alias("sharpe"), annualized_return(F.col("net")).alias("annualized_return"), (-F.min("drawdown")).alias("max_drawdown"))
    turnover = turnovers(curves, key=key).agg(F.coalesce(F.avg("change"), F.lit(0.0)).alias("turnover")).withColumn(key, F.lit("portfolio"))
    return own.join(turnover, key)


def equal_weight(curves: DataFrame, on: str = "dt") -> DataFrame:
    """Mean net return of all series at each time."""
    return curves.groupBy(on).agg(F.avg("net").alias("net"))


def portfolio_sharpe(df: DataFrame, signal: str = "signal", value: str = "ret", key: str = "symbol") -> DataFrame:
    """Mean of the series' Sharpe ratios of s_{t-1} r_t, by minutes of a trading year; flat series do not count."""
    own = df.withColumn("own", F.lag(signal).over(by_time(key)) * F.col(value)).groupBy(key).agg(F.avg("own").alias("m"), F.stddev_pop("own").alias("d"))
    return own.where("d >= 1e-12").agg(F.avg(F.sqrt(F.lit(float(YEAR * MINUTES))) * F.col("m") / F.col("d")).alias("portfolio_sharpe"))


def signal_stats(df: DataFrame, signal: str = "signal", key: str = "symbol") -> DataFrame:
    s = F.col(signal)
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(key).agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), share(s > 0).alias("long"), share(s < 0).alias("short"), share(s == 0).alias("flat"))


def signal_agreement(df: DataFrame, a: str, b: str, key: str = "symbol") -> DataFrame:
    return df.groupBy(key).agg(correlation(a, b).alias("correlation"), F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("agreement"))
