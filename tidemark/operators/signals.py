"""Features and trading signals: window expressions, and linear recurrences as scans over blocks of time."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import scans
from tidemark.operators.prep import by_time


def normalize_returns(df: DataFrame, window: int = 20, value: str = "ret", key: str = "symbol") -> DataFrame:
    """df with z: rolling z-score by the population deviation; null where the window is not full or constant."""
    if window < 2:
        raise ValueError("window must be 2 or more")
    w = by_time(key).rowsBetween(-(window - 1), 0)
    deviation = F.stddev_pop(value).over(w)
    return df.withColumn("z", F.when((F.count(value).over(w) == window) & (deviation > 0), (F.col(value) - F.avg(value).over(w)) / deviation))


def clip(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def prediction_signal(p: Column, transfer: str = "sign", scale: float = 1.0) -> Column:
    if transfer == "sign":
        return F.signum(p)
    if transfer != "linear":
        raise ValueError("transfer must be 'sign' or 'linear'")
    if scale <= 0:
        raise ValueError("scale must be positive")
    return clip(p / scale)


def vote_signal(probs: Column, mu: Column) -> Column:
    """Sum of state probabilities times the signs of the states' means, clipped."""
    weighted = F.zip_with(probs, mu, lambda p, m: p * F.signum(m))
    return clip(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x))


def no_trade_zone(signal: Column, probs: Column, state: int, threshold: float) -> Column:
    """signal where the neutral state's probability stays under the threshold, else 0."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    return F.when(F.element_at(probs, state + 1) < threshold, signal).otherwise(0.0)


def discretize(c: Column, tick: float) -> Column:
    """c rounded to the grid of tick; halves go to the even multiple."""
    if tick <= 0:
        raise ValueError("tick must be positive")
    return F.rint(c / tick) * tick


def tick_variance_floor(tick: float) -> float:
    return tick * tick / 2


def discretized_log_pmf(x: Column, mu: float, variance: float, tick: float, n_sigma: float = 10) -> Column:
    """Log-probability of x, a multiple of tick, under a Gaussian restricted to the grid within n_sigma deviations."""
    reach = n_sigma * math.sqrt(variance)
    low, high = math.floor((mu - reach) / tick), math.ceil((mu + reach) / tick)
    grid = np.arange(low, high + 1) * tick
    log_z = float(np.log(np.exp(-0.5 * (grid - mu) ** 2 / variance).sum()))
    return -0.5 * F.pow(x - mu, 2) / variance - log_z


def soft_sign(df: DataFrame, value: str, sigma: float, key: str = "symbol") -> DataFrame:
    """df with signal = d / sqrt(d^2 + sigma^2) of the value's changes d, without each first row."""
    d = F.col(value) - F.lag(value).over(by_time(key))
    return df.withColumn("__d", d).where("__d IS NOT NULL").withColumn("signal", F.when((F.col("__d") == 0) & F.lit(sigma == 0), 0.0).otherwise(F.col("__d") / F.sqrt(F.col("__d") ** 2 + sigma**2))).drop("__d")


def fir_momentum(df: DataFrame, value: str, n: int = 4, key: str = "symbol") -> DataFrame:
    """df with signal: mean sign of the last n values, where there are n."""
    if n < 1:
        raise ValueError("n must be positive")
    w = by_time(key).rowsBetween(-(n - 1), 0)
    return df.withColumn("signal", F.avg(F.signum(value)).over(w)).where(F.col("seq") >= n)


def normalized_full(df: DataFrame, value: str, key: str = "symbol") -> DataFrame:
    """df with signal: value over its deviation in the whole series, clipped. It looks ahead."""
    deviation = F.stddev_pop(value).over(Window.partitionBy(key))
    return df.withColumn("signal", F.when(deviation > 0, clip(F.col(value) / deviation)).otherwise(0.0))


def jumps(df: DataFrame, value: str, multiple: float = 2.0, key: str = "symbol") -> DataFrame:
    """df with is_jump: changes beyond a multiple of their deviation in the whole series."""
    d = df.withColumn("__d", F.col(value) - F.lag(value).over(by_time(key)))
    return d.withColumn("is_jump", F.coalesce(F.abs("__d") > multiple * F.stddev_pop("__d").over(Window.partitionBy(key)), F.lit(False))).drop("__d")


def linear_recurrence(start: float, a: float, b: np.ndarray) -> np.ndarray:
    """x_0 = start and x_t = a x_{t-1} + b_t for t from 1; b has one entry less than the result."""
    out = np.empty(len(b) + 1)
    out[0] = x = start
    for t, v in enumerate(b.tolist(), 1):
        out[t] = x = a * x + v
    return out


def _averaged(df: DataFrame, output: str, decay: float, driven: Callable[[pd.DataFrame], np.ndarray], made: Callable[[pd.DataFrame, np.ndarray], np.ndarray], key: str, block_rows: int, initial: float | None = None) -> DataFrame:
    """df with output = made(rows, x), where x has the running average before each row and, at its end, that after the last.

    The average moves by x -> decay x + (1 - decay) u with u = driven(rows), and begins with initial or the series' first u. Rows
    of a block are one affine map, so that blocks of a series are worked on side by side.
    """
    begun = lambda first: first if initial is None else initial

    def element(rows: pd.DataFrame) -> np.ndarray:
        u = driven(rows)
        weights = decay ** np.arange(len(u) - 1, -1, -1.0)
        return np.array([decay ** len(u), (1 - decay) * (weights @ u), u[0]])

    def per_block(rows: pd.DataFrame, before: np.ndarray | None) -> pd.DataFrame:
        u = driven(rows)
        start = begun(u[0]) if before is None else before[0] * begun(before[2]) + before[1]
        return rows.assign(**{output: made(rows, linear_recurrence(start, decay, (1 - decay) * u))})

    rows = scans.blocked(df, block_rows)
    carry = scans.scanned(rows, element, lambda a, b: np.array([a[0] * b[0], b[0] * a[1] + b[1], a[2]]), key)
    return scans.with_columns(rows, f"{output} double", per_block, key, [carry])


def ewma_volatility(df: DataFrame, decay: float = 0.94, value: str = "ret", key: str = "symbol", block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """df with variance: s_0 = r_0^2, s_t = decay s_{t-1} + (1 - decay) r_{t-1}^2; the square before counts, not the own one."""
    if not 0 <= decay < 1:
        raise ValueError("decay must be in [0, 1)")
    return _averaged(df, "variance", decay, lambda rows: rows[value].to_numpy(float) ** 2, lambda _, x: x[:-1], key, block_rows)


def smooth_signal(df: DataFrame, alpha: float, value: str = "signal", key: str = "symbol", block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """df with smooth: exponential average that begins with the first value, clipped at the end."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    return _averaged(df, "smooth", 1 - alpha, lambda rows: rows[value].to_numpy(float), lambda _, x: np.clip(x[1:], -1, 1), key, block_rows)


def igarch_scale(df: DataFrame, alpha: float = 0.06, initial: float | None = None, signal: str = "signal", value: str = "ret", key: str = "symbol", block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """df with position = s_t / sqrt(v_t); only then does v become alpha r_t^2 + (1 - alpha) v. v begins with initial or r_0^2."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be in (0, 1)")

    def scaled(rows: pd.DataFrame, variance: np.ndarray) -> np.ndarray:
        if variance[0] <= 0:
            raise ValueError("the first variance must be positive")
        return rows[signal].to_numpy(float) / np.sqrt(variance[:-1])

    return _averaged(df, "position", 1 - alpha, lambda rows: rows[value].to_numpy(float) ** 2, scaled, key, block_rows, initial)
