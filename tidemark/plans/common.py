"""Series, fits and comparison tables that the plans share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numerics as N
from tidemark.operators import backtest as BT
from tidemark.operators import hmm as H
from tidemark.operators import prep as P
from tidemark.shared import cut
from tidemark.sources import market as M


def daily_log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.log_returns(P.sequenced(M.daily(spark, sf_dir), "dt"), "close")


def session_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the regular session, numbered in each series."""
    return P.sequenced(P.filter_rth(M.ticks(spark, sf_dir)), "ts", "event_id")


def by_models(df: DataFrame, models: DataFrame, value: str = "ret") -> DataFrame:
    """df (symbol, seq, value) with each series' own model of models(symbol, A, pi, mu, sigma2) run over it: prediction, neutral
    (probability of the middle state), state (most likely path), signal (weighted vote) and gain (log-likelihood of the row).

    Series and models meet by symbol in a cogroup, so no model passes through the driver.
    """
    names = df.columns

    def per_series(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or model.empty:
            return rows.iloc[:0].assign(prediction=0.0, neutral=0.0, state=0, signal=0.0, gain=0.0)
        rows, m = rows.sort_values("seq", kind="stable"), model.iloc[0]
        A, pi, mu, sigma2 = np.array([list(x) for x in m["A"]]), *(np.array(m[c], float) for c in ("pi", "mu", "sigma2"))
        log_b = N.emissions(rows[value].to_numpy(float), mu, sigma2)
        probs, gain = N.forward(log_b, A, pi)
        prior = np.vstack([pi, probs[:-1] @ A])
        return rows[names].assign(prediction=prior @ mu, neutral=probs[:, len(mu) // 2], state=N.viterbi(log_b, A, pi)[0], signal=np.clip(probs @ np.sign(mu), -1, 1), gain=gain)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    given = models.select(*(F.col(c).alias(c) for c in ("symbol", "A", "pi", "mu", "sigma2")))  # columns of its own, where it comes from df
    return df.groupBy("symbol").cogroup(given.groupBy("symbol")).applyInPandas(per_series, f"{fields}, prediction double, neutral double, state int, signal double, gain double")


def regime_signals(df: DataFrame, k: int = 3, successes: int = 10, attempts: int = 150, max_iter: int = 200, fraction: float = 0.7, seed: int = 42) -> DataFrame:
    """by_models() of each series' test rows, the model fitted on its training rows; seq starts at 1 again. Checkpointed, as plans
    read it more than once."""
    split = P.train_test_split(df, fraction)
    models = H.fit_retried(split.where("is_train"), [k], successes, attempts, max_iter, seed=seed)
    return cut(by_models(split.where("NOT is_train").drop("is_train"), models).withColumn("seq", F.row_number().over(P.by_time())))


def compared(df: DataFrame, named: dict[str, tuple]) -> DataFrame:
    """Metrics of several signals on the same rows: named gives a column and its costs for each strategy.

    Strategies are rows before the backtest, so df is made once, whatever their number.
    """
    each = F.array(*(F.struct(F.lit(name).alias("strategy"), signal.cast("double").alias("signal"), F.lit(float(cost)).alias("cost_bps")) for name, (signal, cost) in named.items()))
    rows = df.select("symbol", "seq", "ret", F.explode(each).alias("s")).select(F.struct("symbol", "s.strategy").alias("series"), "seq", "ret", "s.signal", "s.cost_bps")
    found = BT.metrics(BT.backtest(rows, F.col("cost_bps"), key="series"), "series")
    return found.select("series.symbol", *(c for c in found.columns if c != "series"), "series.strategy")


def strategies(test: DataFrame, cost_bps: float = 5) -> DataFrame:
    """Metrics of the vote, of the prediction's sign and of holding, for each series."""
    return compared(test, {"vote": (F.col("signal"), cost_bps), "sign": (F.signum("prediction"), cost_bps), "hold": (F.lit(1.0), 0.0)})
