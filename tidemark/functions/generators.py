"""Table functions that simulate series, for SQL and for `lateral` joins on tables of parameters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tidemark.functions import numerics as N


@udtf(returnType="seq int, obs double, x1 double, x2 double, jumped boolean")
class LangevinPath:
    """A jump-diffusion of n rows from (level, 0)."""

    def eval(self, n: int, level: float, theta: float, sigma: float, sigma_obs: float, lambda_j: float, sigma_j: float, seed: int) -> Iterator[tuple]:
        p = {"theta": float(theta), "sigma": float(sigma), "sigma_obs": float(sigma_obs), "lambda_J": float(lambda_j), "mu_J": 0.0, "sigma_J": float(sigma_j)}
        out = N.sampled_langevin(int(n), p, np.array([float(level), 0.0]), int(seed))
        yield from zip(range(1, int(n) + 1), out["obs"].tolist(), out["x"][:, 0].tolist(), out["x"][:, 1].tolist(), out["jumped"].tolist(), strict=True)


@udtf(returnType="seq int, state int, ret double")
class RegimePath:
    """A path of n rows of a hidden Markov model."""

    def eval(self, n: int, A: list, pi: list, mu: list, sigma2: list, seed: int) -> Iterator[tuple]:
        states, obs = N.sampled_hmm(int(n), [list(map(float, r)) for r in A], *(list(map(float, x)) for x in (pi, mu, sigma2)), int(seed))
        yield from zip(range(1, int(n) + 1), states.tolist(), obs.tolist(), strict=True)


@udtf(returnType="seq int, price double")
class TrendingPrices:
    """n prices that grow by drift and normal noise."""

    def eval(self, n: int, start: float, drift: float, deviation: float, seed: int) -> Iterator[tuple]:
        steps = 1 + float(drift) + float(deviation) * np.random.default_rng(int(seed)).standard_normal(int(n))
        yield from enumerate((float(start) * np.cumprod(steps)).tolist(), 1)


def register(spark: SparkSession) -> None:
    """Makes langevin_path, regime_path and trending_prices known to SQL."""
    for name, function in (("langevin_path", LangevinPath), ("regime_path", RegimePath), ("trending_prices", TrendingPrices)):
        spark.udtf.register(name, function)
