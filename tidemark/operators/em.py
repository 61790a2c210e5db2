"""EM of series that are larger than a task: the expectation is a job over blocks of time, and Spark adds up its sums.

Blocks of values are kept once, in the shared folder, a row each. An iteration is: products of each block's transitions under all
restarts' models at once; scans of them in both directions (scans.prefixes); sums of every block's posteriors, added up by key on
the map side first; and the new parameters, a row for each series, checkpointed. Restarts share one axis. A restart whose
likelihood moved by less than tol keeps its parameters; the loop ends when all have. The driver sees one number an iteration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import numerics as N
from tidemark.operators import scans
from tidemark.operators.hmm import FIT, _best, seed_of
from tidemark.shared import cut


class _Models:
    """Parameters of all restarts of a series, as one flat array and back."""

    def __init__(self, k: int, restarts: int):
        self.shapes = {"A": (restarts, k, k), "pi": (restarts, k), "mu": (restarts, k), "sigma2": (restarts, k)}

    def flat(self, *parts: np.ndarray) -> np.ndarray:
        return np.concatenate([np.asarray(x, float).ravel() for x in parts])

    def of(self, flat) -> list[np.ndarray]:
        sizes = [int(np.prod(s)) for s in self.shapes.values()]
        return [x.reshape(s) for x, s in zip(np.split(np.asarray(flat, float), np.cumsum(sizes)[:-1]), self.shapes.values(), strict=True)]


def _per_row(f, columns: list[str]):
    def per_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame([f(r) for r in frame.to_dict("records")])[columns]

    return per_batch


def packed(df: DataFrame, value: str = "ret", key: str = "symbol", block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """(key, __block, obs, n, ahead): a row for each block with its values in order, and how many values the series has ahead of it."""
    one = lambda rows: pd.DataFrame({key: rows[key].iloc[:1], "__block": rows["__block"].iloc[:1], "obs": [rows[value].to_numpy(float)], "n": [len(rows)]})
    blocks = cut(scans.by_runs(scans.blocked(df.select(key, "seq", value), block_rows), [key, "__block"], ["seq"], one, f"{scans.kind_of(df, key)}, __block long, obs array<double>, n long"))
    ahead = F.sum("n").over(Window.partitionBy(key).orderBy("__block")) - F.col("n")
    counts = blocks.select(F.col(key).alias("__of"), F.col("__block").alias("__at"), ahead.alias("ahead"))
    return blocks.join(counts, F.col(key).eqNullSafe(F.col("__of")) & (F.col("__block") == F.col("__at"))).drop("__of", "__at")


def _joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner", block: bool = False) -> DataFrame:
    """left with right's other columns; keys that are null are equal."""
    right = right.withColumnRenamed(key, "__of")
    on = F.col(key).eqNullSafe(F.col("__of"))
    if block:
        right = right.withColumnRenamed("__block", "__at")
        on = on & (F.col("__block") == F.col("__at"))
    return left.join(right, on, how).drop("__of", "__at")


def _started(blocks: DataFrame, models: _Models, k: int, restarts: int, seed: int, min_variance: float, key: str) -> DataFrame:
    """(key, model): every restart's random start, the same as for a series in one task."""
    kind = scans.kind_of(blocks, key)
    seeds = lambda name: N.seed_list(seed_of(seed, name, k), restarts)
    sizes = blocks.groupBy(key).agg(F.sum("n").alias("total"))

    def taken(r: dict) -> dict:
        """Values of the block's rows that some restart draws, with the draw's number."""
        at = np.concatenate([N.start_draws(int(r["total"]), k, s)[1] for s in seeds(r[key])])
        mine = np.flatnonzero((at >= r["ahead"]) & (at < r["ahead"] + r["n"]))
        obs = np.asarray(r["obs"])
        return {key: r[key], "draws": mine, "values": obs[at[mine] - int(r["ahead"])], "n": len(obs), "mean": obs.mean(), "m2": ((obs - obs.mean()) ** 2).sum()}

    drawn = _joined(blocks, sizes, key).mapInPandas(_per_row(taken, [key, "draws", "values", "n", "mean", "m2"]), f"{kind}, draws array<int>, values array<double>, n long, mean double, m2 double")
    mean = (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean")
    whole = drawn.groupBy(key).agg(mean, F.sum("n").alias("n"))
    spread = _joined(drawn.select(key, F.col("mean").alias("own"), F.col("n").alias("rows"), "m2"), whole, key).groupBy(key).agg((F.sum(F.col("m2") + F.col("rows") * (F.col("own") - F.col("mean")) ** 2) / F.first("n")).alias("variance"), F.first("n").alias("n"))
    values = drawn.select(key, F.explode(F.arrays_zip("draws", "values")).alias("v")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("v.draws", "v.values"))), lambda x: x["values"]).alias("values"))

    def begun(r: dict) -> dict:
        draws = [N.start_draws(int(r["n"]), k, s) for s in seeds(r[key])]
        mu = np.sort(np.asarray(r["values"]).reshape(restarts, k), axis=1)
        sigma2 = max(r["variance"], min_variance) * np.array([d[2] for d in draws])
        return {key: r[key], "model": models.flat(np.array([d[0] for d in draws]), np.full((restarts, k), 1 / k), mu, sigma2), "active": [True] * restarts, "history": [[] for _ in range(restarts)]}

    return _joined(values, spread, key).mapInPandas(_per_row(begun, [key, "model", "active", "history"]), f"{kind}, model array<double>, active array<boolean>, history array<array<double>>")


def fits_split(df: DataFrame, k: int = 3, restarts: int = 10, max_iter: int = 200, tol: float = 1e-6, seed: int = 42, min_variance: float = 1e-8, value: str = "ret", key: str = "symbol", block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """(key, k, restart, model, ll, n_iter, history), as hmm.fits() gives for one k, with every expectation spread over blocks of time."""
    models, kind = _Models(k, restarts), scans.kind_of(df, key)
    blocks = cut(packed(df, value, key, block_rows))
    now = cut(_started(blocks, models, k, restarts, seed, min_variance, key))

    def transfer(r: dict) -> dict:
        A, _, mu, sigma2 = models.of(r["model"])
        return {key: r[key], "__block": r["__block"], "__element": N.chained(N.emissions(np.asarray(r["obs"]), mu, sigma2), A)[0].ravel()}

    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a.reshape(restarts, k, k) @ b.reshape(restarts, k, k)
        return (x / np.maximum(x.max(axis=(1, 2), keepdims=True), 1e-300)).ravel()

    def expected(r: dict) -> dict:
        A, pi, mu, sigma2 = models.of(r["model"])
        obs, carry = np.asarray(r["obs"]), [None if x is None else np.asarray(x).reshape(restarts, k, k) for x in (r["before"], r["behind"])]
        start = pi if carry[0] is None else (pi[:, None] @ carry[0])[:, 0]
        gamma, xi, gain = N.smoothed_steps(N.emissions(obs, mu, sigma2), A, start / start.sum(axis=1, keepdims=True), None if carry[1] is None else carry[1].sum(axis=2))
        away = obs[:, None] - mu[:, None]
        first = gamma[:, 0] if carry[0] is None else np.zeros((restarts, k))
        return {key: r[key], "sums": models.flat(gain.sum(axis=1), first, gamma.sum(axis=1), (gamma * away).sum(axis=1), (gamma * away**2).sum(axis=1), xi)}

    def maximised(r: dict) -> dict:
        A, pi, mu, sigma2 = models.of(r["model"])
        sums = np.asarray(r["sums"])
        ll, rest = sums[:restarts], sums[restarts:]
        first, weight, y, yy = rest[: 4 * restarts * k].reshape(4, restarts, k)
        xi = rest[4 * restarts * k :].reshape(restarts, k, k)
        weight, shift = np.maximum(weight, 1e-15), y / np.maximum(weight, 1e-15)
        moves = xi / np.maximum(xi.sum(axis=2, keepdims=True), 1e-300)
        new = moves / moves.sum(axis=2, keepdims=True), first / first.sum(axis=1, keepdims=True), mu + shift, np.maximum(yy / weight - shift**2, min_variance)
        active = np.asarray(r["active"], bool)
        history = [list(h) + ([float(x)] if on else []) for h, x, on in zip(r["history"], ll, active, strict=True)]
        parts = [np.where(active.reshape(-1, *[1] * (old.ndim - 1)), x, old) for x, old in zip(new, (A, pi, mu, sigma2), strict=True)]
        going = [bool(on and (len(h) < 2 or abs(h[-1] - h[-2]) >= tol)) for on, h in zip(active, history, strict=True)]
        return {key: r[key], "model": models.flat(*parts), "active": going, "history": history}

    for _ in range(max_iter):
        moving = F.exists("active", lambda x: x)
        going = now.where(moving)
        if going.isEmpty():
            break
        met = _joined(blocks.drop("n", "ahead"), going.select(key, "model"), key)
        last = blocks.groupBy(key).agg(F.min("__block").alias("__low"), F.max("__block").alias("__high")).where("__low < __high").select(key)
        element = _joined(met, last, key).mapInPandas(_per_row(transfer, [key, "__block", "__element"]), f"{kind}, __block long, __element array<double>")
        before, behind = (scans.prefixes(element, product, key, way).withColumnRenamed("__carry", name) for way, name in ((False, "before"), (True, "behind")))
        placed = _joined(_joined(met, before, key, "left", block=True), behind, key, "left", block=True)
        sums = placed.mapInPandas(_per_row(expected, [key, "sums"]), f"{kind}, sums array<double>").select(key, F.posexplode("sums"))
        total = sums.groupBy(key, "pos").agg(F.sum("col").alias("sum")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sum"))), lambda x: x["sum"]).alias("sums"))
        stepped = _joined(going, total, key).mapInPandas(_per_row(maximised, [key, "model", "active", "history"]), f"{kind}, model array<double>, active array<boolean>, history array<array<double>>")
        now = cut(stepped.unionByName(now.where(~moving)))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in (r for frame in frames for r in frame.to_dict("records")):
            parts = models.of(r["model"])
            rows = [{key: r[key], "k": k, "restart": n, "ll": h[-1], "n_iter": len(h), "history": h, **{c: v.tolist() for c, v in N.sorted_states(dict(zip(models.shapes, (x[n] for x in parts), strict=True))).items()}} for n, h in enumerate(r["history"])]
            yield pd.DataFrame(rows)[[key, "k", "restart", *(x.split()[0] for x in FIT.split(", "))]]

    return now.mapInPandas(split, f"{kind}, k int, restart int, {FIT}")


def fit_split(df: DataFrame, k: int = 3, key: str = "symbol", **options) -> DataFrame:
    """(key, k, model, ll, n_iter, history), as hmm.fit()."""
    return _best(fits_split(df, k, key=key, **options), key)
