"""Kalman and particle filters over many series, and searches over their parameters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.functions import numerics as N
from tidemark.operators import scans
from tidemark.operators.hmm import seed_of
from tidemark.operators.signals import linear_recurrence
from tidemark.shared import cut

PARAMETERS = ("theta", "sigma", "sigma_obs", "lambda_J", "mu_J", "sigma_J")


def kalman_filter(df: DataFrame, theta: float, sigma: float, sigma_obs: float, m0=(None, 0.0), c0=((1.0, 0.0), (0.0, 1.0)), dt: float = 1.0, value: str = "price", key: str = "symbol", block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """df with level, trend, level_var, trend_var and ll; a level prior of None is the series' first value.

    Blocks of block_rows rows run side by side: each is one filtering element, and the product of those before it, on the prior, is
    the prediction that it begins with.
    """
    if theta > 0:
        raise ValueError("theta must not be positive")
    f, q = N.discretized(theta, sigma, dt)
    r = sigma_obs**2

    def element(rows: pd.DataFrame) -> np.ndarray:
        obs = rows[value].to_numpy(float)
        return np.append(N.gaussian_block(obs, f, q, r).flat(), obs[0])

    def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.append(N.followed(N.Gaussian.of(a), N.Gaussian.of(b)).flat(), a[-1])

    def per_block(rows: pd.DataFrame, before: np.ndarray | None) -> pd.DataFrame:
        obs = rows[value].to_numpy(float)
        first = obs[0] if before is None else before[-1]
        start = np.array([first if m0[0] is None else m0[0], m0[1]], float), np.array(c0, float)
        m, c, ll = N.kalman_filter(obs, f, q, r, *(start if before is None else N.moved_on(*start, N.Gaussian.of(before))))
        return rows.assign(level=m[:, 0], trend=m[:, 1], level_var=c[:, 0, 0], trend_var=c[:, 1, 1], ll=ll)

    rows = scans.blocked(df, block_rows)
    carry = scans.scanned(rows, element, combine, key)
    return scans.with_columns(rows, "level double, trend double, level_var double, trend_var double, ll double", per_block, key, [carry])


def prior(first: np.ndarray, p: dict[str, np.ndarray], level_var: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Means (sets, 2) and covariances (sets, 2, 2): the first observation and no trend. The level's variance is a hundredth of
    its square unless given, the trend's the stationary one."""
    m, c = np.zeros((len(first), 2)), np.zeros((len(first), 2, 2))
    m[:, 0] = first
    c[:, 0, 0] = 0.01 * first**2 + 1e-12 if level_var is None else level_var
    c[:, 1, 1] = p["sigma"] ** 2 / np.maximum(2 * np.abs(p["theta"]), 1e-12) + 1e-12
    return m, c


#: Particles of all series that advance together in one task.
STACKED = 1 << 14


def stacked(df: DataFrame, columns: str, per_stack, size: int, key: str = "symbol") -> DataFrame:
    """df's rows with more columns, worked on for `size` whole series at a time: per_stack(list of frames in time order) -> frames.

    Series are dealt to tasks by key and read one after the other, the short ones first, so that those of a stack are about equally
    long; a task holds one stack, whatever the number of series.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), columns])

    def per_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[pd.DataFrame] = []
        parts: list[pd.DataFrame] = []
        for frame in frames:
            frame = frame.drop(columns="__rows")
            change = np.flatnonzero(frame[key].to_numpy()[1:] != frame[key].to_numpy()[:-1]) + 1
            for low, high in zip([0, *change], [*change, len(frame)], strict=True):
                part = frame.iloc[low:high]
                if parts and len(part) and parts[-1][key].iloc[0] != part[key].iloc[0]:
                    done.append(pd.concat(parts))
                    parts = []
                    if len(done) == size:
                        yield from per_stack(done)
                        done = []
                if len(part):
                    parts.append(part)
        if parts:
            done.append(pd.concat(parts))
        if done:
            yield from per_stack(done)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.repartition(tasks, key).withColumn("__rows", F.count("*").over(Window.partitionBy(key)))
    return counted.sortWithinPartitions("__rows", key, "seq").mapInPandas(per_partition, schema)


def _observations(series: list[np.ndarray]) -> np.ndarray:
    """(series, T), NaN behind the end of shorter ones."""
    out = np.full((len(series), max(map(len, series))), np.nan)
    for row, x in zip(out, series, strict=True):
        row[: len(x)] = x
    return out


def particle_filters(df: DataFrame, parameters: dict[str, float] | None, n: int = 100, kind: str = "rbpf", seed: int = 42, value: str = "price", key: str = "symbol", dt: float = 1.0, level_var: float | None = None) -> DataFrame:
    """df with level, trend, their deviations and ll, by a Rao-Blackwellised ('rbpf') or a bootstrap ('bootstrap') filter.

    The former also gives n_eff, the effective number of particles, and jump_share, the weight of particles that jumped.
    Without parameters, each series has its own in df's columns PARAMETERS, the same in all its rows.
    """
    run = {"rbpf": N.rbpf_many, "bootstrap": N.particle_filter_many}[kind]
    more = {"rbpf": {"n_eff": "n_eff", "jump_share": "jumped"}, "bootstrap": {}}[kind]

    def per_stack(frames: list[pd.DataFrame]) -> list[pd.DataFrame]:
        series = [f[value].to_numpy(float) for f in frames]
        p = {c: np.array([float(parameters[c] if parameters else f[c].iloc[0]) for f in frames]) for c in PARAMETERS}
        out = run(_observations(series), p, n, *prior(np.array([x[0] for x in series]), p, level_var), [seed_of(seed, f[key].iloc[0]) for f in frames], dt)
        found = []
        for k, f in enumerate(frames):
            at = slice(0, len(f)), k
            found.append(f.assign(level=out["mean"][at][:, 0], trend=out["mean"][at][:, 1], level_std=out["std"][at][:, 0], trend_std=out["std"][at][:, 1], ll=out["ll"][at], **{a: out[b][at] for a, b in more.items()}))
        return found

    columns = "level double, trend double, level_std double, trend_std double, ll double" + "".join(f", {c} double" for c in more)
    return stacked(df, columns, per_stack, max(1, STACKED // n), key)


def resampled(particles: DataFrame, u: float | Column = 0.5, weight: str = "weight", order: str = "particle", key: str = "symbol", block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """(key, place, particle): systematic resampling of filters of any number of particles, as joins and windows.

    Places 0 to n - 1 stand on a comb of n teeth that begins at u, one number in [0, 1) for all filters or a column; each is taken by
    the particle in whose part of the running weights its tooth falls, so a particle's places follow from the running sum up to it
    and that before it. Sums run within blocks of particles, and then over the blocks' sums: a filter spans as many tasks as it has
    blocks. `order` numbers a filter's particles; weights that are all zero, or null, give no places.
    """
    inside = Window.partitionBy(key, "__block").orderBy("particle")
    held = particles.select(key, F.col(order).alias("particle"), F.col(weight).cast("double").alias("__w"), (u if isinstance(u, Column) else F.lit(float(u))).alias("__u"), F.floor(F.col(order) / block_rows).alias("__block"))
    # what the block's rows had so far, and what it has with each
    summed = held.withColumn("__with", F.sum("__w").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__less", F.coalesce(F.lag("__with").over(inside), F.lit(0.0)))
    blocks = summed.groupBy(F.col(key).alias("__of"), F.col("__block").alias("__at")).agg(F.max("__with").alias("__sum"), F.count("*").alias("__rows"))
    ahead, whole = Window.partitionBy("__of").orderBy("__at"), Window.partitionBy("__of")
    blocks = blocks.withColumn("__through", F.sum("__sum").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("__before", F.coalesce(F.lag("__through").over(ahead), F.lit(0.0))).withColumn("__total", F.max("__through").over(whole)).withColumn("__n", F.sum("__rows").over(whole))
    met = summed.join(blocks, F.col(key).eqNullSafe(F.col("__of")) & (F.col("__block") == F.col("__at"))).where("__total > 0")
    reach = lambda c: F.greatest(F.lit(0), F.least(F.col("__n"), F.floor((F.col("__before") + F.col(c)) * (F.col("__n") / F.col("__total")) - F.col("__u")) + 1))
    # before the first of all particles there is no tooth, whatever u is
    low = F.when(F.col("__before") + F.col("__less") == 0, F.lit(0)).otherwise(reach("__less"))
    taken = met.withColumn("__low", low.cast("long")).withColumn("__high", reach("__with").cast("long")).where("__high > __low")
    return taken.select(key, F.explode(F.expr("sequence(__low, __high - 1)")).alias("place"), "particle")


def trend_signals(trend: np.ndarray, prices: np.ndarray, window: int | np.ndarray = 4, alpha: float | np.ndarray | None = 0.06) -> tuple[np.ndarray, np.ndarray]:
    """(returns, signals) of filtered trends (T, sets) of one series: mean sign of the last `window` trends (0 before there are
    so many); with alpha divided by the running volatility and, over the whole series, its deviation, and clipped.

    A set's signals are NaN where they are flat. Row t has the signal of price t and the return from t to t + 1.
    """
    n, sets = trend.shape
    window, alphas = np.broadcast_to(window, sets), None if alpha is None else np.broadcast_to(alpha, sets)
    total = np.concatenate([np.zeros((1, sets)), np.cumsum(np.sign(trend), axis=0)])
    signal = np.zeros((n, sets))
    for w in np.unique(window):
        mine = np.flatnonzero(window == w)
        if w <= n:
            signal[w - 1 :, mine] = (total[w:, mine] - total[:-w, mine]) / w
    ret = np.diff(prices) / prices[:-1]
    if alphas is not None:
        start = ret[0] ** 2 or ret.var() or 1e-10
        for a in np.unique(alphas):
            mine = np.flatnonzero(alphas == a)
            signal[1:, mine] /= np.sqrt(linear_recurrence(start, 1 - a, a * ret[:-1] ** 2))[:, None]
        deviation = signal[1:].std(axis=0)
        signal[1:] = np.clip(signal[1:] / np.where(deviation > 1e-12, deviation, np.nan), -1, 1)
    else:
        signal[:, ~signal.any(axis=0)] = np.nan
    return ret, signal[:-1]


def sharpe_of(ret: np.ndarray, signal: np.ndarray, cost_bps: float = 0.0, lagged: bool = True, per_year: float = 252) -> np.ndarray:
    """Sharpe ratios of signals (T, sets) on returns; traded a row later, as backtest() does, or at once. NaN for a flat result."""
    held = np.concatenate([np.zeros((1, signal.shape[1])), signal[:-1]]) if lagged else signal
    net = held * ret[:, None] - np.abs(np.diff(held, axis=0, prepend=0.0)) * cost_bps / 1e4
    deviation = net.std(axis=0)
    return np.where(deviation > 1e-12, np.sqrt(per_year) * net.mean(axis=0) / np.where(deviation > 1e-12, deviation, 1), np.nan)


class _Sharpes:
    """What trend_signals() without alpha and sharpe_of() give, from pieces of a series in time order: only the last rows are kept."""

    def __init__(self, windows: np.ndarray, cost_bps: float, lagged: bool, per_year: float):
        sets = len(windows)
        self.windows, self.cost, self.lagged, self.per_year, self.rows = windows, cost_bps / 1e4, lagged, per_year, 0
        self.signs, self.signals, self.price = np.zeros((0, sets)), np.zeros((3, sets)), np.zeros(0)
        self.n, self.mean, self.m2 = 0, np.zeros(sets), np.zeros(sets)
        self.lost, self.flat = np.zeros(sets, bool), np.ones(sets, bool)

    def add(self, prices: np.ndarray, trend: np.ndarray) -> None:
        self.lost |= np.isnan(trend).any(axis=0)
        ahead = len(self.signs)
        signs = np.concatenate([self.signs, np.sign(np.nan_to_num(trend))])
        total = np.concatenate([np.zeros((1, signs.shape[1])), np.cumsum(signs, axis=0)])
        signal = np.zeros(trend.shape)
        for w in np.unique(self.windows):
            mine, begin = np.flatnonzero(self.windows == w), max(0, int(w) - 1 - ahead)
            if begin < len(signal):
                signal[begin:, mine] = (total[ahead + begin + 1 :, mine] - total[ahead + begin + 1 - int(w) : len(total) - int(w), mine]) / w
        self.flat &= ~signal.any(axis=0)
        known = np.concatenate([self.price, prices])
        signals = np.concatenate([self.signals, signal])  # the first is that of the row three before the piece
        ret, last = np.diff(known) / known[:-1], len(signals) - (2 if self.lagged else 1)
        held, before = signals[last - len(ret) : last], signals[last - len(ret) - 1 : last - 1]
        net = held * ret[:, None] - np.abs(held - before) * self.cost
        if len(net):
            mean, n = net.mean(axis=0), self.n + len(net)
            away = mean - self.mean
            self.m2 += ((net - mean) ** 2).sum(axis=0) + away**2 * (self.n * len(net) / n)
            self.mean, self.n = self.mean + away * (len(net) / n), n
        self.signs, self.signals, self.price, self.rows = signs[-int(max(self.windows)) :], signals[-3:], prices[-1:].copy(), self.rows + len(prices)

    def ratios(self) -> np.ndarray:
        """NaN without a result."""
        deviation = np.sqrt(self.m2 / max(self.n, 1))
        known = (deviation > 1e-12) & ~self.lost & ~self.flat & (self.rows >= 3)
        return np.where(known, np.sqrt(self.per_year) * self.mean / np.where(known, deviation, 1), np.nan)


#: Grid points of a series that one task evaluates together, and up to twice as many; doubles of those that are scored together;
#: partitions for each chunk of a grid, so that few chunks share one (groups are few and costly, and their rows so small that Spark
#: would merge partitions).
CELLS, SCORED, SPREAD = 64, 1 << 21, 64


def _dealt(points: list[dict], base: dict[str, float], n: int, cells: int | None = None) -> list[list[dict]]:
    """Points of a grid by tasks. Those without jumps need one particle in place of n, so that more of them go together."""
    alike = [[x for x in points if (float(x.get("lambda_J", base["lambda_J"])) > 0) == jumping] for jumping in (True, False)]
    cells = cells or CELLS
    return [part[low : low + size] for part, size in zip(alike, (cells, cells * max(1, min(n, 8))), strict=True) for low in range(0, len(part), size)]


def _evenly(points: list[dict], base: dict[str, float], n: int) -> list[list[dict]]:
    """_dealt() in chunks of CELLS to twice as many points with jumps, as alike as can be: a step costs as much as some 40 points."""
    jumping = sum(float(x.get("lambda_J", base["lambda_J"])) > 0 for x in points)
    return _dealt(points, base, n, -(-jumping // max(1, jumping // CELLS)) or None)


def _streamed(pieces: Iterable[np.ndarray], p: dict[str, np.ndarray], n: int, first: float, seeds: list, dt: float, sharpes: _Sharpes) -> np.ndarray:
    """Sharpe ratios of the filters' signals, while the series comes in pieces."""
    now: list[np.ndarray] = []

    def noted() -> Iterator[np.ndarray]:
        for piece in pieces:
            now[:] = [piece]
            yield piece

    found: list[np.ndarray] = []
    for _, trend, _, _ in N.rbpf_trends(noted(), p, n, *prior(np.full(len(seeds), first), p), seeds, dt, told=False):
        found.append(trend)
        if sum(map(len, found)) == len(now[0]):  # scored by whole pieces, so that sums do not hang on the points beside
            sharpes.add(now[0], np.concatenate(found))
            found.clear()
    return sharpes.ratios()


def _scores(obs: np.ndarray, p: dict[str, np.ndarray], n: int, seeds: list, dt: float, windows: np.ndarray, alphas: np.ndarray | float | None, cost_bps: float, lagged: bool, per_year: float) -> np.ndarray:
    """Sharpe ratios of the filters' signals, NaN without a result. Signals hang on the trends' signs alone, so a byte is kept for
    each row and point, and a few points are scored at a time."""
    sets = len(seeds)
    signs, lost = np.empty((len(obs), sets), np.int8), np.zeros(sets, bool)
    for first, trend, _, _ in N.rbpf_trends(obs, p, n, *prior(np.full(sets, obs[0]), p), seeds, dt):
        lost |= np.isnan(trend).any(axis=0)
        signs[first : first + len(trend)] = np.sign(np.nan_to_num(trend))
    score, size = np.empty(sets), max(1, SCORED // len(obs))
    for low in range(0, sets, size):
        few = slice(low, low + size)
        score[few] = sharpe_of(*trend_signals(signs[:, few], obs, windows[few], alphas[few] if isinstance(alphas, np.ndarray) else alphas), cost_bps, lagged, per_year)
    return np.where(lost, np.nan, score)


def evaluated(df: DataFrame, grid: DataFrame, base: dict[str, float], n: int = 20, seed: int = 42, value: str = "price", key: str = "symbol", dt: float = 1.0, scaled: bool = False, alpha: float | None = None, window: int = 4, cost_bps: float = 0.0, lagged: bool = True, per_year: float = 252) -> DataFrame:
    """(key, grid_idx, parameters, sharpe) of every series and point of its grid: a task takes one series and CELLS points as one filter.

    grid has grid_idx and any of PARAMETERS, `window` and `alpha`, and key too if series have points of their own. With
    `scaled` the standard deviations are percentages of a series' first price. A point without a result has a null.
    """
    names = [c for c in grid.columns if c not in ("grid_idx", key)]
    kind = df.schema[key].dataType.simpleString()
    series = scans.packed(df, value, key)
    columns = [key, "grid_idx", *names, "sharpe"]

    def per_points(name, pieces: Iterator[np.ndarray], points: list[dict]) -> pd.DataFrame:
        head = next(pieces)
        pieces, first = chain([head], pieces), float(head[0])
        scale = first / 100 if scaled else 1.0
        p = {c: np.array([float(x[c]) if c in names else base[c] for x in points]) * (scale if c in ("sigma", "sigma_obs", "sigma_J") else 1.0) for c in PARAMETERS}
        windows = np.array([int(x["window"]) if "window" in names else window for x in points])
        alphas = np.array([float(x["alpha"]) for x in points]) if "alpha" in names else alpha
        seeds = [seed_of(seed, name, int(x["grid_idx"])) for x in points]
        if alphas is None:
            score = _streamed(pieces, p, n, first, seeds, dt, _Sharpes(windows, cost_bps, lagged, per_year))
        else:  # signals are divided by their deviation over the whole series
            obs = np.concatenate(list(map(np.array, pieces)))
            score = _scores(obs, p, n, seeds, dt, windows, alphas, cost_bps, lagged, per_year) if len(obs) >= 3 else np.full(len(points), np.nan)
        return pd.DataFrame([{key: name, "grid_idx": int(x["grid_idx"]), **{c: float(x[c]) for c in names}, "sharpe": None if np.isnan(s) else float(s)} for x, s in zip(points, score, strict=True)], columns=columns)

    schema = f"{key} {kind}, grid_idx int, {', '.join(f'{c} double' for c in names)}, sharpe double"
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if key in grid.columns:  # points and rows meet in the task, so that no row carries points
        cells = grid.select(*(F.col(c).alias(c) for c in (key, "grid_idx", *names)), F.floor(F.col("grid_idx") / CELLS).cast("int").alias("chunk"))
        held = cells.select(F.col(key).alias("__of"), F.col("chunk").alias("__chunk")).distinct()
        paired = series.join(held, F.col(key) == F.col("__of")).select(key, "__block", "obs", F.col("__chunk").alias("chunk"))

        def per_own(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame(columns=columns)
            rows = rows.sort_values("__block")
            return per_points(rows[key].iloc[0], iter(rows["obs"]), own.sort_values("grid_idx").to_dict("records"))

        paired, cells = (x.repartition(max(tasks, SPREAD), key, "chunk").groupBy(key, "chunk") for x in (paired, cells))
        return paired.cogroup(cells).applyInPandas(per_own, schema)
    # the points are what a caller wrote down, so they go with the task and not through a join
    chunks = _evenly([r.asDict() for r in grid.select("grid_idx", *names).orderBy("grid_idx").collect()], base, n)
    # a partition for each chunk of a series, those of costly chunks first; where there are many series, they are dealt by hash
    series = cut(series)
    place, spread = scans.places(series, key, max(tasks, SPREAD))
    dealt = series.select(key, F.explode(F.array(*map(F.lit, range(len(chunks))))).alias("chunk"), "__block", "obs")
    placed = dealt.repartitionById(spread * len(chunks), (F.col("chunk") * spread + place).cast("int"))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, chunk), pieces in scans.pieces(batches, 2):
            yield pa.RecordBatch.from_pandas(per_points(name, pieces, chunks[chunk]), made, preserve_index=False)

    made = to_arrow_schema(StructType.fromDDL(schema))
    return placed.sortWithinPartitions("chunk", key, "__block").select(key, "chunk", "obs").mapInArrow(per_task, schema)


def grid_search(df: DataFrame, grid: DataFrame, base: dict[str, float], n: int = 20, seed: int = 42, train_fraction: float = 0.7, value: str = "price", key: str = "symbol", **options) -> DataFrame:
    """(key, grid_idx, parameters, train_sharpe) for every series and grid point, on each series' training rows."""
    from tidemark.operators.prep import train_test_split

    train = train_test_split(df, train_fraction, key).where("is_train")
    return evaluated(train, grid, base, n, seed, value, key, **options).withColumnRenamed("sharpe", "train_sharpe")


def searched(df: DataFrame, grid: DataFrame, base: dict[str, float], n: int = 20, seed: int = 42, train_fraction: float = 0.7, value: str = "price", key: str = "symbol", **options) -> DataFrame:
    """A row for each series: its best grid point on training rows, the first of equal ones, evaluated once on its test rows.

    (key, grid_idx, parameters, train_sharpe, test_sharpe, gap).
    """
    from tidemark.operators.prep import train_test_split
    from tidemark.operators.regimes import best_by

    # read twice below, and the search is not to run twice
    best = cut(best_by(grid_search(df, grid, base, n, seed, train_fraction, value, key, **options), "train_sharpe", "grid_idx", key))
    test = train_test_split(df, train_fraction, key).where("NOT is_train")
    names = [c for c in grid.columns if c != "grid_idx"]
    tested = evaluated(test, best.select(key, "grid_idx", *names), base, n, seed + 1, value, key, **options).select(key, F.col("sharpe").alias("test_sharpe"))
    return best.join(tested, key, "left").withColumn("gap", F.col("train_sharpe") - F.col("test_sharpe"))


def traded(df: DataFrame, parameters: dict[str, float] | None, n: int = 100, seed: int = 42, value: str = "price", key: str = "symbol", dt: float = 1.0, scaled: bool = False, window: int = 4, alpha: float | None = 0.06) -> DataFrame:
    """Rows (key, seq, value, ret, signal, trend, ll, n_eff) of each series' filter and signal: ret leads from the row to the next one.

    The last row of a series has no return and goes. Without parameters a series has its own in columns PARAMETERS, window, alpha.
    """

    def per_stack(frames: list[pd.DataFrame]) -> list[pd.DataFrame]:
        series = [f[value].to_numpy(float) for f in frames]
        p = {c: np.array([(parameters[c] if parameters else float(f[c].iloc[0])) * (x[0] / 100 if scaled and c in ("sigma", "sigma_obs", "sigma_J") else 1.0) for f, x in zip(frames, series, strict=True)]) for c in PARAMETERS}
        found_of = np.empty((3, max(map(len, series)), len(series)))
        for first, *results in N.rbpf_trends(_observations(series), p, n, *prior(np.array([x[0] for x in series]), p), [seed_of(seed, f[key].iloc[0]) for f in frames], dt):
            found_of[:, first : first + len(results[0])] = results
        trend, ll, n_eff = found_of
        found = []
        for k, (f, x) in enumerate(zip(frames, series, strict=True)):
            if len(x) < 3:
                continue
            ret, signal = trend_signals(trend[: len(x), k : k + 1], x, window if parameters else int(f["window"].iloc[0]), alpha if parameters else float(f["alpha"].iloc[0]))
            found.append(f.iloc[:-1].assign(ret=ret, signal=np.nan_to_num(signal[:, 0]), trend=trend[: len(x) - 1, k], ll=ll[: len(x) - 1, k], n_eff=n_eff[: len(x) - 1, k]))
        return found

    kept = df.select(key, "seq", value, *([] if parameters else [*PARAMETERS, "window", "alpha"]))
    return stacked(kept, "ret double, signal double, trend double, ll double, n_eff double", per_stack, max(1, STACKED // n), key)


def simulated(spark, n_series: int, n: int, parameters: dict[str, float], x0=(100.0, 0.0), seed: int = 42) -> DataFrame:
    """(symbol, seq, obs, x1, x2, jumped): jump-diffusion paths, each from its own seed."""

    def per_series(rows: pd.DataFrame) -> pd.DataFrame:
        i = int(rows["id"].iloc[0])
        out = N.sampled_langevin(n, parameters, np.array(x0), seed_of(seed, i))
        return pd.DataFrame({"symbol": f"s{i}", "seq": np.arange(1, n + 1), "obs": out["obs"], "x1": out["x"][:, 0], "x2": out["x"][:, 1], "jumped": out["jumped"]})

    return spark.range(n_series).groupBy("id").applyInPandas(per_series, "symbol string, seq long, obs double, x1 double, x2 double, jumped boolean")


def simulated_regimes(spark, n_series: int, n: int, A, pi, mu, sigma2, seed: int = 42) -> DataFrame:
    """(symbol, seq, state, ret): paths of a hidden Markov model."""

    def per_series(rows: pd.DataFrame) -> pd.DataFrame:
        i = int(rows["id"].iloc[0])
        states, obs = N.sampled_hmm(n, A, pi, mu, sigma2, seed_of(seed, i))
        return pd.DataFrame({"symbol": f"s{i}", "seq": np.arange(1, n + 1), "state": states, "ret": obs})

    return spark.range(n_series).groupBy("id").applyInPandas(per_series, "symbol string, seq long, state int, ret double")


def simulated_prices(spark, n_series: int, n: int, drift: float = 0.001, deviation: float = 0.01, start: float = 100.0, seed: int = 42) -> DataFrame:
    """(symbol, seq, price): trending prices, the running product of 1 + drift + normal noise."""

    def per_series(rows: pd.DataFrame) -> pd.DataFrame:
        i = int(rows["id"].iloc[0])
        steps = 1 + drift + deviation * np.random.default_rng(seed_of(seed, i)).standard_normal(n)
        return pd.DataFrame({"symbol": f"s{i}", "seq": np.arange(1, n + 1), "price": start * np.cumprod(steps)})

    return spark.range(n_series).groupBy("id").applyInPandas(per_series, "symbol string, seq long, price double")
