"""Structured Streaming in event time: bars with watermarks, and causal recurrences with keyed state.

A recurrence must see its rows in order, and a stream brings them out of order. Rows wait in a buffer of their series, and a timer
is set to the earliest of them. When the watermark (the greatest time so far, less `delay`) has passed it, all rows behind the
watermark are folded in order of time, and go out; so input that is shuffled within `delay` gives what the batch form gives.

A row that comes when a later one of its series has been folded has lost its place. It is not dropped: it goes out with `late` set
and without results, and late_count is how many its series has had. on_time() and late_rows() take the two kinds apart. State is
what the recurrence carries, the buffer, and that count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import numerics as N
from tidemark.operators import statespace as SS
from tidemark.operators.hmm import seed_of
from tidemark.operators.prep import resample_bars

#: How far the watermark stays behind the greatest time so far.
DELAY = "10 minutes"


def streaming_bars(ticks: DataFrame, freq: str, delay: str = "10 minutes") -> DataFrame:
    """Tumbling bars of a stream (symbol, ts, price, size, event_id), final once the watermark has passed them."""
    bars = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    bars = bars.select("symbol", "ts", "event_id", *(F.col("price").alias(c) for c in ("open", "high", "low", "close")), F.col("size").alias("volume"))
    return resample_bars(bars, freq, order=("ts", "event_id"))


class _Recurrence(StatefulProcessor):
    """step(series, state or None, values) -> (state, outputs) along each series, in event time."""

    def __init__(self, step, ts: str, values: tuple[str, ...], outputs: list[str], state_schema: str):
        self.step, self.ts, self.values, self.outputs, self.state_schema = step, ts, values, outputs, state_schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", f"last long, late long, folded boolean, {self.state_schema}")
        self.buffer = handle.getListState("buffer", ", ".join(["at long", *(f"v{k} double" for k in range(len(self.values)))]))

    def _empty(self) -> tuple:
        """State's columns before the first row; they are not read."""
        return tuple(None for _ in self.state_schema.split(", "))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["symbol", "at", *self.outputs, "late", "late_count"])
        frame[self.ts] = pd.to_datetime(frame.pop("at"), unit="us")
        return frame[["symbol", self.ts, *self.outputs, "late", "late_count"]]

    def _waiting(self) -> list[tuple]:
        return [tuple(r) for r in self.buffer.get()]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.carried.get() if self.carried.exists() else (None, 0, False, *self._empty())
        last, late, out, new = held[0], held[1], [], []
        for frame in rows:
            for row in zip(frame["at"].tolist(), *(frame[c].astype(float).tolist() for c in self.values), strict=True):
                if last is not None and row[0] < last:
                    late += 1
                    out.append((key[0], row[0], *[None] * len(self.outputs), True, late))
                else:
                    new.append(row)
        if new:
            self.buffer.appendList(new)
            due = min(r[0] for r in new) // 1000 + 1
            pending = list(self.handle.listTimers())
            if not pending or due < min(pending):
                for t in pending:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(due)
        if out:
            self.carried.update((last, late, *held[2:]))
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.carried.get() if self.carried.exists() else (None, 0, False, *self._empty())
        last, late, now = held[0], held[1], tuple(held[3:]) if held[2] else None
        waiting = sorted(self._waiting(), key=lambda r: r[0])
        ready = [r for r in waiting if r[0] < passed]
        rest = waiting[len(ready) :]
        out = []
        for at, *v in ready:
            last = at
            now, result = self.step(key[0], now, *v)
            out.append((key[0], at, *result, False, late))
        if ready:
            self.carried.update((last, late, True, *now))
            self.buffer.clear()
            if rest:
                self.buffer.put(rest)
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def _folded(stream: DataFrame, output: str, state_schema: str, step, key: str, ts: str, *values: str, delay: str = DELAY) -> DataFrame:
    """(symbol, ts, outputs, late, late_count): step(series, state or None, values) -> (state, outputs) along each series in event time."""
    names = [c.split()[0] for c in output.split(", ")]
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    # times go on as numbers, so that rows behind the watermark reach the processor
    rows = timed.select(F.col(key).alias("symbol"), F.unix_micros(ts).alias("at"), *values)
    processor = _Recurrence(step, ts, values, names, state_schema)
    return rows.groupBy("symbol").transformWithStateInPandas(processor, f"symbol string, {ts} timestamp_ntz, {output}, late boolean, late_count long", "Append", "EventTime")


def on_time(results: DataFrame) -> DataFrame:
    """Rows that were folded in their place, without the marks of late ones."""
    return results.where("NOT late").drop("late", "late_count")


def late_rows(results: DataFrame, ts: str = "ts") -> DataFrame:
    """(symbol, ts, late_count) of the rows that came too late, counted in each series."""
    return results.where("late").select("symbol", ts, "late_count")


def streaming_ewma(stream: DataFrame, decay: float = 0.94, key: str = "symbol", ts: str = "ts", value: str = "ret", delay: str = DELAY) -> DataFrame:
    """The stream form of ewma_volatility: two doubles of state."""

    def step(_, state, r):
        variance = r * r if state is None else decay * state[0] + (1 - decay) * state[1]
        return (variance, r * r), (variance,)

    return _folded(stream, "variance double", "variance double, square double", step, key, ts, value, delay=delay)


def streaming_smooth(stream: DataFrame, alpha: float, key: str = "symbol", ts: str = "ts", value: str = "signal", delay: str = DELAY) -> DataFrame:
    """The stream form of smooth_signal: one double of state, clipped on the way out only."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")

    def step(_, state, s):
        x = s if state is None else (1 - alpha) * state[0] + alpha * s
        return (x,), (min(1.0, max(-1.0, x)),)

    return _folded(stream, "smooth double", "x double", step, key, ts, value, delay=delay)


def streaming_igarch(stream: DataFrame, alpha: float = 0.06, initial: float | None = None, key: str = "symbol", ts: str = "ts", signal: str = "signal", value: str = "ret", delay: str = DELAY) -> DataFrame:
    """The stream form of igarch_scale: the position comes before the variance moves on."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be in (0, 1)")

    def step(_, state, s, r):
        v = state[0] if state is not None else r * r if initial is None else initial
        if v <= 0:
            raise ValueError("the first variance must be positive")
        return (alpha * r * r + (1 - alpha) * v,), (s / v**0.5,)

    return _folded(stream, "position double", "variance double", step, key, ts, signal, value, delay=delay)


def streaming_filter(stream: DataFrame, A, pi, mu, sigma2, key: str = "symbol", ts: str = "ts", value: str = "ret", delay: str = DELAY) -> DataFrame:
    """The stream form of the hidden Markov filter: the probabilities are the state."""
    A, pi, mu, sigma2 = N.checked_model(A, pi, mu, sigma2)
    names = [f"p{k}" for k in range(len(mu))]

    def step(_, state, r):
        prior = pi if state is None else np.array(state) @ A
        log_b = N.log_normal(r, mu, sigma2)
        joint = prior * np.exp(log_b - log_b.max())
        probs = joint / joint.sum()
        return tuple(probs.tolist()), (float(prior @ mu), *probs.tolist())

    columns = ", ".join(f"{n} double" for n in names)
    return _folded(stream, f"prediction double, {columns}", columns, step, key, ts, value, delay=delay)


def streaming_kalman(stream: DataFrame, theta: float, sigma: float, sigma_obs: float, m0=(None, 0.0), c0=((1.0, 0.0), (0.0, 1.0)), dt: float = 1.0, key: str = "symbol", ts: str = "ts", value: str = "price", delay: str = DELAY) -> DataFrame:
    """The stream form of kalman_filter: five doubles of state."""
    q = N.transition(theta, sigma, dt)
    r = sigma_obs**2

    def step(_, state, y):
        belief = N.moved(q, *state) if state is not None else (y if m0[0] is None else m0[0], m0[1], c0[0][0], c0[0][1], c0[1][1])
        x0, x1, c00, c01, c11 = map(float, belief)
        s = c00 + r
        k0, k1, error = c00 / s, c01 / s, y - x0
        x0, x1, keep = x0 + k0 * error, x1 + k1 * error, 1 - k0
        c00, c01, c11 = keep * keep * c00 + k0 * k0 * r, keep * (c01 - k1 * c00) + k0 * k1 * r, c11 - k1 * (2 * c01 - k1 * (c00 + r))
        return (x0, x1, c00, c01, c11), (x0, x1, c00, c11, float(N.log_normal(error, 0.0, s)))

    return _folded(stream, "level double, trend double, level_var double, trend_var double, ll double", "m0 double, m1 double, c00 double, c01 double, c11 double", step, key, ts, value, delay=delay)


def streaming_rbpf(stream: DataFrame, parameters: dict[str, float], n: int = 100, seed: int = 42, dt: float = 1.0, level_var: float | None = None, key: str = "symbol", ts: str = "ts", value: str = "price", delay: str = DELAY) -> DataFrame:
    """The stream form of the Rao-Blackwellised particle filter: five doubles for each particle and a count of steps, from which a
    step's random numbers follow, so that it equals particle_filters() row by row.
    """
    p = {c: np.array([float(parameters[c])]) for c in SS.PARAMETERS}
    model = N.jump_model(p, 1, dt)

    def step(series, state, y):
        t = state[1] if state is not None else 0
        particles = tuple(np.array(state[0]).reshape(5, 1, n)) if state is not None else N.started_particles(*SS.prior(np.array([y]), p, level_var), n)
        particles, now = N.rbpf_step(model, particles, np.array([y]), *N.draws_of_step(seed_of(seed, series), n, t), t == 0)
        return (np.concatenate([x.ravel() for x in particles]).tolist(), t + 1), (*now["mean"][0].tolist(), *now["std"][0].tolist(), float(now["ll"][0]), float(now["n_eff"][0]))

    return _folded(stream, "level double, trend double, level_std double, trend_std double, ll double, n_eff double", "particles array<double>, step long", step, key, ts, value, delay=delay)


def streaming_backtest(stream: DataFrame, cost_bps: float = 5, key: str = "symbol", ts: str = "ts", value: str = "ret", signal: str = "signal", delay: str = DELAY) -> DataFrame:
    """The stream form of backtest: the last two signals and the wealth so far."""

    def step(_, state, r, s):
        lagged, lagged2, wealth = state if state is not None else (0.0, 0.0, 1.0)
        net = lagged * r - abs(lagged - lagged2) * cost_bps / 1e4
        wealth *= 1 + net
        return (s, lagged, wealth), (net, wealth)

    return _folded(stream, "net double, cumulative double", "lagged double, lagged2 double, wealth double", step, key, ts, value, signal, delay=delay)
