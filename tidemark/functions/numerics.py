"""Numerical kernels in numpy, each for one series or for many draws of it at once; operators run them per group."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

LOG_2PI = math.log(2 * math.pi)
FLOOR = 1e-12


def log_sum_exp(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def log_normal(x: np.ndarray, mu: np.ndarray, variance: np.ndarray) -> np.ndarray:
    return -0.5 * (LOG_2PI + np.log(variance) + (x - mu) ** 2 / variance)


def checked_model(A, pi, mu, sigma2) -> tuple[np.ndarray, ...]:
    """Parameters as arrays; rows of A and pi must be positive and sum to one, variances must be positive."""
    A, pi, mu, sigma2 = (np.asarray(x, float) for x in (A, pi, mu, sigma2))
    k = len(pi)
    if A.shape != (k, k) or mu.shape != (k,) or sigma2.shape != (k,):
        raise ValueError("the parameters' shapes do not fit together")
    if (A <= 0).any() or (pi <= 0).any():
        raise ValueError("A and pi must hold strictly positive entries")
    if not np.allclose(A.sum(axis=1), 1, atol=1e-10) or not np.isclose(pi.sum(), 1, atol=1e-10):
        raise ValueError("rows of A and pi must sum to one")
    if (sigma2 <= 0).any():
        raise ValueError("variances must be positive")
    return A, pi, mu, sigma2


# Hidden Markov models. Leading axes, if any, run over independent models (restarts) of the same observations.


def emissions(obs: np.ndarray, mu: np.ndarray, sigma2: np.ndarray) -> np.ndarray:
    """Log-densities, (..., T, K)."""
    return log_normal(obs[:, None], mu[..., None, :], sigma2[..., None, :])


#: Doubles of one array of densities, which says how many lanes and models are worked on together.
WORKING_SET = 1 << 18


class Messages(NamedTuple):
    """Emissions and block transitions of one or more models of a series, time cut into blocks.

    Arrays are (K, steps of a block, models * blocks), so that a step of all blocks and models is one operation on contiguous
    numbers; the last block is padded with rows that say nothing. products: (K, K, models * blocks), each block's transitions
    and emissions multiplied, up to a factor.
    """

    b: np.ndarray
    top: np.ndarray
    A: np.ndarray
    products: np.ndarray
    n: int
    models: int


def messages(log_b: np.ndarray, A: np.ndarray) -> Messages:
    """Of log_b (models, T, K) and A (models, K, K)."""
    models, n, k = log_b.shape
    steps = max(1, int(math.isqrt(n)))
    blocks = -(-n // steps)
    top = log_b.max(axis=-1)
    b = np.ones((models, blocks * steps, k))
    np.exp(log_b - top[..., None], out=b[:, :n])
    b = np.ascontiguousarray(b.reshape(models, blocks, steps, k).transpose(3, 2, 0, 1)).reshape(k, steps, models * blocks)
    A = np.repeat(A.transpose(1, 2, 0), blocks, axis=2)
    products = np.repeat(np.eye(k)[:, :, None], models * blocks, axis=2)
    for t in range(steps if blocks > 1 else 0):
        products = (products[:, :, None] * A[None]).sum(axis=1) * b[None, :, t]
        if t % 8 == 7:
            products /= products.max(axis=(0, 1))
    return Messages(b, top, A, products, n, models)


def filtered_messages(m: Messages, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered probabilities (K, steps, models * blocks), and totals of each step (steps, models * blocks)."""
    k, steps, width = m.b.shape
    blocks = width // m.models
    # what each block begins with: the first one pi itself, the others what the block before ends with
    start = np.empty((k, m.models, blocks))
    start[..., 0] = pi.T
    per_block, A = m.products.reshape(k, k, m.models, blocks), m.A.reshape(k, k, m.models, blocks)[..., 0]
    if blocks > 1:
        end = pi.T  # the first block has no transition before its first row
        first = m.b.reshape(k, steps, m.models, blocks)[..., 0]
        for t in range(steps):
            end = ((end[:, None] * A).sum(axis=0) if t else end) * first[:, t]
            end = end / np.maximum(end.sum(axis=0), 1e-300)
        for j in range(1, blocks):
            start[..., j] = (end[:, None] * A).sum(axis=0)
            end = (end[:, None] * per_block[..., j]).sum(axis=0)
            end = end / np.maximum(end.sum(axis=0), 1e-300)
    prior = start.reshape(k, width)
    filtered, total = np.empty(m.b.shape), np.empty((steps, width))
    for t in range(steps):
        joint = prior * m.b[:, t]
        total[t] = joint.sum(axis=0)
        np.maximum(total[t], 1e-300, out=total[t])
        filtered[:, t] = joint / total[t]
        prior = (filtered[:, t, None] * m.A).sum(axis=0)
    return filtered, total


def _in_time(x: np.ndarray, m: Messages) -> np.ndarray:
    """(..., steps, models * blocks) as (models, T, ...)."""
    *lead, steps, width = x.shape
    x = np.moveaxis(x.reshape(*lead, steps, m.models, width // m.models), (-2, -1, -3), (0, 1, 2))
    return x.reshape(m.models, -1, *lead)[:, : m.n]


def forward(log_b: np.ndarray, A: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered probabilities and the log-likelihood gained at each step, of one model or of several on a leading axis.

    Time is cut into about sqrt(T) blocks: the products of each block's transitions give what it begins with, and then all
    blocks advance together, so that the number of numpy steps grows with sqrt(T).
    """
    single = log_b.ndim == 2
    m = messages(*((x[None] for x in (log_b, A)) if single else (log_b, A)))
    filtered, total = filtered_messages(m, pi[None] if single else pi)
    filtered, gain = _in_time(filtered, m), np.log(_in_time(total, m)) + m.top
    return (filtered[0], gain[0]) if single else (filtered, gain)


def predict_update(probs: np.ndarray, A: np.ndarray, mu: np.ndarray, sigma2: np.ndarray, y: float) -> tuple[np.ndarray, float]:
    """One step of the filter: the probabilities after y, and the prediction made before it."""
    prior = probs @ A
    log_b = log_normal(y, mu, sigma2)
    joint = prior * np.exp(log_b - log_b.max())
    return joint / joint.sum(), float(prior @ mu)


def backward(log_b: np.ndarray, A: np.ndarray) -> np.ndarray:
    """log beta, (..., T, K), with zeros in the last row."""
    out = np.zeros(log_b.shape)
    log_A = np.log(A)
    for t in range(log_b.shape[-2] - 2, -1, -1):
        out[..., t, :] = log_sum_exp(log_A + (log_b[..., t + 1, :] + out[..., t + 1, :])[..., None, :])
    return out


def smoothed_messages(m: Messages, filtered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State posteriors (models, T, K), and the sums over time of the posteriors of transitions (models, K, K)."""
    k, steps, width = m.b.shape
    blocks = width // m.models
    end = np.ones((k, m.models, blocks))  # each block's backward message at its last row
    per_block = m.products.reshape(k, k, m.models, blocks)
    for j in range(blocks - 1, 0, -1):
        x = (per_block[..., j] * end[None, :, :, j]).sum(axis=1)
        end[..., j - 1] = x / np.maximum(x.max(axis=0), 1e-300)
    beta = end.reshape(k, width)
    gamma, ahead = np.empty(m.b.shape), np.empty(m.b.shape)
    for t in range(steps - 1, -1, -1):
        joint = filtered[:, t] * beta
        gamma[:, t] = joint / np.maximum(joint.sum(axis=0), 1e-300)
        ahead[:, t] = w = m.b[:, t] * beta
        beta = (m.A * w[None]).sum(axis=1)
        beta = beta / np.maximum(beta.max(axis=0), 1e-300)
    gamma, f, w = (_in_time(x, m) for x in (gamma, filtered, ahead))
    f, w = f[:, :-1], w[:, 1:]
    A = m.A.reshape(k, k, m.models, blocks)[..., 0].transpose(2, 0, 1)
    norm = np.maximum(((f @ A) * w).sum(axis=-1, keepdims=True), 1e-300)
    return gamma, A * ((f / norm).transpose(0, 2, 1) @ w)


def smoothed_steps(log_b: np.ndarray, A: np.ndarray, pi: np.ndarray, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State posteriors, the sum over time of the posteriors of transitions (never all of them at once), and the log-likelihood
    gained at each step, of one model or of several on a leading axis.

    For a block of a longer series pi is the prediction for its first row, and `after` what all rows behind the block say about the
    state at the first of them, up to a factor; the transition to that row counts.
    """
    single = log_b.ndim == 2
    if single:
        log_b, A, pi = log_b[None], A[None], pi[None]
        after = None if after is None else after[None]
    n = log_b.shape[1]
    if after is not None:  # it acts as one more row
        with np.errstate(divide="ignore"):
            log_b = np.concatenate([log_b, np.log(after)[:, None]], axis=1)
    m = messages(log_b, A)
    filtered, total = filtered_messages(m, pi)
    gamma, xi = smoothed_messages(m, filtered)
    gain = (np.log(_in_time(total, m)) + m.top)[:, :n]
    return (gamma[0, :n], xi[0], gain[0]) if single else (gamma[:, :n], xi, gain)


def smoothed(log_b: np.ndarray, A: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As smoothed_steps(), with the log-likelihood of all steps."""
    gamma, xi, gain = smoothed_steps(log_b, A, pi)
    return gamma, xi, gain.sum(axis=-1)


def chained(log_b: np.ndarray, A: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Product over time of (densities of the row, then a transition), (..., K, K) with greatest entry 1, and the logarithm of its
    factor. Halves are multiplied first, so that numpy takes log T steps."""
    top = log_b.max(axis=-1)
    x, scale = np.exp(log_b - top[..., None])[..., None] * A[..., None, :, :], top.sum(axis=-1)
    while x.shape[-3] > 1:
        odd = x[..., -1:, :, :] if x.shape[-3] % 2 else None
        x = x[..., 0 : x.shape[-3] // 2 * 2 : 2, :, :] @ x[..., 1::2, :, :]
        most = np.maximum(x.max(axis=(-2, -1)), 1e-300)
        x, scale = x / most[..., None, None], scale + np.log(most).sum(axis=-1)
        x = x if odd is None else np.concatenate([x, odd], axis=-3)
    x = x[..., 0, :, :]
    most = np.maximum(x.max(axis=(-2, -1)), 1e-300)
    return x / most[..., None, None], scale + np.log(most)


def best_chained(log_b: np.ndarray, log_A: np.ndarray) -> np.ndarray:
    """Greatest sums over paths through the rows, (..., K, K): from entering the first row in a state to entering the row behind."""
    x = log_b[..., None] + log_A
    while (n := x.shape[-3]) > 1:
        pairs = (x[..., 0 : n // 2 * 2 : 2, :, :, None] + x[..., 1::2, None, :, :]).max(axis=-2)
        x = np.concatenate([pairs, x[..., n // 2 * 2 :, :, :]], axis=-3)
    return x[..., 0, :, :]


def m_step(obs: np.ndarray, gamma: np.ndarray, xi: np.ndarray, min_variance: float = 1e-8) -> tuple[np.ndarray, ...]:
    weight = np.maximum(gamma.sum(axis=-2), 1e-15)
    mu = (gamma * obs[:, None]).sum(axis=-2) / weight
    sigma2 = np.maximum((gamma * (obs[:, None] - mu[..., None, :]) ** 2).sum(axis=-2) / weight, min_variance)
    A = xi / np.maximum(xi.sum(axis=-1, keepdims=True), 1e-300)
    return A / A.sum(axis=-1, keepdims=True), gamma[..., 0, :] / gamma[..., 0, :].sum(axis=-1, keepdims=True), mu, sigma2


def start_draws(n: int, k: int, seed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random transitions of a model, the rows (of n) whose values are its means, and factors of its variances."""
    rng = np.random.default_rng(seed)
    a = np.maximum(rng.dirichlet(np.ones(k), k) * 0.2 + 0.8 * np.eye(k) if k > 1 else np.ones((1, 1)), FLOOR)
    return a / a.sum(axis=-1, keepdims=True), rng.integers(0, n, k), rng.uniform(0.5, 1.5, k)


def started(lanes: Lanes, k: int, seeds: list, min_variance: float = 1e-8) -> tuple[np.ndarray, ...]:
    """Random A, pi, mu, sigma2 of a model for each seed."""
    A, at, factors = (np.array(x) for x in zip(*(start_draws(lanes.n, k, seed) for seed in seeds), strict=True))
    return A, np.full((len(seeds), k), 1 / k), np.sort(lanes.at(at), axis=1), max(lanes.variance(), min_variance) * factors


#: Rows of a lane, and lanes, times models, that shorter ones are cut for; lanes of a series, beyond which they get longer; bytes of
#: values from which on a series lies in a file.
LANE, LANES, MOST_LANES, IN_MEMORY = 64, 1024, 1 << 16, 1 << 24


class Lanes:
    """A series cut into lanes of equal length that advance side by side. Its n values lie in time order in memory or, if it is long,
    in a file without a name, from which a stack of lanes is read at a time."""

    def __init__(self, pieces: Iterable[np.ndarray], n: int, models: int):
        """From n values in pieces of time."""
        self.n, self.steps = n, max(min(LANE, max(8, n * models // LANES)), n // MOST_LANES)
        self.count = -(-n // self.steps)
        self.tail = n - (self.count - 1) * self.steps  # rows of the last lane
        self.file, self.least, self.greatest, total, found = tempfile.SpooledTemporaryFile(IN_MEMORY), math.inf, -math.inf, 0.0, 0
        for piece in filter(len, pieces):
            self.file.write(np.ascontiguousarray(piece, float).tobytes())
            self.least, self.greatest, total, found = min(self.least, piece.min()), max(self.greatest, piece.max()), total + piece.sum(), found + len(piece)
        if found != n:
            raise ValueError(f"there are {found} values in place of {n}")
        self.mean = total / n if n else math.nan

    def values(self, low: int, high: int) -> np.ndarray:
        self.file.seek(8 * low)
        return np.frombuffer(self.file.read(8 * (min(high, self.n) - low)))

    def part(self, low: int, high: int) -> np.ndarray:
        """Lanes as columns, (steps, lanes), with zeros behind the series' end."""
        x = self.values(low * self.steps, high * self.steps)
        x = np.concatenate([x, np.zeros((high - low) * self.steps - len(x))]) if high == self.count else x
        return np.ascontiguousarray(x.reshape(high - low, self.steps).T)

    def at(self, rows: np.ndarray) -> np.ndarray:
        return np.array([self.values(t, t + 1)[0] for t in rows.ravel().tolist()]).reshape(rows.shape)

    def variance(self) -> float:
        return sum(float(((self.values(low, low + WORKING_SET) - self.mean) ** 2).sum()) for low in range(0, self.n, WORKING_SET)) / self.n


class Densities:
    """Densities of lanes' rows under several models, (steps, models, K, lanes), up to a factor for each row.

    It is the greatest density of any state, or, if a row may lie far from all states, the row's own greatest one.
    """

    def __init__(self, lanes: Lanes, mu: np.ndarray, sigma2: np.ndarray):
        peak = -0.5 * (LOG_2PI + np.log(sigma2))
        self.most = peak.max(axis=1)
        self.lanes, self.mu, self.slope, self.level = lanes, mu[:, :, None], (-0.5 / sigma2)[:, :, None], (peak - self.most[:, None])[:, :, None]
        ends = np.array([lanes.least, lanes.greatest])  # a state's density is least at one of them
        self.far = bool(((ends - self.mu) ** 2 * self.slope + self.level).min(axis=2).max(axis=1).min() < -600)

    def __call__(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of some lanes; densities, ones behind the series' end; and the sum of the factors' logarithms that differ from `most`."""
        last, tail = high == self.lanes.count, self.lanes.tail
        values = self.lanes.part(low, high)
        b = values[:, None, None] - self.mu
        b *= b
        b *= self.slope
        b += self.level
        more = np.zeros(len(self.most))
        if self.far:
            top = b.max(axis=2)
            b -= top[:, :, None]
            if last:
                top[tail:, :, -1] = 0
            more = top.sum(axis=(0, 2))
        np.exp(b, out=b)
        if last:
            b[tail:, ..., -1] = 1
        return values, b, more


def _per_sum(x: np.ndarray, axis: tuple[int, ...] | int) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axis, keepdims=True), 1e-300)


def _passed(products: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For products (models, K to, K from, lanes): vectors (models, K, lanes), `first` passed through all lanes before, sums of one.

    Beyond a few lanes these are grouped: products of all groups side by side, what each begins with, and the lanes inside them.
    """
    models, k, _, lanes = products.shape
    out = np.empty((models, k, lanes))
    if lanes <= 32:
        out[..., 0] = first
        for j in range(1, lanes):
            out[..., j] = _per_sum((products[..., j - 1] @ out[..., j - 1, None])[..., 0], 1)
        return out
    size = math.isqrt(lanes)
    groups = -(-lanes // size)
    grouped = np.empty((models, k, k, groups * size))
    grouped[..., :lanes], grouped[..., lanes:] = products, np.eye(k)[:, :, None]
    grouped = np.ascontiguousarray(grouped.reshape(models, k, k, groups, size).transpose(4, 0, 1, 2, 3))
    whole = grouped[0]
    for x in grouped[1:]:
        whole = _per_sum((x[:, :, :, None] * whole[:, None]).sum(axis=2), (1, 2))
    now, inside = _passed(whole, first), np.empty((models, k, groups, size))
    for j, x in enumerate(grouped):
        inside[..., j] = now
        now = _per_sum((x * now[:, None]).sum(axis=2), 1)
    return inside.reshape(models, k, -1)[..., :lanes]


def expectation(lanes: Lanes, A: np.ndarray, pi: np.ndarray, mu: np.ndarray, sigma2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each model (leading axis): the log-likelihood; the state posteriors of the first row; their sums over time, and those times
    the values' and squared distances from the states' means; and the sums of the posteriors of transitions.

    A first pass multiplies each lane's transitions and densities, which gives what every lane begins and ends with; a second one
    works through lanes on their own, some at a time, so that memory does not grow with the series but for the products, K K
    numbers for each lane and model, of which there are up to MOST_LANES.
    """
    steps, count, (models, k) = lanes.steps, lanes.count, mu.shape
    densities, tail, width = Densities(lanes, mu, sigma2), lanes.tail, max(1, WORKING_SET // (steps * models * k))
    turned = np.ascontiguousarray(A.swapaxes(1, 2))
    ends, behind = np.empty((models, k, count)), np.ones((models, k, count))
    if count > 1:
        products = np.empty((models, k, k, count))
        for low in range(0, count, width):
            high = min(low + width, count)
            values, b, more = densities(low, high)
            x = turned[..., None] * b[0][:, :, None]
            if not low:  # no transition leads to the first row
                x[..., 0] = np.eye(k) * b[0, ..., :1]
            spare = np.empty_like(x)
            for t in range(1, steps):
                np.matmul(turned, x.reshape(models, k, -1), out=spare.reshape(models, k, -1))
                np.multiply(spare, b[t][:, :, None], out=x)
                if t % 4 == 3 or t == steps - 1:
                    x /= np.maximum(x.max(axis=(1, 2), keepdims=True), 1e-300)
            products[..., low:high] = x
        ends = _passed(products, pi)
        behind = _passed(products[..., ::-1].swapaxes(1, 2), np.ones((models, k)))[..., ::-1]
        del products
    ll, first = lanes.n * densities.most, np.zeros((models, k))
    sums, moves = np.zeros((3, models, k)), np.zeros((models, k, k))
    for low in range(0, count, width):
        high = min(low + width, count)
        if not 1 < count <= width:  # else those of the first pass are at hand
            values, b, more = densities(low, high)
        filtered, total = np.empty_like(b), np.empty((steps, models, 1, high - low))
        before = ends[..., low:high].copy()
        prior = turned @ before
        if not low:
            prior[..., 0], before[..., 0] = pi, 0
        for t in range(steps):
            joint = np.multiply(prior, b[t], out=filtered[t])
            np.maximum(np.add.reduce(joint, axis=1, keepdims=True, out=total[t]), 1e-300, out=total[t])
            joint /= total[t]
            if t + 1 < steps:
                np.matmul(turned, joint, out=prior)
        if high == count:
            total[tail:, ..., -1] = 1
        ll = ll + more + np.log(total).sum(axis=(0, 2, 3))
        # w: density of the row behind times its backward message; its product with the transitions is the message of the row at hand
        raw, w, gamma, scale = np.ascontiguousarray(behind[..., low:high]), None, np.empty_like(prior), np.empty((models, 1, high - low))
        for t in range(steps - 1, -1, -1):
            if w is not None:
                raw = np.matmul(A, w, out=prior)
            at = filtered[t]
            size = np.add.reduce(np.multiply(at, raw, out=gamma), axis=1, keepdims=True)
            scale.fill(1.0)
            np.divide(1.0, size, out=scale, where=size > 1e-300)
            if w is not None:
                w *= scale
                if high == count and t + 1 >= tail:
                    w[..., -1] = 0
                moves += np.einsum("miw,mjw->mij", at, w)
            raw *= scale
            np.multiply(at, raw, out=gamma)
            w = np.multiply(b[t], raw, out=b[t])
            if high == count and t >= tail:
                gamma[..., -1] = 0
            if not (low or t):
                first = gamma[..., 0].copy()
            sums[0] += gamma.sum(axis=2)
            away = values[t] - densities.mu
            gamma *= away
            sums[1] += gamma.sum(axis=2)
            sums[2] += np.einsum("mkw,mkw->mk", gamma, away)
        # transitions from the lanes before: their last rows' messages are scaled as those inside
        size = np.maximum((before * np.matmul(A, w, out=prior)).sum(axis=1, keepdims=True), 1e-300)
        moves += np.einsum("miw,mjw->mij", before, w / size)
    return ll, first, *sums, A * moves


def maximisation(A: np.ndarray, mu: np.ndarray, first: np.ndarray, weight: np.ndarray, y: np.ndarray, yy: np.ndarray, moves: np.ndarray, min_variance: float = 1e-8) -> tuple[np.ndarray, ...]:
    """Parameters from expectation()'s sums."""
    weight, total = np.maximum(weight, 1e-15), np.maximum(moves.sum(axis=-1, keepdims=True), 1e-300)
    A = moves / total
    return A / A.sum(axis=-1, keepdims=True), first / first.sum(axis=-1, keepdims=True), mu + y / weight, np.maximum(yy / weight - (y / weight) ** 2, min_variance)


def em(obs: np.ndarray | Lanes, k: int, seeds: list, max_iter: int = 200, tol: float = 1e-6, min_variance: float = 1e-8) -> list[dict]:
    """EM from a random start for each seed, all advancing together; one that moves its likelihood by less than tol stops.

    Parameters are those after the last M-step; history holds the likelihoods before each, so its last entry belongs to
    the parameters before.
    """
    lanes = obs if isinstance(obs, Lanes) else Lanes([obs], len(obs), len(seeds))
    if lanes.n < 2 or k < 1:
        raise ValueError("there must be two observations and one state at least")
    A, pi, mu, sigma2 = started(lanes, k, seeds, min_variance)
    history: list[list[float]] = [[] for _ in seeds]
    active = np.arange(len(seeds))
    for _ in range(max_iter):
        ll, *sums = expectation(lanes, A[active], pi[active], mu[active], sigma2[active])
        for r, x in zip(active.tolist(), ll.tolist(), strict=True):
            history[r].append(x)
        A[active], pi[active], mu[active], sigma2[active] = maximisation(A[active], mu[active], *sums, min_variance)
        active = np.array([r for r in active.tolist() if len(history[r]) < 2 or abs(history[r][-1] - history[r][-2]) >= tol], int)
        if not len(active):
            break
    return [{"A": A[r], "pi": pi[r], "mu": mu[r], "sigma2": sigma2[r], "ll": h[-1], "history": h, "n_iter": len(h)} for r, h in enumerate(history)]


def usable(model: dict) -> bool:
    """Whether a fit ended at a finite likelihood and finite parameters. Probabilities that vanished are lifted when states are sorted."""
    return bool(np.isfinite(model["ll"]) and all(np.isfinite(model[c]).all() for c in ("A", "pi", "mu", "sigma2")))


def best_of(models: list[dict]) -> dict:
    """The model of the greatest final likelihood, the first of equal ones, its states in order."""
    finite = [m for m in models if np.isfinite(m["ll"])]
    if not finite:
        raise RuntimeError("no restart reached a finite likelihood")
    best = max(finite, key=lambda m: m["ll"])
    return sorted_states(best) | {c: best[c] for c in ("ll", "history", "n_iter")}


def seed_list(seed: int | list[int], n: int, first: int = 0) -> list[list[int]]:
    return [[*(seed if isinstance(seed, list) else [seed]), r] for r in range(first, first + n)]


def baum_welch(obs: np.ndarray, k: int, restarts: int = 10, max_iter: int = 100, tol: float = 1e-6, seed: int | list[int] = 42, min_variance: float = 1e-8) -> dict:
    return best_of(em(obs, k, seed_list(seed, restarts), max_iter, tol, min_variance))


def retried(obs: np.ndarray, k: int, successes: int = 10, attempts: int = 150, max_iter: int = 200, tol: float = 1e-6, seed: int | list[int] = 42, min_variance: float = 1e-8) -> dict:
    """The best of the first `successes` usable fits, by number of attempt; RuntimeError if `attempts` are used up without one."""
    good: list[dict] = []
    tried = 0
    while len(good) < successes and tried < attempts:
        n = min(successes - len(good), attempts - tried)
        good += [m for m in em(obs, k, seed_list(seed, n, tried), max_iter, tol, min_variance) if usable(m)]
        tried += n
    if not good:
        raise RuntimeError(f"no usable fit in {tried} attempts")
    return best_of(good) | {"attempts": tried}


def sorted_states(model: dict) -> dict:
    """States in ascending order of their means; probabilities and variances clipped at FLOOR."""
    order = np.argsort(model["mu"], kind="stable")
    A = np.maximum(np.asarray(model["A"])[np.ix_(order, order)], FLOOR)
    pi = np.maximum(np.asarray(model["pi"])[order], FLOOR)
    return {"A": A / A.sum(axis=1, keepdims=True), "pi": pi / pi.sum(), "mu": np.asarray(model["mu"])[order], "sigma2": np.maximum(np.asarray(model["sigma2"])[order], FLOOR)}


def viterbi_moves(log_b: np.ndarray, log_A: np.ndarray, entering: np.ndarray) -> tuple[list[list[int]], list[float]]:
    """From scores of entering the first row in each state: which state each state of a later row is best reached from, the lowest
    of equals, and the scores of the last row."""
    into_of, best = log_A.T.tolist(), (entering + log_b[0]).tolist()
    back = []
    for row in log_b[1:].tolist():
        reach, came = [], []
        for into, b in zip(into_of, row, strict=True):
            top, at = best[0] + into[0], 0
            for i in range(1, len(best)):
                if (x := best[i] + into[i]) > top:
                    top, at = x, i
            reach.append(top + b)
            came.append(at)
        best = reach
        back.append(came)
    return back, best


def traced(back: list[list[int]], state: int) -> list[int]:
    """The path that ends in state."""
    path = [state]
    for came in reversed(back):
        state = came[state]
        path.append(state)
    return path[::-1]


#: Runs of rows from which on it is faster to advance them together.
FEW = 8


def together(sizes: np.ndarray) -> list[np.ndarray]:
    """Numbers of runs of these sizes: single ones, where they are FEW or longer than all but FEW, then the others, longest first."""
    order = np.argsort(-sizes, kind="stable")
    lone = len(order) if len(order) <= FEW else int(np.searchsorted(-sizes[order], -sizes[order[FEW]], "left"))
    return [*(order[i : i + 1] for i in range(lone)), *([order[lone:]] if lone < len(order) else [])]


def stacked_moves(log_b: np.ndarray, starts: np.ndarray, sizes: np.ndarray, log_A: np.ndarray, entering: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """viterbi_moves of runs of rows whose sizes descend: for each step the moves of the runs that have it, and the last scores."""
    best, back = entering + log_b[starts], []
    for t in range(1, int(sizes[0])):
        m = int(np.searchsorted(-sizes, -t, "left"))
        own = best[:m]
        top, came = own[:, :1] + log_A[0], np.zeros((m, len(log_A)), np.int16)
        for i in range(1, len(log_A)):
            x = own[:, i : i + 1] + log_A[i]
            better = x > top
            top = np.where(better, x, top)
            came[better] = i
        best[:m] = top + log_b[starts[:m] + t]
        back.append(came)
    return back, best


def stacked_paths(back: list[np.ndarray], starts: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
    """Writes the path of each run that ends in its state of ends to its rows of out."""
    state = ends.copy()
    for t in range(len(back), 0, -1):
        m = len(back[t - 1])
        out[starts[:m] + t] = state[:m]
        state[:m] = back[t - 1][np.arange(m), state[:m]]
    out[starts] = state


def stacked_firsts(back: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """The states that paths begin in which end in the states of ends, (runs, any number)."""
    state = ends.copy()
    for came in reversed(back):
        state[: len(came)] = np.take_along_axis(came, state[: len(came)], axis=1)
    return state


def viterbi(log_b: np.ndarray, A: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, float]:
    """Most likely path of states, the lowest state of equals, and its log-probability."""
    with np.errstate(divide="ignore"):
        back, best = viterbi_moves(log_b, np.log(A), np.log(pi))
    return np.array(traced(back, best.index(max(best)))), float(max(best))


def stationary(A: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eig(np.asarray(A).T)
    v = np.abs(np.real(vectors[:, np.argmin(np.abs(values - 1))]))
    return v / v.sum()


def sampled_hmm(n: int, A, pi, mu, sigma2, seed: int | list[int]) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    A, pi, mu, sigma2 = checked_model(A, pi, mu, sigma2)
    u = rng.random(n)
    states = np.empty(n, int)
    state = int(np.searchsorted(pi.cumsum(), u[0]))
    rows = A.cumsum(axis=1)
    for t in range(n):
        state = state if t == 0 else int(np.searchsorted(rows[state], u[t]))
        states[t] = state = min(state, len(pi) - 1)
    return states, rng.normal(mu[states], np.sqrt(sigma2[states]))


def sampled_path(filtered: np.ndarray, A: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Backward sampling: a path of states from filtered probabilities, with one uniform number for each row.

    The choice of every row is drawn for each state that may follow, all rows at once; a walk back then picks one.
    """
    n, k = filtered.shape
    weight = (filtered[:, None, :] * A.T[None]).cumsum(axis=-1)  # (T, state that follows, state)
    chosen = np.minimum((weight < (u[:, None] * weight[..., -1])[..., None]).sum(axis=-1), k - 1).tolist()
    last = filtered[-1].cumsum()
    state = min(int(np.searchsorted(last, u[-1] * last[-1])), k - 1)
    path = [state]
    for row in chosen[-2::-1]:
        state = row[state]
        path.append(state)
    return np.array(path[::-1])


def dirichlet_prior(prior: float | np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A positive prior of the shape, from one number or an array."""
    out = np.broadcast_to(np.asarray(prior, float), shape)
    if (out <= 0).any():
        raise ValueError("Dirichlet priors must be positive")
    return out


def gibbs(obs: np.ndarray, k: int, n_samples: int = 200, burn_in: int = 200, thin: int = 2, seed: int | list[int] = 42, concentration: float | np.ndarray = 1.0, start_concentration: float | np.ndarray = 1.0) -> dict[str, np.ndarray]:
    """Blocked Gibbs sampling: path by forward filtering and backward sampling, then Dirichlet, normal and inverse-gamma draws.

    States are relabelled by their means in every sweep. Priors: Dirichlet(concentration) for each row of A and
    Dirichlet(start_concentration) for pi, numbers or arrays, means around the data's mean
    with the data's variance, inverse-gamma(2, variance).
    """
    rng = np.random.default_rng(seed)
    rows, first = dirichlet_prior(concentration, (k, k)), dirichlet_prior(start_concentration, (k,))
    n, scale, centre = len(obs), max(obs.var(), 1e-12), obs.mean()
    mu, sigma2 = np.quantile(obs, (np.arange(k) + 0.5) / k), np.full(k, scale)
    A, pi = np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1)) if k > 1 else np.ones((1, 1)), np.full(k, 1 / k)
    out: dict[str, list[np.ndarray]] = {"A": [], "pi": [], "mu": [], "sigma2": []}
    for sweep in range(burn_in + n_samples * thin):
        filtered, _ = forward(emissions(obs, mu, sigma2), A, pi)
        path = sampled_path(filtered, A, rng.random(n))
        moves = np.bincount(path[:-1] * k + path[1:], minlength=k * k).reshape(k, k)
        A = np.array([rng.dirichlet(prior + row) for prior, row in zip(rows, moves, strict=True)])
        pi = rng.dirichlet(first + (np.arange(k) == path[0]))  # k is given, so that unvisited states stay
        count, total = np.bincount(path, minlength=k), np.bincount(path, obs, k)
        precision = count / sigma2 + 1 / scale
        mu = rng.normal((total / sigma2 + centre / scale) / precision, np.sqrt(1 / precision))
        squares = np.bincount(path, (obs - mu[path]) ** 2, k)
        sigma2 = (scale + squares / 2) / rng.gamma(2 + count / 2)
        order = np.argsort(mu, kind="stable")
        A, pi, mu, sigma2 = np.maximum(A[np.ix_(order, order)], 1e-300), np.maximum(pi[order], 1e-300), mu[order], np.maximum(sigma2[order], 1e-15)
        if sweep >= burn_in and (sweep - burn_in) % thin == 0:
            for name, value in (("A", A), ("pi", pi), ("mu", mu), ("sigma2", sigma2)):
                out[name].append(value)
    return {name: np.array(values) for name, values in out.items()}


# Langevin dynamics: level x1 and trend x2, dx1 = x2 dt, dx2 = theta x2 dt + sigma dW, and jumps of x2.


def discretized(theta: float, sigma: float, dt: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Transition matrices and noise covariances over dt, (..., 2, 2), in closed form, with their limits at theta = 0."""
    dt = np.asarray(dt, float)
    f, q = np.zeros((*dt.shape, 2, 2)), np.zeros((*dt.shape, 2, 2))
    f[..., 0, 0] = 1
    if abs(theta) < 1e-12:
        decay, reach = np.ones_like(dt), dt
        q00, q01, q11 = dt**3 / 3, dt**2 / 2, dt
    else:
        decay, reach = np.exp(theta * dt), np.expm1(theta * dt) / theta
        q11 = np.expm1(2 * theta * dt) / (2 * theta)
        q01, q00 = reach**2 / 2, (q11 - 2 * reach + dt) / theta**2
    f[..., 0, 1], f[..., 1, 1] = reach, decay
    q[..., 0, 0], q[..., 0, 1], q[..., 1, 0], q[..., 1, 1] = sigma**2 * q00, sigma**2 * q01, sigma**2 * q01, sigma**2 * q11
    return f, q


def kalman_update(m: np.ndarray, c: np.ndarray, y: float, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Update by an observation of the level: means (..., 2), covariances (..., 2, 2) in Joseph form, log-likelihoods."""
    s = c[..., 0, 0] + r
    gain = c[..., :, 0] / s[..., None]
    error = y - m[..., 0]
    keep = np.zeros(c.shape)
    keep[..., 0, 0], keep[..., 1, 0], keep[..., 1, 1] = 1 - gain[..., 0], -gain[..., 1], 1
    c = keep @ c @ np.swapaxes(keep, -1, -2) + gain[..., :, None] * gain[..., None, :] * r
    return m + gain * error[..., None], c, log_normal(error, np.zeros(()), s)


def kalman_filter(obs: np.ndarray, f: np.ndarray, q: np.ndarray, r: float, m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, covariances and log-likelihoods of every step; the prior is the first step's prediction."""
    (f00, f01), (f10, f11) = f.tolist()
    (q00, q01), (_, q11) = q.tolist()
    m0, m1, c00, c01, c11 = float(m[0]), float(m[1]), float(c[0][0]), float(c[0][1]), float(c[1][1])
    rows = []
    for t, y in enumerate(obs.tolist()):
        if t:
            m0, m1 = f00 * m0 + f01 * m1, f10 * m0 + f11 * m1
            a, b, d, e = f00 * c00 + f01 * c01, f00 * c01 + f01 * c11, f10 * c00 + f11 * c01, f10 * c01 + f11 * c11
            c00, c01, c11 = a * f00 + b * f01 + q00, a * f10 + b * f11 + q01, d * f10 + e * f11 + q11
        s = c00 + r
        k0, k1, error = c00 / s, c01 / s, y - m0
        m0, m1 = m0 + k0 * error, m1 + k1 * error
        keep = 1 - k0
        c00, c01, c11 = keep * keep * c00 + k0 * k0 * r, keep * (c01 - k1 * c00) + k0 * k1 * r, c11 - 2 * k1 * c01 + k1 * k1 * c00 + k1 * k1 * r
        rows.append((m0, m1, c00, c01, c11, -0.5 * (LOG_2PI + math.log(s) + error * error / s)))
    out = np.array(rows).reshape(-1, 6)
    return out[:, :2], out[:, [2, 3, 3, 4]].reshape(-1, 2, 2), out[:, 5]


class Gaussian(NamedTuple):
    """What rows say about moving from a state x before the first of them to the state y before the row behind the last.

    y given x and the rows is normal with mean A x + b and covariance C; the rows' density given x is proportional to that of
    exp(eta' x - x' J x / 2). Such elements are combined associatively. Leading axes run over elements.
    """

    A: np.ndarray
    b: np.ndarray
    C: np.ndarray
    eta: np.ndarray
    J: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self])

    @classmethod
    def of(cls, flat: np.ndarray) -> Gaussian:
        return cls(flat[:4].reshape(2, 2), flat[4:6], flat[6:10].reshape(2, 2), flat[10:12], flat[12:16].reshape(2, 2))


def _solved(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """m^-1 x of 2 by 2 matrices m and matrices or vectors x, on leading axes."""
    return np.linalg.solve(m, x) if x.ndim == m.ndim else np.linalg.solve(m, x[..., None])[..., 0]


def followed(first: Gaussian, then: Gaussian) -> Gaussian:
    """The element of first's rows and then those of the other, as in parallel-in-time filtering of linear Gaussian models."""
    turned = lambda x: np.swapaxes(x, -1, -2)
    apply = lambda m, x: (m @ x[..., None])[..., 0]
    eye = np.eye(2)
    m, w = eye + first.C @ then.J, eye + then.J @ first.C
    A = then.A @ _solved(m, first.A)
    b = apply(then.A, _solved(m, first.b + apply(first.C, then.eta))) + then.b
    C = then.A @ _solved(m, first.C) @ turned(then.A) + then.C
    eta = apply(turned(first.A), _solved(w, then.eta - apply(then.J, first.b))) + first.eta
    J = turned(first.A) @ _solved(w, then.J) @ first.A + first.J
    return Gaussian(A, b, (C + turned(C)) / 2, eta, (J + turned(J)) / 2)


def gaussian_block(obs: np.ndarray, f: np.ndarray, q: np.ndarray, r: float) -> Gaussian:
    """The element of a block of rows, each an observation of the level and then a transition; halves are combined first."""
    n = len(obs)
    eta, J = np.zeros((n, 2)), np.zeros((n, 2, 2))
    eta[:, 0], J[:, 0, 0] = obs / r, 1 / r
    x = Gaussian(np.repeat(f[None], n, axis=0), np.zeros((n, 2)), np.repeat(q[None], n, axis=0), eta, J)
    while len(x.b) > 1:
        odd = Gaussian(*(y[-1:] if len(y) % 2 else y[:0] for y in x))
        even = len(x.b) // 2 * 2
        x = Gaussian(*(np.concatenate(pair) for pair in zip(followed(Gaussian(*(y[0:even:2] for y in x)), Gaussian(*(y[1:even:2] for y in x))), odd, strict=True)))
    return Gaussian(*(y[0] for y in x))


def moved_on(m: np.ndarray, c: np.ndarray, x: Gaussian) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the state behind x's rows, from those before them."""
    known = followed(Gaussian(np.zeros((2, 2)), m, c, np.zeros(2), np.zeros((2, 2))), x)
    return known.b, known.C


def systematic(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Systematic resampling, (..., N) weights: which particle takes each place; u in [0, 1) for each set."""
    n = weights.shape[-1]
    total = weights.cumsum(axis=-1)
    reach = np.clip(np.floor(total * (n / total[..., -1:]) - u[..., None]) + 1, 0, n)  # places up to each particle
    reach[..., -1] = n
    count = np.diff(reach, axis=-1, prepend=0).astype(np.int64)
    return np.repeat(np.tile(np.arange(n), count.size // n), count.ravel()).reshape(weights.shape)


class Transition(NamedTuple):
    """Entries of transition matrices [[1, reach], [0, decay]], of their noise, and the mean's shift."""

    reach: np.ndarray
    decay: np.ndarray
    q00: np.ndarray
    q01: np.ndarray
    q11: np.ndarray
    shift0: np.ndarray | float = 0.0
    shift1: np.ndarray | float = 0.0


def transition(theta: np.ndarray, sigma: np.ndarray, dt: np.ndarray) -> Transition:
    """discretized() for arrays of parameters and times."""
    theta, sigma, dt = np.broadcast_arrays(*(np.asarray(x, float) for x in (theta, sigma, dt)))
    limit = np.abs(theta) < 1e-12
    safe = np.where(limit, -1.0, theta)
    reach = np.where(limit, dt, np.expm1(safe * dt) / safe)
    q11 = np.where(limit, dt, np.expm1(2 * safe * dt) / (2 * safe))
    q00 = np.where(limit, dt**3 / 3, (q11 - 2 * reach + dt) / safe**2)
    return Transition(reach, np.where(limit, 1.0, np.exp(safe * dt)), sigma**2 * q00, sigma**2 * reach**2 / 2, sigma**2 * q11)


def jump_transition(theta: np.ndarray, sigma: np.ndarray, dt: float, tau: np.ndarray, mu_j: np.ndarray, sigma_j: np.ndarray) -> Transition:
    """Over dt with one jump of the trend at each tau."""
    a, b = transition(theta, sigma, tau), transition(theta, sigma, dt - tau)
    s11 = a.q11 + sigma_j**2
    q00 = a.q00 + 2 * b.reach * a.q01 + b.reach**2 * s11 + b.q00
    q01 = b.decay * (a.q01 + b.reach * s11) + b.q01
    return Transition(a.reach + b.reach * a.decay, b.decay * a.decay, q00, q01, b.decay**2 * s11 + b.q11, b.reach * mu_j, b.decay * mu_j)


#: Steps whose random numbers are drawn at once.
DRAWN = 128


class Draws:
    """Uniform numbers of many sets of particles, each from its own generator, whatever sets run beside it."""

    def __init__(self, seeds: list, n: int, steps: int, normals: int = 0):
        self.generators, self.n, self.steps, self.normals = [np.random.default_rng(s) for s in seeds], n, steps, normals

    def __iter__(self):
        """For each step: (jump, tau, resampling, normals), the first two (sets, n), the third (sets,)."""
        for low in range(0, self.steps, DRAWN):
            k = min(DRAWN, self.steps - low)
            uniform = np.stack([g.random((DRAWN, 2 * self.n + 1)) for g in self.generators], axis=1)
            normal = np.stack([g.standard_normal((DRAWN, self.normals, self.n)) for g in self.generators], axis=1) if self.normals else None
            for t in range(k):
                u = uniform[t]
                yield u[:, : self.n], u[:, self.n : 2 * self.n], u[:, -1], None if normal is None else normal[t]


def _columns(p: dict[str, np.ndarray], sets: int) -> dict[str, np.ndarray]:
    return {c: np.broadcast_to(np.asarray(v, float), (sets,))[:, None] for c, v in p.items()}


def _weighted(ll: np.ndarray, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Log-likelihood of each set, weights, and weighted means."""
    top = ll.max(axis=1, keepdims=True)
    w = np.exp(ll - top)
    total = w.sum(axis=1, keepdims=True)
    w /= total
    return (np.log(total) + top)[:, 0] - math.log(ll.shape[1]), w, [np.einsum("sn,sn->s", w, v) for v in x]


def _jumps(p: dict[str, np.ndarray], chance: np.ndarray, u: np.ndarray, tau: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray, Transition]:
    """Sets and particles that jump, and their transitions."""
    row, at = np.nonzero(u < chance)
    own = {c: v[row, 0] for c, v in p.items()}
    return row, at, jump_transition(own["theta"], own["sigma"], dt, tau[row, at] * dt, own["mu_J"], own["sigma_J"])


def rbpf_many(obs: np.ndarray, p: dict[str, np.ndarray], n: int, m0: np.ndarray, c0: np.ndarray, seeds: list, dt: float = 1.0) -> dict[str, np.ndarray]:
    """Rao-Blackwellised particle filters of many series or parameter sets at once: particles sample jumps, and each carries a
    Kalman filter, five numbers.

    obs is (sets, T) or (T,) for all of them; a set's series ends where its observations turn NaN. p holds numbers or an
    array over sets, m0 (sets, 2), c0 (sets, 2, 2); every set draws from its own seed. A jump comes with probability
    1 - exp(-lambda dt) at a uniform time. Particles are resampled at every step. Results are (T, sets, ...).
    """
    sets, steps = len(seeds), obs.shape[-1]
    model = jump_model(p, sets, dt)
    state = started_particles(m0, c0, n)
    out = {"mean": np.empty((steps, sets, 2)), "std": np.empty((steps, sets, 2)), "ll": np.empty((steps, sets)), "n_eff": np.empty((steps, sets)), "jumped": np.zeros((steps, sets))}
    rows = np.broadcast_to(obs, (sets, steps)).T
    for t, (u, tau, places, _) in enumerate(Draws(seeds, n, steps)):
        state, now = rbpf_step(model, state, rows[t], u, tau, places, t == 0)
        for c, v in now.items():
            out[c][t] = v
    return out


#: Random numbers that are held at once, and the exponent under which a weight counts for nothing.
HELD, FAINT = 1 << 18, -500.0


def jump_added(p: dict[str, np.ndarray], row: np.ndarray, tau: np.ndarray, dt: float) -> list[np.ndarray]:
    """What a jump at the share tau of a step adds behind the usual one, in sets row: to the level's variance, its covariance with the
    trend and the trend's variance, and to the means of level and trend where mu_J is not 0 everywhere."""
    rest = transition(p["theta"][row, 0], 0.0, dt - tau * dt)
    variance, mean = p["sigma_J"][row, 0] ** 2, p["mu_J"][row, 0]
    added = [rest.reach**2 * variance, rest.reach * rest.decay * variance, rest.decay**2 * variance]
    return [*added, rest.reach * mean, rest.decay * mean] if p["mu_J"].any() else added


def _laid_out(uniform: np.ndarray, n: int, p: dict[str, np.ndarray], chance: np.ndarray, dt: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Jumps of (sets, steps, 2 n + 1) numbers, by steps: where each step's begin, their particles (sets * n), and what they add, a
    column for each kind."""
    steps = uniform.shape[1]
    row, at = np.divmod(np.flatnonzero(uniform[:, :, :n] < chance[:, :, None]), steps * n)
    step, place = np.divmod(at, n)
    order = np.argsort(step, kind="stable")
    row, step, place = row[order], step[order], place[order]
    return np.searchsorted(step, np.arange(steps + 1)).tolist(), row * n + place, np.stack(jump_added(p, row, uniform[row, step, n + place], dt), axis=1)


def rbpf_trends(obs: np.ndarray | Iterable[np.ndarray], p: dict[str, np.ndarray], n: int, m0: np.ndarray, c0: np.ndarray, seeds: list, dt: float = 1.0, told: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """The filters of rbpf_many(), a few steps at a time: (first step, trend, ll, n_eff), each (steps, sets); without `told` the last
    two are None.

    obs may also come in pieces of time, so that a series is never held whole. All particles take the usual step, and jumps, which
    only add to means and covariances, are added where they happen. Sets without jumps keep n equal particles, so that one is
    enough; callers put such sets together. Arrays are (sets * n), and are written to in place.
    """
    sets, shown, at = len(seeds), n, 0
    p, usual, chance, dt = jump_model(p, sets, dt)
    still = not (chance > 0).any()
    n = 1 if still else n
    size = sets * n
    full = lambda v: np.ascontiguousarray(np.broadcast_to(np.asarray(v, float), (sets, n))).ravel()
    # planes: the level's variance, the level, their covariance, the trend, its variance
    x0, x1, c00, c01, c11 = started_particles(m0, c0, n)
    buffers = np.stack([c00, x0, c01, x1, c11]).reshape(5, size), np.empty((5, size))
    held, spare = ((x, x.reshape(-1), x[0], x[1], x[2], x[3], x[4], x[2:], x[1:3], x[::2], x[:3:2], x[1:4:2], x[3].reshape(sets, n)) for x in buffers)
    r, reach = full(p["sigma_obs"] ** 2), full(usual.reach)
    fade, noise = np.stack([full(usual.decay), full(usual.decay), full(usual.decay**2)]), np.stack([full(usual.q00), full(usual.q01), full(usual.q11)])
    # few buffers, each for several uses, so that a step's numbers stay in the cache
    several, error, inverse, some, comb = np.empty((4, size)), *np.empty((4, size))
    moved_by, gain, pair, errors, combs = several[:3], several[:2], several[2:], error.reshape(sets, n), comb.reshape(sets, n)
    planes = np.array([0, 2, 4, 1, 3])[: 5 if p["mu_J"].any() else 3] * size
    last, taken, copies, places, base = combs[:, -1], np.empty(size, np.intp), np.empty(size, np.intp), np.arange(size), np.repeat(np.arange(sets) * n, n)
    ends = taken.reshape(sets, n)[:, -1]
    generators = [np.random.default_rng(seed) for seed in seeds]
    together = min(DRAWN, max(1, HELD // (sets * (2 * n + 1))))
    uniform = None if still else np.empty((sets, together, 2 * n + 1))
    for piece in (obs,) if isinstance(obs, np.ndarray) else obs:
        rows = piece.tolist() if piece.ndim == 1 else piece.T
        for low in range(0, len(rows), together):
            count = min(together, len(rows) - low)
            if not still:
                for own, generator in zip(uniform, generators, strict=True):
                    generator.random(out=own[:count])
                bounds, jumped, added = _laid_out(uniform[:, :count], n, p, chance, dt)
                jumped = jumped[:, None] + planes
                unlike = np.ascontiguousarray((1 - uniform[:, :count, -1]).T)[:, :, None]
            trend, total, top, squares = (np.empty((count, sets)) for _ in range(4))
            for k in range(count):
                x, flat, c00, x0, c01, x1, c11, c01_x1_c11, x0_c01, covariances, c00_c01, x0_x1, trends = held
                if at + k:
                    np.multiply(c01_x1_c11, reach, out=moved_by)
                    c00 += moved_by[0]
                    x0_c01 += moved_by[1:]
                    c00 += np.multiply(c01, reach, out=some)
                    c01_x1_c11 *= fade
                    covariances += noise
                    if not still and bounds[k] < bounds[k + 1]:
                        flat[jumped[bounds[k] : bounds[k + 1]]] += added[bounds[k] : bounds[k + 1]]
                np.divide(1.0, np.add(c00, r, out=some), out=inverse)
                np.multiply(c00_c01, inverse, out=gain)
                np.subtract(rows[low + k] if piece.ndim == 1 else np.repeat(rows[low + k], n), x0, out=error)
                x0_x1 += np.multiply(gain, error, out=pair)
                c11 -= np.multiply(gain[1], c01, out=some)
                c00_c01 *= np.multiply(inverse, r, out=some)
                error *= error
                error *= inverse
                error *= -0.5
                np.sqrt(inverse, out=some)
                if still:
                    trend[k], total[k], top[k] = x1, some, error
                    continue
                np.maximum.reduce(errors, axis=1, out=top[k])
                errors -= top[k][:, None]
                np.exp(np.maximum(error, FAINT, out=error), out=error)
                error *= some  # the weights
                np.add.accumulate(errors, axis=1, out=combs)
                total[k] = last
                np.einsum("sn,sn->s", errors, trends, out=trend[k])
                if told:
                    np.einsum("sn,sn->s", errors, errors, out=squares[k])
                if not np.minimum.reduce(last) > 0:  # weights of series that have ended are NaN
                    np.add.accumulate(np.where(np.isfinite(errors), errors, 1 / n), axis=1, out=combs)
                combs *= (n / last)[:, None]
                combs += unlike[k]
                np.copyto(taken, np.minimum(comb, n, out=comb), casting="unsafe")
                ends.fill(n)
                taken += base
                copies[0] = taken[0]
                np.subtract(taken[1:], taken[:-1], out=copies[1:])
                np.take(x, places.repeat(copies), axis=1, out=spare[0], mode="clip")
                held, spare = spare, held
            if not still:
                trend /= total
            yield at, trend, np.log(total) + top - 0.5 * LOG_2PI - (0 if still else math.log(n)) if told else None, (np.full((count, sets), float(shown)) if still else total**2 / squares) if told else None
            at += count


def jump_model(p: dict[str, np.ndarray], sets: int, dt: float) -> tuple:
    """What rbpf_step() needs of the parameters: themselves as columns, the step without a jump, and the chance of one."""
    p = _columns(p, sets)
    return p, transition(p["theta"], p["sigma"], dt), -np.expm1(-p["lambda_J"] * dt), dt


def started_particles(m0: np.ndarray, c0: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """n particles for each set, all at its prior: two means and three covariances, each (sets, n)."""
    return tuple(np.repeat(v[:, None], n, axis=1) for v in (m0[:, 0], m0[:, 1], c0[:, 0, 0], c0[:, 0, 1], c0[:, 1, 1]))


def rbpf_step(model: tuple, state: tuple[np.ndarray, ...], y: np.ndarray, u: np.ndarray, tau: np.ndarray, places: np.ndarray, is_first: bool) -> tuple[tuple[np.ndarray, ...], dict[str, np.ndarray]]:
    """Particles after the observations y (sets,), resampled, and the step's results. The first step makes no move."""
    p, usual, chance, dt = model
    x0, x1, c00, c01, c11 = state
    sets, n = x0.shape
    row = at = np.zeros(0, int)
    if not is_first:
        c00, x0, c01 = c00 + usual.reach * c01, x0 + usual.reach * x1, c01 + usual.reach * c11
        c00, c01, x1, c11 = c00 + usual.reach * c01, c01 * usual.decay, x1 * usual.decay, c11 * usual.decay**2
        c00, c01, c11 = c00 + usual.q00, c01 + usual.q01, c11 + usual.q11
        row, at = np.nonzero(u < chance)
        if len(row):
            for target, value in zip((c00, c01, c11, x0, x1), jump_added(p, row, tau[row, at], dt), strict=False):
                target[row, at] += value
    r = p["sigma_obs"] ** 2
    s = c00 + r
    inverse = 1 / s
    k0, k1, error = c00 * inverse, c01 * inverse, y[:, None] - x0
    ll = -0.5 * (LOG_2PI + np.log(s) + error * error * inverse)
    x0, x1, c11, keep = x0 + k0 * error, x1 + k1 * error, c11 - k1 * c01, inverse * r
    c00, c01 = c00 * keep, c01 * keep
    total, w, means = _weighted(ll, [x0, x1])
    spread = [np.sqrt(np.einsum("sn,sn->s", w, c + (x - mean[:, None]) ** 2)) for x, c, mean in ((x0, c00, means[0]), (x1, c11, means[1]))]
    out = {"mean": np.stack(means, axis=1), "std": np.stack(spread, axis=1), "ll": total, "n_eff": 1 / np.einsum("sn,sn->s", w, w), "jumped": np.bincount(row, w[row, at], sets)}
    flat = (systematic(np.where(np.isfinite(w), w, 1 / n), places) + np.arange(sets)[:, None] * n).ravel()  # weights of series that have ended are NaN
    return tuple(v.ravel()[flat].reshape(sets, n) for v in (x0, x1, c00, c01, c11)), out


def moved(q: Transition, x0: np.ndarray, x1: np.ndarray, c00: np.ndarray, c01: np.ndarray, c11: np.ndarray) -> tuple[np.ndarray, ...]:
    """Predicted means and covariances."""
    return x0 + q.reach * x1 + q.shift0, q.decay * x1 + q.shift1, c00 + q.reach * (2 * c01 + q.reach * c11) + q.q00, q.decay * (c01 + q.reach * c11) + q.q01, q.decay**2 * c11 + q.q11


def draws_of_step(seed: list[int], n: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of Draws for step t of one set, (1, n), (1, n) and (1,), found without those before."""
    generator = np.random.default_rng(seed)
    generator.bit_generator.advance(t * (2 * n + 1))
    u = generator.random((1, 2 * n + 1))
    return u[:, :n], u[:, n : 2 * n], u[:, -1]


def rbpf(obs: np.ndarray, p: dict[str, float], n: int, m0: np.ndarray, c0: np.ndarray, seed: int | list[int], dt: float = 1.0) -> dict[str, np.ndarray]:
    """rbpf_many() of one series: results are (T, ...)."""
    return {c: v[:, 0] for c, v in rbpf_many(obs[None], p, n, np.asarray(m0, float)[None], np.asarray(c0, float)[None], [seed], dt).items()}


def particle_filter_many(obs: np.ndarray, p: dict[str, np.ndarray], n: int, m0: np.ndarray, c0: np.ndarray, seeds: list, dt: float = 1.0) -> dict[str, np.ndarray]:
    """Bootstrap particle filters: particles sample whole states. Arguments and results as in rbpf_many()."""
    sets, steps = len(seeds), obs.shape[-1]
    p = _columns(p, sets)
    r, chance, usual = p["sigma_obs"] ** 2, -np.expm1(-p["lambda_J"] * dt), transition(p["theta"], p["sigma"], dt)

    def noise(q, normal):
        root = np.sqrt(np.maximum(q.q00, 0) + 1e-15)
        low = q.q01 / root
        return root * normal[0], low * normal[0] + np.sqrt(np.maximum(q.q11 - low**2, 0) + 1e-15) * normal[1]

    out = {"mean": np.empty((steps, sets, 2)), "std": np.empty((steps, sets, 2)), "ll": np.empty((steps, sets))}
    offsets, rows = np.arange(sets)[:, None] * n, np.broadcast_to(obs, (sets, steps)).T
    x0 = x1 = np.zeros((sets, n))
    for t, (u, tau, places, normal) in enumerate(Draws(seeds, n, steps, normals=2)):
        normal = normal.transpose(1, 0, 2)
        if t:
            row, at, jump = _jumps(p, chance, u, tau, dt)
            a, b = x0[row, at], x1[row, at]
            e0, e1 = noise(usual, normal)
            x0, x1 = x0 + usual.reach * x1 + e0, usual.decay * x1 + e1
            if len(row):
                e0, e1 = noise(jump, normal[:, row, at])
                x0[row, at], x1[row, at] = a + jump.reach * b + jump.shift0 + e0, jump.decay * b + jump.shift1 + e1
        else:
            root = np.linalg.cholesky(c0 + 1e-15 * np.eye(2))
            x0 = m0[:, :1] + root[:, :1, 0] * normal[0]
            x1 = m0[:, 1:] + root[:, 1:, 0] * normal[0] + root[:, 1:, 1] * normal[1]
        error = rows[t][:, None] - x0
        out["ll"][t], w, (mean0, mean1) = _weighted(-0.5 * (LOG_2PI + np.log(r) + error * error / r), [x0, x1])
        out["mean"][t, :, 0], out["mean"][t, :, 1] = mean0, mean1
        for k, (x, mean) in enumerate(((x0, mean0), (x1, mean1))):
            out["std"][t, :, k] = np.sqrt(np.einsum("sn,sn->s", w, (x - mean[:, None]) ** 2))
        flat = (systematic(np.where(np.isfinite(w), w, 1 / n), places) + offsets).ravel()
        x0, x1 = x0.ravel()[flat].reshape(sets, n), x1.ravel()[flat].reshape(sets, n)
    return out


def particle_filter(obs: np.ndarray, p: dict[str, float], n: int, m0: np.ndarray, c0: np.ndarray, seed: int | list[int], dt: float = 1.0) -> dict[str, np.ndarray]:
    return {c: v[:, 0] for c, v in particle_filter_many(obs[None], p, n, np.asarray(m0, float)[None], np.asarray(c0, float)[None], [seed], dt).items()}


def sampled_langevin(n: int, p: dict[str, float], x0: np.ndarray, seed: int | list[int], dt: float = 1.0) -> dict[str, np.ndarray]:
    """States, observations and jump flags of a jump-diffusion."""
    rng = np.random.default_rng(seed)
    f0, q0 = discretized(p["theta"], p["sigma"], dt)
    x, states, jumped = np.asarray(x0, float), np.empty((n, 2)), np.zeros(n, bool)
    for t in range(n):
        if t:
            f, q, shift = f0, q0, 0.0
            if rng.random() < -math.expm1(-p.get("lambda_J", 0.0) * dt):
                jumped[t] = True
                j = jump_transition(p["theta"], p["sigma"], dt, np.asarray(rng.uniform(0, dt)), p["mu_J"], p["sigma_J"])
                f, q, shift = np.array([[1, j.reach], [0, j.decay]]), np.array([[j.q00, j.q01], [j.q01, j.q11]]), np.array([j.shift0, j.shift1])
            x = rng.multivariate_normal(f @ x + shift, q)
        states[t] = x
    return {"x": states, "obs": states[:, 0] + p["sigma_obs"] * rng.standard_normal(n), "jumped": jumped}
