"""Hidden Markov models over many series. Filter, smoother, M-step and Viterbi are scans over blocks of time; a restart or a chain of a
series is a group of its own."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.functions import numerics as N
from tidemark.operators import scans
from tidemark.shared import cut

MODEL = "A array<array<double>>, pi array<double>, mu array<double>, sigma2 array<double>"
FIT = f"{MODEL}, ll double, n_iter int, history array<double>"


def seed_of(base: int, *parts: object) -> list[int]:
    """A seed for a group that depends on nothing but the base and the group's keys."""
    return [base, *(zlib.crc32(str(p).encode()) for p in parts)]


def _transfer(A, mu, sigma2, value: str) -> scans.Element:
    """A block's element: the product of its rows' densities and transitions, with the logarithm of its factor behind."""

    def element(rows: pd.DataFrame) -> np.ndarray:
        product, scale = N.chained(N.emissions(rows[value].to_numpy(float), mu, sigma2), A)
        return np.append(product.ravel(), scale)

    return element


def _product(k: int) -> scans.Combine:
    def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a[:-1].reshape(k, k) @ b[:-1].reshape(k, k)
        most = max(x.max(), 1e-300)
        return np.append((x / most).ravel(), a[-1] + b[-1] + np.log(most))

    return combine


def _prior(pi: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """The prediction for a block's first row: pi, moved on through all rows before."""
    if before is None:
        return pi
    x = pi @ before[:-1].reshape(len(pi), -1)
    return x / x.sum()


def _after(k: int, behind: np.ndarray | None) -> np.ndarray | None:
    """What all rows behind a block say about the state at the first of them, up to a factor."""
    return None if behind is None else behind[:-1].reshape(k, k).sum(axis=1)


def infer(df: DataFrame, A, pi, mu, sigma2, value: str = "ret", key: str = "symbol", block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """df with prediction, probs (filtered) and ll of each row, under one model for all series.

    The first row's prior is pi itself, without a transition; predictions are means of the states before the update. Blocks of
    block_rows rows run side by side, each from the product of all transitions before it.
    """
    A, pi, mu, sigma2 = N.checked_model(A, pi, mu, sigma2)

    def per_block(rows: pd.DataFrame, before: np.ndarray | None) -> pd.DataFrame:
        start = _prior(pi, before)
        filtered, gain = N.forward(N.emissions(rows[value].to_numpy(float), mu, sigma2), A, start)
        return rows.assign(prediction=np.vstack([start, filtered[:-1] @ A]) @ mu, probs=list(filtered), ll=gain)

    rows = scans.blocked(df, block_rows)
    carry = scans.scanned(rows, _transfer(A, mu, sigma2, value), _product(len(mu)), key)
    return scans.with_columns(rows, "prediction double, probs array<double>, ll double", per_block, key, [carry])


def likelihoods(df: DataFrame, A, pi, mu, sigma2, value: str = "ret", key: str = "symbol") -> DataFrame:
    return infer(df, A, pi, mu, sigma2, value, key).groupBy(key).agg(F.sum("ll").alias("ll"), F.count("*").alias("n"))


def log_alpha(df: DataFrame, A, pi, mu, sigma2, value: str = "ret", key: str = "symbol") -> DataFrame:
    """df with log_alpha, the joint log-density of the rows so far and each state: filtered probabilities plus gains so far."""
    so_far = F.sum("ll").over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return infer(df, A, pi, mu, sigma2, value, key).withColumn("__so_far", so_far).withColumn("log_alpha", F.transform("probs", lambda p: F.log(p) + F.col("__so_far"))).drop("__so_far", "prediction", "probs", "ll")


def statistics(df: DataFrame, A, pi, mu, sigma2, value: str = "ret", key: str = "symbol", block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """(key, state, start, weight, y, yy, moves), sums over each series of what an EM step needs: the state's posterior in the first
    row, in all rows, times the value's and its square's distance from the state's mean, and expected moves to each state.

    One pass of forward and backward messages over the blocks, whose sums Spark adds up.
    """
    A, pi, mu, sigma2 = N.checked_model(A, pi, mu, sigma2)
    k = len(mu)

    def per_block(rows: pd.DataFrame, before: np.ndarray | None, behind: np.ndarray | None) -> pd.DataFrame:
        obs = rows[value].to_numpy(float)
        gamma, xi, _ = N.smoothed_steps(N.emissions(obs, mu, sigma2), A, _prior(pi, before), _after(k, behind))
        away = obs[:, None] - mu
        start = gamma[0] if before is None else np.zeros(k)
        return pd.DataFrame({key: [rows[key].iloc[0]] * k, "state": np.arange(k), "start": start, "weight": gamma.sum(axis=0), "y": (gamma * away).sum(axis=0), "yy": (gamma * away**2).sum(axis=0), "moves": list(xi)})

    rows = scans.blocked(df, block_rows)
    element = scans.elements(scans.several(rows, key), _transfer(A, mu, sigma2, value), key)
    carries = [scans.prefixes(element, _product(k), key), scans.prefixes(element, _product(k), key, reverse=True)]
    sums = scans.applied(rows, per_block, key, f"{scans.kind_of(df, key)}, state int, start double, weight double, y double, yy double, moves array<double>", carries)
    moves = F.array(*(F.sum(F.element_at("moves", j + 1)) for j in range(k)))
    return sums.groupBy(key, "state").agg(*(F.sum(c).alias(c) for c in ("start", "weight", "y", "yy")), moves.alias("moves"))


def transition_posteriors(df: DataFrame, A, pi, mu, sigma2, value: str = "ret", key: str = "symbol", block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """(key, i, j, xi): expected moves from state i to j in each series, summed over time."""
    return statistics(df, A, pi, mu, sigma2, value, key, block_rows).select(key, F.col("state").alias("i"), F.posexplode("moves").alias("j", "xi"))


def stationary(models: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, state, share): each model's long-run shares of its states."""

    def per_model(rows: pd.DataFrame) -> pd.DataFrame:
        share = N.stationary(np.array([list(r) for r in rows["A"].iloc[0]]))
        return pd.DataFrame({key: rows[key].iloc[0], "state": np.arange(len(share)), "share": share})

    return models.select(key, "A").groupBy(key).applyInPandas(per_model, f"{key} {models.schema[key].dataType.simpleString()}, state int, share double")


def backward(df: DataFrame, A, mu, sigma2, value: str = "ret", key: str = "symbol", block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """df with log_beta, an array over states."""
    A, _, mu, sigma2 = N.checked_model(A, np.full(len(mu), 1 / len(mu)), mu, sigma2)

    def per_block(rows: pd.DataFrame, behind: np.ndarray | None) -> pd.DataFrame:
        log_b = N.emissions(rows[value].to_numpy(float), mu, sigma2)
        if behind is not None:  # what is behind the block acts as one more row
            log_b = np.vstack([log_b, np.log(_after(len(mu), behind)) + behind[-1]])
        return rows.assign(log_beta=list(N.backward(log_b, A)[: len(rows)]))

    rows = scans.blocked(df, block_rows)
    carry = scans.scanned(rows, _transfer(A, mu, sigma2, value), _product(len(mu)), key, reverse=True)
    return scans.with_columns(rows, "log_beta array<double>", per_block, key, [carry])


def posteriors(df: DataFrame, A, pi, mu, sigma2, value: str = "ret", key: str = "symbol", block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """df with gamma, the smoothed probabilities."""
    A, pi, mu, sigma2 = N.checked_model(A, pi, mu, sigma2)
    k = len(mu)

    def per_block(rows: pd.DataFrame, before: np.ndarray | None, behind: np.ndarray | None) -> pd.DataFrame:
        log_b = N.emissions(rows[value].to_numpy(float), mu, sigma2)
        return rows.assign(gamma=list(N.smoothed_steps(log_b, A, _prior(pi, before), _after(k, behind))[0]))

    rows = scans.blocked(df, block_rows)
    element = scans.elements(scans.several(rows, key), _transfer(A, mu, sigma2, value), key)
    carries = [scans.prefixes(element, _product(k), key), scans.prefixes(element, _product(k), key, reverse=True)]
    return scans.with_columns(rows, "gamma array<double>", per_block, key, carries)


def emission_m_step(df: DataFrame, value: str = "ret", key: str = "symbol", min_variance: float = 1e-8) -> DataFrame:
    """(key, state, weight, mu, sigma2) from gamma: the M-step of the emissions as one aggregation over states."""
    g, y = F.col("g"), F.col(value)
    long = df.select(key, value, F.posexplode("gamma").alias("state", "g"))
    sums = long.groupBy(key, "state").agg(F.sum(g).alias("weight"), (F.sum(g * y) / F.greatest(F.sum(g), F.lit(1e-15))).alias("mu"), F.sum(g * y * y).alias("yy"))
    spread = F.col("yy") / F.greatest("weight", F.lit(1e-15)) - F.col("mu") ** 2
    return sums.select(key, "state", "weight", "mu", F.greatest(spread, F.lit(min_variance)).alias("sigma2"))


def m_step(df: DataFrame, A, pi, mu, sigma2, value: str = "ret", key: str = "symbol", min_variance: float = 1e-8, block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """(key, state, start, A, mu, sigma2): all parameters of one EM step from a given model; A is the state's row of moves."""
    means = F.element_at(F.array(*map(F.lit, np.asarray(mu, float).tolist())), F.col("state") + 1)
    weight, total = F.greatest("weight", F.lit(1e-15)), F.greatest(F.aggregate("moves", F.lit(0.0), lambda a, x: a + x), F.lit(1e-300))
    shift = F.col("y") / weight
    sums = statistics(df, A, pi, mu, sigma2, value, key, block_rows)
    return sums.select(key, "state", "start", F.transform("moves", lambda x: x / total).alias("A"), (means + shift).alias("mu"), F.greatest(F.col("yy") / weight - shift**2, F.lit(min_variance)).alias("sigma2"))


def viterbi(df: DataFrame, A, pi, mu, sigma2, value: str = "ret", key: str = "symbol", block_rows: int = scans.BLOCK_ROWS) -> DataFrame:
    """df with state, the most likely path's, and log_prob, that of the whole path, the same in all rows of a series.

    Going forward, blocks are max-plus matrices: from scores of entering a block in each state to those of entering the next. Going
    back, each is a map from the state that the next block begins in to the one that it begins in itself.
    """
    A, pi, mu, sigma2 = N.checked_model(A, pi, mu, sigma2)
    k, log_A, log_pi = len(mu), np.log(A), np.log(pi)
    kind = scans.kind_of(df, key)
    emitted = lambda rows: N.emissions(rows[value].to_numpy(float), mu, sigma2)
    sizes_of = lambda rows, starts: np.diff(np.append(starts, len(rows)))

    def entered(given: np.ndarray, before: np.ndarray) -> np.ndarray:
        out = np.tile(log_pi, (len(given), 1))
        if given.any():
            out[given] = (log_pi[:, None] + before[given].reshape(-1, k, k)).max(axis=1)
        return out

    def solved(rows: pd.DataFrame, starts: np.ndarray, entering: np.ndarray):
        """Of all blocks, some at a time: their numbers, moves (of a single block as lists), last scores, the best last state and the
        best one by the state that the next block begins in."""
        log_b, sizes = emitted(rows), sizes_of(rows, starts)
        for blocks in N.together(sizes):
            if len(blocks) == 1:
                low = starts[blocks[0]]
                back, best = N.viterbi_moves(log_b[low : low + sizes[blocks[0]]], log_A, entering[blocks[0]])
                best = np.array([best])
            else:
                back, best = N.stacked_moves(log_b, starts[blocks], sizes[blocks], log_A, entering[blocks])
            top = np.zeros(len(blocks), int)
            for i in range(1, k):
                top[best[:, i] > best[np.arange(len(blocks)), top]] = i
            yield blocks, back, best, top, (best[:, :, None] + log_A).argmax(axis=1)

    def elements(rows: pd.DataFrame, starts: np.ndarray) -> np.ndarray:
        log_b, sizes = emitted(rows), sizes_of(rows, starts)
        out = np.zeros((len(starts), k * k))
        for size in np.unique(sizes):
            blocks = np.flatnonzero(sizes == size)
            out[blocks] = N.best_chained(log_b[starts[blocks][:, None] + np.arange(size)], log_A).reshape(-1, k * k)
        return out

    def choices(rows: pd.DataFrame, starts: np.ndarray, before) -> np.ndarray:
        """The state that each block begins in by the one of the next block's beginning; then, if it is the last, the state and score."""
        out = np.zeros((len(starts), k + 2))
        for blocks, back, best, top, last in solved(rows, starts, entered(*before)):
            ends = np.column_stack([last, top])
            out[blocks, : k + 1] = [[N.traced(back, i)[0] for i in ends[0].tolist()]] if len(blocks) == 1 else N.stacked_firsts(back, ends)
            out[blocks, -1] = best[np.arange(len(blocks)), top]
        return out

    def chosen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.array([*a[b[: k + 1].astype(int)], b[-1]])

    def per_stack(rows: pd.DataFrame, starts: np.ndarray, before, behind) -> pd.DataFrame:
        state, score, (followed, behind) = np.zeros(len(rows), np.int32), np.zeros(len(starts)), behind
        for blocks, back, best, top, last in solved(rows, starts, entered(*before)):
            ends, score[blocks] = top.copy(), best[np.arange(len(blocks)), top]
            at = np.flatnonzero(followed[blocks])
            if len(at):
                ends[at], score[blocks[at]] = last[at, behind[blocks[at], k].astype(int)], behind[blocks[at], -1]
            if len(blocks) == 1:
                path = N.traced(back, int(ends[0]))
                state[starts[blocks[0]] : starts[blocks[0]] + len(path)] = path
            else:
                N.stacked_paths(back, starts[blocks], ends, state)
        return rows.assign(state=state, log_prob=np.repeat(score, sizes_of(rows, starts)))

    def per_block(f, df: DataFrame, carries: list[DataFrame]) -> DataFrame:
        one = lambda rows, starts, *begins: pd.DataFrame({key: rows[key].iloc[starts], "__block": rows["__block"].iloc[starts], "__element": list(f(rows, starts, *begins))})
        return scans.applied_together(df, one, key, f"{kind}, __block long, __element array<double>", carries)

    rows = scans.blocked(df, block_rows)
    long = scans.several(rows, key).select(key, "seq", value, "__block")
    forward = scans.prefixes(per_block(elements, long, []), lambda a, b: (a.reshape(k, k, 1) + b.reshape(1, k, k)).max(axis=1).ravel(), key)
    backward = scans.prefixes(per_block(choices, long, [forward]), chosen, key, reverse=True)
    return scans.with_columns(rows, "state int, log_prob double", per_stack, key, [forward, backward], scans.applied_together)


#: Restarts that advance together in one task, fewer where the series is long; further ones run beside it.
RESTARTS_TOGETHER, ROWS_TOGETHER = 5, 1 << 16
#: Partitions for each restart, so that few of them share one: they are few and costly, and Spark would merge their few rows.
SPREAD = 16


def fits(df: DataFrame, ks: list[int], restarts: int = 10, max_iter: int = 200, tol: float = 1e-6, seed: int = 42, value: str = "ret", key: str = "symbol") -> DataFrame:
    """(key, k, restart, model, ll, n_iter, history) of every series, k and restart: groups of RESTARTS_TOGETHER are tasks of their own,
    of fewer restarts where they have more than ROWS_TOGETHER rows in all.

    A series goes to its tasks as rows of PACKED_ROWS values, of which a task keeps the values alone, in a
    file if they are many. A restart
    draws from its own seed, so that results do not hang on the grouping.
    """
    series = cut(scans.packed(df, value, key))
    n = F.sum(F.size("obs")).over(Window.partitionBy(key))
    together = F.greatest(F.lit(1), F.least(F.lit(RESTARTS_TOGETHER), F.floor(F.lit(ROWS_TOGETHER) / F.col("n")))).cast("int")
    dealt = series.withColumn("n", n).withColumn("size", together).withColumn("low", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1), F.col("size"))))
    dealt = dealt.select(key, F.posexplode(F.array(*map(F.lit, ks))).alias("at", "k"), "low", "size", "n", "__block", "obs")
    # a partition for each group, so that none waits for another; where there are many series, they are dealt by hash
    groups = restarts * len(ks)
    spread = max(SPREAD, -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // groups))
    place, _ = scans.places(series, key, spread)
    placed = dealt.repartitionById(spread * groups, ((F.col("at") * restarts + F.col("low")) * spread + place).cast("int"))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, k, low, size, n), pieces in scans.pieces(batches, 5):
            size = min(size, restarts - low)
            found = N.em(N.Lanes(pieces, n, size), k, N.seed_list(seed_of(seed, name, k), size, low), max_iter, tol)
            yield pa.RecordBatch.from_pylist([{key: name, "k": k, "restart": low + r, "ll": m["ll"], "n_iter": m["n_iter"], "history": m["history"], **{c: v.tolist() for c, v in N.sorted_states(m).items()}} for r, m in enumerate(found)], made)

    schema = f"{key} {df.schema[key].dataType.simpleString()}, k int, restart int, {FIT}"
    made = to_arrow_schema(StructType.fromDDL(schema))
    return placed.sortWithinPartitions(key, "k", "low", "__block").select(key, "k", "low", "size", "n", "obs").mapInArrow(per_task, schema)


def fit(df: DataFrame, k: int = 3, restarts: int = 10, max_iter: int = 200, tol: float = 1e-6, seed: int = 42, value: str = "ret", key: str = "symbol") -> DataFrame:
    """(key, k, model, ll, n_iter, history) of every series, by EM: the restart of the greatest finite likelihood."""
    return _best(fits(df, [k], restarts, max_iter, tol, seed, value, key), key)


def _best(found: DataFrame, key: str) -> DataFrame:
    """Of each series and k the best restart, the first of equal ones; an error where no likelihood is finite."""
    finite = F.when(F.abs("ll") < float("inf"), F.col("ll"))
    rank = F.row_number().over(Window.partitionBy(key, "k").orderBy(F.desc_nulls_last("__ll"), "restart"))
    best = found.withColumn("__ll", finite).withColumn("__rank", rank).where("__rank = 1")
    checked = F.when(F.col("__ll").isNull(), F.raise_error(F.lit("no restart reached a finite likelihood")).cast("double")).otherwise(F.col("ll"))
    return best.withColumn("ll", checked).drop("__ll", "__rank", "restart")


def attempted(df: DataFrame, ks: list[int], successes: int = 10, attempts: int = 150, max_iter: int = 200, tol: float = 1e-6, seed: int = 42, value: str = "ret", key: str = "symbol", accept: Callable[[dict], bool] = N.usable) -> DataFrame:
    """(key, k, attempt, accepted, model, ll, n_iter, history) of all attempts made until `successes` of a series and k are accepted.

    Attempts are made in waves: each series and k gets as many as it still lacks, in groups of RESTARTS_TOGETHER that are tasks of
    their own, and none once it has all or has used up `attempts`. An attempt draws from its own seed, so that results equal those
    of trying one after the other. A wave's results are checkpointed; the driver only asks whether another wave is needed.
    """
    series = df.select(key, "seq", value)
    names = [x.split()[0] for x in FIT.split(", ")]
    lacking = series.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, ks))).alias("k"), F.lit(0).alias("tried"), F.lit(successes).alias("need"))

    def per_group(rows: pd.DataFrame) -> pd.DataFrame:
        obs = rows.sort_values("seq", kind="stable")[value].to_numpy(float)
        name, k, low, high = rows[key].iloc[0], *(int(rows[c].iloc[0]) for c in ("k", "low", "high"))
        found = N.em(obs, k, N.seed_list(seed_of(seed, name, k), high - low, low), max_iter, tol)
        out = []
        for n, m in enumerate(found, low):
            ok = bool(accept(m))
            model = {c: v.tolist() for c, v in N.sorted_states(m).items()} if ok else dict.fromkeys(("A", "pi", "mu", "sigma2"))
            out.append({key: name, "k": k, "attempt": n, "accepted": ok, **{c: m[c] for c in ("ll", "n_iter", "history")}, **model})
        return pd.DataFrame(out)[[key, "k", "attempt", "accepted", *names]]

    made = None
    while True:
        dealt = lacking.withColumn("end", F.least(F.col("tried") + F.col("need"), F.lit(attempts))).where("need > 0 AND tried < end")
        groups = dealt.select(F.col(key).alias("__of"), "k", "end", F.explode(F.expr(f"sequence(tried, end - 1, {RESTARTS_TOGETHER})")).alias("low")).withColumn("high", F.least(F.col("low") + RESTARTS_TOGETHER, F.col("end"))).drop("end")
        if made is not None and groups.isEmpty():
            return made
        met = series.join(groups, F.col(key).eqNullSafe(F.col("__of"))).drop("__of")
        wave = met.groupBy(key, "k", "low").applyInPandas(per_group, f"{scans.kind_of(df, key)}, k int, attempt int, accepted boolean, {FIT}")
        made = cut(wave if made is None else made.unionByName(wave))
        lacking = made.groupBy(key, "k").agg(F.count("*").cast("int").alias("tried"), (F.lit(successes) - F.count_if("accepted")).cast("int").alias("need"))


def fit_retried(df: DataFrame, ks: list[int], successes: int = 10, attempts: int = 150, max_iter: int = 200, tol: float = 1e-6, seed: int = 42, value: str = "ret", key: str = "symbol", accept: Callable[[dict], bool] = N.usable) -> DataFrame:
    """As fit() for each of ks, with attempts: the best of the first `successes` usable fits of at most `attempts`, in their order;
    an error where there is none."""
    made = attempted(df, ks, successes, attempts, max_iter, tol, seed, value, key, accept)
    whole = Window.partitionBy(key, "k")
    rank = F.row_number().over(whole.orderBy(F.desc("accepted"), F.desc("ll"), "attempt"))
    best = made.withColumn("attempts", F.count("*").over(whole).cast("int")).withColumn("__rank", rank).where("__rank = 1")
    failed = F.raise_error(F.concat(F.lit("no usable fit in "), F.col("attempts"), F.lit(" attempts"))).cast("double")
    return best.withColumn("ll", F.when(F.col("accepted"), F.col("ll")).otherwise(failed)).drop("__rank", "attempt", "accepted")


def select_k(df: DataFrame, ks: list[int], criterion: str = "bic", value: str = "ret", key: str = "symbol", **options) -> DataFrame:
    """A row for each series and k with ll, aic, bic and whether the criterion chooses it; the smallest k of equals.

    Fits of all k and restarts run side by side.
    """
    from tidemark.operators.regimes import aic, bic

    if criterion not in ("aic", "bic"):
        raise ValueError("criterion must be 'aic' or 'bic'")
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    scored = _best(fits(df, ks, value=value, key=key, **options), key).select(key, "k", "ll").join(n, key)
    scored = scored.withColumn("aic", aic(F.col("ll"), F.col("k"))).withColumn("bic", bic(F.col("ll"), F.col("k"), F.col("n")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last(criterion), "k"))
    return scored.withColumn("chosen", rank == 1)


def gibbs(df: DataFrame, k: int = 3, n_samples: int = 200, burn_in: int = 200, thin: int = 2, chains: int = 1, seed: int = 42, value: str = "ret", key: str = "symbol", concentration=1.0, start_concentration=1.0) -> DataFrame:
    """(key, chain, sample, state, mu, sigma2, pi, a) in long form: posterior means and deviations are aggregates of it."""
    kind = df.schema[key].dataType.simpleString()
    chained = df.select(key, "seq", value, F.explode(F.sequence(F.lit(0), F.lit(chains - 1))).alias("chain"))

    def per_chain(rows: pd.DataFrame) -> pd.DataFrame:
        obs = rows.sort_values("seq", kind="stable")[value].to_numpy(float)
        name, chain = rows[key].iloc[0], int(rows["chain"].iloc[0])
        out = N.gibbs(obs, k, n_samples, burn_in, thin, seed_of(seed, name, chain), concentration, start_concentration)
        n = len(out["mu"])
        return pd.DataFrame({key: name, "chain": chain, "sample": np.repeat(np.arange(n), k), "state": np.tile(np.arange(k), n), "mu": out["mu"].ravel(), "sigma2": out["sigma2"].ravel(), "pi": out["pi"].ravel(), "a": list(out["A"].reshape(-1, k))})

    return chained.groupBy(key, "chain").applyInPandas(per_chain, f"{key} {kind}, chain int, sample int, state int, mu double, sigma2 double, pi double, a array<double>")


def posterior_summary(draws: DataFrame, key: str = "symbol") -> DataFrame:
    return draws.groupBy(key, "state").agg(*(f(c).alias(f"{c}_{n}") for c in ("mu", "sigma2", "pi") for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def expected_durations(models: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows a stay in each state is expected to last."""
    stay = F.element_at("row", F.col("state") + 1)
    return models.select(key, F.posexplode("A").alias("state", "row")).select(key, "state", (1 / F.greatest(1 - stay, F.lit(1e-12))).alias("duration"))
