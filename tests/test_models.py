"""Identities and recovery of the models: filters against smoothers, special cases against closed forms."""

import itertools

import numpy as np
import pytest

from tidemark.functions import numerics as N
from tidemark.operators import hmm as H
from tidemark.operators import statespace as SS

A = np.array([[0.88, 0.08, 0.04], [0.06, 0.89, 0.05], [0.02, 0.09, 0.89]])
PI, MU, S2 = np.array([0.25, 0.35, 0.4]), np.array([-0.03, 0.002, 0.035]), np.array([3e-4, 1.5e-4, 2.5e-4])


@pytest.fixture(scope="module")
def sample():
    return N.sampled_hmm(600, A, PI, MU, S2, 7)


def test_forward_and_backward_give_one_likelihood(sample):
    log_b = N.emissions(sample[1], MU, S2)
    _, gain = N.forward(log_b, A, PI)
    assert gain.sum() == pytest.approx(N.log_sum_exp(np.log(PI) + log_b[0] + N.backward(log_b, A)[0]), abs=1e-8)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 333])
def test_blocks_equal_the_recursion_row_by_row(n):
    """Filter, smoother and moves of two models at once, whatever the length, against plain recursions."""
    obs = N.sampled_hmm(400, A, PI, MU, S2, 9)[1][:n]
    models = [(A, PI, MU, S2), (A[::-1, ::-1].copy(), PI[::-1].copy(), MU * 0.5, S2 * 3)]
    log_b = np.stack([N.emissions(obs, m, v) for _, _, m, v in models])
    filtered, gain = N.forward(log_b, np.stack([m[0] for m in models]), np.stack([m[1] for m in models]))
    gamma, xi, ll = N.smoothed(log_b, np.stack([m[0] for m in models]), np.stack([m[1] for m in models]))
    for k, (a, p, _, _) in enumerate(models):
        prior, f, g = p, [], []
        for t in range(n):
            joint = prior * np.exp(log_b[k, t])
            f.append(joint / joint.sum())
            g.append(np.log(joint.sum()))
            prior = f[-1] @ a
        beta = np.exp(N.backward(log_b[k], a) - N.backward(log_b[k], a).max(axis=1, keepdims=True))
        both = np.array(f) * beta
        moves = [np.array(f)[t][:, None] * a * (np.exp(log_b[k, t + 1]) * beta[t + 1]) for t in range(n - 1)]
        assert np.allclose(filtered[k], f, atol=1e-12) and np.allclose(gain[k], g, atol=1e-9) and ll[k] == pytest.approx(sum(g))
        assert np.allclose(gamma[k], both / both.sum(axis=1, keepdims=True), atol=1e-9)
        assert np.allclose(xi[k], sum((m / m.sum() for m in moves), np.zeros((3, 3))), atol=1e-8)


def test_restarts_do_not_hang_on_what_runs_beside_them(sample, monkeypatch):
    together = N.em(sample[1], 2, N.seed_list(5, 4), 15)
    monkeypatch.setattr(N, "WORKING_SET", 1)
    for one, other in zip(together, N.em(sample[1], 2, N.seed_list(5, 4), 15), strict=True):
        assert one["ll"] == pytest.approx(other["ll"], abs=1e-9) and np.allclose(one["mu"], other["mu"])


def test_the_best_of_a_number_of_usable_fits(sample, monkeypatch):
    fits = iter([{"ll": x, "history": [x], "n_iter": 1, "A": np.eye(1), "pi": np.ones(1), "mu": np.array([float(k)]), "sigma2": np.ones(1)} for k, x in enumerate((np.nan, 3.0, -np.inf, 5.0, 9.0))])
    monkeypatch.setattr(N, "em", lambda obs, k, seeds, *_: [next(fits) for _ in seeds])
    found = N.retried(sample[1], 1, successes=2, attempts=10)
    assert (found["ll"], found["mu"][0], found["attempts"]) == (5.0, 3.0, 4)
    monkeypatch.setattr(N, "em", lambda obs, k, seeds, *_: [{"ll": np.nan, "A": np.eye(1), "pi": np.ones(1), "mu": np.ones(1), "sigma2": np.ones(1)}] * len(seeds))
    with pytest.raises(RuntimeError):
        N.retried(sample[1], 1, successes=2, attempts=5)


def test_sampled_paths_follow_the_filter(sample):
    filtered, _ = N.forward(N.emissions(sample[1], MU, S2), A, PI)
    paths = np.stack([N.sampled_path(filtered, A, np.random.default_rng(k).random(600)) for k in range(300)])
    gamma = N.smoothed(N.emissions(sample[1], MU, S2), A, PI)[0]
    assert np.abs(np.stack([(paths == k).mean(axis=0) for k in range(3)], axis=1) - gamma).max() < 0.13


def test_array_priors():
    assert N.dirichlet_prior(2.0, (3,)).tolist() == [2, 2, 2]
    with pytest.raises(ValueError):
        N.dirichlet_prior([[1.0, 0.0], [1.0, 1.0]], (2, 2))
    draws = N.gibbs(np.random.default_rng(1).normal(size=60), 2, 30, 10, 1, 3, concentration=np.array([[1e6, 1.0], [1.0, 1e6]]))
    assert draws["A"].mean(axis=0)[0, 0] > 0.99


def test_likelihood_and_path_against_all_paths():
    obs, a, p, m, v = np.array([0.03, -0.04, 0.02, 0.07, -0.01]), np.array([[0.7, 0.3], [0.4, 0.6]]), np.array([0.35, 0.65]), np.array([-0.02, 0.03]), np.array([6e-4, 1.1e-3])
    log_b = N.emissions(obs, m, v)
    scores = {path: np.log(p[path[0]]) + log_b[0, path[0]] + sum(np.log(a[i, j]) for i, j in itertools.pairwise(path)) + sum(log_b[t, path[t]] for t in range(1, 5)) for path in itertools.product((0, 1), repeat=5)}
    assert N.forward(log_b, a, p)[1].sum() == pytest.approx(N.log_sum_exp(np.array(list(scores.values()))), abs=1e-9)
    path, score = N.viterbi(log_b, a, p)
    assert tuple(path) == max(scores, key=scores.get) and score == pytest.approx(max(scores.values()))


def test_em_likelihood_never_falls_and_means_are_found(sample):
    out = N.baum_welch(sample[1], 3, 5, 100, seed=3)
    assert (np.diff(out["history"]) > -1e-6).all()
    assert np.allclose(out["mu"], MU, atol=0.01) and (np.diff(out["mu"]) > 0).all()


def test_gibbs_means(sample):
    draws = N.gibbs(sample[1], 3, 40, 40, 1, seed=1)
    assert np.allclose(draws["mu"].mean(axis=0), MU, atol=0.01)
    assert draws["A"].shape == (40, 3, 3)


def test_model_checks():
    with pytest.raises(ValueError, match="strictly positive"):
        N.checked_model(np.eye(3), PI, MU, S2)
    with pytest.raises(ValueError, match="sum to one"):
        N.checked_model(A * 0.5, PI, MU, S2)


def test_discretised_dynamics_against_integration():
    theta, sigma, dt = -0.45, 0.25, 1.0
    f, q = N.discretized(theta, sigma, dt)
    s = (np.arange(20000) + 0.5) / 20000
    b = np.stack([(np.exp(theta * s) - 1) / theta, np.exp(theta * s)]) * sigma
    assert np.allclose(q, b @ b.T / 20000, atol=1e-8) and f[1, 1] == pytest.approx(np.exp(theta))
    assert np.allclose(N.discretized(0.0, 1.0, 1.0)[1], [[1 / 3, 0.5], [0.5, 1.0]])
    near, limit = N.discretized(-1e-7, 1.0, 1.0)[1], N.discretized(0.0, 1.0, 1.0)[1]
    assert np.allclose(near, limit, atol=1e-2)


def test_rao_blackwell_without_jumps_is_the_kalman_filter():
    p = {"theta": -0.35, "sigma": 0.4, "sigma_obs": 0.25, "lambda_J": 0.0, "mu_J": 0.0, "sigma_J": 0.0}
    path, m0, c0 = N.sampled_langevin(120, p, (40.0, 0.0), 1), np.array([40.0, 0.0]), np.diag([2.0, 0.7])
    m, c, ll = N.kalman_filter(path["obs"], *N.discretized(-0.35, 0.4, 1.0), 0.0625, m0, c0)
    rb = N.rbpf(path["obs"], p, 20, m0, c0, 5)
    assert np.allclose(rb["mean"], m, atol=1e-10) and np.allclose(rb["ll"], ll, atol=1e-10)
    pf = N.particle_filter(path["obs"], p, 4000, m0, c0, 5)
    assert np.abs(pf["mean"][:, 0] - m[:, 0]).mean() < 0.03
    assert (np.linalg.eigvalsh(c) > -1e-12).all()


def test_systematic_resampling_follows_the_weights():
    w = np.array([0.5, 0.0, 0.25, 0.25])
    assert np.bincount(N.systematic(w, np.array(0.5)), minlength=4).tolist() == [2, 0, 1, 1]


def test_filters_do_not_hang_on_what_runs_beside_them():
    """Series of different lengths and parameters stacked, against each of them alone."""
    p = {"theta": np.array([-0.3, -0.1, -0.6]), "sigma": np.array([0.3, 0.2, 0.5]), "sigma_obs": np.array([0.3, 0.5, 0.2]), "lambda_J": np.array([0.1, 0.3, 0.0]), "mu_J": np.array([0.0, 0.2, 0.0]), "sigma_J": np.array([1.0, 0.5, 0.0])}
    series = [N.sampled_langevin(n, {c: float(v[k]) for c, v in p.items()}, (20.0, 0.0), k)["obs"] for k, n in enumerate((150, 40, 200))]
    m0, c0 = SS.prior(np.array([x[0] for x in series]), p)
    for many, one in ((N.rbpf_many, N.rbpf), (N.particle_filter_many, N.particle_filter)):
        stack = many(SS._observations(series), p, 30, m0, c0, [[7, k] for k in range(3)])
        for k, x in enumerate(series):
            alone = one(x, {c: float(v[k]) for c, v in p.items()}, 30, m0[k], c0[k], [7, k])
            assert all(np.allclose(stack[c][: len(x), k], v, atol=1e-9) for c, v in alone.items())


def test_jump_transitions_against_matrices():
    """Two stretches with a jump between, written out with matrices."""
    tau = np.array([0.2, 0.9])
    got = N.jump_transition(np.full(2, -0.7), np.full(2, 0.4), 1.0, tau, np.full(2, 0.3), np.full(2, 0.8))
    for k, t in enumerate(tau):
        (f1, q1), (f2, q2) = N.discretized(-0.7, 0.4, t), N.discretized(-0.7, 0.4, 1 - t)
        f, q = f2 @ f1, f2 @ (q1 + np.diag([0, 0.64])) @ f2.T + q2
        assert np.allclose([got.reach[k], got.decay[k], got.q00[k], got.q01[k], got.q11[k]], [f[0, 1], f[1, 1], q[0, 0], q[0, 1], q[1, 1]])
        assert np.allclose([got.shift0[k], got.shift1[k]], f2[:, 1] * 0.3)


def test_signals_and_ratios_against_loops():
    rng = np.random.default_rng(4)
    trend, prices = rng.normal(size=(60, 2)), 100 * np.cumprod(1 + 0.01 * rng.normal(size=60))
    ret, signal = SS.trend_signals(trend, prices, np.array([4, 7]), np.array([0.06, 0.2]))
    for k, (w, a) in enumerate(((4, 0.06), (7, 0.2))):
        fir = [np.mean(np.sign(trend[t - w + 1 : t + 1, k])) if t >= w - 1 else 0.0 for t in range(60)]
        v, scaled = ret[0] ** 2, []
        for t in range(59):
            scaled.append(fir[t + 1] / np.sqrt(v))
            v = a * ret[t] ** 2 + (1 - a) * v
        full = [0.0, *np.clip(np.array(scaled) / np.std(scaled), -1, 1)]
        assert np.allclose(signal[:, k], full[:-1])
        net = [0.0 * r for r in ret[:1]] + [full[t - 1] * ret[t] - abs(full[t - 1] - (full[t - 2] if t > 1 else 0)) * 3e-4 for t in range(1, 59)]
        assert SS.sharpe_of(ret, signal[:, k : k + 1], 3)[0] == pytest.approx(np.sqrt(252) * np.mean(net) / np.std(net))


def test_series_run_apart_from_each_other(spark):
    both = SS.simulated_regimes(spark, 2, 120, A, PI, MU, S2)
    together = H.fit(both, 2, 2, 10).where("symbol = 's1'").select("ll").first()[0]
    alone = H.fit(both.where("symbol = 's1'").repartition(3), 2, 2, 10).select("ll").first()[0]
    assert together == alone


def test_selection_and_posterior_summary(spark):
    df = SS.simulated_regimes(spark, 1, 400, [[0.93, 0.07], [0.06, 0.94]], [0.4, 0.6], [-0.04, 0.03], [1e-4, 2e-4])
    chosen = H.select_k(df, [1, 2, 3], restarts=3, max_iter=40).where("chosen").first()
    assert chosen.k == 2
    summary = {r.state: r.mu_mean for r in H.posterior_summary(H.gibbs(df, 2, 20, 20, 1, chains=2)).collect()}
    assert summary[0] == pytest.approx(-0.04, abs=0.005) and summary[1] == pytest.approx(0.03, abs=0.005)


def test_grid_search(spark, monkeypatch):
    """Every point of every series; points do not hang on the chunks they come in; the best one is evaluated on test rows."""
    from tidemark.operators import regimes as R

    p = {"theta": -0.2, "sigma": 0.4, "sigma_obs": 0.3, "lambda_J": 0.0, "mu_J": 0.0, "sigma_J": 0.0}
    paths = SS.simulated(spark, 2, 90, p).withColumnRenamed("obs", "price")
    grid = R.parameter_grid(spark, theta=[-0.1, -1.0], lambda_J=[0.0, 0.5], window=[2.0, 6.0])
    out = {(r.symbol, r.grid_idx): r for r in SS.grid_search(paths, grid, p, n=5, alpha=0.06).collect()}
    assert len(out) == 16 and all(r.train_sharpe is not None for r in out.values())
    best = SS.searched(paths, grid, p, n=5, alpha=0.06).collect()
    assert {r.symbol: r.grid_idx for r in best} == {s: max((r.grid_idx for (x, _), r in out.items() if x == s), key=lambda i: (out[s, i].train_sharpe, -i)) for s in ("s0", "s1")}
    assert all(r.gap == pytest.approx(r.train_sharpe - r.test_sharpe) for r in best)
    monkeypatch.setattr(SS, "CELLS", 3)
    assert {k: r.train_sharpe for k, r in out.items()} == pytest.approx({(r.symbol, r.grid_idx): r.train_sharpe for r in SS.grid_search(paths, grid, p, n=5, alpha=0.06).collect()})


def test_particle_trading_learns_from_training_rows(spark):
    """The filter starts at the last training row, has its series' own moments, and does not see the scale of prices."""
    from tidemark.operators import prep as P
    from tidemark.operators import statistics as ST
    from tidemark.plans import trends as E

    steps = np.random.default_rng(3).normal(0, [[0.01], [0.05]], (2, 60))
    prices = [(s, k + 1, float(scale * np.exp(x))) for s, i, scale in (("a", 0, 1), ("b", 1, 1)) for k, x in enumerate(np.cumsum(steps[i]))]
    df = P.log_returns(spark.createDataFrame(prices, "symbol string, seq int, price double"))
    found = E.filtered_on_test(df, n=20).toPandas()
    train = ST.langevin_moments(df.where("seq <= 41")).toPandas().set_index("symbol")
    for symbol, rows in found.groupby("symbol"):
        assert sorted(rows["seq"]) == list(range(41, 60))
        assert all(np.allclose(rows[c], train.loc[symbol, c]) for c in ("theta", "sigma", "sigma_obs", "lambda_J", "sigma_J"))
    scaled = E.filtered_on_test(df.withColumn("price", df["price"] * 1000), n=20).toPandas()
    both = found.merge(scaled, on=["symbol", "seq"])
    assert np.allclose(both["trend_x"], both["trend_y"], atol=1e-6) and np.allclose(both["level_x"] + np.log(1000), both["level_y"])


@pytest.mark.parametrize("jumps", [(0.0, 0.0, 0.0), (0.0, 0.6, 3.0)])
def test_filters_of_trends_equal_the_full_ones(jumps):
    """Laid-out transitions, and one particle for sets without jumps, change nothing; series of different lengths end where they end."""
    rng = np.random.default_rng(5)
    obs = 100 + rng.normal(0, 2, (3, 300))
    obs[1, 200:] = np.nan
    p = {"theta": np.array([-0.1, -0.5, 0.0]), "sigma": np.full(3, 0.4), "sigma_obs": np.array([0.3, 2.0, 1.0]), "lambda_J": np.array(jumps), "mu_J": np.full(3, 0.1), "sigma_J": np.full(3, 2.0)}
    start, seeds = SS.prior(obs[:, 0], p), [[1, k] for k in range(3)]
    full, parts = N.rbpf_many(obs, p, 12, *start, seeds), list(N.rbpf_trends(obs, p, 12, *start, seeds))
    assert [x[0] for x in parts] == np.cumsum([0, *(len(x[1]) for x in parts[:-1])]).tolist()
    for got, want in zip((np.concatenate([x[k] for x in parts]) for k in (1, 2, 3)), (full["mean"][..., 1], full["ll"], full["n_eff"]), strict=True):
        for k, n in enumerate((300, 200, 300)):
            assert got[:n, k] == pytest.approx(want[:n, k], rel=1e-12, abs=1e-14)


def test_a_search_reads_its_series_in_pieces():
    """Filters and Sharpe ratios of pieces are those of the whole series, and no array has a row's points for all rows."""
    import tracemalloc

    rng, sets = np.random.default_rng(8), 4
    obs = 100 + rng.normal(0, 1, 900).cumsum()
    p = {"theta": np.array([-0.1, -0.5, -0.2, -1.0]), "sigma": np.full(4, 0.4), "sigma_obs": np.array([0.3, 2.0, 1.0, 1.0]), "lambda_J": np.full(4, 0.2), "mu_J": np.array([0.0, 0.1, 0.0, 0.0]), "sigma_J": np.full(4, 2.0)}
    start, seeds, windows = SS.prior(np.full(sets, obs[0]), p), [[1, k] for k in range(sets)], np.array([1, 4, 4, 9])
    cuts = np.split(obs, [1, 3, 4, 300, 556])
    whole, parts = (np.concatenate([x[1] for x in N.rbpf_trends(y, p, 6, *start, seeds)]) for y in (obs, iter(cuts)))
    assert np.array_equal(whole, parts)
    for cost, lagged in ((0.0, True), (3.0, True), (3.0, False)):
        want = SS.sharpe_of(*SS.trend_signals(whole, obs, windows, None), cost, lagged)
        got = SS._streamed(iter(cuts), p, 6, obs[0], seeds, 1.0, SS._Sharpes(windows, cost, lagged, 252))
        assert np.isfinite(want).all() and got == pytest.approx(want, rel=1e-9)
    short = SS._streamed(iter([obs[:2]]), p, 6, obs[0], seeds, 1.0, SS._Sharpes(windows, 0.0, True, 252))
    flat = SS._streamed(iter([np.full(50, 5.0)]), p | {"lambda_J": np.zeros(4)}, 6, 5.0, seeds, 1.0, SS._Sharpes(windows, 0.0, True, 252))
    assert np.isnan(short).all() and np.isnan(flat).all()
    rows, sets = 20_000, 64
    p, made = {c: np.full(sets, x[0]) for c, x in p.items()} | {"lambda_J": np.zeros(sets)}, (100 + rng.normal(0, 1, 250) for _ in range(rows // 250))
    tracemalloc.start()
    SS._streamed(made, p, 2, 100.0, [[k] for k in range(sets)], 1.0, SS._Sharpes(np.full(sets, 4), 0.0, True, 252))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * rows * sets  # the whole series' trends have 8 bytes for each row and point, signals several times that


def test_chunks_of_a_search_have_partitions_of_their_own(spark, monkeypatch):
    """Each chunk of a series is a partition, whatever the keys' hashes; a null key is a series too."""
    from tidemark.operators import regimes as R

    p = {"theta": -0.2, "sigma": 0.4, "sigma_obs": 0.3, "lambda_J": 0.0, "mu_J": 0.0, "sigma_J": 0.0}
    rows = [(s, k + 1, 100 + float(x)) for s in (1, 2, 3, 5, None) for k, x in enumerate(np.random.default_rng(s or 9).normal(0, 1, 40).cumsum())]
    df = spark.createDataFrame(rows, "symbol long, seq int, price double")
    monkeypatch.setattr(SS, "CELLS", 2)
    grid = R.parameter_grid(spark, theta=[-0.1, -1.0, -2.0], lambda_J=[0.0, 0.3])
    out = SS.evaluated(df, grid, p, n=5)
    held = [{r.symbol for r in part} for part in out.rdd.glom().collect()]
    assert len(held) == 10 and sorted(map(len, held)) == [1] * 10 and out.count() == 30
    monkeypatch.setattr(SS, "SPREAD", 3)  # by hash where there are more series
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    hashed = SS.evaluated(df, grid, p, n=5)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert hashed.rdd.getNumPartitions() == 2 * 3
    by = lambda r: (str(r.symbol), r.grid_idx)
    assert sorted(out.collect(), key=by) == sorted(hashed.collect(), key=by)


def test_scores_of_a_grid_hold_a_byte_a_row_and_point():
    import tracemalloc

    sets, obs = 64, 100 + np.random.default_rng(6).normal(0, 1, 6000).cumsum()
    p = {c: np.full(sets, x) for c, x in {"theta": -0.2, "sigma": 0.4, "sigma_obs": 0.3, "lambda_J": 0.0, "mu_J": 0.0, "sigma_J": 0.0}.items()}
    mean = N.rbpf_many(obs, p, 2, *SS.prior(np.full(sets, obs[0]), p), [[k] for k in range(sets)])["mean"][..., 1]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(SS, "SCORED", 6000 * 3)
        tracemalloc.start()
        got = SS._scores(obs, p, 2, [[k] for k in range(sets)], 1.0, np.full(sets, 4), 0.06, 2.0, True, 252)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert got == pytest.approx(SS.sharpe_of(*SS.trend_signals(mean, obs, 4, 0.06), 2.0))
    assert peak < 6000 * sets * 8  # one array of doubles; the full filter has seven of them


def test_a_search_runs_once(spark):
    """The best point is read twice, for its row and for its test; points without jumps go with more to a task."""
    from tidemark.operators import regimes as R

    p = {"theta": -0.2, "sigma": 0.4, "sigma_obs": 0.3, "lambda_J": 0.0, "mu_J": 0.0, "sigma_J": 0.0}
    paths = SS.simulated(spark, 2, 40, p).withColumnRenamed("obs", "price")
    out = SS.searched(paths, R.parameter_grid(spark, theta=[-0.1, -1.0]), p, n=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") + plan.count("FlatMapCoGroupsInPandas") == 2 and plan.count("FlatMapCoGroupsInPandas") == 1  # paths are simulated in a group each
    points = [{"grid_idx": k, "lambda_J": k % 2 / 10} for k in range(300)]
    dealt = SS._dealt(points, p, 20)
    assert sorted(x["grid_idx"] for part in dealt for x in part) == list(range(300)) and [len(x) for x in dealt] == [64, 64, 22, 150]


def test_restarts_of_long_series_go_apart(spark, monkeypatch):
    """Restarts are dealt by their rows, to partitions that Spark does not merge, and draw the same numbers however they are dealt."""
    df = SS.simulated_regimes(spark, 2, 120, A[:2, :2] / A[:2, :2].sum(axis=1, keepdims=True), PI[:2] / PI[:2].sum(), MU[:2], S2[:2])
    fits = lambda: H.fits(df, [2], restarts=3, max_iter=5)
    together = {(r.symbol, r.restart): r.ll for r in fits().collect()}
    monkeypatch.setattr(H, "ROWS_TOGETHER", 120)
    apart = fits()
    assert apart.rdd.getNumPartitions() >= 3 * H.SPREAD
    assert len(together) == 6 and {(r.symbol, r.restart): r.ll for r in apart.collect()} == pytest.approx(together, rel=1e-12)
