"""Kernels against definitions and optimality conditions."""

import numpy as np
import pytest

from quantloom.config import Config, override
from quantloom.kernels import hmm, optim, series


@pytest.fixture
def returns():
    rng = np.random.default_rng(1)
    return 0.01 * (rng.normal(size=(250, 1)) + rng.normal(size=(250, 12)) * np.linspace(0.5, 2, 12)) + 0.0005


def test_min_variance_satisfies_kkt(returns):
    s = optim.covariance(returns)
    w = optim.min_variance(s)
    g = s @ w
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    assert (g >= w @ g - 1e-9).all() and np.allclose(g[w > 1e-6], w @ g, rtol=1e-4)


@pytest.mark.parametrize("strategy", [s for s in optim.strategies() if s != "index_benchmark"])
def test_weights_are_long_only_and_sum_to_one(returns, strategy):
    w = optim.build_weights(strategy, returns, Config().portfolio, np.linspace(0.5, 1.5, len(returns)))
    assert w.sum() == pytest.approx(1) and (w >= -1e-12).all()


def test_conditional_strategy_needs_context(returns):
    with pytest.raises(ValueError):
        optim.build_weights("hrp_rc", returns, Config().portfolio)


def test_cvar_beats_neighbours(returns):
    w = optim.cvar_min(returns, 0.95)
    best, rng = optim.cvar(returns, w, 0.95), np.random.default_rng(0)
    for _ in range(200):
        v = 0.9 * w + 0.1 * rng.dirichlet(np.ones(len(w)))
        assert optim.cvar(returns, v, 0.95) >= best - 1e-8


def test_weighted_covariance_with_equal_weights_is_the_sample_one(returns):
    assert np.allclose(optim.covariance(returns, "sample", np.ones(len(returns))), np.cov(returns.T))


def test_hmm_recovers_two_regimes_and_filter_meets_smoother():
    rng = np.random.default_rng(3)
    truth = np.tile(np.r_[np.zeros(120, int), np.ones(80, int)], 4)
    x = rng.normal(size=len(truth)) * np.where(truth, 2.5, 0.5)
    model = hmm.fit(np.column_stack((x, np.abs(x))), 2, n_init=2, rounds=80)
    f = np.column_stack((x, np.abs(x)))
    path = np.argsort(hmm.volatility_order(hmm.decode(model, f), x, 2))[hmm.decode(model, f)]
    assert (path == truth).mean() > 0.85
    assert np.allclose(hmm.filtered(model, f)[-1], hmm.smoothed(model, f)[0][-1])
    assert hmm.n_params(2, 2) == 13


def test_chi2_and_bootstrap():
    assert series.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert series.chi2_sf(7.815, 3) == pytest.approx(0.05, abs=1e-4)
    x = np.random.default_rng(0).normal(0.001, 0.01, 300)
    assert series.bootstrap_sharpe_test(x, x, n_boot=50)["p_value"] == 1.0
    assert series.bootstrap_sharpe_test(x[:20], x[:20]) == {"n_obs": 20}
    assert series.deflated_sharpe(x, 100) <= series.deflated_sharpe(x, 2)


def test_override_copies():
    base = Config()
    assert override(base, backtest={"rebalance_frequency": "Q"}).backtest.rebalance_frequency == "Q"
    assert base.backtest.rebalance_frequency == "M"


def test_hrp_shares_alike_between_clusters_without_variance():
    w = optim.hrp(np.diag([0.0, 0.0, 1.0, 1.0]))
    assert np.isfinite(w).all() and w.sum() == pytest.approx(1)
    assert optim.hrp(np.zeros((3, 3))) == pytest.approx([0.25, 0.25, 0.5], abs=0.26) and np.isfinite(optim.hrp(np.zeros((3, 3)))).all()
    s = np.diag([1.0, 4.0])
    assert optim.hrp(s) == pytest.approx([0.8, 0.2])


def test_black_litterman_is_the_precision_weighted_mean(returns):
    s = optim.covariance(returns)
    prior, view = s @ np.full(12, 1 / 12), returns.mean(0)
    for confidence in (0.1, 1.0, 5.0):
        ts = np.linalg.inv(0.05 * s + 1e-10 * np.eye(12))
        omega = np.diag(1 / np.maximum(0.05 * np.diag(s) / confidence, 1e-12))
        assert optim.black_litterman(s, prior, view, 0.05, confidence) == pytest.approx(np.linalg.solve(ts + omega, ts @ prior + omega @ view), rel=1e-8)


def test_shrinkage_by_its_definition(returns):
    x = returns - returns.mean(0)
    t, n = x.shape
    s = x.T @ x / t
    mu = np.trace(s) / n
    d2 = ((s - mu * np.eye(n)) ** 2).sum() / n
    b2 = min(d2, sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / t / t / n)
    assert optim.covariance(returns) == pytest.approx(b2 / d2 * mu * np.eye(n) + (1 - b2 / d2) * s)


def test_max_sharpe_and_utility_beat_neighbours(returns):
    s, mu, rng = optim.covariance(returns), returns.mean(0), np.random.default_rng(5)
    best, cautious = optim.max_sharpe(s, mu), optim.max_utility(s, mu, 5.0)
    ratio = lambda w: w @ mu / np.sqrt(w @ s @ w)
    useful = lambda w: w @ mu - 2.5 * w @ s @ w
    for _ in range(300):
        v = rng.dirichlet(np.ones(12))
        assert ratio(0.9 * best + 0.1 * v) <= ratio(best) + 1e-6 and useful(0.9 * cautious + 0.1 * v) <= useful(cautious) + 1e-9


@pytest.mark.parametrize("kind", hmm.KINDS)
def test_covariance_kinds(kind):
    rng = np.random.default_rng(6)
    truth = np.repeat([0, 1, 0, 1], 120)
    x = rng.normal(size=(480, 2)) * np.where(truth[:, None], 3.0, 0.5) + truth[:, None] * 2
    model = hmm.fit(x, 2, n_init=3, rounds=60, kind=kind)
    c = model.covars
    assert {"full": 13, "diag": 11, "spherical": 9, "tied": 10}[kind] == hmm.n_params(2, 2, kind)
    assert kind == "full" or (kind == "tied" and np.allclose(c[0], c[1])) or np.allclose(c * (1 - np.eye(2)), 0)
    assert kind != "spherical" or np.allclose(c[:, 0, 0], c[:, 1, 1])
    gamma, _, total = hmm.smoothed(model, x)
    assert model.loglik == pytest.approx(total, rel=1e-3) and np.allclose(gamma.sum(1), 1)
    with pytest.raises(ValueError):
        hmm.fit(x, 2, kind="round")


def test_restarts_side_by_side_equal_single_ones():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 2)) * np.where(np.arange(200)[:, None] // 50 % 2, 3.0, 0.5)
    one = [hmm.fit(x, 2, n_init=1, rounds=40, seed=42 + i).loglik for i in range(4)]
    assert hmm.fit(x, 2, n_init=4, rounds=40).loglik == pytest.approx(max(one))
    with pytest.raises(RuntimeError):
        hmm.fit(x[:1], 2)


def test_correlations_return_to_the_covariance_of_the_residuals():
    rng = np.random.default_rng(8)
    z = rng.normal(size=(400, 2)) @ np.linalg.cholesky(np.array([[1.0, 0.5], [0.5, 1.0]])).T * [1.3, 0.7]
    path, _ = series.dcc_path(z, 0.0, 0.0)
    bar = np.cov(z.T)
    assert path[5, 0, 1] == pytest.approx(bar[0, 1] / np.sqrt(bar[0, 0] * bar[1, 1]))
    q = 0.95 * bar + 0.05 * np.outer(z[0], z[0])
    assert series.dcc_path(z, 0.05, 0.0)[0][1, 0, 1] == pytest.approx(q[0, 1] / np.sqrt(q[0, 0] * q[1, 1]))
    found = series.fit_dcc(z[:250] / 100)
    assert 1e-6 <= found["a"] <= 0.3 and 1e-6 <= found["b"] <= 0.999 and found["a"] + found["b"] < 0.999
    assert found["mean"][0, 1] == pytest.approx(0.5, abs=0.12)


def test_series_tests_tell_known_series_apart():
    rng = np.random.default_rng(9)
    noise, walks = rng.normal(size=600), rng.normal(size=(9, 600)).cumsum(1)
    assert series.adf(noise)[1] < 0.01 < 0.1 < np.median([series.adf(w)[1] for w in walks])
    assert series.kpss(noise)[1] == 0.10 and np.median([series.kpss(w)[1] for w in walks]) == 0.01
    assert series.ks_normal(noise)[1] > 0.05 > series.ks_normal(rng.standard_t(2, 600))[1]
    smooth = np.convolve(noise, [1, 0.8], "valid")
    assert series.ljung_box(smooth, 10)[1] < 0.01
    h, e = 1.0, []
    for v in noise:
        e.append(np.sqrt(h) * v)
        h = 0.2 + 0.6 * e[-1] ** 2 + 0.2 * h
    assert series.arch_lm(np.array(e), 10)[1] < 0.01
    c = noise - noise.mean()
    q = 600 * 602 * sum((sum(c[t] * c[t - k] for t in range(k, 600)) / (c @ c)) ** 2 / (600 - k) for k in range(1, 11))
    assert series.ljung_box(noise, 10)[0] == pytest.approx(q)
    facts = series.stylised_facts(noise)
    s, k = (c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2 - 3
    assert facts["jb"] == pytest.approx(100 * (s * s + k * k / 4)) and series.stylised_facts(noise[:10]) == {"n_obs": 10}


def test_bootstrap_has_size_and_power():
    rng = np.random.default_rng(10)
    small = 0
    for k in range(12):
        x, y = rng.normal(0.0005, 0.01, (2, 250))
        small += series.bootstrap_sharpe_test(x, y, n_boot=200, seed=k)["p_value"] < 0.05
    assert small <= 6
    y = rng.normal(0, 0.01, 500)
    assert series.bootstrap_sharpe_test(y + 0.004, y, n_boot=200)["p_value"] < 0.05
    assert np.isnan(series.deflated_sharpe(y[:20], 5)) and series.expected_max_sharpe(1, 1.0) == 0.0


def test_garch_recovers_persistence():
    rng = np.random.default_rng(11)
    h, r = 1e-4, []
    for v in rng.normal(size=2500):
        r.append(np.sqrt(h) * v)
        h = 2e-6 + 0.1 * r[-1] ** 2 + 0.88 * h
    found = series.fit_garch(np.array(r))
    assert 0.03 < found["alpha"] < 0.2 and 0.93 < found["alpha"] + found["beta"] < 1 and np.isfinite(found["loglik"])


def clusters_by_definition(d):
    """Single-linkage merges found by looking at all pairs of clusters each time; no two distances may be equal."""
    n = len(d)
    groups, merges = {k: {k} for k in range(n)}, []
    while len(groups) > 1:
        near = {(a, b): min(d[i, j] for i in groups[a] for j in groups[b]) for a in groups for b in groups if a < b}
        (a, b), gap = min(near.items(), key=lambda x: x[1])
        groups[n + len(merges)] = groups.pop(a) | groups.pop(b)
        merges.append((a, b, gap, len(groups[n + len(merges)])))
    return merges


def leaves_of(merges, k):
    n = len(merges) + 1
    return [k] if k < n else leaves_of(merges, merges[k - n][0]) + leaves_of(merges, merges[k - n][1])


def hrp_by_definition(s):
    n = len(s)
    sd = np.sqrt(np.diag(s))
    merges = clusters_by_definition(np.sqrt(np.maximum(1 - s / np.outer(sd, sd), 0) / 2))

    def variance(part):
        iv = 1 / np.diag(s)[part]
        return (iv / iv.sum()) @ s[np.ix_(part, part)] @ (iv / iv.sum())

    def share(part):
        if len(part) == 1:
            return {part[0]: 1.0}
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        a = 1 - variance(left) / (variance(left) + variance(right))
        return {k: a * v for k, v in share(left).items()} | {k: (1 - a) * v for k, v in share(right).items()}

    told = share(leaves_of(merges, 2 * n - 2))
    return np.array([told[k] for k in range(n)])


def test_linkage_rows_and_leaf_order_of_three_names():
    d = np.array([[0, 0.3, 0.6], [0.3, 0, 0.4], [0.6, 0.4, 0]])
    assert optim.linkage(d) == [(0, 1, 0.3, 2), (2, 3, 0.4, 3)]
    assert optim.leaf_order(optim.linkage(d)) == [2, 0, 1]  # a name's number is below a cluster's
    sd = np.array([0.1, 0.2, 0.3])
    s = (1 - 2 * d**2) * np.outer(sd, sd)
    assert optim.hrp(s) == pytest.approx(hrp_by_definition(s))


def test_linkage_ties_go_to_the_lower_name_and_from_the_left():
    d = np.ones((4, 4)) - np.eye(4)
    assert optim.linkage(d) == [(0, 1, 1.0, 2), (2, 4, 1.0, 3), (3, 5, 1.0, 4)]
    assert optim.leaf_order(optim.linkage(d)) == [3, 2, 0, 1]
    assert optim.linkage(np.zeros((1, 1))) == [] and optim.leaf_order([]) == [0]


@pytest.mark.parametrize("seed", range(50))
def test_hrp_follows_the_dendrogram(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 12))
    s = np.cov(rng.normal(size=(3 * n + 5, n)) @ rng.normal(size=(n, n)), rowvar=False)
    sd = np.sqrt(np.diag(s))
    d = np.sqrt(np.maximum(1 - s / np.outer(sd, sd), 0) / 2)
    np.fill_diagonal(d, 0)
    got, want = optim.linkage(d), clusters_by_definition(d)
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])
    assert optim.hrp(s) == pytest.approx(hrp_by_definition(s), rel=1e-9)


def test_survivors_give_the_path_of_every_prefix():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 2)) * np.where(np.arange(200) // 30 % 2, 2.0, 0.5)[:, None]
    model = hmm.fit(x, 3, n_init=2, rounds=30)
    seen, p = hmm.survivors(model, x), hmm.filtered(model, x)
    for upto in (1, 2, 57, 199, 200):
        alone = hmm.decode(model, x[:upto])
        assert (seen.path(upto) == alone).all() and (seen.path(upto, 20) == alone[-20:]).all()
        assert np.allclose(p[:upto], hmm.filtered(model, x[:upto]), atol=1e-12)
    # By definition: no path of a short prefix is likelier.
    import itertools

    b = hmm.log_density(model, x[:6])
    score = lambda s: np.log(model.start[s[0]]) + sum(b[t, k] for t, k in enumerate(s)) + sum(np.log(model.trans[i, j]) for i, j in itertools.pairwise(s))
    with np.errstate(divide="ignore"):
        assert score(tuple(seen.path(6))) >= max(map(score, itertools.product(range(3), repeat=6))) - 1e-9


def test_restarts_alone_are_those_side_by_side():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2)) * np.where(np.arange(300) // 50 % 2, 2.0, 0.5)[:, None]
    both = hmm.restarts(x, 2, [42, 43, 44], 40, 1e-2, 1e-3)
    for seed, m in zip((42, 43, 44), both, strict=True):
        (alone,) = hmm.restarts(x, 2, [seed], 40, 1e-2, 1e-3)
        assert alone.loglik == pytest.approx(m.loglik, rel=1e-9) and np.allclose(alone.means, m.means, atol=1e-7)


@pytest.mark.parametrize("n", [2, 3, 17, 100, 101])
def test_blocked_expectations_are_those_of_the_recursion(n):
    rng = np.random.default_rng(n)
    k, x = 3, rng.normal(size=(n, 2))
    runs = hmm._Runs(rng.dirichlet(np.ones(k), 2), rng.dirichlet(np.ones(k), (2, k)), rng.normal(size=(2, k, 2)), np.repeat(np.eye(2)[None, None], 2, 0).repeat(k, 1), np.zeros(2))
    gamma, counts, total = hmm._expect(runs, hmm._densities(runs, x))
    for i in range(2):
        one = hmm.Hmm(runs.start[i], runs.trans[i], runs.means[i], runs.covars[i])
        g, c, ll = hmm.smoothed(one, x)
        assert np.allclose(gamma[:, i], g, atol=1e-10) and np.allclose(counts[i], c, atol=1e-8) and total[i] == pytest.approx(ll, abs=1e-8)


def test_dcc_likelihoods_and_pairs_are_those_of_the_whole_path():
    rng = np.random.default_rng(5)
    z = rng.normal(size=(150, 3)) @ np.linalg.cholesky(np.array([[1, 0.5, 0.2], [0.5, 1, 0.4], [0.2, 0.4, 1]])).T
    points = np.array([(0.0, 0.0), (0.05, 0.9), (0.2, 0.3), (0.02, 0.97)])
    assert series.dcc_likelihoods(z, points) == pytest.approx([series.dcc_path(z, *p)[1] for p in points])
    path, _ = series.dcc_path(z, 0.05, 0.9)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert np.allclose(series.dcc_pair(z[:, i], z[:, j], 0.05, 0.9), path[:, i, j])
    assert series.dcc_inside(series.dcc_grid()).all() and not series.dcc_inside(np.array([[0.3, 0.7], [0.31, 0.1], [0.0, 0.5]])).any()


def test_dcc_polish_beats_the_grid_and_its_neighbours():
    rng = np.random.default_rng(6)
    q, bar, z = np.eye(2), np.array([[1, 0.4], [0.4, 1]]), []
    for _ in range(1500):
        q = 0.08 * bar + 0.07 * (np.outer(z[-1], z[-1]) if z else bar) + 0.85 * q
        s = 1 / np.sqrt(np.diag(q))
        z.append(np.linalg.cholesky(q * np.outer(s, s)) @ rng.normal(size=2))
    z = np.array(z)
    (a, b), top, converged = series.dcc_polish(z, np.array([0.04, 0.88]))
    assert converged and abs(a - 0.07) < 0.05 and abs(b - 0.85) < 0.15
    assert top >= series.dcc_likelihoods(z, series.dcc_grid()).max() and top >= series.dcc_likelihoods(z, np.array([[a, b]]) + rng.normal(0, 0.003, (50, 2))).max() - 1e-6


@pytest.mark.parametrize("t", [60, 333])
def test_slices_of_a_bootstrap_are_the_whole_one(t, monkeypatch):
    rng = np.random.default_rng(t)
    x, y = rng.normal(0.001, 0.01, t), rng.normal(0, 0.01, t)
    # As it is defined: one resample after the other from one generator.
    one, gap, want = np.random.default_rng(7), series.sharpe(x) - series.sharpe(y), []
    for _ in range(130):
        rows = np.concatenate([np.arange(s, s + 21) % t for s in one.integers(0, t, size=-(-t // 21))])[:t]
        want.append(series.sharpe(x[rows]) - series.sharpe(y[rows]))
    d, s = series.bootstrap_draws(x, y, 21, 7, 0, 130)
    assert d == pytest.approx(want, rel=1e-12)
    monkeypatch.setattr(series, "RESAMPLED", 10 * t)
    parts = [series.bootstrap_draws(x, y, 21, 7, a, min(a + 37, 130)) for a in range(0, 130, 37)]
    assert np.array_equal(np.concatenate([p[0] for p in parts]), d) and np.array_equal(np.concatenate([p[1] for p in parts]), s)
    assert series.sharpe_test(x, y, d, s)["t_stat"] == pytest.approx(gap / series.sharpe_gap_errors(x, y)[0])
