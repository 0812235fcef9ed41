"""Tests and models of one return series: stylised facts, GARCH, DCC, Markov-switching GARCH, bootstrap inference."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()
#: MacKinnon's published response surface for the constant case, and the level KPSS table.
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
KPSS_CRITICAL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def chi2_sf_even(x: float, df: int) -> float:
    """Survival function for an even number of degrees of freedom."""
    h = x / 2
    return math.exp(-h) * sum(h**j / math.factorial(j) for j in range(df // 2))


def chi2_sf(x: float, df: int) -> float:
    """Survival function: closed form for even df, else the regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        return chi2_sf_even(x, df)
    total = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for j in range(1, (df - 1) // 2 + 1):
        total += term
        term *= x / (2 * j + 1)
    return min(1.0, total)


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, their standard errors, residual sum of squares)."""
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rss = float(((y - x @ beta) ** 2).sum())
    var = rss / max(len(y) - x.shape[1], 1) * np.linalg.pinv(x.T @ x)
    return beta, np.sqrt(np.maximum(np.diag(var), 0)), rss


def ljung_box(x: np.ndarray, lags: int) -> tuple[float, float]:
    c = x - x.mean()
    n, power = len(c), c @ c
    q = n * (n + 2) * sum((c[k:] @ c[:-k] / power) ** 2 / (n - k) for k in range(1, lags + 1))
    return float(q), chi2_sf(q, lags)


def arch_lm(x: np.ndarray, lags: int) -> tuple[float, float]:
    e = (x - x.mean()) ** 2
    y = e[lags:]
    rss = ols(y, np.column_stack([np.ones(len(y)), *(e[lags - k : -k] for k in range(1, lags + 1))]))[2]
    stat = len(y) * (1 - rss / ((y - y.mean()) ** 2).sum())
    return float(stat), chi2_sf(stat, lags)


def adf(x: np.ndarray) -> tuple[float, float]:
    """Augmented Dickey-Fuller with a constant; lags by AIC on a common sample."""
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    d = np.diff(x)

    def regress(lag, drop):
        y = d[drop:]
        cols = [x[drop:-1], np.ones(len(y)), *(d[drop - k : -k] for k in range(1, lag + 1))]
        return y, np.column_stack(cols)

    def aic(lag):
        y, m = regress(lag, most)
        return len(y) * math.log(ols(y, m)[2] / len(y)) + 2 * m.shape[1]

    lag = min(range(most + 1), key=aic)
    beta, se, _ = ols(*regress(lag, lag))
    tau = float(beta[0] / se[0])
    if tau > ADF_MAX:
        return tau, 1.0
    if tau < ADF_MIN:
        return tau, 0.0
    poly = ADF_SMALL if tau <= ADF_STAR else ADF_LARGE
    return tau, NORMAL.cdf(sum(c * tau**k for k, c in enumerate(poly)))


def kpss(x: np.ndarray) -> tuple[float, float]:
    """Level stationarity with the automatic Bartlett bandwidth of Hobijn et al."""
    e = x - x.mean()
    n = len(e)
    cover = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for k in range(1, cover + 1):
        g = 2 * (e[k:] @ e[:-k]) / n
        s0 += g
        s1 += k * g
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    lrv = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
    eta = float((np.cumsum(e) ** 2).sum() / n**2 / lrv)
    return eta, float(np.interp(eta, *zip(*KPSS_CRITICAL, strict=True)))


def ks_normal(x: np.ndarray) -> tuple[float, float]:
    """Kolmogorov-Smirnov distance from the normal of the sample's own mean and deviation; asymptotic p."""
    n = len(x)
    cdf = np.array([NORMAL.cdf(v) for v in np.sort((x - x.mean()) / x.std(ddof=1))])
    d = float(max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max()))
    z = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n))
    return d, float(min(1, max(0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101)))))


def moments(x: np.ndarray) -> tuple[float, float]:
    """Bias-corrected skewness and excess kurtosis."""
    n, c = len(x), x - x.mean()
    m2, m3, m4 = (c**2).mean(), (c**3).mean(), (c**4).mean()
    g2 = m4 / m2**2 - 3
    return math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))


def stylised_facts(x: np.ndarray, lb_lags: int = 10, arch_lags: int = 10, tests: bool = True) -> dict[str, float]:
    """Moments and tests of a series; fewer than 20 values give their number only, a failing regression no entry."""
    x = x[np.isfinite(x)]
    out: dict[str, float] = {"n_obs": len(x)}
    if len(x) < 20:
        return out
    out["skew"], out["kurt"] = moments(x)
    out["mean_ann"], out["vol_ann"] = x.mean() * 252, x.std(ddof=1) * math.sqrt(252)
    c = x - x.mean()
    s, k = (c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2 - 3
    out["jb"] = len(x) / 6 * (s * s + k * k / 4)
    out["jb_p"] = math.exp(-out["jb"] / 2)
    out["ks"], out["ks_p"] = ks_normal(x)
    if tests:
        for name, run in {"adf": lambda: adf(x), "kpss": lambda: kpss(x), "lb": lambda: ljung_box(x, lb_lags), "lb2": lambda: ljung_box(x**2, lb_lags), "arch": lambda: arch_lm(x, arch_lags)}.items():
            try:
                out[name], out[f"{name}_p"] = run()
            except (np.linalg.LinAlgError, ValueError, ZeroDivisionError, IndexError):
                continue
    return out


# ------------------------------------------------------------------------------------------------ volatility
def nelder_mead(f, x0: np.ndarray, step: np.ndarray, rounds: int = 400, tol: float = 1e-9) -> np.ndarray:
    points = [np.asarray(x0, float), *(x0 + np.eye(len(x0))[i] * step[i] for i in range(len(x0)))]
    ranked = sorted(((f(p), i, p) for i, p in enumerate(points)), key=lambda t: t[:2])
    stamp = len(ranked)
    for _ in range(rounds):
        if abs(ranked[-1][0] - ranked[0][0]) < tol * (1 + abs(ranked[0][0])):
            break
        centre = np.mean([p for _, _, p in ranked[:-1]], 0)
        worst = ranked[-1]
        at = lambda k: (f(p := centre + k * (centre - worst[2])), stamp, p)  # noqa: B023, E731
        new = at(1.0)
        if new[0] < ranked[0][0]:
            new = min(new, at(2.0), key=lambda t: t[0])
        elif new[0] >= ranked[-2][0]:
            new = min(at(0.5), at(-0.5), key=lambda t: t[0])
        stamp += 1
        if new[0] < worst[0]:
            ranked[-1] = new
        else:
            ranked = [ranked[0], *((f(q := ranked[0][2] + 0.5 * (p - ranked[0][2])), i, q) for _, i, p in ranked[1:])]
        ranked.sort(key=lambda t: t[:2])
    return ranked[0][2]


def garch_variance(e: np.ndarray, omega: float, alpha: float, beta: float) -> np.ndarray:
    h = np.empty(len(e))
    h[0] = e.var()
    for t in range(1, len(e)):
        h[t] = omega + alpha * e[t - 1] ** 2 + beta * h[t - 1]
    return h


def fit_garch(x: np.ndarray) -> dict[str, np.ndarray | float]:
    """GARCH(1,1) with a constant mean by Gaussian likelihood, on percent returns; parameters and residuals."""
    r = 100 * x
    e = r - r.mean()

    def loss(p):
        omega, alpha, beta = p
        if omega <= 0 or alpha < 0 or beta < 0 or alpha + beta >= 0.9999:
            return 1e12
        h = garch_variance(e, omega, alpha, beta)
        return 0.5 * float((np.log(h) + e * e / h).sum())

    starts = [(e.var() * (1 - a - b), a, b) for a, b in ((0.05, 0.9), (0.1, 0.8), (0.05, 0.5))]
    best = min((nelder_mead(loss, np.array(s), np.array([0.2 * s[0], 0.05, -0.1])) for s in starts), key=loss)
    h = garch_variance(e, *best)
    return {"omega": best[0], "alpha": best[1], "beta": best[2], "loglik": -loss(best) - 0.5 * len(e) * math.log(2 * math.pi), "z": e / np.sqrt(h), "vol": np.sqrt(h)}


def dcc_path(z: np.ndarray, a: float, b: float) -> tuple[np.ndarray, float]:
    """(T x N x N correlations, likelihood part) of the DCC(1,1) recursion towards the covariance of the residuals.

    The likelihood is minus infinity where a correlation matrix is not positive definite.
    """
    bar = np.atleast_2d(np.cov(z.T))
    q, out, total = bar.copy(), np.empty((len(z), *bar.shape)), 0.0
    for t in range(len(z)):
        if t:
            q = (1 - a - b) * bar + a * np.outer(z[t - 1], z[t - 1]) + b * q
        s = 1 / np.sqrt(np.diag(q))
        r = out[t] = q * np.outer(s, s)
        sign, det = np.linalg.slogdet(r)
        if sign <= 0:
            return out, -math.inf
        total -= 0.5 * (det + z[t] @ np.linalg.solve(r, z[t]) - z[t] @ z[t])
    return out, total


def dcc_likelihoods(z: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The likelihood part of ``dcc_path`` at each (a, b) of ``points``, in one pass over the days."""
    bar = np.atleast_2d(np.cov(z.T))
    a, b = (points[:, k, None, None] for k in (0, 1))
    q, total, good = np.repeat(bar[None], len(points), 0), np.zeros(len(points)), np.ones(len(points), bool)
    for t in range(len(z)):
        if t:
            q = (1 - a - b) * bar + a * np.outer(z[t - 1], z[t - 1]) + b * q
        s = 1 / np.sqrt(np.diagonal(q, axis1=1, axis2=2))
        r = q * s[:, :, None] * s[:, None, :]
        sign, det = np.linalg.slogdet(r)
        good &= sign > 0
        r[~good] = np.eye(len(bar))
        total -= 0.5 * (det + np.linalg.solve(r, np.broadcast_to(z[t], s.shape)[..., None])[..., 0] @ z[t] - z[t] @ z[t])
    return np.where(good, total, -math.inf)


def dcc_inside(points: np.ndarray) -> np.ndarray:
    """Whether a is in [1e-6, 0.3], b in [1e-6, 0.999], and a + b below 0.999."""
    return (points >= 1e-6).all(1) & (points[:, 0] <= 0.3) & (points[:, 1] <= 0.999) & (points.sum(1) < 0.999)


def dcc_polish(z: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float, bool]:
    """(a, b), its likelihood, and whether no neighbour at 1e-3 is likelier, from a start inside the bounds."""

    def loss(p):
        return min(-dcc_likelihoods(z, p[None])[0], 1e10) if dcc_inside(p[None])[0] else 1e10

    best = nelder_mead(loss, start, np.array([0.01 if start[0] < 0.29 else -0.01, -0.02 if start[1] > 0.02 else 0.02]), rounds=80, tol=1e-7)
    around = best + 1e-3 * np.array([[1, 0], [-1, 0], [0, 1], [0, -1], [1, -1], [-1, 1]])
    around = around[dcc_inside(around)]
    top = -loss(best)
    return best, top, not len(around) or bool((dcc_likelihoods(z, around) <= top).all())


#: Values of a and b whose pairs are tried before the best ones are polished.
DCC_A, DCC_B = (1e-6, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.28), (1e-6, 0.2, 0.5, 0.7, 0.8, 0.88, 0.93, 0.96, 0.985)


def dcc_grid() -> np.ndarray:
    points = np.array([(a, b) for a in DCC_A for b in DCC_B])
    return points[dcc_inside(points)]


def dcc_pair(x: np.ndarray, y: np.ndarray, a: float, b: float) -> np.ndarray:
    """The correlation path of two of the residual series; it does not depend on the others."""
    bar = np.cov(x, y)
    q, out = bar.copy(), np.empty(len(x))
    for t in range(len(x)):
        if t:
            v = np.array((x[t - 1], y[t - 1]))
            q = (1 - a - b) * bar + a * np.outer(v, v) + b * q
        out[t] = q[0, 1] / math.sqrt(q[0, 0] * q[1, 1])
    return out


def fit_dcc(x: np.ndarray) -> dict:
    """Two-step DCC of T x N returns in one place: GARCH residuals, the grid, and the polished best point."""
    z = np.column_stack([fit_garch(c)["z"] for c in x.T])
    points = dcc_grid()
    (a, b), total, converged = dcc_polish(z, points[dcc_likelihoods(z, points).argmax()])
    path, _ = dcc_path(z, a, b)
    return {"a": float(a), "b": float(b), "persistence": float(a + b), "converged": converged, "loglik": total, "path": path, "mean": path.mean(0)}


def fit_msgarch(x: np.ndarray, k: int = 2, rounds: int = 600) -> dict:
    """Markov-switching GARCH with parallel variance recursions per state and Student-t innovations.

    The Hamilton filter gives the likelihood, a backward pass the smoothed probabilities; states come out by rising
    sample deviation of the returns decoded to them.
    """
    r = 100 * (x - x.mean())
    base = r.var()

    def unpack(p):
        omega, alpha, beta = np.exp(p[:k]), np.empty(k), np.empty(k)
        for j in range(k):
            s, share = 0.999 / (1 + math.exp(-p[k + j])), 1 / (1 + math.exp(-p[2 * k + j]))
            alpha[j], beta[j] = s * share, s * (1 - share)
        stay = 1 / (1 + np.exp(-p[3 * k : 4 * k]))
        trans = np.full((k, k), 0.0)
        for j in range(k):
            trans[j] = (1 - stay[j]) / max(k - 1, 1)
            trans[j, j] = stay[j] if k > 1 else 1.0
        return omega, alpha, beta, trans, 2.1 + math.exp(min(p[-1], 5))

    def run(p):
        omega, alpha, beta, trans, nu = unpack(p)
        h = np.empty((len(r), k))
        h[0] = np.minimum(omega / np.maximum(1 - alpha - beta, 1e-3), 50 * base)
        for t in range(1, len(r)):
            h[t] = omega + alpha * r[t - 1] ** 2 + beta * h[t - 1]
        const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        b = const - 0.5 * np.log(h) - (nu + 1) / 2 * np.log1p(r[:, None] ** 2 / ((nu - 2) * h))
        e, total = np.exp(b - b.max(1, keepdims=True)), float(b.max(1).sum())
        f = np.empty_like(e)
        q = np.full(k, 1 / k)
        for t in range(len(r)):
            q = (f[t - 1] @ trans if t else q) * e[t]
            s = max(q.sum(), 1e-300)
            f[t] = q / s
            total += math.log(s)
        return f, trans, total

    def loss(p):
        total = run(p)[2] if np.abs(p).max() < 30 else -1e12
        return -total if math.isfinite(total) else 1e12

    start = np.concatenate((np.log(base * 0.05 * 4.0 ** np.arange(k)), np.full(k, 2.5), np.full(k, -2.0), np.full(k, 3.5), [1.5]))
    best = nelder_mead(loss, start, np.full(len(start), 0.4), rounds=rounds, tol=1e-8)
    f, trans, total = run(best)
    smooth = f.copy()
    for t in range(len(r) - 2, -1, -1):
        ahead = np.maximum(f[t] @ trans, 1e-300)
        smooth[t] = f[t] * (trans @ (smooth[t + 1] / ahead))
    smooth /= smooth.sum(1, keepdims=True)
    own = smooth.argmax(1)
    order = np.argsort([x[own == j].std(ddof=1) if (own == j).sum() > 1 else np.inf for j in range(k)], kind="stable")
    return {"state": np.argsort(order)[own], "smooth": smooth[:, order], "loglik": total}


# ------------------------------------------------------------------------------------------------- inference
def sharpe(x: np.ndarray) -> float:
    s = x.std(ddof=1)
    return float(x.mean() / s) if s > 0 else math.nan


def sharpe_gap_errors(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """HAC standard errors (Bartlett, lag floor(4 (T / 100)^(2/9))) of Sharpe differences, one for each row of x and y."""
    x, y = np.atleast_2d(x), np.atleast_2d(y)
    t = x.shape[1]
    lag = int(4 * (t / 100) ** (2 / 9))
    m1, m2, g1, g2 = x.mean(1), y.mean(1), (x**2).mean(1), (y**2).mean(1)
    s1, s2 = g1 - m1**2, g2 - m2**2
    with np.errstate(all="ignore"):
        grad = np.stack((g1 / s1**1.5, -g2 / s2**1.5, -0.5 * m1 / s1**1.5, 0.5 * m2 / s2**1.5))
        # The delta method is linear, so the long-run variance of one combined influence series is enough.
        v = grad[0][:, None] * (x - m1[:, None]) + grad[1][:, None] * (y - m2[:, None]) + grad[2][:, None] * (x**2 - g1[:, None]) + grad[3][:, None] * (y**2 - g2[:, None])
        var = (v * v).mean(1) + sum(2 * (1 - k / (lag + 1)) * (v[:, k:] * v[:, :-k]).sum(1) / t for k in range(1, lag + 1))
        return np.where((s1 > 0) & (s2 > 0) & (var > 0), np.sqrt(np.maximum(var, 0) / t), np.nan)


def _sharpe_gap(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Values present in both, the difference of their Sharpe ratios, and its HAC error (nan below 50 values)."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    return x, y, *((sharpe(x) - sharpe(y), float(sharpe_gap_errors(x, y)[0])) if len(x) >= 50 else (math.nan, math.nan))


#: Values that are resampled at a time.
RESAMPLED = 4_000_000


def bootstrap_draws(x: np.ndarray, y: np.ndarray, block: int, seed: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(differences, studentised differences) of resamples ``first`` to ``last`` of a circular block bootstrap.

    Block starts follow ``default_rng(seed)``; those of earlier resamples are drawn and passed over, since a bounded draw
    may take more than one number of the stream. So slices give what one run over all gives, to the last bit. Nothing is
    drawn where the difference has no error.
    """
    x, y, gap, error = _sharpe_gap(x, y)
    t = len(x)
    if not error > 0 or last <= first:
        return np.zeros(0), np.zeros(0)
    rng, blocks = np.random.default_rng(seed), -(-t // block)
    width = max(1, RESAMPLED // t)
    for at in range(0, first, width):
        rng.integers(0, t, (min(width, first - at), blocks))
    d, s = np.empty(last - first), np.empty(last - first)
    for at in range(0, last - first, width):
        k = min(width, last - first - at)
        starts = rng.integers(0, t, (k, blocks))
        rows = ((starts[:, :, None] + np.arange(block)).reshape(k, -1) % t)[:, :t]
        bx, by = x[rows], y[rows]
        with np.errstate(all="ignore"):
            d[at : at + k] = bx.mean(1) / bx.std(1, ddof=1) - by.mean(1) / by.std(1, ddof=1)
            s[at : at + k] = (d[at : at + k] - gap) / sharpe_gap_errors(bx, by)
    return d, s


def sharpe_test(x: np.ndarray, y: np.ndarray, d: np.ndarray, s: np.ndarray) -> dict[str, float]:
    """The two-sided test of equal Sharpe ratios from all draws of ``bootstrap_draws``."""
    x, y, gap, error = _sharpe_gap(x, y)
    if len(x) < 50:
        return {"n_obs": len(x)}
    year = math.sqrt(252)
    out = {"n_obs": len(x), "sharpe": sharpe(x) * year, "sharpe_benchmark": sharpe(y) * year, "sharpe_diff": gap * year}
    if not error > 0:  # nothing varies, so there is nothing to resample
        return out | {"hac_se": 0.0, "ci_low": gap * year, "ci_high": gap * year, "p_value": 1.0 if abs(gap) < 1e-12 else math.nan}
    valid = np.isfinite(s)
    low, high = np.nanpercentile(d, [2.5, 97.5])
    p = {"p_value": float((np.abs(s[valid]) >= abs(gap / error)).mean())} if valid.any() else {}
    return out | {"hac_se": error * year, "t_stat": gap / error, "ci_low": low * year, "ci_high": high * year} | p


def bootstrap_sharpe_test(x: np.ndarray, y: np.ndarray, block: int = 21, n_boot: int = 2000, seed: int = 42) -> dict[str, float]:
    """Studentised circular block bootstrap of equal Sharpe ratios, in one place."""
    return sharpe_test(x, y, *bootstrap_draws(x, y, block, seed, 0, n_boot))


def expected_max_sharpe(n_trials: int, variance: float) -> float:
    if n_trials < 2:
        return 0.0
    g = 0.5772156649015329
    return math.sqrt(max(variance, 0)) * ((1 - g) * NORMAL.inv_cdf(1 - 1 / n_trials) + g * NORMAL.inv_cdf(1 - 1 / (n_trials * math.e)))


def deflated_sharpe(x: np.ndarray, n_trials: int, variance: float | None = None) -> float:
    """Probability that the Sharpe ratio beats the best of ``n_trials`` without skill; nan below 50 values."""
    x = x[np.isfinite(x)]
    if len(x) < 50:
        return math.nan
    sr, (skew, kurt) = sharpe(x), moments(x)
    spread = 1 - skew * sr + 0.25 * (kurt + 2) * sr * sr
    bar = expected_max_sharpe(n_trials, spread / (len(x) - 1) if variance is None else variance)
    return NORMAL.cdf((sr - bar) * math.sqrt(len(x) - 1) / math.sqrt(max(spread, 1e-12)))


def eigen_share(x: np.ndarray) -> float:
    """Share of the first eigenvalue of the correlation of complete columns; nan below ten columns."""
    x = x[:, x.std(0, ddof=1) > 0] if x.size else x
    if x.shape[1] < 10:
        return math.nan
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    gram = z @ z.T if len(z) < z.shape[1] else z.T @ z
    return float(np.linalg.eigvalsh(gram)[-1] / (len(z) - 1) / z.shape[1])
