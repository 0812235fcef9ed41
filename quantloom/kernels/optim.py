"""Covariance shrinkage and long-only portfolio optimisers."""

from __future__ import annotations

import numpy as np


def covariance(x: np.ndarray, how: str = "ledoit_wolf", weights: np.ndarray | None = None) -> np.ndarray:
    """Sample or shrunk covariance of T x N returns, optionally with observation weights (scaled to sum to T)."""
    t = len(x)
    w = np.ones(t) if weights is None else weights * (t / weights.sum())
    centred = x - (w[:, None] * x).sum(0) / w.sum()
    if how == "sample":
        return (centred * w[:, None]).T @ centred / max(w.sum() - 1, 1)
    if how != "ledoit_wolf":
        raise ValueError(f"unknown covariance estimator {how}")
    return shrink(centred * np.sqrt(w)[:, None])


def shrink(x: np.ndarray) -> np.ndarray:
    """Ledoit-Wolf (2004) shrinkage towards a scaled identity of centred rows; divisor T."""
    t, n = x.shape
    s = x.T @ x / t
    mu = np.trace(s) / n
    d2 = ((s - mu * np.eye(n)) ** 2).sum() / n
    b2 = min(d2, ((x**2).sum(1) ** 2).sum() / t / t / n - (s**2).sum() / t / n)
    share = b2 / d2 if d2 > 0 else 0.0
    return (1 - share) * s + share * mu * np.eye(n)


def nonnegative_qp(s: np.ndarray, q: np.ndarray, sweeps: int = 5000, tol: float = 1e-12) -> np.ndarray:
    """argmin of y'Sy / 2 - q'y over y >= 0 by coordinate descent with an active-set finish."""
    n = len(q)
    diagonal = np.maximum(np.diag(s), 1e-18)
    y, g = np.zeros(n), -q.astype(float).copy()
    for _ in range(sweeps):
        worst = 0.0
        for i in range(n):
            new = max(0.0, y[i] - g[i] / diagonal[i])
            step = new - y[i]
            if step:
                g += step * s[:, i]
                y[i] = new
                worst = max(worst, abs(step) * diagonal[i])
        if worst < tol * (1 + np.abs(q).max()):
            break
    on = y > 0
    if on.any():
        exact = np.linalg.lstsq(s[np.ix_(on, on)], q[on], rcond=None)[0]
        if (exact > 0).all():
            y[on] = exact
    return y


def project_simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    c = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - c[np.flatnonzero(u > c)[-1]], 0)


def normalised(w: np.ndarray, tol: float = 1e-6) -> np.ndarray:
    w = np.where(w > tol, w, 0.0)
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


def min_variance(s: np.ndarray) -> np.ndarray:
    """min w'Sw on the simplex: the scaled solution of min y'Sy / 2 - 1'y, y >= 0."""
    scale = np.trace(s) / len(s)
    return normalised(nonnegative_qp(s / scale, np.ones(len(s)))) if scale > 0 else np.full(len(s), 1 / len(s))


def max_sharpe(s: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Tangency weights; without any positive mean the minimum-variance weights."""
    if (mu <= 0).all():
        return min_variance(s)
    scale = np.trace(s) / len(s)
    return normalised(nonnegative_qp(s / scale, mu / np.abs(mu).max()))


def max_utility(s: np.ndarray, mu: np.ndarray, aversion: float, rounds: int = 20_000, tol: float = 1e-6) -> np.ndarray:
    """max mu'w - aversion / 2 w'Sw on the simplex by accelerated projected gradient with restarts; weights up to ``tol`` go."""
    n = len(mu)
    step = 1 / max(aversion * np.linalg.norm(s, 2), 1e-12)
    w = z = np.full(n, 1 / n)
    k = 1.0
    for _ in range(rounds):
        new = project_simplex(z - step * (aversion * (s @ z) - mu))
        k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        if (z - new) @ (new - w) > 0:
            k2, z2 = 1.0, new
        else:
            z2 = new + (k - 1) / k2 * (new - w)
        done = np.abs(new - w).max() < 1e-13 and np.abs(new - z).max() < 1e-13
        w, z, k = new, z2, k2
        if done:
            break
    return normalised(w, tol)


def linkage(d: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Single-linkage merges of a distance matrix: (child, child, distance, size), the smaller cluster number first.

    Names are clusters 0 to n - 1, merge k makes cluster n + k. Names are lined up from name 0, always the one nearest to
    any before it (ties to the lower name); a cluster is then a stretch of this line, and closing its gaps in rising
    order (ties from the left) gives the merges.
    """
    n = len(d)
    line, gaps, near = [0], [], np.where(np.arange(n) == 0, np.inf, d[0])
    while len(line) < n:
        j = int(near.argmin())
        line.append(j)
        gaps.append(near[j])
        near = np.where(np.isinf(near) | (np.arange(n) == j), np.inf, np.minimum(near, d[j]))
    # A stretch is known at both of its ends: (cluster, first place, last place).
    at = {k: (name, k, k) for k, name in enumerate(line)}
    merges = []
    for k in np.argsort(gaps, kind="stable").tolist():
        (left, first, _), (right, _, last) = at[k], at[k + 1]
        merges.append((min(left, right), max(left, right), float(gaps[k]), last - first + 1))
        at[first] = at[last] = (n + len(merges) - 1, first, last)
    return merges


def leaf_order(merges: list[tuple[int, int, float, int]]) -> list[int]:
    """The names under the last merge, the first child's before the second's."""
    n, out, todo = len(merges) + 1, [], [2 * len(merges)]
    while todo:
        k = todo.pop()
        if k < n:
            out.append(k)
        else:
            todo += [merges[k - n][1], merges[k - n][0]]
    return out


def hrp(s: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: linkage order, then halving with inverse cluster variances.

    A name without variance has no weight inside its cluster unless all are like it; two clusters without variance
    share alike.
    """
    n = len(s)
    if n == 1:
        return np.ones(1)
    sd = np.sqrt(np.maximum(np.diag(s), 1e-18))
    order = leaf_order(linkage(np.sqrt(np.maximum((1 - np.clip(s / np.outer(sd, sd), -1, 1)) / 2, 0))))

    def spread(part):
        own = np.diag(s)[part]
        iv = np.divide(1, own, out=np.zeros(len(part)), where=own > 0)
        iv = iv / iv.sum() if iv.any() else np.full(len(part), 1 / len(part))
        return iv @ s[np.ix_(part, part)] @ iv

    w, todo = np.ones(n), [order]
    while todo:
        part = todo.pop()
        if len(part) > 1:
            left, right = part[: len(part) // 2], part[len(part) // 2 :]
            a, b = spread(left), spread(right)
            share = b / (a + b) if a + b > 0 else 0.5
            w[left] *= share
            w[right] *= 1 - share
            todo += [left, right]
    return w / w.sum()


def solve_lp(a: np.ndarray, b: np.ndarray, cost: np.ndarray, rounds: int = 80, tol: float = 1e-9) -> np.ndarray | None:
    """min cost'x, a x = b, x >= 0 by a primal-dual interior point method with predictor and corrector."""
    m, n = a.shape
    pinv = np.linalg.lstsq(a @ a.T + 1e-10 * np.eye(m), np.stack((b, a @ cost), 1), rcond=None)[0]
    x, y = a.T @ pinv[:, 0], pinv[:, 1]
    z = cost - a.T @ y
    x, z = x + max(-1.5 * x.min(), 0), z + max(-1.5 * z.min(), 0)
    gap = x @ z
    x, z = x + 0.5 * gap / max(z.sum(), 1e-9) + 1e-6, z + 0.5 * gap / max(x.sum(), 1e-9) + 1e-6
    for _ in range(rounds):
        rp, rd, mu = b - a @ x, cost - a.T @ y - z, x @ z / n
        if max(np.abs(rp).max() / (1 + np.abs(b).max()), np.abs(rd).max() / (1 + np.abs(cost).max()), abs(x @ z) / (1 + abs(cost @ x))) < tol:
            return x
        d = x / z
        normal = (a * d) @ a.T
        normal[np.diag_indices(m)] += 1e-13 * np.trace(normal) / m

        def step(rc, rp=rp, rd=rd, d=d, normal=normal, x=x, z=z):
            dy = np.linalg.solve(normal, rp + a @ (d * rd - rc / z))
            dz = rd - a.T @ dy
            return (rc - x * dz) / z, dy, dz

        reach = lambda v, dv: min(1.0, 0.9995 * np.min(-v[dv < 0] / dv[dv < 0])) if (dv < 0).any() else 1.0
        dx, dy, dz = step(-x * z)
        p, q = reach(x, dx), reach(z, dz)
        sigma = ((x + p * dx) @ (z + q * dz) / n / mu) ** 3
        dx, dy, dz = step(sigma * mu - x * z - dx * dz)
        p, q = reach(x, dx), reach(z, dz)
        x, y, z = x + p * dx, y + q * dy, z + q * dz
    return None


def cvar_min(x: np.ndarray, confidence: float, weights: np.ndarray | None = None) -> np.ndarray:
    """Rockafellar-Uryasev: min zeta + sum p_t u_t / (1 - c), u_t >= -r_t'w - zeta, w on the simplex; 1/N on failure."""
    t, n = x.shape
    p = np.full(t, 1 / t) if weights is None else weights / weights.sum()
    scale = x.std() or 1.0
    a = np.zeros((t + 1, n + 2 + 2 * t))
    a[:t, :n], a[:t, n], a[:t, n + 1] = x / scale, 1, -1
    a[:t, n + 2 : n + 2 + t], a[:t, n + 2 + t :] = np.eye(t), -np.eye(t)
    a[t, :n] = 1
    cost = np.concatenate((np.zeros(n), [1, -1], p / (1 - confidence), np.zeros(t)))
    cost[n : n + 2] += 1e-9
    try:
        found = solve_lp(a, np.concatenate((np.zeros(t), [1.0])), cost)
    except np.linalg.LinAlgError:
        found = None
    return np.full(n, 1 / n) if found is None else normalised(found[:n])


def cvar(x: np.ndarray, w: np.ndarray, confidence: float) -> float:
    """The objective at w, by its definition over the worst share of equally likely days."""
    loss = np.sort(-(x @ w))[::-1]
    k = (1 - confidence) * len(loss)
    full = int(k)
    return float((loss[:full].sum() + (k - full) * (loss[full] if full < len(loss) else 0)) / k)


def black_litterman(s: np.ndarray, prior: np.ndarray, view: np.ndarray, tau: float, confidence: float) -> np.ndarray:
    """Posterior mean with absolute views on every name and view variance diag(tau S) / confidence, 1e-12 at least."""
    ts = tau * s + 1e-10 * np.eye(len(s))
    omega = np.diag(np.maximum(tau * np.diag(s) / max(confidence, 1e-8), 1e-12))
    return prior + ts @ np.linalg.solve(ts + omega, view - prior)


METHODS = ("mean_variance", "min_variance", "hrp", "cvar", "equilibrium")


def strategies() -> list[str]:
    """Two benchmarks, and five methods each with and without regime conditioning."""
    return ["equal_weight", "index_benchmark", *(x for m in METHODS for x in (m, f"{m}_rc"))]


def parse_strategy(name: str) -> tuple[str, bool]:
    return (name[:-3], True) if name.endswith("_rc") else (name, False)


def build_weights(strategy: str, x: np.ndarray, cfg, obs: np.ndarray | None = None) -> np.ndarray:
    """Weights of one window (T x N) under a portfolio section; ``obs`` are regime weights, required by ``_rc`` names."""
    method, conditional = parse_strategy(strategy)
    if conditional and obs is None:
        raise ValueError(f"{strategy} needs a regime context")
    n = x.shape[1]
    if n == 0:
        return np.zeros(0)
    obs = obs if conditional else None
    if method == "equal_weight":
        return np.full(n, 1 / n)
    if method == "cvar":
        return cvar_min(x, cfg.cvar_confidence, obs)
    s = covariance(x, cfg.covariance_estimator, obs)
    mu = x.mean(0) if obs is None else obs @ x / obs.sum()
    if method == "min_variance":
        return min_variance(s)
    if method == "hrp":
        return hrp(s)
    if method == "mean_variance":
        if cfg.mean_variance_objective == "max_utility":
            return max_utility(s, mu, cfg.risk_aversion)
        # Without any positive mean the fallback ignores the observation weights.
        return max_sharpe(s, mu) if (mu > 0).any() else min_variance(covariance(x, cfg.covariance_estimator))
    if method == "equilibrium":
        prior = cfg.risk_aversion * s @ np.full(n, 1 / n)
        return max_utility(s, black_litterman(s, prior, mu, cfg.bl_tau, cfg.bl_view_confidence), cfg.risk_aversion, tol=0.0)
    raise NotImplementedError(strategy)
