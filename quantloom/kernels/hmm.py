"""Gaussian hidden Markov models: EM with restarts, filtering, smoothing, decoding and selection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Hmm:
    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    covars: np.ndarray
    loglik: float = -np.inf
    converged: bool = False


def log_density(model: Hmm, x: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(model.means)))
    for k, (m, c) in enumerate(zip(model.means, model.covars, strict=True)):
        root = np.linalg.cholesky(c)
        z = np.linalg.solve(root, (x - m).T)
        out[:, k] = -0.5 * ((z**2).sum(0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(root)).sum()
    return out


def _forward(model: Hmm, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Filtered probabilities and the log-likelihood; each step is normalised, so nothing underflows."""
    top = b.max(1, keepdims=True)
    e = np.exp(b - top)
    alpha, total = np.empty_like(e), float(top.sum())
    p = model.start * e[0]
    for t in range(len(e)):
        if t:
            p = (alpha[t - 1] @ model.trans) * e[t]
        s = max(p.sum(), 1e-300)
        alpha[t] = p / s
        total += np.log(s)
    return alpha, total


def filtered(model: Hmm, x: np.ndarray) -> np.ndarray:
    """P(state_t | x_1..x_t)."""
    return _forward(model, log_density(model, x))[0]


def smoothed(model: Hmm, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(state_t | all x), expected transition counts, log-likelihood)."""
    b = log_density(model, x)
    alpha, total = _forward(model, b)
    e = np.exp(b - b.max(1, keepdims=True))
    gamma, counts = np.empty_like(alpha), np.zeros_like(model.trans)
    back = np.ones(alpha.shape[1])
    gamma[-1] = alpha[-1]
    for t in range(len(x) - 2, -1, -1):
        ahead = e[t + 1] * back
        joint = alpha[t][:, None] * model.trans * ahead
        s = max(joint.sum(), 1e-300)
        counts += joint / s
        back = model.trans @ ahead
        back /= max(back.max(), 1e-300)
        g = alpha[t] * back
        gamma[t] = g / max(g.sum(), 1e-300)
    return gamma, counts, total


@dataclass
class Survivors:
    """Viterbi scores and back pointers of every row: the best path up to any row can be read off without another pass."""

    score: np.ndarray
    trail: np.ndarray

    def path(self, upto: int, days: int | None = None) -> np.ndarray:
        """The last ``days`` states (all of them without it) of the most likely path of the first ``upto`` rows."""
        first = 0 if days is None else max(0, upto - days)
        out = np.empty(upto - first, int)
        if upto:
            out[-1] = self.score[upto - 1].argmax()
        for t in range(upto - 1, first, -1):
            out[t - 1 - first] = self.trail[t, out[t - first]]
        return out


def survivors(model: Hmm, x: np.ndarray) -> Survivors:
    """One forward pass; row t needs no later row."""
    b, lt = log_density(model, x), np.log(np.maximum(model.trans, 1e-300))
    score, trail = np.empty(b.shape), np.zeros(b.shape, int)
    if len(x):
        score[0] = np.log(np.maximum(model.start, 1e-300)) + b[0]
    for t in range(1, len(x)):
        step = score[t - 1][:, None] + lt
        trail[t] = step.argmax(0)
        score[t] = step.max(0) + b[t]
    return Survivors(score, trail)


def decode(model: Hmm, x: np.ndarray) -> np.ndarray:
    """The most likely path (Viterbi)."""
    return survivors(model, x).path(len(x))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    scale = x.std(0) + 1e-12
    z = x / scale
    centres = z[rng.choice(len(z), k, replace=False)]
    for _ in range(25):
        own = ((z[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.stack([z[own == j].mean(0) if (own == j).any() else z[rng.integers(len(z))] for j in range(k)])
    return centres * scale


KINDS = ("full", "diag", "spherical", "tied")


def shaped(scatter: np.ndarray, mass: np.ndarray, prior: float, kind: str) -> np.ndarray:
    """k x d x d covariances from the states' scatter matrices: one each, its diagonal, its mean variance, or one for all."""
    d = scatter.shape[1]
    if kind == "tied":
        scatter, mass = np.broadcast_to(scatter.sum(0), scatter.shape), np.full(len(mass), mass.sum())
    out = (scatter + prior * np.eye(d)) / (mass[:, None, None] + 1)
    if kind in ("diag", "spherical"):
        out = out * np.eye(d)
    if kind == "spherical":
        out = np.trace(out, axis1=1, axis2=2)[:, None, None] / d * np.eye(d)
    return out + 1e-10 * np.eye(d)


@dataclass
class _Runs:
    """Models of several restarts, stacked along the first axis; ``ll`` is of the model before its last update."""

    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray
    covars: np.ndarray
    ll: np.ndarray

    def of(self, at) -> _Runs:
        return _Runs(*(v[at].copy() for v in (self.start, self.trans, self.means, self.covars, self.ll)))


def _densities(runs: _Runs, x: np.ndarray) -> np.ndarray:
    """T x runs x k log densities; nan where a covariance is not positive definite."""
    d = x.shape[1]
    good = (np.linalg.eigvalsh(runs.covars)[..., 0] > 0) & np.isfinite(runs.covars).all((2, 3))
    safe = np.where(good[..., None, None], runs.covars, np.eye(d))
    root = np.linalg.cholesky(safe)
    z = (x[None, None] - runs.means[:, :, None]) @ np.linalg.inv(root).swapaxes(-1, -2)
    out = -0.5 * ((z**2).sum(-1) + d * np.log(2 * np.pi)) - np.log(np.diagonal(root, axis1=-2, axis2=-1)).sum(-1)[..., None]
    return np.where(good[..., None], out, np.nan).transpose(2, 0, 1)


def _expect(runs: _Runs, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(T x runs x k state probabilities, runs x k x k transition counts, log-likelihoods), all restarts in one pass.

    The recursions go through blocks of about sqrt(T) days, all blocks at once: products of a block's transitions say how
    a vector leaves it, a pass over blocks gives the vector at each one's edge, and then every block is walked from there.
    """
    top = b.max(2, keepdims=True)
    e = np.exp(b - top)
    n, _, k = e.shape
    width = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // width)
    cut = lambda x, pad: np.concatenate((x, np.full((blocks * width - n, *x.shape[1:]), pad))).reshape(blocks, width, *x.shape[1:])
    whole = lambda x: x.reshape(blocks * width, *x.shape[2:])[:n]
    identity = np.eye(k)

    def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = x @ y
        return out / np.maximum(out.sum((-2, -1), keepdims=True), 1e-300)

    # Forward: alpha_t is alpha_(t-1) times the transitions, weighed by e_t; the first day has no transition before it.
    ahead = cut(e, 1.0)

    def forth(i: int) -> np.ndarray:
        move = np.broadcast_to(runs.trans, (blocks, *runs.trans.shape))
        if not i:
            move = move.copy()
            move[0] = identity
        return move * ahead[:, i, :, None, :]

    steps = [forth(i) for i in range(width)]
    leaves = steps[0]
    for step in steps[1:]:
        leaves = product(leaves, step)
    edge = np.empty((blocks, *runs.start.shape))
    edge[0] = runs.start
    for j in range(1, blocks):
        v = (edge[j - 1][:, None] @ leaves[j - 1])[:, 0]
        edge[j] = v / np.maximum(v.sum(1, keepdims=True), 1e-300)
    alpha, scale, v = np.empty_like(ahead), np.empty(ahead.shape[:3]), edge
    for i, step in enumerate(steps):
        v = (v[:, :, None] @ step)[:, :, 0]
        scale[:, i] = np.maximum(v.sum(2), 1e-300)
        v = alpha[:, i] = v / scale[:, i, :, None]
    alpha, scale = whole(alpha), whole(scale)
    # Backward: beta_t is the transitions times what the next day weighs; after the last day nothing is left to weigh.
    weighed = e[1:] / scale[1:, :, None]
    move = cut(np.concatenate((runs.trans[None] * weighed[:, :, None, :], np.broadcast_to(identity, (1, *runs.trans.shape)))), 0.0)
    move.reshape(blocks * width, *runs.trans.shape)[n:] = identity
    leaves = move[:, -1]
    for i in range(width - 2, -1, -1):
        leaves = move[:, i] @ leaves
    edge = np.ones((blocks, *runs.start.shape))
    for j in range(blocks - 2, -1, -1):
        edge[j] = (leaves[j + 1] @ edge[j + 1][..., None])[..., 0]
    beta, v = np.empty_like(ahead), edge
    for i in range(width - 1, -1, -1):
        v = beta[:, i] = (move[:, i] @ v[..., None])[..., 0]
    beta = whole(beta)
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(2, keepdims=True), 1e-300)
    counts = np.einsum("trj,trk->rjk", alpha[:-1], weighed * beta[1:]) * runs.trans
    return gamma, counts, top[..., 0].sum(0) + np.log(scale).sum(0)


def _em(x: np.ndarray, k: int, seeds: list[int], rounds: int, prior: float, ridge: float, tol: float, kind: str) -> list[Hmm]:
    """EM of all restarts side by side; one that has converged or failed leaves the others to go on."""
    d, n = x.shape[1], len(seeds)
    whole = np.repeat(np.atleast_2d(np.cov(x.T))[None], k, 0)
    first = (whole if kind == "full" else shaped(whole * len(x) / k, np.full(k, len(x) / k), 0.0, kind)) + ridge * np.eye(d)
    trans = np.full((k, k), 0.1 / max(k - 1, 1))
    np.fill_diagonal(trans, 0.9 if k > 1 else 1.0)
    starts = [_kmeans(x, k, np.random.default_rng(s)) for s in seeds]
    runs = _Runs(np.full((n, k), 1 / k), np.repeat(trans[None], n, 0), np.stack(starts), np.repeat(first[None], n, 0), np.full(n, -np.inf))
    found: list[Hmm | None] = [None] * n
    live, before = np.arange(n), np.full(n, -np.inf)

    def leave(gone: np.ndarray, converged: np.ndarray) -> None:
        nonlocal runs, live, before
        for i in np.flatnonzero(gone):
            one = runs.of(i)
            found[live[i]] = Hmm(one.start, one.trans, one.means, one.covars, float(one.ll), bool(converged[i]))
        runs, live, before = runs.of(~gone), live[~gone], before[~gone]

    for _ in range(rounds):
        if not len(live):
            break
        gamma, counts, runs.ll = _expect(runs, _densities(runs, x))
        still = (runs.ll - before < tol) & np.isfinite(before)
        out = still | ~np.isfinite(runs.ll)
        before = runs.ll
        if out.any():
            gamma, counts = gamma[:, ~out], counts[~out]
            leave(out, still)
            if not len(live):
                break
        mass = gamma.sum(0) + 1e-12
        runs.start = gamma[0] / gamma[0].sum(1, keepdims=True)
        runs.trans = (counts + 1e-12) / (counts + 1e-12).sum(2, keepdims=True)
        runs.means = np.einsum("trk,td->rkd", gamma, x) / mass[..., None]
        centred = x[None, None] - runs.means[:, :, None]
        scatter = (gamma.transpose(1, 2, 0)[..., None] * centred).swapaxes(-1, -2) @ centred
        runs.covars = np.stack([shaped(scatter[i], mass[i], prior, kind) for i in range(len(live))])
    leave(np.ones(len(live), bool), np.zeros(len(live), bool))
    return found


def fit(x: np.ndarray, k: int, n_init: int = 10, rounds: int = 1000, seed: int = 42, prior: float = 1e-2, ridge: float = 1e-3, kind: str = "full", tol: float = 1e-4) -> Hmm:
    """The best of ``n_init`` restarts (seeds seed, seed + 1, ...; the first wins ties); an error if all fail."""
    good = [m for m in restarts(x, k, [seed + i for i in range(n_init)], rounds, prior, ridge, kind, tol) if np.isfinite(m.loglik)]
    if not good:
        raise RuntimeError(f"all {n_init} restarts failed for {k} states")
    return max(good, key=lambda m: m.loglik)


def restarts(x: np.ndarray, k: int, seeds: list[int], rounds: int, prior: float, ridge: float, kind: str = "full", tol: float = 1e-4) -> list[Hmm]:
    """A model for each seed; one that failed has a log-likelihood that is not finite."""
    if kind not in KINDS:
        raise ValueError(f"unknown covariance type {kind}")
    if len(x) < k:
        raise RuntimeError(f"{len(x)} rows cannot have {k} states")
    with np.errstate(all="ignore"):
        return _em(x, k, seeds, rounds, prior, ridge, tol, kind)


def n_params(k: int, d: int, kind: str = "full") -> int:
    """Free parameters of start, transitions, means and covariances."""
    one = d * (d + 1) // 2
    return (k - 1) + k * (k - 1) + k * d + {"full": k * one, "diag": k * d, "spherical": k, "tied": one}[kind]


def select(x: np.ndarray, grid: tuple[int, ...], criterion: str = "bic", **how) -> tuple[Hmm, list[dict]]:
    """The model of least AIC or BIC (fewest states on ties) and the table of all."""
    table, models = [], {}
    for k in grid:
        m = models[k] = fit(x, k, **how)
        p = n_params(k, x.shape[1], how.get("kind", "full"))
        table.append({"k": k, "loglik": m.loglik, "n_params": p, "aic": 2 * p - 2 * m.loglik, "bic": p * np.log(len(x)) - 2 * m.loglik, "converged": m.converged})
    return models[min(table, key=lambda r: (r[criterion], r["k"]))["k"]], table


def volatility_order(states: np.ndarray, ret: np.ndarray, k: int) -> np.ndarray:
    """Raw states from calm to turbulent; a state without days counts as most turbulent."""
    return np.argsort([ret[states == j].std() if (states == j).any() else np.inf for j in range(k)], kind="stable")
