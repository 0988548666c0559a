"""Factor model with fewer shocks than static factors, its identification and what each series adds to an update. No Spark here.

q dynamic factors follow a vector autoregression and load with their current and `deep` lagged values, so r = q (deep + 1) static factors
are driven by q shocks. EM is exact: states by filter and smoother, then loadings, autoregression, shocks and noise from their moments.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from tidemark.operators import kernels


@dataclass(frozen=True)
class Model:
    loadings: np.ndarray  # n x q (deep + 1), current values first
    phi: np.ndarray  # q x q lags
    shocks: np.ndarray  # q x q
    noise: np.ndarray  # n
    loglik: tuple[float, ...] = ()

    @property
    def q(self) -> int:
        return len(self.phi)

    def state_space(self) -> dict[str, np.ndarray]:
        q, size = self.q, max(self.loadings.shape[1], self.phi.shape[1])
        h, f, v = np.zeros((len(self.loadings), size)), np.zeros((size, size)), np.zeros((size, size))
        h[:, : self.loadings.shape[1]] = self.loadings
        f[:q, : self.phi.shape[1]] = self.phi
        f[q:, : size - q] += np.eye(size - q)
        v[:q, :q] = self.shocks
        return {"h": h, "f": f, "q": v, "r": np.diag(self.noise), "x0": np.zeros(size), "p0": 10 * np.eye(size)}


def filtered(y: np.ndarray, m: Model) -> dict:
    return kernels.kalman(y, **{k: v for k, v in m.state_space().items()})


def started(y: np.ndarray, q: int, deep: int, lags: int) -> Model:
    """From principal components of the panel, zeros where it is missing."""
    n = y.shape[1]
    z = np.nan_to_num(y)
    f = kernels.principal(z, q)[0]
    stacked = np.column_stack([f[deep - k : len(f) - k] for k in range(deep + 1)])
    loadings = np.linalg.lstsq(stacked, z[deep:], rcond=None)[0].T
    past = np.column_stack([f[lags - k - 1 : len(f) - k - 1] for k in range(lags)])
    phi = np.linalg.lstsq(past, f[lags:], rcond=None)[0].T
    u = f[lags:] - past @ phi.T
    return Model(loadings, phi, u.T @ u / len(u) + 1e-6 * np.eye(q), np.maximum(np.nanvar(y[deep:] - stacked @ loadings.T, axis=0), 1e-3) if n else np.empty(0))


def step(y: np.ndarray, m: Model, got: dict) -> Model:
    """One round of EM from the filter's results under m."""
    q, wide, used = m.q, m.loadings.shape[1], m.phi.shape[1]
    xs, ps, lag = kernels.smoothed(got, m.state_space()["f"])
    second = ps + np.einsum("ti,tj->tij", xs, xs)
    cross = (lag[1:, :q, :used] + np.einsum("ti,tj->tij", xs[1:, :q], xs[:-1, :used])).sum(0)
    phi = np.linalg.solve(second[:-1, :used, :used].sum(0), cross.T).T
    shocks = (second[1:, :q, :q].sum(0) - phi @ cross.T) / (len(y) - 1)
    loadings, noise = m.loadings.copy(), m.noise.copy()
    for i in range(y.shape[1]):
        seen = ~np.isnan(y[:, i])
        if seen.any():
            s = second[seen][:, :wide, :wide]
            loadings[i] = np.linalg.solve(s.sum(0), (y[seen, i][:, None] * xs[seen, :wide]).sum(0))
            e = y[seen, i] - xs[seen, :wide] @ loadings[i]
            noise[i] = max(1e-6, (e @ e + np.einsum("i,tij,j->", loadings[i], ps[seen][:, :wide, :wide], loadings[i])) / seen.sum())
    return Model(loadings, phi, (shocks + shocks.T) / 2, noise)


def estimated(y: np.ndarray, q: int = 1, deep: int = 1, lags: int = 2, rounds: int = 100, tolerance: float = 1e-6) -> Model:
    """EM until the likelihood gains less than the tolerance; a round that would lower it (the first state's prior isn't part of the round) ends it."""
    m, path = started(y, q, deep, lags), []
    best = m
    for _ in range(rounds):
        got = filtered(y, m)
        if path and got["loglik"] < path[-1]:
            break
        best = m
        path.append(got["loglik"])
        if len(path) > 1 and path[-1] - path[-2] < tolerance * (1 + abs(path[-2])):
            break
        m = step(y, m, got)
    return replace(best, loglik=tuple(path))


def identified(m: Model) -> Model:
    """The same model with independent shocks of variance one that enter the first q series in turn: its current loadings there are lower triangular, their diagonal positive."""
    q = m.q
    low = np.linalg.cholesky(m.shocks)
    first = m.loadings[:q, :q] @ low
    orthonormal, upper = np.linalg.qr(first.T)
    signs = np.sign(np.diag(upper))
    signs[signs == 0] = 1
    new = low @ orthonormal * signs  # f = new f*
    back = np.linalg.inv(new)
    blocks = lambda a: [a[:, k : k + q] for k in range(0, a.shape[1], q)]
    return replace(m, loadings=np.hstack([b @ new for b in blocks(m.loadings)]), phi=np.hstack([back @ b @ new for b in blocks(m.phi)]), shocks=np.eye(q))


def contributions(y: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """innovations (months x n), what each series adds to the update of the factors (months x n x q), and the updates (months x q).

    An update is gain times innovations, so it is a sum over the series seen in that month.
    """
    s, got = m.state_space(), filtered(y, m)
    t, n = y.shape
    news, parts = np.full((t, n), np.nan), np.zeros((t, n, m.q))
    for k in range(t):
        seen = np.flatnonzero(~np.isnan(y[k]))
        if not seen.size:
            continue
        h, p = s["h"][seen], got["pp"][k]
        gain = np.linalg.solve(h @ p @ h.T + s["r"][np.ix_(seen, seen)], h @ p).T
        news[k, seen] = y[k, seen] - h @ got["xp"][k]
        parts[k, seen] = (gain[: m.q] * news[k, seen]).T
    return news, parts, got["xf"][:, : m.q] - got["xp"][:, : m.q]


def null_model(y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Autoregressions of order one of y and of the regressor m, apart from each other: (intercept, slope) of both, and their residuals side by side."""
    both = []
    for x in (y, m):
        z = np.column_stack([np.ones(len(x) - 1), x[:-1]])
        c = np.linalg.lstsq(z, x[1:], rcond=None)[0]
        c[1] = np.clip(c[1], -0.99, 0.99)
        both.append((c, x[1:] - z @ c))
    e = np.column_stack([b[1] for b in both])
    return both[0][0], both[1][0], e - e.mean(0)


def null_paths(y: np.ndarray, m: np.ndarray, reps: int, draw: str, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """reps x months of y and m, generated month by month from the null model; errors are resampled in pairs, or normal with their covariance."""
    cy, cm, e = null_model(y, m)
    t = len(y)
    errors = e[rng.integers(0, len(e), (reps, t))] if draw == "residual" else rng.multivariate_normal(np.zeros(2), np.cov(e.T), (reps, t))
    out = np.empty((2, reps, t))
    start = rng.integers(0, t, reps)  # a month of the data, the same for both
    out[0, :, 0], out[1, :, 0] = y[start], m[start]
    for k in range(1, t):
        out[0, :, k] = cy[0] + cy[1] * out[0, :, k - 1] + errors[:, k, 0]
        out[1, :, k] = cm[0] + cm[1] * out[1, :, k - 1] + errors[:, k, 1]
    return out[0], out[1]


def mse_f(y: np.ndarray, m: np.ndarray, lags: int, horizon: int, tests: int) -> np.ndarray:
    """MSE-F of direct forecasts `horizon` months ahead with `lags` values of m beside y's last, against y's last alone; each of the last `tests` from what
    was known then. y, m: paths x months; one pass of running normal equations for all paths."""
    paths, t = y.shape
    first = lags - 1
    at = np.arange(first, t - horizon)
    full = np.stack([np.ones((paths, len(at))), y[:, at], *(m[:, at - k] for k in range(lags))], 2)
    target = y[:, at + horizon]
    origins = np.arange(len(at) - tests, len(at))
    out = []
    for z in (full[:, :, :2], full):
        xx, xy = np.cumsum(np.einsum("ptk,ptl->ptkl", z, z), 1), np.cumsum(z * target[:, :, None], 1)
        known = origins - horizon  # the last row whose target had been seen
        ridge = 1e-9 * np.einsum("ptkk->pt", xx[:, known])[..., None, None] * np.eye(z.shape[2])
        beta = np.linalg.solve(xx[:, known] + ridge, xy[:, known][..., None])[..., 0]
        out.append(((target[:, origins] - (z[:, origins] * beta).sum(2)) ** 2).mean(1))
    return tests * (out[0] - out[1]) / out[1]
