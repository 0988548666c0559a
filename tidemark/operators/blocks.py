"""A Bayesian factor model of blocks: loadings and dynamics by pattern, a trend, volatilities and outliers. No Spark here.

Series i in month t is mean + trend[i] g_t + sum over blocks of load[i, j] active[t, j] f_tj + e_ti; a quarterly series is what the
weights 1 2 3 2 1 make of such months. g is a random walk, f a vector autoregression, e an autoregression of each series; innovations of
f and e have a volatility (a random walk in logs) and an outlier scale. A `Pattern` says which loadings and lag coefficients are free.

A `Chain` is all that a sweep needs, its generator too: stored as bytes and taken up again it goes on as if it had never stopped.
"""

from __future__ import annotations

import io
import json
import math
from dataclasses import dataclass, field

import numpy as np

from tidemark.operators import bayes

WEIGHTS = bayes.AGGREGATOR
#: Variance of each state before the first month, and of what is seen given the states.
BEFORE, NOISE = 10.0, 1e-6
#: Prior values, fixed: precisions of means, of loadings and of own lags; degrees and scale of step variances; outliers once in two years, worth 20 months.
MEAN_PRECISION, LOAD_PRECISION, LOAD_SHARED, OWN_PRECISION = 100.0, 10.0, 0.1, 25.0
TREND_STEP, FACTOR_STEP, OWN_STEP = (18.0, 1e-4), (2.0, 1e-3), (18.0, 1e-4)
OUTLIERS = (20 / 24, 20 * 23 / 24)


@dataclass(frozen=True)
class Pattern:
    """loadings (n x r) and phi (r x r x lags): NaN is free, a number fixed. trend: n. active: months x r. The last `quarterly` series are quarterly."""

    loadings: np.ndarray
    phi: np.ndarray
    trend: np.ndarray
    active: np.ndarray
    quarterly: int

    @property
    def depth(self) -> int:
        return max(self.phi.shape[2], len(WEIGHTS))

    @property
    def size(self) -> int:
        n, r = self.loadings.shape
        return len(WEIGHTS) + r * self.depth + (n - self.quarterly) + len(WEIGHTS) * self.quarterly


def pattern(blocks: np.ndarray, months: int, quarterly: int, lags: int = 2, trend: np.ndarray | None = None, confined: int | None = None, window: np.ndarray | None = None) -> Pattern:
    """blocks (n x r): 0 no loading, 1 free, 100 fixed at one (what names the block). A confined block has dynamics of its own alone and acts in the window only."""
    n, r = blocks.shape
    loadings = np.where(blocks == 0, 0.0, np.where(blocks == 100, 1.0, np.nan))
    phi, active = np.full((r, r, lags), np.nan), np.ones((months, r))
    if confined is not None:
        phi[confined], phi[:, confined] = 0.0, 0.0
        phi[confined, confined] = np.nan
        active[:, confined] = window
    return Pattern(loadings, phi, np.zeros(n) if trend is None else trend, active, quarterly)


@dataclass
class Chain:
    mean: np.ndarray
    trend_step: float
    load: np.ndarray
    phi: np.ndarray
    own: np.ndarray
    step: np.ndarray  # of the log variances, factors first
    share: np.ndarray  # of outliers, factors first
    sigma: np.ndarray  # months x (r + n), factors first
    scale: np.ndarray
    prior: np.ndarray  # mean of the loadings
    rng: np.random.Generator = field(default_factory=np.random.default_rng)
    sweeps: int = 0

    ARRAYS = ("mean", "load", "phi", "own", "step", "share", "sigma", "scale", "prior")

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, trend_step=self.trend_step, sweeps=self.sweeps, **{k: getattr(self, k) for k in self.ARRAYS})
        state = json.dumps(self.rng.bit_generator.state).encode()
        return len(state).to_bytes(4, "little") + state + out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> Chain:
        n = int.from_bytes(raw[:4], "little")
        with np.load(io.BytesIO(raw[4 + n :])) as z:
            chain = Chain(**{k: z[k] for k in Chain.ARRAYS}, trend_step=float(z["trend_step"]), sweeps=int(z["sweeps"]))
        chain.rng.bit_generator.state = json.loads(raw[4 : 4 + n])
        return chain

    def longer(self, months: int) -> Chain:
        """With volatilities for more months: the last ones stay as they are, without outliers."""
        more = months - len(self.sigma)
        if more > 0:
            self.sigma = np.vstack([self.sigma, np.repeat(self.sigma[-1:], more, 0)])
            self.scale = np.vstack([self.scale, np.ones((more, self.scale.shape[1]))])
        return self


def seeded_loadings(y: np.ndarray, p: Pattern) -> np.ndarray:
    """Principal directions of the standardised panel as a start: signs by the series that name the blocks, zeros of the pattern, columns of length one."""
    r = p.loadings.shape[1]
    seen = ~np.isnan(y).all(0)
    out = np.zeros(p.loadings.shape)
    if seen.sum() > 1:
        _, s, v = np.linalg.svd(np.where(np.isnan(y), 0.0, y)[:, seen], full_matrices=False)
        k = min(r, len(s))
        out[seen, :k] = (v[:k] * s[:k, None]).T
    for j in range(r):
        named = np.flatnonzero(p.loadings[:, j] == 1)
        if named.size and out[named[0], j] < 0:
            out[:, j] *= -1
    out[p.loadings == 0] = 0
    size = np.linalg.norm(out, axis=0)
    return out / np.where(size > 0, size, 1)


def started(y: np.ndarray, p: Pattern, seed: int) -> Chain:
    n, r = p.loadings.shape
    prior = seeded_loadings(y, p)
    phi = np.where(np.isnan(p.phi), 0.0, p.phi)
    phi[..., 0] += 0.5 * np.eye(r) * np.isnan(p.phi[..., 0])
    shape = (len(y), r + n)
    return Chain(np.zeros(n), 0.01, np.where(np.isnan(p.loadings), prior, p.loadings), phi, np.zeros(n), np.full(r + n, 0.001), np.full(r + n, 1 / 24), np.full(shape, 0.5), np.ones(shape), prior, np.random.default_rng(seed))


def collapsed(load: np.ndarray, row: int, floor: float, block: int = 0) -> bool:
    """Whether a series has lost its tie to a block: the estimate then no longer hears the panel, however plausible it looks."""
    return bool(abs(load[row, block]) < floor)


def matrices(c: Chain, p: Pattern) -> dict[str, np.ndarray]:
    """State space: h for each month, f, the diagonal of each month's state variance, d. States: trend, factors by lag, monthly own parts, quarterly ones."""
    n, r = p.loadings.shape
    t, w, nq, lags = len(c.sigma), len(WEIGHTS), p.quarterly, p.phi.shape[2]
    nm, deep, size = n - nq, r * p.depth, p.size
    f, q, h = np.zeros((size, size)), np.zeros((t, size)), np.zeros((t, n, size))
    f[0, 0] = 1
    f[1:w, : w - 1] += np.eye(w - 1)
    q[:, 0] = c.trend_step**2
    f[w : w + r, w : w + r * lags] = c.phi.transpose(0, 2, 1).reshape(r, -1)
    f[w + r : w + deep, w : w + deep - r] = np.eye(deep - r)
    var = (c.sigma * c.scale) ** 2
    q[:, w : w + r] = var[:, :r]
    a, b = w + deep, w + deep + nm
    f[range(a, b), range(a, b)] = c.own[:nm]
    q[:, a:b] = var[:, r : r + nm]
    h[:, :nm, 0] = p.trend[:nm]
    h[:, :nm, w : w + r] = c.load[:nm] * p.active[:, None, :]
    h[:, range(nm), range(a, b)] = 1
    for k in range(nq):
        i, at = nm + k, b + k * w
        f[at, at] = c.own[i]
        f[at + 1 : at + w, at : at + w - 1] = np.eye(w - 1)
        q[:, at] = var[:, r + i]
        h[:, i, :w] = p.trend[i] * WEIGHTS
        h[:, i, at : at + w] = WEIGHTS
        for j, weight in enumerate(WEIGHTS):
            then = np.vstack([np.repeat(p.active[:1], j, 0), p.active[: t - j]])
            h[:, i, w + j * r : w + (j + 1) * r] = weight * c.load[i] * then
    return {"h": h, "f": f, "q": q, "d": c.mean}


def visible(y: np.ndarray, p: Pattern) -> np.ndarray:
    """y without quarterly values whose five months aren't all in the panel."""
    y = y.copy()
    if p.quarterly:
        y[: len(WEIGHTS) - 1, -p.quarterly :] = np.nan
    return y


def smooth(y: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """Means of the states given y (deviations from d), by a filter and the adjoint recursion."""
    t, size = len(y), len(m["f"])
    x, cov = np.zeros(size), BEFORE * np.eye(size)
    kept = []
    for k in range(t):
        x, cov = m["f"] @ x, m["f"] @ cov @ m["f"].T
        cov[np.diag_indices(size)] += m["q"][k]
        seen = ~np.isnan(y[k])
        h = m["h"][k, seen]
        ph = cov @ h.T
        inverse = np.linalg.inv(h @ ph + NOISE * np.eye(len(h)))
        v = y[k, seen] - h @ x
        kept.append((x, cov, h, inverse @ v, ph @ inverse))
        x, cov = x + ph @ (inverse @ v), cov - ph @ inverse @ ph.T
        cov = (cov + cov.T) / 2
    out, r = np.empty((t, size)), np.zeros(size)
    for k in range(t - 1, -1, -1):
        x, cov, h, u, gain = kept[k]
        r = h.T @ (u - gain.T @ r) + r
        out[k] = x + cov @ r
        r = m["f"].T @ r
    return out


def state_draw(y: np.ndarray, m: dict[str, np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """One draw of the states given y: simulated states, corrected by the smoothed difference."""
    t, size = len(y), len(m["f"])
    x = math.sqrt(BEFORE) * rng.standard_normal(size)
    states, z = np.empty((t, size)), rng.standard_normal((t, size)) * np.sqrt(m["q"])
    for k in range(t):
        x = states[k] = m["f"] @ x + z[k]
    sim = np.einsum("tij,tj->ti", m["h"], states) + math.sqrt(NOISE) * rng.standard_normal(y.shape)
    return states + smooth(y - m["d"] - sim, m)


def parts(states: np.ndarray, p: Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, factors and own parts, by month."""
    n, r = p.loadings.shape
    w, at = len(WEIGHTS), len(WEIGHTS) + r * p.depth
    own = np.column_stack([states[:, at : at + n - p.quarterly], states[:, at + n - p.quarterly :: w]])
    return states[:, 0], states[:, w : w + r], own


def aggregated(x: np.ndarray) -> np.ndarray:
    """Months' values by the quarterly weights; the first four rows have none."""
    out = np.full(x.shape, np.nan)
    out[len(WEIGHTS) - 1 :] = sum(wt * x[len(WEIGHTS) - 1 - j : len(x) - j] for j, wt in enumerate(WEIGHTS))
    return out


def own_covariance(rho: float, var: np.ndarray, rows: np.ndarray, quarterly: bool) -> np.ndarray:
    """Covariance of a series' own part in the rows where it is seen."""
    t = len(var)
    lag = np.subtract.outer(np.arange(t), np.arange(t))
    step = np.where(lag >= 0, float(rho) ** np.maximum(lag, 0), 0.0)
    cov = (step * var) @ step.T + BEFORE * np.outer(rho ** (np.arange(t) + 1.0), rho ** (np.arange(t) + 1.0))
    if not quarterly:
        return cov[np.ix_(rows, rows)] + NOISE * np.eye(len(rows))
    weights = np.zeros((len(rows), t))
    for j, wt in enumerate(WEIGHTS):
        weights[np.arange(len(rows)), rows - j] = wt
    return weights @ cov @ weights.T + NOISE * np.eye(len(rows))


def loading_moments(i: int, y: np.ndarray, g: np.ndarray, f: np.ndarray, c: Chain, p: Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and covariance of a series' mean and free loadings given trend and factors, its own part integrated out; and which loadings are free."""
    n, r = p.loadings.shape
    quarterly = i >= n - p.quarterly
    shown = p.active * f
    if quarterly:
        g, shown = aggregated(g), aggregated(shown)
    rows = np.flatnonzero(~np.isnan(y[:, i]))
    free = np.flatnonzero(np.isnan(p.loadings[i]))
    fixed = np.where(np.isnan(p.loadings[i]), 0.0, p.loadings[i])
    x = np.column_stack([np.ones(len(rows)), shown[rows][:, free]])
    target = y[rows, i] - p.trend[i] * g[rows] - shown[rows] @ fixed
    others = np.delete(np.arange(n), i)
    # the prior ties the loadings of a block together: what the others' say of this one
    tie = LOAD_SHARED / n
    weight = LOAD_PRECISION - tie
    mean = c.prior[i] + tie / weight * (c.load[others] - c.prior[others]).sum(0)
    precision = np.diag(np.concatenate([[MEAN_PRECISION], np.full(len(free), weight)]))
    pull = np.concatenate([[0.0], weight * mean[free]])
    if rows.size:
        low = np.linalg.cholesky(own_covariance(c.own[i], (c.sigma[:, r + i] * c.scale[:, r + i]) ** 2, rows, quarterly))
        xs, ys = np.linalg.solve(low, x), np.linalg.solve(low, target)
        precision, pull = precision + xs.T @ xs, pull + xs.T @ ys
    cov = bayes.spd_inv(precision)
    return cov @ pull, cov, free


def phi_prior(r: int, lags: int) -> np.ndarray:
    """Precision of a row of the lag coefficients, lag by lag: each near its mean the more the longer the lag, sums by factor and over all held too."""
    each = 5 * np.diag(np.repeat(np.arange(1.0, lags + 1), r))
    x = np.vstack([each, 2 * np.tile(np.eye(r), (1, lags)), 2 * np.ones((1, r * lags))])
    return x.T @ x


def phi_moments(j: int, f: np.ndarray, c: Chain, p: Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and covariance of the free coefficients of factor j's row, and which they are (lag by lag)."""
    r, _, lags = p.phi.shape
    row = p.phi[j].T.ravel()
    free = np.isnan(row)
    past = np.column_stack([f[lags - k - 1 : len(f) - k - 1] for k in range(lags)])
    w = 1 / (c.sigma[lags:, j] * c.scale[lags:, j]) ** 2
    prior, mean = phi_prior(r, lags), np.zeros(r * lags)
    mean[j] = 1.0
    fixed = np.where(free, 0.0, row)
    target = f[lags:, j] - past[:, ~free] @ fixed[~free]
    x = past[:, free]
    precision = prior[np.ix_(free, free)] + (x * w[:, None]).T @ x
    pull = prior[np.ix_(free, free)] @ mean[free] - prior[np.ix_(free, ~free)] @ (fixed - mean)[~free] + (x * w[:, None]).T @ target
    cov = bayes.spd_inv(precision)
    return cov @ pull, cov, free


def stationary(phi: np.ndarray) -> bool:
    r, _, lags = phi.shape
    top = phi.transpose(0, 2, 1).reshape(r, -1)
    companion = np.vstack([top, np.eye(r * (lags - 1), r * lags)]) if lags > 1 else top
    return bool(np.abs(np.linalg.eigvals(companion)).max() < 0.995)


def residuals(f: np.ndarray, own: np.ndarray, c: Chain, p: Pattern) -> np.ndarray:
    """Innovations of factors and own parts, months x (r + n); the months that start a recursion have none."""
    lags = p.phi.shape[2]
    out = np.full((len(f), f.shape[1] + own.shape[1]), np.nan)
    out[lags:, : f.shape[1]] = f[lags:] - sum(f[lags - k - 1 : len(f) - k - 1] @ c.phi[:, :, k].T for k in range(lags))
    out[1:, f.shape[1] :] = own[1:] - c.own * own[:-1]
    return out


def redraw_scales(c: Chain, y: np.ndarray, p: Pattern) -> np.ndarray:
    """New outlier scales given the parameters and volatilities, which stay; gives the state draw behind them."""
    states = state_draw(y, matrices(c, p), c.rng)
    _, f, own = parts(states, p)
    u = residuals(f, own, c, p)
    for k in range(u.shape[1]):
        c.scale[:, k] = bayes.update_scl(u[:, k] / c.sigma[:, k], *bayes.scale_support(c.share[k]), c.rng)[0]
    return states


def averaged_scales(c: Chain, y: np.ndarray, p: Pattern, draws: int) -> np.ndarray:
    """Mean of the scales over so many redraws; the chain is left with it."""
    total = np.zeros_like(c.scale)
    for _ in range(draws):
        redraw_scales(c, y, p)
        total += c.scale / draws
    c.scale = total
    return total


def sweep(c: Chain, y: np.ndarray, p: Pattern) -> np.ndarray:
    """One draw of all from their conditionals, in place; gives the states. y: standardised, months x n, through `visible`."""
    n, r = p.loadings.shape
    rng = c.rng
    states = state_draw(y, matrices(c, p), rng)
    g, f, own = parts(states, p)
    c.trend_step = math.sqrt(bayes.update_gam(np.diff(g), *TREND_STEP, rng))
    for j in range(r):
        mean, cov, free = phi_moments(j, f, c, p)
        new = c.phi.copy()
        row = new[j].T.ravel()
        row[free] = bayes.normal(mean, cov, rng)
        new[j] = row.reshape(-1, r).T
        if stationary(new):
            c.phi = new
    for i in range(n):
        w = 1 / (c.sigma[1:, r + i] * c.scale[1:, r + i]) ** 2
        precision = OWN_PRECISION + (w * own[:-1, i] ** 2).sum()
        new = rng.normal((w * own[:-1, i] * own[1:, i]).sum() / precision, precision**-0.5)
        c.own[i] = new if abs(new) < 0.98 else c.own[i]
    u = residuals(f, own, c, p)
    for k in range(r + n):
        c.sigma[:, k] = np.clip(bayes.update_vol(u[:, k] / c.scale[:, k], c.sigma[:, k], c.step[k], rng, mean=-1.0), 1e-3, 1e2)
        c.scale[:, k] = bayes.update_scl(u[:, k] / c.sigma[:, k], *bayes.scale_support(c.share[k]), rng)[0]
        c.step[k] = bayes.update_gam(np.diff(2 * np.log(c.sigma[:, k])), *(FACTOR_STEP if k < r else OWN_STEP), rng)
        c.share[k] = bayes.update_ps(c.scale[:, k], *OUTLIERS, rng)
    for i in range(n):
        mean, cov, free = loading_moments(i, y, g, f, c, p)
        new = bayes.normal(mean, cov, rng)
        c.mean[i], c.load[i, free] = new[0], new[1:]
    c.sweeps += 1
    return states


def seen_value(states: np.ndarray, c: Chain, p: Pattern, row: int, series: int) -> float:
    """What the states say of a series in a month."""
    return float(c.mean[series] + matrices(c, p)["h"][row, series] @ states[row])


def density_draw(c: Chain, y: np.ndarray, p: Pattern, row: int, series: int) -> float:
    """One draw of a series' value from a stored draw's parameters: outlier scales answer to the data, then states."""
    redraw_scales(c, y, p)
    return seen_value(state_draw(y, matrices(c, p), c.rng), c, p, row, series)
