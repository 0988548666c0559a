"""Blocks of a Bayesian dynamic factor model: draws from conditionals, state-space matrices, simulation smoother, news. No Spark here.

Each block is a pure function of arrays and a generator, so a chain is a grouping key and its seed comes from it.
"""

from __future__ import annotations

import math

import numpy as np

from tidemark.operators import kernels

#: The ten-component normal mixture for the log of a chi-square of one degree (Omori, Chib, Shephard, Nakajima 2007).
MIX_P = np.array([0.00609, 0.04775, 0.13057, 0.20674, 0.22715, 0.18842, 0.12047, 0.05591, 0.01575, 0.00115])
MIX_M = np.array([1.92677, 1.34744, 0.73504, 0.02266, -0.85173, -1.97278, -3.46788, -5.55246, -8.68384, -14.65])
MIX_V = np.array([0.11265, 0.17788, 0.26768, 0.40611, 0.62699, 0.98583, 1.57469, 2.54498, 4.16591, 7.33342])
#: Months' weights in a quarter's growth of a monthly growth rate.
AGGREGATOR = np.array([1.0, 2.0, 3.0, 2.0, 1.0]) / 9


def symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def spd_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a^-1 b by Cholesky."""
    low = np.linalg.cholesky(a)
    return np.linalg.solve(low.T, np.linalg.solve(low, b))


def spd_inv(a: np.ndarray) -> np.ndarray:
    return symmetric(spd_solve(a, np.eye(len(a))))


def spd_logdet(a: np.ndarray) -> float:
    return 2 * float(np.log(np.diag(np.linalg.cholesky(a))).sum())


def normal(mean: np.ndarray, cov: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A draw of a multivariate normal; where the covariance is only semidefinite, by its eigenvalues."""
    z = rng.standard_normal(len(mean))
    if not (cov - np.diag(np.diag(cov))).any():
        return mean + np.sqrt(np.diag(cov)) * z
    try:
        return mean + np.linalg.cholesky(cov) @ z
    except np.linalg.LinAlgError:
        value, vector = np.linalg.eigh(symmetric(cov))
        return mean + vector @ (np.sqrt(np.maximum(value, 0)) * z)


def categorical(probs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A column for each row of probabilities."""
    edges = np.cumsum(probs, 1)
    return (edges < rng.random((len(probs), 1)) * edges[:, -1:]).sum(1).clip(max=probs.shape[1] - 1)


def posterior_rows(likelihood: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Rows of likelihood times prior that sum to one; the prior where a row is 0 or not a number."""
    p = likelihood * prior
    total = p.sum(1, keepdims=True)
    good = np.isfinite(total) & (total > 0)
    return np.where(good, p / np.where(good, total, 1), prior)


def mixture_posterior(log_square: np.ndarray) -> np.ndarray:
    """Chances of the mixture's components, given log e**2 of standard normal errors."""
    z = (log_square[:, None] - MIX_M) / np.sqrt(MIX_V)
    return posterior_rows(np.exp(-0.5 * z * z) / np.sqrt(MIX_V), MIX_P)


def random_walk_states(y: np.ndarray, noise: np.ndarray, step: float, mean: float, var: float, rng: np.random.Generator) -> np.ndarray:
    """A draw of h given y_t = h_t + e_t, e_t of variance noise_t, and h a random walk of step variance `step` from N(mean, var)."""
    n = len(y)
    m, p = np.empty(n), np.empty(n)
    a, b = mean, var
    for t in range(n):
        if t:
            b = b + step
        gain = b / (b + noise[t]) if np.isfinite(y[t]) else 0.0
        a, b = a + gain * ((y[t] - a) if gain else 0.0), b * (1 - gain)
        m[t], p[t] = a, b
    out = np.empty(n)
    out[-1] = rng.normal(m[-1], math.sqrt(p[-1]))
    for t in range(n - 2, -1, -1):
        j = p[t] / (p[t] + step)
        out[t] = rng.normal(m[t] + j * (out[t + 1] - m[t]), math.sqrt(p[t] * (1 - j)))
    return out


def update_vol(x: np.ndarray, sigma: np.ndarray, step: float, rng: np.random.Generator, mean: float = 0.0, var: float = 10.0) -> np.ndarray:
    """Deviations of the innovations x by stochastic volatility: mixture components given sigma, then the log variances given these."""
    log_square = np.log(np.where(np.isfinite(x), x, 0.0) ** 2 + 1e-10)
    log_square = np.where(np.isfinite(x), log_square, np.nan)
    k = categorical(mixture_posterior(np.where(np.isfinite(log_square), log_square - 2 * np.log(sigma), 0.0)), rng)
    return np.exp(random_walk_states(log_square - MIX_M[k], MIX_V[k], step, mean, var, rng) / 2)


def scale_support(share: float) -> tuple[np.ndarray, np.ndarray]:
    """Outlier scales and their prior chances: 1 with 1 - share, else evenly 2 to 5."""
    vals = np.concatenate([[1.0], np.linspace(2, 5, 99)])
    return vals, np.concatenate([[1 - share], np.full(99, share / 99)])


def update_scl(x: np.ndarray, vals: np.ndarray, probs: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Outlier scale of each standardised innovation, and the chance that it is none; a missing one has the prior's."""
    z = np.where(np.isfinite(x), x, np.nan)[:, None] / vals
    like = np.where(np.isfinite(z), np.exp(-0.5 * z * z) / vals, 1.0)
    post = posterior_rows(like, probs)
    return vals[categorical(post, rng)], post[:, 0]


def update_gam(changes: np.ndarray, nu: float, s2: float, rng: np.random.Generator) -> float:
    """Step variance given the changes of a random walk: inverse gamma with nu degrees and s2 as the prior."""
    return (nu * s2 + float(changes @ changes)) / 2 / rng.gamma((nu + len(changes)) / 2)


def update_ps(scales: np.ndarray, a: float, b: float, rng: np.random.Generator) -> float:
    """Share of outliers given the scales: beta."""
    out = int((scales > 1).sum())
    return rng.beta(a + out, b + len(scales) - out)


def layout(n_monthly: int, n_quarterly: int, factors: int, lags: int) -> dict[str, slice]:
    """Where the blocks of the state are: factors and their lags (five at least, for quarters), then monthly and quarterly parts of their own."""
    depth = max(lags, len(AGGREGATOR) if n_quarterly else 1)
    a, b = factors * depth, n_monthly
    return {"factors": slice(0, a), "monthly": slice(a, a + b), "quarterly": slice(a + b, a + b + n_quarterly * len(AGGREGATOR))}


def state_space(loadings: np.ndarray, phi: np.ndarray, q: np.ndarray, own_ar: np.ndarray, own_var: np.ndarray, n_quarterly: int) -> dict[str, np.ndarray]:
    """Matrices of a mixed-frequency factor model: the last n_quarterly series see five months by the aggregator, of factors and of their own part."""
    n, r = loadings.shape
    n_monthly, lags, width = n - n_quarterly, phi.shape[1] // r, len(AGGREGATOR)
    at = layout(n_monthly, n_quarterly, r, lags)
    size = at["quarterly"].stop
    h, f, v = np.zeros((n, size)), np.zeros((size, size)), np.zeros((size, size))
    f[:r, : r * lags] = phi
    deep = at["factors"].stop
    f[r:deep, : deep - r] = np.eye(deep - r)
    v[:r, :r] = q
    h[:n_monthly, :r] = loadings[:n_monthly]
    for k in range(n_quarterly):
        i, start = n_monthly + k, at["quarterly"].start + k * width
        for j, w in enumerate(AGGREGATOR):
            h[i, j * r : (j + 1) * r] = w * loadings[i]
        h[i, start : start + width] = AGGREGATOR
        f[start, start], v[start, start] = own_ar[i], own_var[i]
        f[start + 1 : start + width, start : start + width - 1] = np.eye(width - 1)
    h[:n_monthly, at["monthly"]] = np.eye(n_monthly)
    own = np.arange(at["monthly"].start, at["monthly"].stop)
    f[own, own], v[own, own] = own_ar[:n_monthly], own_var[:n_monthly]
    return {"h": h, "f": f, "q": v, "r": 1e-6 * np.eye(n), "x0": np.zeros(size), "p0": 10 * np.eye(size)}


def simulated(ssm: dict[str, np.ndarray], n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """States and observations, forward; the first state comes from x0 and p0 and then takes a step. q may have a matrix for each period."""
    x = normal(ssm["x0"], ssm["p0"], rng)
    states, seen, q = [], [], ssm["q"]
    for t in range(n):
        x = ssm["f"] @ x + normal(np.zeros(len(x)), q[t] if q.ndim == 3 else q, rng)
        states.append(x)
        seen.append(ssm["h"] @ x + normal(np.zeros(len(ssm["h"])), ssm["r"], rng))
    return np.array(states), np.array(seen)


def smoothed_states(y: np.ndarray, ssm: dict[str, np.ndarray]) -> np.ndarray:
    """Means of the states given all observations, by adjoint recursion: no state covariance has to be inverted."""
    got = kernels.kalman(y, ssm["h"], ssm["f"], ssm["q"], ssm["r"], ssm["x0"], ssm["p0"])
    r = np.zeros(len(ssm["x0"]))
    out = np.empty_like(got["xf"])
    for t in range(len(y) - 1, -1, -1):
        seen = ~np.isnan(y[t])
        h, p = ssm["h"][seen], got["pp"][t]
        if seen.any():
            s = h @ p @ h.T + ssm["r"][np.ix_(seen, seen)]
            gain = np.linalg.solve(s, h @ p).T
            r = h.T @ np.linalg.solve(s, y[t, seen] - h @ got["xp"][t]) + (np.eye(len(r)) - gain @ h).T @ r
        out[t] = got["xp"][t] + p @ r
        r = ssm["f"].T @ r
    return out


def state_draw(y: np.ndarray, ssm: dict[str, np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """One draw of the states given y: simulated states, corrected by the smoothed difference of the observations."""
    x, sim = simulated(ssm, len(y), rng)
    centred = dict(ssm, x0=np.zeros_like(ssm["x0"]))
    return x + smoothed_states(y - np.where(np.isnan(y), np.nan, sim), centred)


def packed(params: dict[str, np.ndarray]) -> tuple[np.ndarray, list[tuple[str, tuple[int, ...]]]]:
    """Parameters as one vector, columns first, with their names and shapes."""
    return np.concatenate([np.asarray(v).ravel("F") for v in params.values()]), [(k, np.shape(v)) for k, v in params.items()]


def unpacked(vector: np.ndarray, shapes: list[tuple[str, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes:
        size = math.prod(shape)
        out[name] = vector[at : at + size].reshape(shape, order="F")
        at += size
    return out


def model(fit: dict) -> dict[str, np.ndarray]:
    """State space of an EM fit."""
    r = len(fit["f"])
    return {"h": fit["h"], "f": fit["f"], "q": fit["q"], "r": np.diag(fit["noise"]), "x0": np.zeros(r), "p0": 10 * np.eye(r)}


def news_rows(y_old: np.ndarray, y_new: np.ndarray, old: dict, new: dict, row: int, series: int) -> tuple[dict[str, float], list[dict]]:
    """Why an estimate moved: old, then what parameters, revisions and releases add; and of each released cell its forecast, weight and impact.

    y_new has all cells of y_old. The estimate is linear in the cells, so a release's weight is what one unit more of it adds given all
    cells, and its impact the weight times actual less forecast: the impacts add up to the release row, in whatever order they came.
    """
    estimate = lambda y, m: float(smoothed_states(y, m)[row] @ m["h"][series])
    revised = np.where(np.isnan(y_old), np.nan, y_new)
    at_old, at_param, at_revised, at_new = estimate(y_old, old), estimate(y_old, new), estimate(revised, new), estimate(y_new, new)
    expected = smoothed_states(revised, new) @ new["h"].T
    cells = []
    for t, i in np.argwhere(np.isnan(y_old) & ~np.isnan(y_new)):
        more = y_new.copy()
        more[t, i] += 1
        weight = estimate(more, new) - at_new
        cells.append({"row": int(t), "series": int(i), "forecast": float(expected[t, i]), "actual": float(y_new[t, i]), "weight": weight, "impact": weight * float(y_new[t, i] - expected[t, i])})
    return {"old": at_old, "parameters": at_param - at_old, "revisions": at_revised - at_param, "releases": at_new - at_revised}, cells


def volatility_chain(x: np.ndarray, sweeps: int, burn: int, seed: int, share: float = 0.05) -> dict[str, np.ndarray]:
    """Gibbs chain of one series of innovations: volatilities, outlier scales, step variance and outlier share, each from its conditional."""
    rng = np.random.default_rng(seed)
    sigma, scale, step = np.full(len(x), max(np.nanstd(x), 1e-6)), np.ones(len(x)), 0.01
    total = {k: np.zeros(len(x)) for k in ("sigma", "scale", "plain")}
    shares, steps = [], []
    for k in range(burn + sweeps):
        sigma = update_vol(x / scale, sigma, step, rng, mean=2 * math.log(max(np.nanstd(x), 1e-6)))
        vals, probs = scale_support(share)
        scale, plain = update_scl(x / sigma, vals, probs, rng)
        step = update_gam(np.diff(2 * np.log(sigma)), 10.0, 0.01, rng)
        share = update_ps(scale, 1.0, 19.0, rng)
        if k >= burn:
            for name, v in (("sigma", sigma), ("scale", scale), ("plain", plain)):
                total[name] += v / sweeps
            shares.append(share)
            steps.append(step)
    return total | {"share": np.array(shares), "step": np.array(steps)}


def regression_draw(y: np.ndarray, x: np.ndarray, noise: np.ndarray | float, prior_mean: np.ndarray, prior_var: float, rng: np.random.Generator) -> np.ndarray:
    """Coefficients of y on x with known error variances (one for all or one a row) and an independent normal prior."""
    w = x / np.asarray(noise).reshape(-1, 1) if np.ndim(noise) else x / noise
    precision = symmetric(x.T @ w) + np.eye(x.shape[1]) / prior_var
    cov = spd_inv(precision)
    return normal(cov @ (w.T @ y + prior_mean / prior_var), cov, rng)


def steady(phi: np.ndarray) -> bool:
    """Whether a scalar autoregression's roots are inside the unit circle."""
    p = len(phi)
    companion = np.vstack([phi, np.eye(p - 1, p)]) if p > 1 else phi.reshape(1, 1)
    return bool(np.abs(np.linalg.eigvals(companion)).max() < 0.995)


def mixed_chain(y: np.ndarray, n_quarterly: int, draws: int, burn: int, seed: int, thin: int = 1, lags: int = 2, share: float = 0.05) -> dict[str, np.ndarray]:
    """Gibbs chain of a one-factor model of monthly and (last) quarterly series, standardised, T x n.

    Blocks, each from its conditional: all states by simulation smoother with the factor's variance of each month; loadings and own
    autoregressions of monthly series on quasi-differenced rows; a quarterly series' loading with its own part integrated out (its errors
    share months across quarters, so their covariance has three diagonals); own variances; the factor's autoregression, kept stationary;
    its volatility by the normal mixture, outlier scales, step variance and outlier share. Gives draws of what each series is at every
    month (`fitted` mean), of the last month's quarterly value (`last`), and means of volatility and scales.
    """
    rng = np.random.default_rng(seed)
    t, n = y.shape
    n_monthly = n - n_quarterly
    load, rho, var = np.ones((n, 1)), np.zeros(n), np.full(n, 0.5)
    phi, sigma, scale, step = np.zeros(lags), np.full(t, 0.5), np.ones(t), 0.01
    near = np.zeros(t)
    out: dict[str, list] = {"last": [], "loadings": []}
    total = {"fitted": np.zeros((t, n)), "sigma": near.copy(), "scale": near.copy()}
    overlap = float(AGGREGATOR[3:] @ AGGREGATOR[:2])
    for sweep in range(burn + draws * thin):
        ssm = state_space(load, phi[None, :], np.eye(1), rho, var, n_quarterly)
        q = np.repeat(ssm["q"][None], t, 0)
        q[:, 0, 0] = (sigma * scale) ** 2
        states = state_draw(y, dict(ssm, q=q), rng)
        f = states[:, 0]
        at = layout(n_monthly, n_quarterly, 1, lags)
        for i in range(n_monthly):
            pairs = np.flatnonzero(~np.isnan(y[1:, i]) & ~np.isnan(y[:-1, i])) + 1
            dy, df = y[pairs, i] - rho[i] * y[pairs - 1, i], f[pairs] - rho[i] * f[pairs - 1]
            load[i] = regression_draw(dy, df[:, None], var[i], np.ones(1), 1.0, rng)
            e = y[:, i] - load[i, 0] * f
            new = regression_draw(e[pairs], e[pairs - 1][:, None], var[i], np.zeros(1), 0.1, rng)
            rho[i] = new[0] if abs(new[0]) < 0.98 else rho[i]
            var[i] = max(update_gam(e[pairs] - rho[i] * e[pairs - 1], 4.0, 0.3, rng), 1e-4)
        months = np.arange(len(AGGREGATOR) - 1, t)
        agg = np.full(t, np.nan)
        agg[months] = sum(w * f[months - j] for j, w in enumerate(AGGREGATOR))
        for k in range(n_quarterly):
            i = n_monthly + k
            rows = months[~np.isnan(y[months, i])]
            cov = var[i] * (float(AGGREGATOR @ AGGREGATOR) * np.eye(len(rows)) + overlap * (np.abs(np.subtract.outer(rows, rows)) == 3))
            low = np.linalg.cholesky(cov)
            load[i] = regression_draw(np.linalg.solve(low, y[rows, i]), np.linalg.solve(low, agg[rows])[:, None], 1.0, np.ones(1), 1.0, rng)
            var[i] = max(update_gam(states[:, at["quarterly"].start + k * len(AGGREGATOR)], 4.0, 0.3, rng), 1e-4)
        past = np.column_stack([f[lags - j - 1 : t - j - 1] for j in range(lags)])
        new = regression_draw(f[lags:], past, (sigma * scale)[lags:] ** 2, np.zeros(lags), 0.25, rng)
        phi = new if steady(new) else phi
        u = np.concatenate([f[:lags], f[lags:] - past @ phi])
        sigma = np.clip(update_vol(u / scale, sigma, step, rng), 1e-3, 1e2)
        vals, probs = scale_support(share)
        scale = update_scl(u / sigma, vals, probs, rng)[0]
        step, share = update_gam(np.diff(2 * np.log(sigma)), 10.0, 0.01, rng), update_ps(scale, 1.0, 19.0, rng)
        if load[:, 0].sum() < 0:
            load, states = -load, states.copy()
            states[:, at["factors"]] *= -1
        if sweep >= burn and (sweep - burn + 1) % thin == 0:
            fit = states @ state_space(load, phi[None, :], np.eye(1), rho, var, n_quarterly)["h"].T
            total["fitted"] += fit / draws
            total["sigma"] += sigma / draws
            total["scale"] += scale / draws
            out["last"].append(fit[-1, n_monthly:])
            out["loadings"].append(load[:, 0].copy())
    return total | {k: np.array(v) for k, v in out.items()}
