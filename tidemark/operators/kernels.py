"""Numeric kernels on small dense arrays: regression, factors, filters, sampling. No Spark here.

Each is a pure function of arrays and a seed; `tidemark.plans.kernel_queries` runs them once a
group with applyInPandas, so that series, as-of dates, variants and chains are grouping keys.
"""

from __future__ import annotations

import math

import numpy as np


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residuals, (X'X)^-1."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    return beta, y - x @ beta, inverse


def kernel_weight(x: float, kind: str = "bartlett") -> float:
    if x == 0:
        return 1.0
    if kind == "truncated":
        return float(abs(x) <= 1)
    if kind == "bartlett":
        return max(0.0, 1 - abs(x))
    if kind == "parzen":
        return 1 - 6 * x**2 + 6 * abs(x) ** 3 if abs(x) <= 0.5 else 2 * (1 - abs(x)) ** 3 if abs(x) <= 1 else 0.0
    if kind == "tukey":
        return (1 + math.cos(math.pi * x)) / 2 if abs(x) <= 1 else 0.0
    z = 6 * math.pi * x / 5  # quadratic spectral
    return 3 / z**2 * (math.sin(z) / z - math.cos(z))


def bandwidth(n: int, rule: str = "nw") -> int:
    return math.floor(4 * (n / 100) ** (2 / 9)) if rule == "nw" else math.floor(0.75 * n ** (1 / 3))


def hac(x: np.ndarray, e: np.ndarray, inverse: np.ndarray, lags: int | None = None, kind: str = "bartlett", leverage: str = "hc0") -> np.ndarray:
    """Covariance of the coefficients under heteroskedastic, autocorrelated errors; residuals scaled by leverage."""
    n, k = x.shape
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    scale = {"hc0": 1.0, "hc1": math.sqrt(n / (n - k)), "hc2": 1 / np.sqrt(1 - h), "hc3": 1 / (1 - h)}[leverage]
    u = x * (e * scale)[:, None]
    s = u.T @ u
    for lag in range(1, (bandwidth(n) if lags is None else lags) + 1):
        g = u[lag:].T @ u[:-lag]
        s += kernel_weight(lag / ((bandwidth(n) if lags is None else lags) + 1), kind) * (g + g.T)
    return inverse @ s @ inverse


def scaled_residuals(e: np.ndarray, leverage: np.ndarray, kind: str = "EH") -> np.ndarray:
    """Residuals as they enter a robust covariance: e / (1 - h) ** (d / 2), where d depends on the kind.

    EH: 0, plain. EB: 1, standardised. ET: 2, prediction errors. With the leverage relative to its mean, r = n h / sum(h): ED, discounted:
    min(4, r); EM, discounted in two parts: min(1, r) + min(1.5, r); ES: min(r, max(4, 0.7 max(r))).
    """
    r = len(leverage) * leverage / leverage.sum()
    power = {
        "EH": lambda: 0.0, "EB": lambda: 1.0, "ET": lambda: 2.0, "ED": lambda: np.minimum(4, r),
        "EM": lambda: np.minimum(1, r) + np.minimum(1.5, r), "ES": lambda: np.minimum(r, max(4.0, 0.7 * r.max())),
    }[kind]()
    return e / (1 - leverage) ** (power / 2)


def recursive_residuals(y: np.ndarray, x: np.ndarray, standard: bool = True) -> np.ndarray:
    """Errors of one-step forecasts, each by the regression on the rows before it, over their deviation; one pass, the inverse gets rank-one updates.

    The first k rows, for k columns, start it and have no residual; they must be independent.
    """
    k = x.shape[1]
    inverse = np.linalg.pinv(x[:k].T @ x[:k])
    beta = inverse @ x[:k].T @ y[:k]
    out = np.empty(len(y) - k)
    for t in range(k, len(y)):
        gain = inverse @ x[t]
        wider = 1 + float(x[t] @ gain)
        error = float(y[t] - x[t] @ beta)
        out[t - k] = error / math.sqrt(wider) if standard else error
        inverse -= np.outer(gain, gain) / wider
        beta = beta + gain * (error / wider)
    return out


def forecast_scores(y: np.ndarray, x: np.ndarray, standard: bool = True, trim: float = 0.1) -> np.ndarray:
    """Rows of x times their recursive residuals, without the first `trim` of them, which few rows stand behind."""
    if not 0 <= trim < 1:
        raise ValueError("trim must be from 0 to under 1")
    e = recursive_residuals(y, x, standard)
    first = math.floor(len(e) * trim)
    return x[len(x) - len(e) + first :] * e[first:, None]


def long_run(scores: np.ndarray, lags: int, kind: str = "bartlett") -> np.ndarray:
    """Sum of the scores' cross products over all lags up to `lags`, weighted by the kernel."""
    s = scores.T @ scores
    for lag in range(1, lags + 1):
        g = scores[lag:].T @ scores[:-lag]
        s += kernel_weight(lag / (lags + 1), kind) * (g + g.T)
    return s


def automatic_bandwidth(scores: np.ndarray, kind: str = "bartlett") -> float:
    """Bandwidth from first-order autoregressions of the columns of x e (Andrews 1991); a constant's column should be left out.

    For Bartlett the published divisor (1 - rho)^6 (1 + rho)^2 is taken; some code has (1 - rho)^8, as for the other kernels. rho is
    held within 0.97, since the published forms have no limit at 1.
    """
    top = bottom = 0.0
    for u in scores.T:
        rho = float(u[1:] @ u[:-1] / (u[:-1] @ u[:-1]))
        rho = min(max(rho, -0.97), 0.97)
        v = float(((u[1:] - rho * u[:-1]) ** 2).mean()) ** 2
        top += 4 * rho**2 * v / ((1 - rho) ** 6 * (1 + rho) ** 2) if kind == "bartlett" else 4 * rho**2 * v / (1 - rho) ** 8
        bottom += v / (1 - rho) ** 4
    n, a = len(scores), top / bottom
    rate = {"bartlett": (1.1447, 1 / 3), "truncated": (0.6611, 1 / 5), "parzen": (2.6614, 1 / 5), "tukey": (1.7462, 1 / 5)}.get(kind, (1.3221, 1 / 5))
    return rate[0] * (a * n) ** rate[1]


def spectral(x: np.ndarray, q: int, m: int) -> dict[str, np.ndarray]:
    """Dynamic principal components: eigenvalues at each frequency of the Bartlett-smoothed spectral density, and the common part's share."""
    n, k = x.shape
    u = x - x.mean(0)
    covs = [u[lag:].T @ u[: n - lag] / n for lag in range(m + 1)]
    freq = 2 * np.pi * np.arange(2 * m + 1) / (2 * m + 1)
    values = np.empty((len(freq), k))
    for j, w in enumerate(freq):
        s = covs[0].astype(complex)
        for lag in range(1, m + 1):
            weight = 1 - lag / (m + 1)
            s += weight * (covs[lag] * np.exp(-1j * w * lag) + covs[lag].T * np.exp(1j * w * lag))
        values[j] = np.linalg.eigvalsh(s / (2 * np.pi))[::-1]
    total = values.mean(0)
    return {"freq": freq, "values": values, "mean": total, "share": total[:q].sum() / total.sum()}


def dynamic_count(x: np.ndarray, most: int, m: int, panels: int = 6, seed: int = 0) -> int:
    """Number of dynamic factors (Hallin and Liska): the log of what the eigenvalues beyond q leave, and a penalty times a constant.

    The constant is where the number is the same in random sub-panels of growing size: its first such stretch below the most allowed.
    """
    rng = np.random.default_rng(seed)
    n, k = x.shape
    most = min(most, k - 1)
    order, found = rng.permutation(k), []
    for j in range(panels):
        share = 0.75 + 0.25 * (j + 1) / panels
        part = x[: max(m + 2, int(n * share)), order[: max(most + 1, int(k * share))]]
        periods, series = part.shape
        mean = spectral(part, most, m)["mean"]
        penalty = (m**-2 + math.sqrt(m / periods) + 1 / series) * math.log(min(series, m**2, math.sqrt(periods / m)) + 1)
        found.append(([math.log(max(mean[q:].sum() / series, 1e-12)) for q in range(most + 1)], penalty))
    grid = np.linspace(0.02, 4, 200)
    chosen = np.array([[int(np.argmin([v + c * q * penalty for q, v in enumerate(left)])) for left, penalty in found] for c in grid])
    same = (chosen == chosen[:, :1]).all(1)
    for i in range(len(grid) - 1):
        if same[i] and same[i + 1] and chosen[i, 0] == chosen[i + 1, 0] < most:
            return int(chosen[i, 0])
    return int(chosen[np.searchsorted(grid, 1.0), -1])


def chi2_tail(x: float, k: int) -> float:
    """Upper tail of chi-square for k degrees, by its finite sums."""
    if x <= 0:
        return 1.0
    if k % 2 == 0:
        term = total = 1.0
        for j in range(1, k // 2):
            term *= x / 2 / j
            total += term
        return math.exp(-x / 2) * total
    total, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for j in range(1, (k - 1) // 2 + 1):
        total += term
        term *= x / (2 * j + 1)
    return total


def wald(beta: np.ndarray, cov: np.ndarray, r: np.ndarray, q: np.ndarray | float = 0.0) -> tuple[float, float]:
    """Statistic and chance of R beta = q."""
    d = r @ beta - q
    stat = float(d @ np.linalg.pinv(r @ cov @ r.T) @ d)
    return stat, chi2_tail(stat, len(r))


def adf(y: np.ndarray, most: int = 4) -> tuple[float, int]:
    """Dickey-Fuller t statistic with drift; lags by AIC, all lag lengths on the rows that the longest has."""
    best = (math.inf, 0.0, 0)
    dy = np.diff(y)
    for p in range(most + 1):
        rows = np.arange(most, len(dy))
        x = np.column_stack([np.ones(len(rows)), y[rows], *(dy[rows - j] for j in range(1, p + 1))])
        beta, e, inverse = ols(dy[rows], x)
        aic = len(rows) * math.log(e @ e / len(rows)) + 2 * x.shape[1]
        best = min(best, (aic, float(beta[1] / math.sqrt(e @ e / (len(rows) - x.shape[1]) * inverse[1, 1])), p))
    return best[1], best[2]


def long_run_variance(u: np.ndarray, lags: int) -> float:
    return float(u @ u / len(u) + 2 * sum((1 - k / (lags + 1)) * (u[k:] @ u[:-k]) / len(u) for k in range(1, lags + 1)))


def kpss(y: np.ndarray) -> float:
    u = y - y.mean()
    return float((np.cumsum(u) ** 2).sum() / len(u) ** 2 / long_run_variance(u, bandwidth(len(u))))


def acf(y: np.ndarray, lags: int) -> np.ndarray:
    u = y - y.mean()
    return np.array([u[k:] @ u[: len(u) - k] / (u @ u) for k in range(lags + 1)])


def pacf(y: np.ndarray, lags: int) -> np.ndarray:
    r = acf(y, lags)
    return np.array([1.0, *(np.linalg.solve(r[np.abs(np.subtract.outer(range(k), range(k)))], r[1 : k + 1])[-1] for k in range(1, lags + 1))])


def almon(lags: int, a: float, b: float) -> np.ndarray:
    w = np.exp(a * np.arange(1, lags + 1) + b * np.arange(1, lags + 1) ** 2)
    return w / w.sum()


def beta_weights(lags: int, a: float, b: float) -> np.ndarray:
    u = np.clip(np.linspace(0, 1, lags), 1e-6, 1 - 1e-6)
    w = u ** (a - 1) * (1 - u) ** (b - 1)
    return w / w.sum()


def var_ols(y: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Coefficients (const first), innovation covariance, AIC, SIC of a VAR(p)."""
    x = np.column_stack([np.ones(len(y) - p), *(y[p - k : len(y) - k] for k in range(1, p + 1))])
    beta, e, _ = ols(y[p:], x)
    omega = e.T @ e / len(e)
    logdet = float(np.linalg.slogdet(omega + 1e-12 * np.eye(len(omega)))[1])
    return beta, omega, logdet + 2 * beta.size / len(e), logdet + math.log(len(e)) * beta.size / len(e)


def companion(beta: np.ndarray, p: int) -> np.ndarray:
    n = beta.shape[1]
    out = np.zeros((n * p, n * p))
    out[:n] = beta[1:].T
    out[n:, :-n] = np.eye(n * (p - 1))
    return out


def principal(x: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors, loadings (orthonormal), variance shares; each factor's loadings sum to a positive number."""
    value, vector = np.linalg.eigh(np.cov(x.T))
    order = np.argsort(value)[::-1]
    loadings = vector[:, order[:r]]
    loadings = loadings * np.where(loadings.sum(0) < 0, -1, 1)
    return (x - x.mean(0)) @ loadings, loadings, value[order] / value.sum()


def factor_count(x: np.ndarray, most: int) -> int:
    """Bai-Ng number of static factors (second criterion)."""
    t, n = x.shape
    best = (math.inf, 0)
    for r in range(most + 1):
        fit = np.zeros_like(x)
        if r:
            f, loadings, _ = principal(x, r)
            fit = f @ loadings.T + x.mean(0)
        v = ((x - fit) ** 2).mean()
        best = min(best, (math.log(v) + r * (n + t) / (n * t) * math.log(min(n, t)), r))
    return best[1]


def kalman(y: np.ndarray, h: np.ndarray, f: np.ndarray, q: np.ndarray, r: np.ndarray, x0: np.ndarray, p0: np.ndarray) -> dict:
    """Filter of y_t = H x_t + e, x_t = F x_{t-1} + u; missing observations are dropped row by row. q: the variance of u, or one for each t."""
    n, k = len(y), len(x0)
    out = {"xp": np.zeros((n, k)), "pp": np.zeros((n, k, k)), "xf": np.zeros((n, k)), "pf": np.zeros((n, k, k)), "loglik": 0.0, "gain": None}
    x, p = x0, p0
    for t in range(n):
        x, p = f @ x, f @ p @ f.T + (q[t] if q.ndim == 3 else q)
        out["xp"][t], out["pp"][t] = x, p
        seen = ~np.isnan(y[t])
        gain = np.zeros((k, 0))
        if seen.any():
            hs = h[seen]
            v = y[t, seen] - hs @ x
            s = hs @ p @ hs.T + r[np.ix_(seen, seen)]
            gain = np.linalg.solve(s, hs @ p).T
            out["loglik"] -= 0.5 * (seen.sum() * math.log(2 * math.pi) + np.linalg.slogdet(s)[1] + v @ np.linalg.solve(s, v))
            x, p = x + gain @ v, p - gain @ hs @ p
            p = (p + p.T) / 2
        out["xf"][t], out["pf"][t] = x, p
    return out


def smoothed(filtered: dict, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rauch-Tung-Striebel: states, covariances, covariances with the state before."""
    xs, ps = filtered["xf"].copy(), filtered["pf"].copy()
    lag = np.zeros_like(ps)
    for t in range(len(xs) - 2, -1, -1):
        j = np.linalg.solve(filtered["pp"][t + 1], f @ filtered["pf"][t]).T
        xs[t] += j @ (xs[t + 1] - filtered["xp"][t + 1])
        ps[t] += j @ (ps[t + 1] - filtered["pp"][t + 1]) @ j.T
        lag[t + 1] = ps[t + 1] @ j.T
    return xs, ps, lag


def em_factor(y: np.ndarray, r: int = 1, rounds: int = 50, tolerance: float = 1e-5) -> dict:
    """EM for a dynamic factor model with missing data; y standardised, T x n. Returns parameters, path of the likelihood, states."""
    filled = np.where(np.isnan(y), 0.0, y)
    factors, h, _ = principal(filled, r)
    f = np.linalg.lstsq(factors[:-1], factors[1:], rcond=None)[0].T
    q = np.atleast_2d(np.cov((factors[1:] - factors[:-1] @ f.T).T)) + 1e-6 * np.eye(r)
    noise = np.maximum(np.nanvar(y - factors @ h.T, axis=0), 1e-4)
    path: list[float] = []
    for _ in range(rounds):
        got = kalman(y, h, f, q, np.diag(noise), np.zeros(r), np.eye(r) * 10)
        xs, ps, lag = smoothed(got, f)
        path.append(got["loglik"])
        if len(path) > 1 and abs(path[-1] - path[-2]) < tolerance * (1 + abs(path[-2])):
            break
        second = ps + np.einsum("ti,tj->tij", xs, xs)
        cross = lag[1:] + np.einsum("ti,tj->tij", xs[1:], xs[:-1])
        f = np.linalg.solve(second[:-1].sum(0), cross.sum(0).T).T
        q = (second[1:].sum(0) - f @ cross.sum(0).T) / (len(y) - 1)
        q = (q + q.T) / 2
        for i in range(y.shape[1]):
            seen = ~np.isnan(y[:, i])
            if seen.any():
                h[i] = np.linalg.solve(second[seen].sum(0), (y[seen, i][:, None] * xs[seen]).sum(0))
                e = y[seen, i] - xs[seen] @ h[i]
                noise[i] = max(1e-6, (e @ e + np.einsum("i,tij,j->", h[i], ps[seen], h[i])) / seen.sum())
    sign = np.where(h.sum(0) < 0, -1.0, 1.0)
    return {"h": h * sign, "f": f * np.outer(sign, sign), "q": q * np.outer(sign, sign), "noise": noise, "loglik": path, "filtered": got["xf"] * sign, "smoothed": xs * sign, "parts": got}


def news(y_old: np.ndarray, y_new: np.ndarray, fit: dict, row: int, series: int) -> dict[int, float]:
    """Change of the expected value of a series at a row that each series' new cells bring, one series after another in their order (bayes.news_rows doesn't depend on it)."""
    r = len(fit["f"])
    expected = lambda y: float((smoothed(kalman(y, fit["h"], fit["f"], fit["q"], np.diag(fit["noise"]), np.zeros(r), np.eye(r) * 10), fit["f"])[0] @ fit["h"].T)[row, series])
    out, y, before = {}, y_old.copy(), expected(y_old)
    for k in range(y.shape[1]):
        y[:, k] = y_new[:, k]
        after = expected(y)
        out[k], before = after - before, after
    return out


def simulate_states(y: np.ndarray, h: np.ndarray, f: np.ndarray, q: np.ndarray, r: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One draw of the states given y, forward filter and backward sampling."""
    k = len(f)
    got = kalman(y, h, f, q, r, np.zeros(k), np.eye(k) * 10)
    out = np.zeros_like(got["xf"])
    draw = lambda m, v: m + np.linalg.cholesky(v + 1e-9 * np.eye(k)) @ rng.standard_normal(k)
    out[-1] = draw(got["xf"][-1], got["pf"][-1])
    for t in range(len(out) - 2, -1, -1):
        j = np.linalg.solve(got["pp"][t + 1], f @ got["pf"][t]).T
        v = got["pf"][t] - j @ f @ got["pf"][t]
        out[t] = draw(got["xf"][t] + j @ (out[t + 1] - f @ got["xf"][t]), (v + v.T) / 2)
    return out


def gibbs_factor(y: np.ndarray, draws: int = 60, burn: int = 30, seed: int = 0, thin: int = 1) -> dict:
    """Gibbs for a one-factor model with stochastic volatility of the factor by a random walk in log variance.

    States, loadings, noise and the autoregression are drawn from their conditionals; the log variances by
    Metropolis steps, one a time. Returns means, and draws of the last state: `draws` of
    them, one every `thin` sweeps after `burn`.
    """
    rng = np.random.default_rng(seed)
    fit = em_factor(y, 1, 15)
    h, f, noise = fit["h"].copy(), fit["f"].copy(), fit["noise"].copy()
    logv = np.full(len(y), math.log(max(float(fit["q"][0, 0]), 1e-4)))
    total, last = np.zeros(len(y)), []
    for s in range(burn + draws * thin):
        q = np.exp(logv)[:, None, None]
        x = simulate_states(y, h, f, q, np.diag(noise), rng)[:, 0]
        for i in range(y.shape[1]):
            seen = ~np.isnan(y[:, i])
            precision = x[seen] @ x[seen] / noise[i] + 1.0
            h[i, 0] = rng.normal((x[seen] @ y[seen, i] / noise[i] + 0.5) / precision, precision**-0.5)
            e = y[seen, i] - h[i, 0] * x[seen]
            noise[i] = (0.5 + e @ e / 2) / rng.gamma(3 + seen.sum() / 2)
        w = np.exp(-logv[1:])
        precision = (w * x[:-1] ** 2).sum() + 4
        f = np.array([[float(np.clip(rng.normal((w * x[:-1] * x[1:]).sum() / precision, precision**-0.5), -0.98, 0.98))]])
        u = np.concatenate([[x[0]], x[1:] - f[0, 0] * x[:-1]])
        for t in range(len(y)):
            near = logv[[k for k in (t - 1, t + 1) if 0 <= k < len(y)]]
            fit_of = lambda v, t=t, near=near: -0.5 * (v + u[t] ** 2 * math.exp(-v)) - ((v - near) ** 2).sum() / 0.08
            new = logv[t] + 0.3 * rng.standard_normal()
            if math.log(rng.random()) < fit_of(new) - fit_of(logv[t]):
                logv[t] = new
        if h.sum() < 0:
            h, x = -h, -x
        if s >= burn and (s - burn + 1) % thin == 0:
            total += x
            last.append(float(x[-1] * f[0, 0] * h[0, 0]))
    return {"factor": total / draws, "draws": np.array(last), "loadings": h[:, 0], "vol": np.exp(logv / 2)}


def mse_f(e1: np.ndarray, e2: np.ndarray) -> float:
    """MSE-F statistic of a larger model's errors e2 against a nested one's e1."""
    return float(len(e1) * ((e1**2).mean() - (e2**2).mean()) / (e2**2).mean())


def one_step(y: np.ndarray, x: np.ndarray, start: int) -> np.ndarray:
    """Errors of recursive one-step forecasts, each from the rows before."""
    return np.array([y[t] - x[t] @ ols(y[:t], x[:t])[0] for t in range(start, len(y))])


def one_step_matrix(x: np.ndarray, start: int) -> np.ndarray:
    """The matrix that maps y to the errors of one_step(y, x, start): they are linear in y."""
    out = np.zeros((len(x) - start, len(x)))
    for t in range(start, len(x)):
        out[t - start, :t] = -x[t] @ np.linalg.pinv(x[:t])
        out[t - start, t] = 1
    return out


def bootstrap_mse_f(y: np.ndarray, x: np.ndarray, start: int, reps: int, seed: int) -> tuple[float, np.ndarray]:
    """The statistic, and draws of it where x has no part in y: residuals of the mean model are resampled."""
    rng = np.random.default_rng(seed)
    ones = np.ones((len(y), 1))
    small, full = one_step_matrix(ones, start), one_step_matrix(np.column_stack([ones, x]), start)
    e = y - y.mean()
    draws = np.array([y.mean() + rng.choice(e, len(e)) for _ in range(reps)])
    stats = [mse_f(small @ v, full @ v) for v in (y, *draws)]
    return stats[0], np.array(stats[1:])


def stable_rank(wald: np.ndarray, least: float) -> np.ndarray:
    """Places of the statistics that reach the threshold, largest first, ties by place."""
    order = np.argsort(-wald, kind="stable")
    return order[wald[order] >= least]
