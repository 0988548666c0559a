"""The first model, one for each component: monthly series and the component's quarterly growth share factors. No Spark here.

Monthly series load with a factor's current value, quarterly growth with a weighted sum of five (growth of averages of three months).
EM is exact: states of five lags by filter and smoother, then loadings, autoregression, shocks and noise from their moments.
A model is fitted once and then only filtered: with parameters fixed, an estimate moves by its releases alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np

from tidemark.operators import kernels

#: Quarterly growth in months' growth.
WEIGHTS = np.array([1, 2, 3, 2, 1]) / 3
#: Factors, rounds of EM, and the relative gain of the likelihood that ends it: defaults of the reference.
FACTORS, ROUNDS, TOLERANCE = 3, 100, 1e-4
#: Quarters that a model needs at least.
LEAST = 8
#: A factor whose squared loadings sum to less explains next to nothing.
WEAK = 0.1
LEVELS = (68, 95)


@dataclass(frozen=True)
class Model:
    loadings: np.ndarray  # series, then the target, x factors
    phi: np.ndarray
    shocks: np.ndarray
    noise: np.ndarray  # series, then the target
    loglik: tuple[float, ...] = ()
    converged: bool = False

    def state_space(self) -> dict[str, np.ndarray]:
        r = len(self.phi)
        h, f, v = np.zeros((len(self.loadings), 5 * r)), np.zeros((5 * r, 5 * r)), np.zeros((5 * r, 5 * r))
        h[:-1, :r], h[-1] = self.loadings[:-1], np.kron(WEIGHTS, self.loadings[-1])
        f[:r, :r], f[r:, :-r] = self.phi, np.eye(4 * r)
        v[:r, :r] = self.shocks
        return {"h": h, "f": f, "q": v, "r": np.diag(self.noise), "x0": np.zeros(5 * r), "p0": 10 * np.eye(5 * r)}


def filtered(y: np.ndarray, m: Model) -> dict:
    return kernels.kalman(y, **m.state_space())


def started(y: np.ndarray, r: int) -> Model:
    """From principal components of the series, zeros where they are missing."""
    z = np.nan_to_num(y[:, :-1])
    f, loadings, _ = kernels.principal(z, r)
    sums = sum(w * np.roll(f, k, 0) for k, w in enumerate(WEIGHTS))
    seen = ~np.isnan(y[:, -1]) & (np.arange(len(y)) >= 4)
    own = np.linalg.lstsq(sums[seen], y[seen, -1], rcond=None)[0]
    phi = np.linalg.lstsq(f[:-1], f[1:], rcond=None)[0].T
    u = f[1:] - f[:-1] @ phi.T
    noise = np.append(np.nanvar(y[:, :-1] - f @ loadings.T, axis=0), np.var(y[seen, -1] - sums[seen] @ own))
    return Model(np.vstack([loadings, own]), phi, u.T @ u / len(u) + 1e-6 * np.eye(r), np.maximum(noise, 1e-3))


def step(y: np.ndarray, m: Model, got: dict) -> Model:
    """One round of EM from the filter's results under m. A state holds the lag, so its own moments are all that the autoregression takes."""
    r = len(m.phi)
    xs, ps, _ = kernels.smoothed(got, m.state_space()["f"])
    second = ps + np.einsum("ti,tj->tij", xs, xs)
    total = second.sum(0)
    phi = np.linalg.solve(total[r : 2 * r, r : 2 * r], total[r : 2 * r, :r]).T
    shocks = (total[:r, :r] - phi @ total[r : 2 * r, :r]) / len(y)
    loadings, noise = m.loadings.copy(), m.noise.copy()
    takes = [np.eye(r, 5 * r)] * (y.shape[1] - 1) + [np.kron(WEIGHTS, np.eye(r))]
    for i, take in enumerate(takes):
        seen = ~np.isnan(y[:, i])
        if seen.any():
            z, s = xs[seen] @ take.T, take @ second[seen].sum(0) @ take.T
            loadings[i] = np.linalg.solve(s, z.T @ y[seen, i])
            noise[i] = max(1e-6, (y[seen, i] @ y[seen, i] - loadings[i] @ (z.T @ y[seen, i])) / seen.sum())
    return Model(loadings, phi, (shocks + shocks.T) / 2, noise)


def estimated(y: np.ndarray, r: int = FACTORS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Model:
    """y: months x (series, target), standardised, the target in its quarters' last months; no more factors than series."""
    m, path = started(y, min(r, y.shape[1] - 1)), []
    for k in range(rounds):
        got = filtered(y, m)
        path.append(got["loglik"])
        if k and path[-1] - path[-2] < tolerance * (abs(path[-1]) + abs(path[-2])) / 2:
            return replace(m, loglik=tuple(path), converged=True)
        if k < rounds - 1:
            m = step(y, m, got)
    return replace(m, loglik=tuple(path))


def identified(y: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Loadings on factors of variance one, orthogonal and the largest first, each summing to a positive number; and each series' share explained."""
    xs, ps, _ = kernels.smoothed(filtered(y, m), m.state_space()["f"])
    r = len(m.phi)
    low = np.linalg.cholesky((ps[:, :r, :r] + np.einsum("ti,tj->tij", xs[:, :r], xs[:, :r])).mean(0) + 1e-12 * np.eye(r))
    u, s, _ = np.linalg.svd(m.loadings[:-1] @ low, full_matrices=False)
    out = u * s
    e = y - xs @ m.state_space()["h"].T
    return out * np.where(out.sum(0) < 0, -1, 1), 1 - np.nanmean(e**2, 0) / np.nanmean(y**2, 0)


@dataclass(frozen=True)
class Panel:
    """values: months x (series, target); published: days of the same shape, infinite where there is no value."""

    values: np.ndarray
    published: np.ndarray

    def known(self, day: float, rows: int | None = None) -> np.ndarray:
        return np.where(self.published <= day, self.values, np.nan)[:rows]


@dataclass(frozen=True)
class Fitted:
    model: Model
    mean: np.ndarray
    scale: np.ndarray
    learnt: np.ndarray  # standardised
    used: np.ndarray  # columns of the panel


def fitted(panel: Panel, day: float, r: int = FACTORS) -> Fitted | None:
    """The model from what was published by a day; none with under LEAST quarters, or without two series that vary."""
    y = panel.known(day)
    months = np.flatnonzero(~np.isnan(y).all(1))
    if not months.size or (~np.isnan(y[:, -1])).sum() < LEAST:
        return None
    y = y[: months[-1] + 1]
    enough = (~np.isnan(y)).sum(0) >= LEAST
    scale = np.array([np.nanstd(y[:, i], ddof=1) if enough[i] else 0.0 for i in range(y.shape[1])])
    used = np.flatnonzero(scale > 0)
    if len(used) < 3 or used[-1] != y.shape[1] - 1:
        return None
    mean = np.nanmean(y[:, used], axis=0)
    learnt = (y[:, used] - mean) / scale[used]
    return Fitted(estimated(learnt, r), mean, scale[used], learnt, used)


def tracked(panel: Panel, fit: Fitted, target: int, days: list[float]) -> Iterator[tuple[dict, list[dict]]]:
    """At each day the target row's estimate, its deviation and bands, and every release since the day before with forecast, actual, weight and impact.

    An estimate is linear in the cells: a release's weight is the estimate from this cell alone at one, its impact the weight times actual less
    what was expected of it, so the impacts add up to the change in whatever order they came. A release is known from the day it is published.
    """
    h = fit.model.state_space()["h"]
    published = panel.published[: target + 1, fit.used]
    values = (panel.values[: target + 1, fit.used] - fit.mean) / fit.scale
    last = fit.scale[-1]
    before, expected, run = None, None, None
    for day in days:
        seen = published <= day
        cells = []
        if before is None or (seen != before).any():
            y = np.where(seen, values, np.nan)
            got = filtered(y, fit.model)
            for t, i in np.argwhere(seen & ~before) if before is not None else ():
                alone = np.where(seen, 0.0, np.nan)
                alone[t, i] = 1
                weight = float(h[-1] @ filtered(alone, fit.model)["xf"][-1])
                surprise = values[t, i] - expected[t, i]
                cells.append({"row": int(t), "column": int(fit.used[i]), "forecast": expected[t, i] * fit.scale[i] + fit.mean[i], "actual": panel.values[t, fit.used[i]], "weight": weight * last / fit.scale[i], "impact": weight * surprise * last})
            before, expected = seen, kernels.smoothed(got, fit.model.state_space()["f"])[0] @ h.T
            point = float(fit.mean[-1] + last * (h[-1] @ got["xf"][-1]))
            deviation = float(last * np.sqrt(h[-1] @ got["pf"][-1] @ h[-1] + fit.model.noise[-1]))
            bands = {f"{side}{c}": point + sign * NormalDist().inv_cdf((1 + c / 100) / 2) * deviation for c in LEVELS for side, sign in (("low", -1), ("high", 1))}
            run = {"nowcast": point, "deviation": deviation, **bands}
        yield run, cells
