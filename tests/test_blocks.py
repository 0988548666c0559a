"""The block model's conditionals against dense normal arithmetic, restrictions, restarts and planted factors."""

import numpy as np
import pytest
from tidemark.operators import bayes
from tidemark.operators import blocks as b


def small(seed=0, t=14, lags=2):
    """Four monthly series and a quarterly one; three blocks, the last confined to months 5 to 9."""
    rng = np.random.default_rng(seed)
    table = np.array([[100, 0, 1], [1, 100, 0], [1, 1, 100], [1, 0, 0], [1, 0, 1]], float)
    window = (np.arange(t) >= 5) & (np.arange(t) < 10)
    p = b.pattern(table, t, 1, lags, np.array([0, 0, 0, 0, 0.7]), 2, window)
    y = rng.normal(size=(t, 5))
    y[rng.random(y.shape) < 0.15] = np.nan
    y[np.arange(t) % 3 != 2, 4] = np.nan
    y = b.visible(y, p)
    c = b.started(y, p, seed)
    c.mean, c.own = rng.normal(0, 0.2, 5), np.array([0.3, -0.4, 0.5, 0.1, 0.6])
    c.sigma, c.scale = rng.uniform(0.3, 1.5, c.sigma.shape), rng.choice([1.0, 1.0, 3.0], c.scale.shape)
    c.phi = np.where(np.isnan(p.phi), rng.normal(0, 0.15, p.phi.shape), p.phi)
    c.trend_step = 0.3
    return c, p, y


def joint(m):
    """Covariance of all months' states, by writing each as a sum of innovations."""
    t, size = m["q"].shape
    power = [np.linalg.matrix_power(m["f"], k) for k in range(t + 1)]
    cov = np.zeros((t * size, t * size))
    for i in range(t):
        for j in range(t):
            x = b.BEFORE * power[i + 1] @ power[j + 1].T
            for s in range(min(i, j) + 1):
                x = x + power[i - s] * m["q"][s] @ power[j - s].T
            cov[i * size : (i + 1) * size, j * size : (j + 1) * size] = x
    return cov


def wide_h(m):
    t, n, size = m["h"].shape
    out = np.zeros((t * n, t * size))
    for k in range(t):
        out[k * n : (k + 1) * n, k * size : (k + 1) * size] = m["h"][k]
    return out


def test_smoothed_means_are_the_dense_conditional():
    c, p, y = small()
    m = b.matrices(c, p)
    h, cov = wide_h(m), joint(m)
    seen = ~np.isnan(y.ravel())
    v = (y - c.mean).ravel()[seen]
    s = h[seen] @ cov @ h[seen].T + b.NOISE * np.eye(seen.sum())
    want = cov @ h[seen].T @ np.linalg.solve(s, v)
    assert np.allclose(b.smooth(y - c.mean, m), want.reshape(len(y), -1), atol=1e-5)


def test_state_draws_have_the_dense_moments():
    c, p, y = small()
    m = b.matrices(c, p)
    h, cov = wide_h(m), joint(m)
    seen = ~np.isnan(y.ravel())
    s = h[seen] @ cov @ h[seen].T + b.NOISE * np.eye(seen.sum())
    post = cov - cov @ h[seen].T @ np.linalg.solve(s, h[seen] @ cov)
    rng = np.random.default_rng(1)
    draws = np.array([b.state_draw(y, m, rng)[:, len(b.WEIGHTS)] for _ in range(1500)])  # the first factor
    at = np.arange(len(y)) * p.size + len(b.WEIGHTS)
    want = np.sqrt(np.diag(post)[at])
    assert np.allclose(draws.std(0), want, rtol=0.12)
    assert np.all(np.abs(draws.mean(0) - b.smooth(y - c.mean, m)[:, len(b.WEIGHTS)]) < 5 * want / np.sqrt(1500))


@pytest.mark.parametrize("i", range(5))
def test_loadings_given_factors_are_the_dense_conditional(i):
    c, p, y = small()
    rng = np.random.default_rng(3)
    g, f = np.cumsum(rng.normal(size=len(y))), rng.normal(size=(len(y), 3))
    mean, cov, free = b.loading_moments(i, y, g, f, c, p)
    assert list(free) == list(np.flatnonzero(np.isnan(p.loadings[i])))
    # the own part's covariance from the state space, with no loadings and no trend
    alone, bare = b.Chain.from_bytes(c.to_bytes()), b.Pattern(p.loadings, p.phi, np.zeros(5), p.active, 1)
    alone.load = np.zeros_like(c.load)
    m = b.matrices(alone, bare)
    rows = np.flatnonzero(~np.isnan(y[:, i]))
    h = wide_h(m)[rows * 5 + i]
    noise = h @ joint(m) @ h.T + b.NOISE * np.eye(len(rows))
    quarter = lambda x, t: sum(w * x[t - j] for j, w in enumerate([1 / 9, 2 / 9, 3 / 9, 2 / 9, 1 / 9]))
    shown = np.where(((np.arange(len(y)) >= 5) & (np.arange(len(y)) < 10))[:, None], f, f * [1, 1, 0])
    at = (lambda x: np.array([quarter(x, t) for t in rows])) if i == 4 else (lambda x: x[rows])
    x = np.column_stack([np.ones(len(rows)), at(shown)[:, free]])
    target = y[rows, i] - p.trend[i] * at(g) - at(shown) @ np.nan_to_num(p.loadings[i])
    full = 10 * np.eye(15) - (0.1 / 5) * np.kron(np.eye(3), np.ones((5, 5)))  # of all loadings, columns first
    mine, rest = [j * 5 + i for j in free], [k for k in range(15) if k % 5 != i]
    prior, load = c.prior.T.ravel(), c.load.T.ravel()
    before = prior[mine] - np.linalg.solve(full[np.ix_(mine, mine)], full[np.ix_(mine, rest)] @ (load - prior)[rest])
    precision = np.zeros((1 + len(mine),) * 2)
    precision[0, 0], precision[1:, 1:] = 100, full[np.ix_(mine, mine)]
    pull = precision @ np.concatenate([[0], before])
    want = np.linalg.inv(precision + x.T @ np.linalg.inv(noise) @ x)
    assert np.allclose(cov, want, atol=1e-8) and np.allclose(mean, want @ (pull + x.T @ np.linalg.inv(noise) @ target), atol=1e-7)


@pytest.mark.parametrize("j", range(3))
def test_dynamics_are_the_conditional_of_the_free_posterior(j):
    c, p, y = small(t=40)
    f = np.random.default_rng(4).normal(size=(40, 3))
    mean, cov, free = b.phi_moments(j, f, c, p)
    row = np.array([p.phi[j, k, lag] for lag in range(2) for k in range(3)])
    assert list(free) == list(np.isnan(row)) and (~free).sum() == (4 if j == 2 else 2)
    past = np.column_stack([f[1:39], f[0:38]])
    w = np.diag(1 / (c.sigma[2:, j] * c.scale[2:, j]) ** 2)
    precision = b.phi_prior(3, 2) + past.T @ w @ past
    start = np.eye(6)[j]
    full = np.linalg.solve(precision, b.phi_prior(3, 2) @ start + past.T @ w @ f[2:, j])
    inverse = np.linalg.inv(precision)
    gain = inverse[np.ix_(free, ~free)] @ np.linalg.inv(inverse[np.ix_(~free, ~free)])
    assert np.allclose(mean, full[free] + gain @ (row[~free] - full[~free])) and np.allclose(cov, inverse[np.ix_(free, free)] - gain @ inverse[np.ix_(~free, free)])


def test_pattern_holds_through_sweeps():
    c, p, y = small(t=30)
    for _ in range(5):
        b.sweep(c, y, p)
    fixed = ~np.isnan(p.loadings)
    assert np.array_equal(c.load[fixed], p.loadings[fixed]) and (c.phi[2, :2] == 0).all() and (c.phi[:2, 2] == 0).all() and c.phi[2, 2].any()
    m = b.matrices(c, p)
    assert not m["h"][:5, :4, len(b.WEIGHTS) + 2].any() and m["h"][6, 2, len(b.WEIGHTS) + 2] == 1
    assert (b.phi_prior(2, 1) == np.array([[25 + 4 + 4, 4], [4, 25 + 4 + 4]])).all()


def test_restarted_chain_is_the_same_bit_for_bit():
    c, p, y = small(t=20)
    for _ in range(4):
        b.sweep(c, y, p)
    other = b.Chain.from_bytes(c.to_bytes())
    for _ in range(4):
        b.sweep(c, y, p)
        b.sweep(other, y, p)
    assert c.to_bytes() == other.to_bytes() and other.sweeps == 8
    longer = b.Chain.from_bytes(c.to_bytes()).longer(23)
    assert longer.sigma.shape == longer.scale.shape == (23, 8) and (longer.scale[20:] == 1).all() and (longer.sigma[22] == c.sigma[19]).all()


def test_scales_alone_are_redrawn():
    c, p, y = small(t=40)
    y[25, 0] = 14.0  # an outlier
    c.scale[:], c.sigma[:] = 1, 0.5
    before = b.Chain.from_bytes(c.to_bytes())
    means = []
    for seed in range(2):
        one = b.Chain.from_bytes(c.to_bytes())
        one.rng = np.random.default_rng(seed)
        means.append(b.averaged_scales(one, y, p, 400))
        for k in ("mean", "load", "phi", "own", "step", "share", "sigma"):
            assert np.array_equal(getattr(one, k), getattr(before, k))
    assert means[0][25, 3] > 2 > np.median(means[0][:, 3]) and np.abs(means[0] - means[1]).mean() < 0.06
    # chances of each scale given an innovation: the dense arithmetic of normals of those scales
    vals, probs = bayes.scale_support(0.05)
    like = np.array([np.exp(-0.5 * (2.2 / v) ** 2) / v for v in vals]) * probs
    rng = np.random.default_rng(0)
    draws = bayes.update_scl(np.full(20_000, 2.2), vals, probs, rng)[0]
    assert abs((draws > 1).mean() - like[1:].sum() / like.sum()) < 0.01


def planted(seed, t=120):
    rng = np.random.default_rng(seed)
    f = np.zeros((t, 2))
    for k in range(1, t):
        f[k] = [0.8, 0.5] * f[k - 1] + rng.normal(size=2) * 0.6
    load = np.array([[1, 0], [0.9, 1.0], [0.7, 0.8], [0.8, 0], [-0.8, 0], [1.0, 0]])
    y = f @ load.T + 0.3 * rng.normal(size=(t, 6))
    y[:, 5] = b.aggregated(y[:, 5])
    y[np.arange(t) % 3 != 2, 5] = np.nan
    table = np.array([[100, 0], [1, 100], [1, 1], [1, 0], [1, 0], [1, 0]], float)
    p = b.pattern(table, t, 1)
    return b.visible(y, p), p, load, f


def test_planted_loadings_and_last_value_are_found():
    y, p, load, _ = planted(5)
    hidden = y[-1, 5]
    y[-1, 5] = np.nan
    c = b.started(y, p, 0)
    seen, values = [], []
    for k in range(160):
        states = b.sweep(c, y, p)
        if k >= 60:
            seen.append(c.load.copy())
            values.append(b.seen_value(states, c, p, len(y) - 1, 5))
    assert np.allclose(np.mean(seen, 0), load, atol=0.35)
    assert abs(np.mean(values) - hidden) < 4 * np.std(values) + 0.05 and np.std(values) < 0.6
    again = [b.density_draw(b.Chain.from_bytes(c.to_bytes()), y, p, len(y) - 1, 5)]
    assert np.isfinite(again).all()


def test_seeds_of_loadings_and_collapse():
    y, p, load, _ = planted(7)
    seed = b.seeded_loadings(y, p)
    assert (seed[np.nan_to_num(p.loadings, nan=1) == 0] == 0).all() and np.allclose(np.linalg.norm(seed, axis=0), 1)
    assert seed[0, 0] > 0 and seed[1, 1] > 0 and seed[4, 0] < 0
    flipped = b.seeded_loadings(-y, p)
    assert flipped[0, 0] > 0
    y[:, 3] = np.nan
    assert (b.seeded_loadings(y, p)[3] == 0).all()
    assert b.collapsed(np.array([[0.02, 1.0]]), 0, 0.1) and not b.collapsed(load, 5, 0.1)
