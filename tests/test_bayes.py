"""Blocks of the Bayesian model: draws against their conditionals, smoothing against dense normals, news that adds up."""

import math

import numpy as np
from tidemark.operators import bayes, kernels


def small_model(quarterly=1):
    rng = np.random.default_rng(0)
    n, r, lags = 3, 1, 2
    return bayes.state_space(rng.normal(1, 0.3, (n, r)), np.array([[0.5, 0.2]]), np.eye(1), np.array([0.3, 0.1, 0.2]), np.array([0.5, 0.4, 0.3]), quarterly)


def dense(y, ssm):
    """Means and covariance of all states given y, from the joint normal."""
    n, k = len(y), len(ssm["x0"])
    mean, cov, cross = np.zeros(n * k), np.zeros((n * k, n * k)), []
    m, p = ssm["x0"], ssm["p0"]
    power = [np.eye(k)]
    for _ in range(n):
        power.append(ssm["f"] @ power[-1])
    for t in range(n):
        m, p = ssm["f"] @ m, ssm["f"] @ p @ ssm["f"].T + ssm["q"]
        mean[t * k : (t + 1) * k] = m
        cross.append(p)
        for s in range(t + 1):
            block = power[t - s] @ cross[s]
            cov[t * k : (t + 1) * k, s * k : (s + 1) * k] = block
            cov[s * k : (s + 1) * k, t * k : (t + 1) * k] = block.T
    seen = ~np.isnan(y.ravel())
    h = np.kron(np.eye(n), ssm["h"])[seen]
    s = h @ cov @ h.T + np.kron(np.eye(n), ssm["r"])[np.ix_(seen, seen)]
    gain = cov @ h.T @ np.linalg.inv(s)
    return (mean + gain @ (y.ravel()[seen] - h @ mean)).reshape(n, k), cov - gain @ h @ cov


def gappy(ssm, n=8):
    y = bayes.simulated(ssm, n, np.random.default_rng(1))[1]
    y[:, 2] = np.where(np.arange(n) % 3 == 2, y[:, 2], np.nan)
    y[3, 0] = y[n - 3] = np.nan
    return y


def test_linear_algebra():
    a = np.array([[4.0, 1.0], [1.0, 3.0]])
    assert np.allclose(bayes.spd_inv(a) @ a, np.eye(2)) and math.isclose(bayes.spd_logdet(a), math.log(11)) and np.allclose(a @ bayes.spd_solve(a, np.ones(2)), 1)
    assert np.allclose(bayes.symmetric(np.array([[1.0, 2.0], [0.0, 1.0]])), [[1, 1], [1, 1]])
    half = np.array([[1.0, 1.0], [1.0, 1.0]])  # semidefinite
    draws = np.array([bayes.normal(np.zeros(2), half, np.random.default_rng(k)) for k in range(400)])
    assert np.allclose(draws[:, 0], draws[:, 1], atol=1e-6) and abs(draws.std() - 1) < 0.1


def test_smoothing_is_the_dense_normal():
    ssm = small_model()
    y = gappy(ssm)
    assert np.allclose(bayes.smoothed_states(y, ssm), dense(y, ssm)[0], atol=1e-6)
    assert bayes.layout(2, 1, 1, 2) == {"factors": slice(0, 5), "monthly": slice(5, 7), "quarterly": slice(7, 12)}


def test_simulation_smoother_draws_from_the_posterior():
    ssm = small_model()
    y = gappy(ssm, 5)
    mean, cov = dense(y, ssm)
    rng = np.random.default_rng(2)
    draws = np.array([bayes.state_draw(y, ssm, rng).ravel() for _ in range(3000)])
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    assert (np.abs(draws.mean(0) - mean.ravel()) < 5 * sd / math.sqrt(3000) + 1e-3).all()
    assert np.abs(np.cov(draws.T) - cov).max() < 0.15 * sd.max() ** 2


def test_states_with_a_variance_for_each_period():
    """The filter with q of each period is that of the dense normal; with equal ones it's the plain one."""
    h, f, r = np.array([[1.0], [0.5]]), np.array([[0.7]]), 0.3 * np.eye(2)
    y = np.random.default_rng(3).normal(size=(6, 2))
    q = np.array([0.2, 3.0, 0.1, 1.0, 2.0, 0.5])
    got = kernels.kalman(y, h, f, q[:, None, None], r, np.zeros(1), np.eye(1))
    x, p = 0.0, 1.0
    for t in range(6):
        x, p = 0.7 * x, 0.49 * p + q[t]
        s = h @ h.T * p + r
        k = p * h.T @ np.linalg.inv(s)
        x, p = float((x + k @ (y[t] - h[:, 0] * x))[0]), float((p - p * k @ h)[0, 0])
        assert math.isclose(got["xf"][t, 0], x) and math.isclose(got["pf"][t, 0, 0], p)
    same = kernels.kalman(y, h, f, np.full((6, 1, 1), 0.4), r, np.zeros(1), np.eye(1))
    assert np.allclose(same["xf"], kernels.kalman(y, h, f, np.array([[0.4]]), r, np.zeros(1), np.eye(1))["xf"])


def test_mixture_and_discrete_draws():
    assert abs(bayes.MIX_P.sum() - 1) < 1e-4 and abs((bayes.MIX_P * bayes.MIX_M).sum() + 1.2704) < 1e-3  # mean of log chi-square
    rng = np.random.default_rng(4)
    p = np.array([[0.2, 0.5, 0.3]] * 20_000)
    assert np.abs(np.bincount(bayes.categorical(p, rng)) / 20_000 - p[0]).max() < 0.02
    rows = bayes.posterior_rows(np.array([[0.0, 0.0], [1.0, 3.0], [np.inf, 1.0]]), np.array([0.25, 0.75]))
    assert np.allclose(rows, [[0.25, 0.75], [0.1, 0.9], [0.25, 0.75]])
    vals, probs = bayes.scale_support(0.1)
    assert len(vals) == 100 and vals[0] == 1 and math.isclose(probs.sum(), 1) and math.isclose(probs[0], 0.9)
    scale, plain = bayes.update_scl(np.array([0.1, 6.0, np.nan] * 3000), vals, probs, rng)
    want = probs * np.exp(-0.5 * (6 / vals) ** 2) / vals
    assert math.isclose(plain[1], want[0] / want.sum()) and math.isclose(plain[2], 0.9) and abs((scale[2::3] == 1).mean() - 0.9) < 0.02 and (scale[1::3] > 1).mean() > 0.99


def test_scalar_conditionals():
    rng = np.random.default_rng(5)
    x = np.full(30, 0.5)
    draws = np.array([bayes.update_gam(x, 10, 0.2, rng) for _ in range(20_000)])
    a, b = 20, (10 * 0.2 + 7.5) / 2
    assert abs(draws.mean() - b / (a - 1)) < 0.01
    shares = np.array([bayes.update_ps(np.array([1, 1, 2, 3, 1.0]), 1, 4, rng) for _ in range(20_000)])
    assert abs(shares.mean() - 3 / 10) < 0.01


def test_random_walk_states_are_the_dense_normal():
    y, noise = np.array([1.0, np.nan, 0.5, 2.0]), np.array([0.5, 1.0, 0.2, 1.5])
    cov = 2.0 + 0.3 * np.minimum.outer(np.arange(4), np.arange(4))
    seen = ~np.isnan(y)
    gain = cov[:, seen] @ np.linalg.inv(cov[np.ix_(seen, seen)] + np.diag(noise[seen]))
    mean, post = 0.4 + gain @ (y[seen] - 0.4), cov - gain @ cov[seen]
    rng = np.random.default_rng(6)
    draws = np.array([bayes.random_walk_states(y, noise, 0.3, 0.4, 2.0, rng) for _ in range(20_000)])
    assert np.abs(draws.mean(0) - mean).max() < 0.03 and np.abs(np.cov(draws.T) - post).max() < 0.04


def test_volatility_follows_a_break_and_outliers_are_found():
    rng = np.random.default_rng(7)
    x = rng.normal(size=300) * np.where(np.arange(300) < 150, 1.0, 4.0)
    x[60] = 9.0
    got = bayes.volatility_chain(x, 300, 150, 3)
    assert 0.7 < np.median(got["sigma"][:140]) < 1.4 and 3 < np.median(got["sigma"][160:]) < 5.2
    assert got["scale"][60] > 2 and got["plain"][60] < 0.2 and np.median(got["plain"]) > 0.8 and 0 < got["share"].mean() < 0.2


def test_parameters_as_a_vector():
    params = {"a": np.arange(6.0).reshape(2, 3), "b": np.array([7.0])}
    vector, shapes = bayes.packed(params)
    assert vector.tolist() == [0, 3, 1, 4, 2, 5, 7] and all(np.array_equal(params[k], v) for k, v in bayes.unpacked(vector, shapes).items())


def test_news_adds_up_whatever_the_order_of_series():
    rng = np.random.default_rng(8)
    f = np.zeros(40)
    for t in range(1, 40):
        f[t] = 0.8 * f[t - 1] + rng.normal()
    y = f[:, None] * [1.0, 0.8, 1.2, 0.5] + rng.normal(size=(40, 4)) * 0.4
    old = y.copy()
    old[20] += 0.3
    old[-2:] = np.nan
    new = y.copy()
    new[-1, 2] = np.nan
    one, two = bayes.model(kernels.em_factor(old, 1, 10)), bayes.model(kernels.em_factor(new, 1, 10))
    rows, cells = bayes.news_rows(old, new, one, two, 39, 0)
    assert math.isclose(sum(rows.values()), float(bayes.smoothed_states(new, two)[39] @ two["h"][0]), abs_tol=1e-9)
    assert len(cells) == 7 and math.isclose(sum(c["impact"] for c in cells), rows["releases"], abs_tol=1e-8)
    order = [2, 0, 3, 1]
    turned = lambda m: dict(m, h=m["h"][order], r=m["r"][np.ix_(order, order)])
    again, turned_cells = bayes.news_rows(old[:, order], new[:, order], turned(one), turned(two), 39, 1)
    assert all(math.isclose(rows[k], again[k], abs_tol=1e-9) for k in rows)
    impact = {(c["row"], c["series"]): c["impact"] for c in cells}
    assert all(math.isclose(impact[c["row"], order[c["series"]]], c["impact"], abs_tol=1e-9) for c in turned_cells)


def test_spectral_values_and_number_of_dynamic_factors():
    rng = np.random.default_rng(9)
    white = rng.normal(size=(400, 3))
    got = kernels.spectral(white, 1, 10)
    assert np.allclose(got["values"].sum(1).mean() * 2 * np.pi, np.trace(np.cov(white.T, ddof=0)), rtol=1e-9)  # the spectrum integrates to the variance
    f = rng.normal(size=400)
    common = np.column_stack([f, np.roll(f, 1), np.roll(f, 2)] * 4) + 0.1 * rng.normal(size=(400, 12))
    assert kernels.dynamic_count(common, 3, 10) == 1 and kernels.spectral(common, 1, 10)["share"] > 0.8


def test_scaled_residuals_and_bandwidth():
    e, h = np.array([1.0, -2.0, 0.5, 1.5]), np.array([0.2, 0.5, 0.3, 1.0 - 1e-9])
    assert np.allclose(kernels.scaled_residuals(e[:3], h[:3], "ET"), e[:3] / (1 - h[:3])) and np.allclose(kernels.scaled_residuals(e, h, "EB"), e / np.sqrt(1 - h))
    rng = np.random.default_rng(10)
    white, slow = rng.normal(size=(500, 1)), np.zeros((500, 1))
    for t in range(1, 500):
        slow[t] = 0.8 * slow[t - 1] + rng.normal()
    assert kernels.automatic_bandwidth(white) < 4 < kernels.automatic_bandwidth(slow)


def test_mixed_chain_recovers_the_factor_and_the_quarters():
    rng = np.random.default_rng(11)
    t = 120
    f = np.zeros(t)
    for k in range(1, t):
        f[k] = 0.7 * f[k - 1] + rng.normal()
    monthly = f[:, None] * [1.0, 0.8, 1.1, 0.9] + 0.5 * rng.normal(size=(t, 4))
    agg = np.convolve(f, bayes.AGGREGATOR)[:t]
    quarter = np.where((np.arange(t) % 3 == 2) & (np.arange(t) >= 5), 0.9 * agg + 0.1 * rng.normal(size=t), np.nan)
    y = np.column_stack([monthly, quarter])
    truth = 0.9 * agg[-1]
    y[-1, 4] = np.nan
    y[-2:, 0] = np.nan
    got = bayes.mixed_chain(y, 1, 120, 60, 1)
    assert np.corrcoef(got["fitted"][10:, 1], f[10:])[0, 1] > 0.9 and got["last"].shape == (120, 1)
    assert abs(got["last"].mean() - truth) < 4 * max(got["last"].std(), 0.15) and got["last"].std() < 1.0
    ratio = got["loadings"].mean(0) / got["loadings"].mean(0)[0]
    assert np.abs(ratio - [1.0, 0.8, 1.1, 0.9, 0.9]).max() < 0.3
    same = bayes.mixed_chain(y, 1, 5, 3, 1)["last"]
    assert np.array_equal(same, bayes.mixed_chain(y, 1, 5, 3, 1)["last"])  # a seed fixes a chain
