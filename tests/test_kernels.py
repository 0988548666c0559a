"""Numeric kernels against closed forms and simulations."""

import math

import numpy as np
import pytest
from tidemark.operators import kernels as k


def simulated(n=200, m=6, seed=0, missing=0.0):
    rng = np.random.default_rng(seed)
    f = np.zeros(n)
    for t in range(1, n):
        f[t] = 0.8 * f[t - 1] + rng.standard_normal()
    y = np.outer(f, np.linspace(0.5, 1.5, m)) + 0.5 * rng.standard_normal((n, m))
    y[rng.random((n, m)) < missing] = np.nan
    return (y - np.nanmean(y, 0)) / np.nanstd(y, 0), f


def test_ols_and_hac():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(500), rng.standard_normal((500, 2))])
    y = x @ [1.0, 2.0, -1.0] + rng.standard_normal(500)
    beta, e, inverse = k.ols(y, x)
    assert np.allclose(beta, np.linalg.lstsq(x, y, rcond=None)[0])
    white = inverse @ (x * e[:, None] ** 2).T @ x @ inverse
    assert np.allclose(k.hac(x, e, inverse, 0), white)
    assert k.wald(beta, k.hac(x, e, inverse), np.eye(3)[1:])[1] < 1e-6
    assert len(k.recursive_residuals(y[:60], x[:60])) == 57


@pytest.mark.parametrize(("x", "df", "p"), [(6.251389, 3, 0.1), (4.605170, 2, 0.1), (3.841459, 1, 0.05), (9.487729, 4, 0.05), (11.070498, 5, 0.05)])
def test_chi2(x, df, p):
    assert math.isclose(k.chi2_tail(x, df), p, rel_tol=1e-5)


def test_unit_roots_tell_a_walk_from_noise():
    rng = np.random.default_rng(2)
    noise, walk = rng.standard_normal(400), np.cumsum(rng.standard_normal(400))
    assert k.adf(noise)[0] < -3 < k.adf(walk)[0]
    assert k.kpss(noise) < 0.463 < k.kpss(walk)
    assert k.acf(noise, 3)[0] == 1 and abs(k.pacf(walk, 2)[1]) > 0.9


def test_weights():
    assert math.isclose(k.almon(5, 0.1, -0.05).sum(), 1) and math.isclose(k.beta_weights(5, 2, 3).sum(), 1)
    assert [round(k.kernel_weight(0.5, n), 4) for n in ("truncated", "bartlett", "parzen", "tukey")] == [1.0, 0.5, 0.25, 0.5]


def test_var_companion():
    rng = np.random.default_rng(3)
    y = np.zeros((2000, 2))
    a = np.array([[0.5, 0.1], [0.0, 0.3]])
    for t in range(1, 2000):
        y[t] = a @ y[t - 1] + rng.standard_normal(2)
    beta, omega, aic, sic = k.var_ols(y, 1)
    assert np.allclose(beta[1:].T, a, atol=0.07) and np.allclose(omega, np.eye(2), atol=0.12) and aic < sic
    assert np.allclose(k.companion(beta, 1), beta[1:].T)


def test_filter_is_the_regression_when_states_do_not_move():
    rng = np.random.default_rng(4)
    y = 3 + rng.standard_normal((50, 1))
    got = k.kalman(y, np.eye(1), np.eye(1), np.zeros((1, 1)), np.eye(1), np.zeros(1), np.eye(1) * 1e8)
    assert math.isclose(got["xf"][-1, 0], y.mean(), abs_tol=1e-5)
    xs, ps, _ = k.smoothed(got, np.eye(1))
    assert np.allclose(xs, y.mean(), atol=1e-4) and np.allclose(ps[:, 0, 0], 1 / 50, atol=1e-5)


def test_em_finds_the_factor_and_never_loses_likelihood():
    y, f = simulated(missing=0.2)
    fit = k.em_factor(y)
    assert all(b >= a - 1e-3 for a, b in zip(fit["loglik"], fit["loglik"][1:], strict=False))
    assert abs(np.corrcoef(fit["smoothed"][:, 0], f)[0, 1]) > 0.95
    assert k.factor_count(simulated(300, 30)[0], 4) == 1


def test_news_adds_up():
    y, _ = simulated(80)
    old = y.copy()
    old[-2:] = np.nan
    fit = k.em_factor(old)
    impact = k.news(old, y, fit, 79, 0)
    whole = lambda z: (k.smoothed(k.kalman(z, fit["h"], fit["f"], fit["q"], np.diag(fit["noise"]), np.zeros(1), np.eye(1) * 10), fit["f"])[0] @ fit["h"].T)[79, 0]
    assert math.isclose(sum(impact.values()), whole(y) - whole(old), abs_tol=1e-9)


def test_gibbs_follows_the_factor():
    y, f = simulated(100)
    got = k.gibbs_factor(y, 40, 20, 1)
    assert abs(np.corrcoef(got["factor"], f)[0, 1]) > 0.9 and np.all(got["vol"] > 0)
    assert np.array_equal(got["draws"], k.gibbs_factor(y, 40, 20, 1)["draws"])


def test_bootstrap_tells_a_predictor_from_noise():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((80, 1))
    stat, draws = k.bootstrap_mse_f(2 * x[:, 0] + rng.standard_normal(80), x, 50, 20, 0)
    assert (draws > stat).mean() < 0.06 and k.mse_f(np.ones(4), np.ones(4)) == 0
    assert k.stable_rank(np.array([1.0, 7.0, 6.5, 7.0]), 6.25).tolist() == [1, 3, 2]


def test_bootstrap_errors_are_the_recursive_ones():
    rng = np.random.default_rng(2)
    y, x = rng.standard_normal(60), np.column_stack([np.ones(60), rng.standard_normal(60)])
    assert np.allclose(k.one_step_matrix(x, 40) @ y, k.one_step(y, x, 40))
    stat, _ = k.bootstrap_mse_f(y, x[:, 1:], 40, 1, 0)
    assert math.isclose(stat, k.mse_f(k.one_step(y, x[:, :1], 40), k.one_step(y, x, 40)), rel_tol=1e-9)


def test_gibbs_thins_after_the_burn_in():
    y, _ = simulated(40, 2)
    every, third = k.gibbs_factor(y, 12, 5, 1), k.gibbs_factor(y, 4, 5, 1, thin=3)
    assert np.array_equal(every["draws"][2::3], third["draws"])
