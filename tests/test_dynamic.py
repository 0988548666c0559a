"""Dynamic factor model with fewer shocks than factors, contributions, and bootstrap of paths."""

import numpy as np
import pytest
from tidemark.operators import dynamic
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


def planted(q=1, t=200, n=8, seed=0):
    rng = np.random.default_rng(seed)
    f = np.zeros((t, q))
    for k in range(2, t):
        f[k] = 0.6 * f[k - 1] - 0.2 * f[k - 2] + rng.normal(size=q)
    load = rng.normal(size=(n, 2 * q)) + np.repeat([1.0, 0.0], q)
    y = f @ load[:, :q].T + np.vstack([np.zeros((1, q)), f[:-1]]) @ load[:, q:].T + 0.4 * rng.normal(size=(t, n))
    y[rng.random(y.shape) < 0.05] = np.nan
    return y, f, load


@pytest.mark.parametrize("q", [1, 2])
def test_likelihood_never_falls_and_factors_are_found(q):
    y, f, _ = planted(q)
    m = dynamic.estimated(y, q, 1, 2)
    assert len(m.loglik) > 3 and all(b >= a for a, b in zip(m.loglik, m.loglik[1:], strict=False)) and m.loglik[-1] > m.loglik[0] + 10
    got = dynamic.filtered(y, m)["xf"][:, :q]
    fit = got @ np.linalg.lstsq(got, f, rcond=None)[0]
    assert all(np.corrcoef(fit[5:, k], f[5:, k])[0, 1] > 0.95 for k in range(q))


@pytest.mark.parametrize("q", [1, 2])
def test_identification_is_a_rotation(q):
    y, *_ = planted(q, seed=2)
    m = dynamic.estimated(y, q, 1, 2, rounds=15)
    r = dynamic.identified(m)
    assert np.allclose(r.shocks, np.eye(q)) and np.allclose(np.triu(r.loadings[:q, :q], 1), 0, atol=1e-9) and (np.diag(r.loadings[:q, :q]) > 0).all()
    y[:3] = np.nan  # the prior of the first states isn't rotated: compare what later months say
    a, b = (dynamic.filtered(y, x)["xf"] @ x.state_space()["h"].T for x in (m, r))
    assert np.allclose(a[60:], b[60:], atol=1e-4)


def test_contributions_add_up():
    y, *_ = planted(2, seed=3)
    news, parts, updates = dynamic.contributions(y, dynamic.identified(dynamic.estimated(y, 2, 1, 2, rounds=10)))
    assert np.allclose(parts.sum(1), updates, atol=1e-9) and (parts[np.isnan(news)] == 0).all()


def test_query_adds_up(spark):
    total = {}
    for r in registry.queries()["dynamic_shocks"](spark, SF).collect():
        a = total.setdefault((r.category, r.date), [0.0, r.update])
        a[0] += r.contribution
    assert total and all(abs(a - b) < 1e-8 for a, b in total.values())


def loop_mse_f(y, m, lags, horizon, tests):
    rows = [(t, [1.0, y[t], *(m[t - k] for k in range(lags))]) for t in range(lags - 1, len(y) - horizon)]
    errors = []
    for t, z in rows[-tests:]:
        both = []
        for width in (2, 2 + lags):
            x = np.array([r[:width] for s, r in rows if s + horizon <= t])
            c = np.linalg.lstsq(x, np.array([y[s + horizon] for s, _ in rows if s + horizon <= t]), rcond=None)[0]
            both.append(y[t + horizon] - np.array(z[:width]) @ c)
        errors.append(both)
    a, b = (np.array(errors) ** 2).mean(0)
    return tests * (a - b) / b


@pytest.mark.parametrize(("lags", "horizon"), [(1, 1), (2, 3)])
def test_statistic_against_loops(lags, horizon):
    rng = np.random.default_rng(4)
    y, m = rng.normal(size=(3, 70)).cumsum(1) * 0.3, rng.normal(size=(3, 70))
    got = dynamic.mse_f(y, m, lags, horizon, 15)
    assert np.allclose(got, [loop_mse_f(a, b, lags, horizon, 15) for a, b in zip(y, m, strict=True)], rtol=1e-4)


@pytest.mark.parametrize("draw", ["residual", "normal"])
def test_size_is_near_nominal_and_power_there(draw):
    rng = np.random.default_rng(5)

    def chance(slope):
        y, m = np.zeros(90), np.zeros(90)
        for k in range(1, 90):
            m[k] = 0.5 * m[k - 1] + rng.normal()
            y[k] = 0.4 * y[k - 1] + slope * m[k - 1] + rng.normal()
        paths = dynamic.null_paths(y, m, 200, draw, rng)
        return (dynamic.mse_f(*paths, 1, 1, 25) > dynamic.mse_f(y[None], m[None], 1, 1, 25)[0]).mean()

    null, real = [chance(0.0) for _ in range(150)], [chance(0.8) for _ in range(20)]
    assert 0.03 < np.mean(np.array(null) < 0.1) < 0.2 and np.mean(np.array(real) < 0.1) > 0.8


def test_query_of_paths(spark):
    rows = registry.queries()["bootstrap_paths"](spark, SF).collect()
    assert rows and all(0 <= r.p <= 1 for r in rows) and len({(r.model, r.horizon, r.draw) for r in rows}) == 8
    assert len(rows) == 8 * len({r.key for r in rows})
