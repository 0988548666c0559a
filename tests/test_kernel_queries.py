"""Kernel queries against plain recomputation of the collected rows, by other means than the kernels' own."""

import math

import numpy as np
import pytest
from tidemark.plans import kernel_queries as kq
from tidemark.plans import registry
from tidemark.sources import tables as t

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    pdf = kq.growth_rows(spark, SF).toPandas().sort_values(["key", "date"])
    return {k: g for k, g in pdf.groupby("key")}


def collected(spark, name):
    return registry.queries()[name](spark, SF).collect()


def regression(y, x):
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return beta, y - x @ beta, np.linalg.inv(x.T @ x)


def test_wald_gate(spark, rows):
    for r in collected(spark, "hac_wald_gate"):
        g = rows[r.key]
        y, m = g["x"].to_numpy(), g["m"].to_numpy()
        x = np.array([[1, m[k], m[k - 1], m[k - 2]] for k in range(2, len(y))])
        beta, e, inverse = regression(y[2:], x)
        n = len(e)
        lags = math.floor(4 * (n / 100) ** (2 / 9))
        s = sum((1 - abs(i - j) / (lags + 1)) * e[i] * e[j] * np.outer(x[i], x[j]) for i in range(n) for j in range(max(0, i - lags), min(n, i + lags + 1)))
        cov = inverse @ s @ inverse
        stat = beta[1:] @ np.linalg.inv(cov[1:, 1:]) @ beta[1:]
        p = math.erfc(math.sqrt(stat / 2)) + math.sqrt(2 * stat / math.pi) * math.exp(-stat / 2)  # three degrees
        assert math.isclose(r.slope, beta[1], rel_tol=1e-6) and math.isclose(r.wald, stat, rel_tol=1e-6) and math.isclose(r.p, p, abs_tol=1e-8) and r.keep == (p < 0.1)


def test_unit_roots(spark, rows):
    for r in collected(spark, "unit_roots"):
        y = rows[r.key]["x"].to_numpy()
        dy, best = y[1:] - y[:-1], []
        for p in range(5):
            x = np.array([[1, y[k], *(dy[k - j] for j in range(1, p + 1))] for k in range(4, len(dy))])
            beta, e, inverse = regression(dy[4:], x)
            best.append((len(e) * math.log(e @ e / len(e)) + 2 * x.shape[1], beta[1] / math.sqrt(e @ e / (len(e) - x.shape[1]) * inverse[1, 1]), p))
        _, tau, lags = min(best)
        assert math.isclose(r.adf, tau, rel_tol=1e-6) and r.lags == lags
        u = y - y.mean()
        n, q = len(u), math.floor(4 * (len(u) / 100) ** (2 / 9))
        long = sum(u[i] * u[j] * (1 - abs(i - j) / (q + 1)) for i in range(n) for j in range(n) if abs(i - j) <= q) / n
        assert math.isclose(r.kpss, sum(u[: k + 1].sum() ** 2 for k in range(n)) / n**2 / long, rel_tol=1e-8)
        acf = [sum(u[k:] * u[: n - k]) / sum(u * u) for k in range(3)]
        assert math.isclose(r.acf1, acf[1], rel_tol=1e-8) and math.isclose(r.pacf2, (acf[2] - acf[1] ** 2) / (1 - acf[1] ** 2), rel_tol=1e-8)


def test_umidas(spark, rows):
    means = next(iter(rows.values())).set_index("date")["m"]
    every = {}
    for g in rows.values():
        every |= dict(zip(g["date"], g["m"], strict=True))
    quarter = {r.q_index: r.growth for r in t.growth(spark, SF).collect() if r.growth is not None}
    lags = {}
    for day, m in every.items():
        lags.setdefault(day.year * 4 + (day.month - 1) // 3, {})[2 - (day.month - 1) % 3] = m
    got = {(r.stage, r.q_index): r for r in collected(spark, "umidas")}
    assert len(means) and got
    for stage, use in ((1, [2]), (2, [2, 1]), (3, [2, 1, 0])):
        data = sorted((q, g, [lags[q][k] for k in use]) for q, g in quarter.items() if len(lags.get(q, {})) == 3)
        for n in range(12, len(data)):
            x = np.array([[1, np.mean(v)] if stage == 3 else [1, *v] for _, _, v in data])
            y = np.array([g for _, g, _ in data])
            beta = np.linalg.lstsq(x[:n], y[:n], rcond=None)[0]
            r = got.pop((stage, data[n][0]))
            assert math.isclose(r.forecast, x[n] @ beta, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(r.naive, y[:n].mean()) and math.isclose(r.actual, y[n])
    assert not got


def test_mse_f_statistic(spark, rows):
    for r in collected(spark, "bootstrap_gain"):
        y, m = rows[r.key]["x"].to_numpy(), rows[r.key]["m"].to_numpy()
        small, full = [], []
        for k in range(len(y) - 20, len(y)):
            small.append(y[k] - y[:k].mean())
            slope, cut = np.polyfit(m[:k], y[:k], 1)
            full.append(y[k] - cut - slope * m[k])
        one, two = np.mean(np.square(small)), np.mean(np.square(full))
        assert math.isclose(r.stat, 20 * (one - two) / two, rel_tol=1e-6, abs_tol=1e-9) and 0 <= r.p <= 1


def by_category(spark):
    pdf = kq.monthly_panel(spark, SF).toPandas()
    out = {}
    for name, g in pdf.groupby("category"):
        w = g.pivot(index="date", columns="key", values="x").sort_index()
        out[name] = (w.to_numpy(), list(w.columns))
    return out


def test_principal_factors(spark):
    panels = by_category(spark)
    for r in collected(spark, "pca_factors"):
        y, keys = panels[r.category]
        z = np.nan_to_num((y - np.nanmean(y, 0)) / np.nanstd(y, 0, ddof=1))
        _, s, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
        v = vt[r.factor] * (-1 if vt[r.factor].sum() < 0 else 1)
        assert math.isclose(abs(r.loading), abs(v[keys.index(r.key)]), rel_tol=1e-5, abs_tol=1e-7) and math.isclose(r.share, s[r.factor] ** 2 / (s**2).sum(), rel_tol=1e-6)


def test_filtered_factors_do_not_look_ahead(spark):
    """With the fit's parameters, filtered states up to a month are the same without the months after it; smoothed ones agree at the end."""
    from tidemark.operators import kernels

    for name, (y, _) in by_category(spark).items():
        z = (y - np.nanmean(y, 0)) / np.nanstd(y, 0, ddof=1)
        fit = kernels.em_factor(z, 1, 20)
        got = sorted((r.date, r.filtered, r.smoothed) for r in collected(spark, "real_time_factor") if r.category == name)
        short = kernels.kalman(z[:30], fit["h"], fit["f"], fit["q"], np.diag(fit["noise"]), np.zeros(1), 10 * np.eye(1))["xf"][:, 0]
        assert np.allclose([g[1] for g in got], fit["filtered"][:, 0], atol=1e-6) and math.isclose(got[-1][1], got[-1][2], abs_tol=1e-9)
        assert np.corrcoef(short, [g[1] for g in got[:30]])[0, 1] > 0.99
        assert all(b >= a - 1e-6 * abs(a) for a, b in zip(fit["loglik"], fit["loglik"][1:], strict=False))  # EM never falls
        break


def test_news_decomposition_adds_up(spark):
    got = collected(spark, "news_decomposition")
    for name in {r.category for r in got}:
        own = [r for r in got if r.category == name]
        assert {r.part for r in own} == {"old", "parameters", "revisions", "releases", "cell"}
        assert math.isclose(sum(r.value for r in own if r.part == "cell"), next(r.value for r in own if r.part == "releases"), abs_tol=1e-8)
        assert all(1 <= r.months_ago <= 3 for r in own if r.part == "cell")


def test_volatility_states(spark, rows):
    got = collected(spark, "volatility_states")
    assert len(got) == sum(map(len, rows.values())) and all(r.sigma > 0 and 1 <= r.scale <= 5 and 0 <= r.plain <= 1 for r in got)
    for k, g in rows.items():
        assert 0.3 < np.sqrt(np.mean([r.sigma**2 for r in got if r.key == k])) / g["x"].std() < 2


def scalings(e, h):
    """Each scaling from its statement, a row at a time."""
    n, mean = len(h), sum(h) / len(h)
    rel = [v / mean for v in h]
    d = {"EH": [0.0] * n, "EB": [1.0] * n, "ET": [2.0] * n, "ED": [min(4.0, r) for r in rel], "EM": [min(1.0, r) + min(1.5, r) for r in rel], "ES": [min(r, max(4.0, 0.7 * max(rel))) for r in rel]}
    return {k: np.array([x / (1 - v) ** (p / 2) for x, v, p in zip(e, h, ps, strict=True)]) for k, ps in d.items()}


def refitted(y, x):
    """Standardised one-step errors by a new regression for every row."""
    out = []
    for t in range(x.shape[1], len(y)):
        beta, _, inverse = regression(y[:t], x[:t])
        out.append((y[t] - x[t] @ beta) / math.sqrt(1 + x[t] @ inverse @ x[t]))
    return np.array(out)


def test_robust_errors(spark, rows):
    got = {(r.key, r.kernel, r.scaling): r for r in collected(spark, "robust_errors")}
    weights = {"truncated": lambda z: float(z <= 1), "bartlett": lambda z: 1 - z, "parzen": lambda z: 1 - 6 * z**2 + 6 * z**3 if z <= 0.5 else 2 * (1 - z) ** 3, "tukey": lambda z: (1 + math.cos(math.pi * z)) / 2}
    assert len(got) == 35 * len(rows)
    for key, g in rows.items():
        y, x = g["x"].to_numpy(), np.column_stack([np.ones(len(g)), g["m"]])
        beta, e, inverse = regression(y, x)
        h = np.diag(x @ inverse @ x.T)
        steps = refitted(y, x)
        first = math.floor(0.1 * len(steps))
        scores = {k: x * u[:, None] for k, u in scalings(e, h).items()} | {"FE": x[2 + first :] * steps[first:, None]}
        for kernel, weight in weights.items():
            for scaling, u in scores.items():
                one = got[key, kernel, scaling]
                lags = min(len(u) - 2, int(one.bandwidth))
                s = sum(weight(abs(i - j) / (lags + 1)) * np.outer(u[i], u[j]) for i in range(len(u)) for j in range(max(0, i - lags), min(len(u), i + lags + 1)))
                var = (inverse @ s @ inverse)[1, 1]
                assert math.isclose(one.slope, beta[1], rel_tol=1e-6) and math.isclose(one.error, math.sqrt(max(var, 0)), rel_tol=1e-6, abs_tol=1e-9)


def test_recursive_errors(spark, rows):
    got = {}
    for r in sorted(collected(spark, "recursive_errors"), key=lambda r: (r.key, r.date)):
        got.setdefault(r.key, []).append((r.error, r.path))
    for key, g in rows.items():
        want = refitted(g["x"].to_numpy(), np.column_stack([np.ones(len(g)), g["m"]]))
        assert np.allclose([e for e, _ in got[key]], want, rtol=1e-6, atol=1e-9) and np.allclose([p for _, p in got[key]], np.cumsum(want) / want.std(ddof=1), atol=1e-6)


def test_activity_index_moves_with_mean_growth(spark, rows):
    longest = max(rows.values(), key=len)
    means = dict(zip(longest["date"], longest["m"], strict=True))
    got = {r.date: r.activity for r in collected(spark, "activity_index")}
    both = sorted(set(got) & set(means))
    assert len(both) > 40 and np.corrcoef([got[d] for d in both], [means[d] for d in both])[0, 1] > 0.3
