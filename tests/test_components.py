"""The first model by component: exact against dense normals, EM, tracking, contributions by hand, queries against plain recomputation."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from tidemark.operators import components
from tidemark.plans import component_queries as plans

SF = "/root/testdata/sf0.001"
D = dt.date.fromisoformat


def planted(months=12, n=3, r=2, seed=0):
    rng = np.random.default_rng(seed)
    phi = np.diag([0.7, -0.3][:r])
    m = components.Model(rng.normal(0.6, 0.5, (n + 1, r)), phi, np.diag([0.5, 0.8][:r]), np.full(n + 1, 0.3))
    f = np.zeros((months + 5, r))
    for k in range(1, months + 5):
        f[k] = phi @ f[k - 1] + rng.normal(0, np.sqrt(np.diag(m.shocks)))
    y = f[5:] @ m.loadings[:-1].T + rng.normal(0, np.sqrt(0.3), (months, n))
    g = np.array([components.WEIGHTS @ f[k + 5 - np.arange(5)] @ m.loadings[-1] for k in range(months)]) + rng.normal(0, np.sqrt(0.3), months)
    g[np.arange(months) % 3 != 2] = np.nan
    return m, np.column_stack([y, g]), f[5:]


def dense(m, months):
    """Covariance of all cells (months x columns, months first), from the definition."""
    s = m.state_space()
    p, at = s["p0"], []
    for _ in range(months):
        p = s["f"] @ p @ s["f"].T + s["q"]
        at.append(p)
    c = len(s["h"])
    out = np.zeros((months * c, months * c))
    for a in range(months):
        step = np.eye(len(s["f"]))
        for b in range(a, months):
            block = s["h"] @ at[a] @ step.T @ s["h"].T + (s["r"] if a == b else 0)  # x_b = step x_a + shocks
            out[a * c : (a + 1) * c, b * c : (b + 1) * c], out[b * c : (b + 1) * c, a * c : (a + 1) * c] = block, block.T
            step = s["f"] @ step
    return out


def test_estimates_bands_and_impacts_are_those_of_the_dense_normal():
    m, y, _ = planted()
    t, c = y.shape
    y[[3, 7], [1, 0]] = np.nan
    published = np.where(np.isnan(y), np.inf, np.arange(t)[:, None] * 30.0 + np.array([35, 45, 60, 90]))
    panel = components.Panel(y, published)
    mean, scale = np.array([1.0, -2.0, 0.5, 3.0]), np.array([2.0, 1.0, 0.5, 4.0])
    raw = components.Panel(y * scale + mean, published)
    fit = components.Fitted(m, mean, scale, y, np.arange(c))
    days = [310.0, 330.0, 366.0, 380.0]
    cov = dense(m, t)
    target = (t - 1) * c + c - 1
    known = lambda day: np.flatnonzero((panel.published <= day).ravel())
    weights = lambda day, of: np.linalg.solve(cov[np.ix_(known(day), known(day))], cov[np.ix_(known(day), of)])
    previous = None
    for day, (run, cells) in zip(days, components.tracked(raw, fit, t - 1, days), strict=True):
        w = weights(day, [target])[:, 0]
        assert run["nowcast"] == pytest.approx(3 + 4 * (w @ y.ravel()[known(day)]))
        deviation = 4 * np.sqrt(cov[target, target] - w @ cov[known(day), target])
        assert run["deviation"] == pytest.approx(deviation)
        assert run["high95"] - run["nowcast"] == pytest.approx(1.959963985 * deviation) and run["nowcast"] - run["low68"] == pytest.approx(0.994457883 * deviation)
        if previous is None:
            assert cells == []
        else:
            fresh = np.setdiff1d(known(day), known(previous[0]))
            forecast = weights(previous[0], fresh).T @ y.ravel()[known(previous[0])]
            assert [x["row"] * c + x["column"] for x in cells] == list(fresh)
            for cell, k, e in zip(cells, fresh, forecast, strict=True):
                i = k % c
                assert cell["forecast"] == pytest.approx(mean[i] + scale[i] * e) and cell["actual"] == pytest.approx(mean[i] + scale[i] * y.ravel()[k])
                own = w[list(known(day)).index(k)] * 4 / scale[i]
                assert cell["weight"] == pytest.approx(own) and cell["impact"] == pytest.approx(own * (cell["actual"] - cell["forecast"]))
            assert sum(x["impact"] for x in cells) == pytest.approx(run["nowcast"] - previous[1])
        previous = (day, run["nowcast"])
    assert len(known(days[-1])) > len(known(days[0]))


def test_likelihood_never_falls_and_planted_factor_is_found():
    m, y, f = planted(180, 6, 1, seed=3)
    got = components.estimated(y, 1, 300, 1e-6)
    assert got.converged and (np.diff(got.loglik) > -1e-8).all()
    common = components.filtered(y, got)["xf"][:, :1] @ got.loadings[:-1].T
    assert np.corrcoef(common[20:].ravel(), (f @ m.loadings[:-1].T)[20:].ravel())[0, 1] > 0.9
    assert got.loadings[-1, 0] / got.loadings[:-1, 0].sum() == pytest.approx(m.loadings[-1, 0] / m.loadings[:-1, 0].sum(), abs=0.15)
    assert not components.estimated(y, 1, 2).converged  # stopped by its rounds


def test_two_factors_never_fall_with_gaps():
    _, y, _ = planted(90, 5, 2, seed=5)
    y[np.random.default_rng(1).random(y.shape) < 0.15] = np.nan
    got = components.estimated(y, 2, 60, 1e-7)
    assert (np.diff(got.loglik) > -1e-8).all()
    loadings, explained = components.identified(y, got)
    norms = (loadings**2).sum(0)
    assert norms[0] >= norms[1] and abs(loadings[:, 0] @ loadings[:, 1]) < 1e-8 and (loadings.sum(0) > 0).all() and (explained[:-1] > 0).all()


def panel_of(y, lag=20):
    return components.Panel(y, np.where(np.isnan(y), np.inf, np.arange(len(y))[:, None] * 30.0 + lag))


def test_short_constant_and_missing_columns():
    _, y, _ = planted(60, 4, 1, seed=2)
    day = 60 * 30.0
    assert components.fitted(panel_of(y), day).used.tolist() == [0, 1, 2, 3, 4]
    y[:, 1] = 5.0
    y[:, 2] = np.nan
    assert components.fitted(panel_of(y), day, 1).used.tolist() == [0, 3, 4]
    assert components.fitted(panel_of(y), 30.0 * 3 * (components.LEAST - 1), 1) is None  # one quarter too few
    y[:, 3] = np.nan
    assert components.fitted(panel_of(y), day, 1) is None  # one series left
    assert components.fitted(panel_of(np.full((60, 3), np.nan)), day) is None


def test_later_publications_change_no_earlier_run():
    _, y, _ = planted(60, 4, 1, seed=4)
    changed = y.copy()
    changed[52:] += 100  # published from day 1580 on
    days = [1545.0, 1579.0]
    a, b = (panel_of(x) for x in (y, changed))
    fits = [components.fitted(p, 1500.0, 1) for p in (a, b)]
    assert fits[0].model.loglik == fits[1].model.loglik
    got = [[r["nowcast"] for r, _ in components.tracked(p, f, 53, days)] for p, f in zip((a, b), fits, strict=True)]
    assert got[0] == got[1]


def test_weekly_runs_of_quarters():
    dates = list(pd.date_range("2001-02-01", "2001-12-01", freq="MS").date)
    got = plans.quarters_of(2001, dates)
    assert [(q, dates[row].month, len(days), days[0].month, days[-1] <= dt.date(2001, 12, 31)) for q, row, days in got] == [(8005, 6, 13, 4, True), (8006, 9, 14, 7, True), (8007, 12, 14, 10, True)]
    assert plans.quarters_of(2001, [D("2001-01-01"), *dates])[0][2][-1] == D("2001-03-26")


def test_contributions_by_hand(spark):
    tracked = spark.createDataFrame([("a", 10, D("2001-03-08"), 2.0), ("b", 10, D("2001-03-08"), -1.0), ("a", 10, D("2001-03-01"), 3.0), ("c", 10, D("2001-03-08"), 9.0), ("a", 11, D("2001-06-01"), 0.0)], "component string, quarter int, run_date date, nowcast double")
    levels = spark.createDataFrame([("a", 8, 50.0, D("2000-12-06")), ("a", 9, 60.0, D("2001-03-07")), ("b", 9, 40.0, D("2001-03-07")), ("b", 10, 999.0, D("2001-06-06"))], "component string, quarter int, value double, published date")
    got = {(r.component, r.run_date.isoformat()): (r.last_quarter, round(r.level, 6), r.share, round(r.contribution_pp, 6), None if r.contribution_pct is None else round(r.contribution_pct, 6), round(r.total, 6)) for r in plans.contributions(tracked, levels).collect()}
    assert got == {
        ("a", "2001-03-01"): (8, 51.5, 1.0, 3.0, 100.0, 3.0),  # b's level wasn't out
        ("a", "2001-03-08"): (9, 61.2, 0.6, 1.2, 150.0, 0.8),
        ("b", "2001-03-08"): (9, 39.6, 0.4, -0.4, -50.0, 0.8),
        ("a", "2001-06-01"): (9, 60.0, 1.0, 0.0, None, 0.0),
    }  # c has no level


def test_largest_and_evolution(spark):
    news = spark.createDataFrame([("a", 1, D("2001-01-08"), k, D("2000-12-01"), v) for k, v in [("x", 1.0), ("y", -1.0), ("z", 0.0), ("u", 3.0)]] + [("b", 1, D("2001-01-08"), "x", D("2000-12-01"), 0.5)], "component string, quarter int, run_date date, key string, date date, impact double")
    assert [(r.component, r.place, r.key) for r in plans.largest(news, 2).orderBy("component", "place").collect()] == [("a", 1, "u"), ("a", 2, "x"), ("b", 1, "x")]
    tracked = spark.createDataFrame([("a", 1, D(f"2001-01-{k:02d}"), v) for k, v in [(15, 2.5), (1, 1.0), (8, 2.0)]], "component string, quarter int, run_date date, nowcast double")
    assert [(r.nowcast_change, r.cumulative_change) for r in plans.evolution(tracked).orderBy("run_date").collect()] == [(None, 0.0), (1.0, 1.0), (0.5, 1.5)]
    empty = tracked.where("false")
    levels = spark.createDataFrame([], "component string, quarter int, value double, published date")
    assert plans.evolution(empty).count() == 0 and plans.contributions(empty, levels).count() == 0 and plans.contributions(tracked, levels).count() == 0


def test_queries_equal_one_plain_model(spark):
    """One component and year recomputed from its rows; changes of its runs are the sums of its releases' impacts."""
    rows = plans.component_rows(spark, SF).where("component = 'EUROPE'").cache()
    tracked = plans.evolution(plans.runs(rows)).where("year = 2000").toPandas().sort_values("run_date")
    news = plans.released(rows).where("year = 2000").toPandas()
    pdf = rows.toPandas()
    pdf = pdf[[p.year <= 2000 for p in pdf["published"]]]
    months = sorted({x for x in pd.date_range(min(pdf["date"]), "2000-12-01", freq="MS").date})
    keys = [*sorted(set(pdf["key"]) - {"target"}), "target"]
    values = pdf.pivot(index="date", columns="key", values="x").reindex(index=months, columns=keys).to_numpy()
    out = pdf.assign(n=[p.toordinal() for p in pdf["published"]]).pivot(index="date", columns="key", values="n").reindex(index=months, columns=keys).fillna(np.inf).to_numpy(float)
    panel = components.Panel(values, out)
    fit = components.fitted(panel, D("1999-12-31").toordinal())
    for q in range(4):
        days = tracked[tracked["quarter"] == 8000 + q]["run_date"].tolist()
        assert days[0] == dt.date(2000, 3 * q + 1, 1) and all((b - a).days == 7 for a, b in zip(days, days[1:], strict=False))
        plain = [r["nowcast"] for r, _ in components.tracked(panel, fit, months.index(dt.date(2000, 3 * q + 3, 1)), [x.toordinal() for x in days])]
        assert np.allclose(tracked[tracked["quarter"] == 8000 + q]["nowcast"], plain)
    impact = news.groupby("run_date")["impact"].sum()
    for r in tracked.itertuples():
        if not np.isnan(r.nowcast_change):
            assert abs(r.nowcast_change - impact.get(r.run_date, 0.0)) < 1e-8
    assert set(news["key"]) == set(keys)  # last quarter's target is a release too
    rows.unpersist()


def test_combination_of_both_models(spark):
    """The first arm is the sum of contributions, the second the whole's model; corrections take only misses printed by the run."""
    got = plans.arms(spark, SF).toPandas().set_index("as_of")
    sums = plans.contributions(plans.runs(plans.component_rows(spark, SF)), plans.component_levels(spark, SF)).toPandas().groupby("run_date")["contribution_pp"].sum()
    whole = plans.runs(plans.whole_rows(spark, SF)).toPandas().set_index("run_date")
    y = plans.printed(spark, SF).toPandas().set_index("target")
    assert set(got.index) == set(sums.index) and len(got) > 100
    finals = whole.sort_index().groupby("quarter")["nowcast"].last()
    misses = sorted((y.printed[q], finals[q] - y.growth[q]) for q in finals.index if q in y.index)
    for day, r in got.iterrows():
        assert r.v2 == pytest.approx(sums[day]) and r.v3_raw == pytest.approx(whole.nowcast[day]) and r.target == whole.quarter[day]
        known = [m for p, m in misses if p <= day][-8:]
        fix = sum(known) / len(known) if len(known) >= 4 else None
        assert (np.isnan(r.correction) if fix is None else r.correction == pytest.approx(fix)) and r.combo == pytest.approx((r.v2 + r.v3_raw - (fix or 0)) / 2)
    assert got.correction.notna().any() and got.correction.isna().any()
