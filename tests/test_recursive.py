"""Interval vintages, recursive selection and nowcasts, lag regressions with curved weights."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.operators import intervals, lag_fit
from tidemark.plans import recursive_queries as rq
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


def test_running_sums_are_those_of_each_day(spark):
    day = lambda k: dt.date(2000, 1, 1) + dt.timedelta(days=k)
    rng = np.random.default_rng(0)
    prints = [(f"s{s}", c, float(rng.integers(1, 9)), day(int(c * 3 + r * 5 + rng.integers(0, 3)))) for s in range(3) for c in range(12) for r in range(1 + (c + s) % 3)]
    prints = list({(s, c, d): (s, c, v, d) for s, c, v, d in prints}.values())
    df = spark.createDataFrame(prints, "key string, cell int, v double, published date")
    moves = intervals.changes(intervals.intervals(df, ["key", "cell"]), ["key", "v"])
    assert moves.count() <= 2 * len(prints)
    days = spark.createDataFrame([(day(k),) for k in (-1, 0, 7, 20, 60)], "as_of date")
    got = {(r.key, r.as_of): (r.n, r.v) for r in intervals.running(moves, ["key"], {"n": F.lit(1.0), "v": F.col("v")}, days).collect()}
    for s in range(3):
        for k in (-1, 0, 7, 20, 60):
            known = {}
            for key, c, v, d in sorted(prints, key=lambda r: r[3]):
                if key == f"s{s}" and d <= day(k):
                    known[c] = v
            assert got[f"s{s}", day(k)] == (len(known), sum(known.values()))


def test_walk_shows_the_panel_of_each_day():
    import pandas as pd

    moves = pd.DataFrame([(1, "a", "x", 1.0, 1), (3, "a", "x", 1.0, -1), (3, "a", "x", 2.0, 1), (2, "b", "x", 5.0, 1)], columns=["day", "row", "column", "value", "sign"])
    seen = list(intervals.walked(moves, [0, 1, 2, 3], lambda d, x: {"d": d, "x": x.copy()}, ["a", "b"], ["x"]))
    assert [[None if np.isnan(v) else v for v in s["x"][:, 0]] for s in seen] == [[None, None], [1.0, None], [1.0, 5.0], [2.0, 5.0]]


def test_recursive_nowcast_at_some_dates(spark):
    got = {(r.gate, r.as_of): r for r in registry.queries()["recursive_nowcast"](spark, SF).collect()}
    prints = [tuple(r) for r in rq.prints(spark, SF).select("key", "date", "value", "published").collect()]
    gate = [tuple(r) for r in rq.gate(spark, SF).select("as_of", "key", "n", "wald").collect()]
    y = {r.q_index: (r.growth, r.date + dt.timedelta(days=60)) for r in rq.t.growth(spark, SF).where("growth is not null").collect()}
    assert got
    for name, as_of in sorted(got, key=str)[:: max(1, len(got) // 6)]:
        known = {}
        for key, date, v, published in sorted(prints, key=lambda r: r[3]):
            if published <= as_of:
                known[key, date.year * 4 + (date.month - 1) // 3, date.month] = v
        quarters = {}
        for (key, q, _), v in known.items():
            quarters.setdefault((key, q), []).append(v)
        x = {k: math.log(sum(v) / 3) for k, v in quarters.items() if len(v) == 3}
        keys = sorted(k for d, k, n, w in gate if d == as_of and n >= 8 and w is not None and w >= rq.GATES[name])
        rows = [q for q in sorted({q for _, q in x}) if all((k, q) in x for k in keys)]
        z = np.array([[x[k, q] for k in keys] for q in rows])
        z = (z - z.mean(0)) / z.std(0)
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        f = u[:, 0] * s[0]
        learnt = [i for i, q in enumerate(rows) if q in y and y[q][1] <= as_of]
        c = np.polyfit(f[learnt], [y[rows[i]][0] for i in learnt], 1)
        r = got[name, as_of]
        assert (r.series, r.quarters, r.target) == (len(keys), len(learnt), rows[-1])
        assert r.forecast == pytest.approx(c[0] * f[-1] + c[1], rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("kind", ["almon", "beta"])
def test_gradient_of_weights(kind):
    phi, theta, h = lag_fit.features(kind, 9), np.array([0.4, -0.07]), 1e-6
    g = lag_fit.gradient(theta, phi)
    for j in range(2):
        step = np.eye(2)[j] * h
        assert np.allclose(g[:, j], (lag_fit.weights(theta + step, phi) - lag_fit.weights(theta - step, phi)) / (2 * h), atol=1e-7)


@pytest.mark.parametrize(("kind", "theta"), [("almon", (0.6, -0.1)), ("almon", (-0.4, 0.0)), ("beta", (1.0, 3.0)), ("beta", (0.5, 0.0))])
def test_planted_weights_are_found(kind, theta):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(160, 9))
    w = lag_fit.weights(np.array(theta), lag_fit.features(kind, 9))
    y = 0.5 + 2.0 * (x @ w) + 0.05 * rng.normal(size=160)
    fits = [lag_fit.fitted(y, x, kind, s) for s in lag_fit.starts(kind, 9)]
    best = lag_fit.best(fits)
    assert np.allclose(best.weights, w, atol=0.02) and abs(best.a - 0.5) < 0.02 and abs(best.b - 2) < 0.05 and best.sse <= min(f.sse for f in fits)


def test_fit_is_no_worse_than_a_grid(spark):
    rows = rq.lag_rows(spark, SF).orderBy("q_index").collect()
    y, x = np.array([r.growth for r in rows]), np.array([r.x for r in rows])
    got = {r.kind: r for r in registry.queries()["restricted_lags"](spark, SF).collect()}
    for kind, r in got.items():
        phi, least = lag_fit.features(kind, x.shape[1]), np.inf
        for a in np.linspace(-1, 4, 26):
            for b in np.linspace(-0.5, 4, 46) if kind == "beta" else np.linspace(-0.5, 0.1, 31):
                z = np.column_stack([np.ones(len(y)), x @ lag_fit.weights(np.array([a, b]), phi)])
                least = min(least, ((y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2).sum())
        z = np.column_stack([np.ones(len(y)), x @ np.array(r.weights)])
        assert math.isclose(((y - z @ [r.a, r.b]) ** 2).sum(), r.sse, rel_tol=1e-8) and sum(r.weights) == pytest.approx(1)
        assert r.sse <= least * 1.002 and r.sse <= r.worst
