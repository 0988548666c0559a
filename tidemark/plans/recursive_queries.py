"""Recursive backtest on publication intervals: selection, factor and regression at every as-of date; and lag regressions with curved weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import intervals, kernels, lag_fit
from tidemark.plans.backtest_queries import HISTORY, PRINT_LAG, mean_growth
from tidemark.plans.registry import query
from tidemark.sources import tables as t

S = SparkSession

#: Days after a month's end of its last value, behind the first print.
REVISED = 120
#: Squared t statistics from which a series is taken: chi-square of one degree at 10, 5 and 1 per cent.
GATES = {"ten": 2.705543454095404, "five": 3.841458820694124, "one": 6.6348966010212145}
LAGS = 9


def prints(spark: S, d: str) -> DataFrame:
    """key, date, value, published: the first print after the series' lag, the last value after REVISED days."""
    r = t.revisions(spark, d).join(t.registry(spark, d).select("key", "lag_days"), "key")
    end = F.last_day("date")
    both = F.array(F.struct(F.date_add(end, F.col("lag_days")).alias("published"), F.col("first").alias("value")), F.struct(F.date_add(end, REVISED).alias("published"), F.col("latest").alias("value")))
    return r.select("key", "date", F.inline(both)).where("value is not null")


def quarter_prints(spark: S, d: str) -> DataFrame:
    """key, q, x, published, growth: a quarter's log mean value, anew with each print of its months, beside the target's growth; from the target's print on."""
    y = t.growth(spark, d).where("growth is not null").select(F.col("q_index").alias("q"), "growth", F.date_add("date", PRINT_LAG).alias("printed"))
    met = quarter_values(spark, d).join(F.broadcast(y), "q")  # one row a quarter
    met = met.select("key", "q", "x", "growth", F.greatest("published", "printed").alias("published"), F.col("published").alias("own"))
    # several prints before the target's: the last of them
    return met.groupBy("key", "q", "published").agg(F.max_by("x", "own").alias("x"), F.first("growth").alias("growth"))


def as_of_days(spark: S, d: str) -> DataFrame:
    """as_of: month ends of the panel after its first HISTORY months; one row each."""
    m = t.monthly(spark, d).agg(F.add_months(F.min("date"), HISTORY).alias("a"), F.max("date").alias("b"))
    return m.select(F.explode(F.sequence("a", F.greatest("a", "b"), F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("as_of"))


def gate(spark: S, d: str) -> DataFrame:
    """as_of, key, n, slope, intercept, wald: the regression of growth on each series as it was known at each date, from running sums."""
    cells = intervals.intervals(quarter_prints(spark, d), ["key", "q"])
    moves = intervals.changes(cells, ["key", "x", "growth"])
    x, y = F.col("x"), F.col("growth")
    sums = intervals.running(moves, ["key"], {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}, as_of_days(spark, d))
    return sums.select("as_of", "key", F.round("n").cast("bigint").alias("n"), *(c.alias(k) for k, c in intervals.simple_regression().items()))


@query(f"""with p as (select key, date, cast(last_day(date) + lag_days as date) as published, first as value from revisions join registry using (key) where first is not null union all select key, date, cast(last_day(date) + {REVISED} as date), latest from revisions),
    asofs as (select distinct cast(last_day(date) as date) as as_of from months where date >= (select min(date) + interval {HISTORY} month from months)),
    known as (select as_of, key, date, arg_max(value, published) as value from p, asofs where published <= as_of group by 1, 2, 3),
    q as (select as_of, key, cast(year(date) * 4 + quarter(date) - 1 as integer) as q, ln(avg(value)) as x from known group by 1, 2, 3 having count(*) = 3),
    xy as (select as_of, key, x, growth as y from q join growth g on g.q_index = q.q and g.growth is not null and g.date + {PRINT_LAG} <= as_of),
    r as (select as_of, key, count(*) as n, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, regr_sxx(y, x) as sxx, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) as rest from xy group by 1, 2)
    select as_of, key, n, slope, intercept, slope * slope * sxx / (rest / (n - 2)) as wald from r where n >= 8""", levels=("intercept",), ratios=("slope", "wald"))
def recursive_gate(spark: S, d: str) -> DataFrame:
    """Each series' regression at every as-of date on the vintage of that date, 8 quarters at least: running sums of what came and went, no panel a date."""
    return gate(spark, d).where("n >= 8")


def nowcasts(moves: pd.DataFrame, growth: pd.DataFrame, chosen: dict, days: list) -> list[dict]:
    """as_of, series, quarters, forecast: at each date a factor of the chosen series' quarterly logs as they then were, and growth regressed on it."""
    quarters, keys = sorted(moves["row"].unique()), sorted(moves["column"].unique())
    y = growth.set_index("q").reindex(quarters)
    printed, target = pd.to_datetime(y["printed"]).to_numpy(), y["growth"].to_numpy(dtype=float)
    place = {k: j for j, k in enumerate(keys)}

    def answer(as_of: object, x: np.ndarray) -> dict | None:
        own = [place[k] for k in chosen.get(as_of, ()) if k in place]
        seen = ~np.isnan(x[:, own]).any(1) if own else np.zeros(len(x), bool)
        learnt = seen & ~np.isnan(target) & (printed <= np.datetime64(as_of))
        if learnt.sum() < 8:
            return None
        rows = np.flatnonzero(seen)
        z = x[np.ix_(rows, own)]
        z = (z - z.mean(0)) / np.where(z.std(0) > 0, z.std(0), 1)
        f = kernels.principal(z, 1)[0][:, 0] if len(own) > 1 else z[:, 0]
        f = f if f @ z.mean(1) >= 0 else -f
        fit = np.flatnonzero(learnt[rows])
        b = np.polyfit(f[fit], target[rows[fit]], 1)
        return {"as_of": as_of, "series": len(own), "quarters": len(fit), "target": int(quarters[rows[-1]]), "forecast": float(b[0] * f[-1] + b[1])}

    return list(intervals.walked(moves, days, answer, quarters, keys))


@query()
def recursive_nowcast(spark: S, d: str) -> DataFrame:
    """By gate, at every as-of date: series selected on that date's vintage, their first factor, growth regressed on it, and the newest quarter's value.

    The gates are grouping keys; each reads every change of the panel once.
    """
    q = quarter_values(spark, d)
    moves = intervals.changes(intervals.intervals(q, ["key", "q"]), ["key", "q", "x"]).select("day", F.col("q").alias("row"), F.col("key").alias("column"), F.col("x").alias("value"), "sign")
    passed = gate(spark, d).where("n >= 8 and wald is not null").select("as_of", "key", "wald")
    names = F.array(*(F.struct(F.lit(g).alias("gate"), F.lit(v).alias("least")) for g, v in GATES.items()))
    chosen = passed.select("as_of", "key", "wald", F.inline(names)).where("wald >= least").groupBy("gate", "as_of").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # the panel's series at most
    y = t.growth(spark, d).where("growth is not null").select(F.col("q_index").alias("q"), "growth", F.date_add("date", PRINT_LAG).alias("printed")).toPandas()  # one row a quarter
    days = [r.as_of for r in as_of_days(spark, d).collect()]  # one row a month

    def run(own: pd.DataFrame, picks: pd.DataFrame) -> pd.DataFrame:
        out = [] if own.empty or picks.empty else nowcasts(own, y, {r.as_of: list(r.keys_) for r in picks.rename(columns={"keys": "keys_"}).itertuples()}, days)
        return pd.DataFrame([{"gate": own["gate"].iloc[0], **r} for r in out], columns=["gate", "as_of", "series", "quarters", "target", "forecast"])

    each = moves.withColumn("gate", F.explode(F.array(*map(F.lit, GATES))))
    return each.groupBy("gate").cogroup(chosen.groupBy("gate")).applyInPandas(run, "gate string, as_of date, series int, quarters int, target int, forecast double")


def quarter_values(spark: S, d: str) -> DataFrame:
    """key, q, x, published: a quarter's log mean value after each day on which one of its months changed, once it has three."""
    moves = intervals.changes(intervals.intervals(prints(spark, d), ["key", "date"]), ["key", "date", "value"])
    byday = moves.select("key", (F.year("date") * 4 + F.quarter("date") - 1).alias("q"), "day", "sign", "value").groupBy("key", "q", "day").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("value")).alias("v"))
    w = Window.partitionBy("key", "q").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    every = byday.select("key", "q", F.col("day").alias("published"), F.sum("n").over(w).alias("n"), F.sum("v").over(w).alias("v"))
    return every.where("n = 3 and v > 0").select("key", "q", F.log(F.col("v") / 3).alias("x"), "published")


def lag_rows(spark: S, d: str, lags: int = LAGS) -> DataFrame:
    """q_index, growth, x: the target's growth and the panel mean's growth in the quarter's last months, newest first."""
    m = mean_growth(spark, d)
    w = Window.orderBy("date").rowsBetween(-(lags - 1), 0)  # one row a month
    stacked = m.withColumn("x", F.reverse(F.collect_list("m").over(w))).where(F.size("x") == lags).select("date", "x")
    return t.growth(spark, d).where("growth is not null").join(stacked, "date").select("q_index", "growth", "x")


@query()
def restricted_lags(spark: S, d: str) -> DataFrame:
    """Growth on nine monthly lags with weights on an exponential Almon or beta curve, by damped Gauss-Newton; starts are grouping keys, the best is kept."""
    rows = lag_rows(spark, d)
    starts = [(kind, k, *s) for kind in ("almon", "beta") for k, s in enumerate(lag_fit.starts(kind, LAGS))]
    grid = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("start"), F.lit(a).alias("t1"), F.lit(b).alias("t2")) for kind, k, a, b in starts))
    each = rows.select("*", F.inline(grid)).repartition(len(starts), "kind", "start")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("q_index")
        one = pdf.iloc[0]
        fit = lag_fit.fitted(pdf["growth"].to_numpy(), np.array(pdf["x"].tolist()), one["kind"], (one["t1"], one["t2"]))
        return pd.DataFrame({"kind": [one["kind"]], "start": [one["start"]], "a": [fit.a], "b": [fit.b], "theta1": [fit.theta[0]], "theta2": [fit.theta[1]], "weights": [fit.weights.tolist()], "sse": [fit.sse], "steps": [fit.steps]})

    fits = each.groupBy("kind", "start").applyInPandas(run, "kind string, start int, a double, b double, theta1 double, theta2 double, weights array<double>, sse double, steps int")
    best = fits.groupBy("kind").agg(F.min_by(F.struct("start", "a", "b", "theta1", "theta2", "weights", "sse", "steps"), F.struct("sse", "start")).alias("f"), F.max("sse").alias("worst"))
    return best.select("kind", "f.*", "worst")

