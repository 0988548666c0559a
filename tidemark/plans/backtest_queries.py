"""Backtests and the combined estimate: as-of dates and variants are grouping keys, never loops.

At each as-of date only months published by then (their date and 45 days) and quarters printed by then (their date and
60 days) count. The current quarter's regressor is what is known of it; a quarter of which nothing is known takes the
mean of the months known last. Forecasts are simple regressions, so they are aggregates; nothing here runs in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import bands, calendar
from tidemark.operators import joins, panel
from tidemark.plans.registry import query
from tidemark.sources import tables as t

S = SparkSession
MONTH_LAG, PRINT_LAG, LEAST = 45, 60, 6
#: Months of the panel before the first as-of date: with fewer nothing can be learnt.
HISTORY = 24

GRID = f"""mm as (select date, avg(x) as m from (select key, date, 100 * ln(value / lag(value) over (partition by key order by date)) as x from dense) where x is not null group by 1),
    asofs as (select cast(last_day(date) as date) as as_of from months where date >= (select min(date) + interval {HISTORY} month from months)),
    known as (select as_of, cast(year(date) * 4 + quarter(date) - 1 as integer) as q, count(*) as stage, avg(m) as qa, arg_max(m, date) as last from mm, asofs where date + {MONTH_LAG} <= as_of group by 1, 2),
    long as (select as_of, q, stage, unnest(['qa', 'last']) as variant, unnest([qa, last]) as x from known),
    y as (select q_index as q, date, growth from growth where growth is not null),
    fits as (select l.as_of, l.variant, regr_slope(growth, x) as b, regr_intercept(growth, x) as a, count(*) as n from long l join y on y.q = l.q and y.date + {PRINT_LAG} <= l.as_of group by 1, 2 having count(*) >= {LEAST}),
    target as (select as_of, cast(year(as_of) * 4 + quarter(as_of) - 1 as integer) as q from asofs),
    now as (select as_of, variant, arg_max(x, q) as x, max(q) as xq from long group by 1, 2),
    runs as (select f.as_of, f.variant, g.q as target, case when xq = g.q then stage else 0 end as stage, a + b * now.x as forecast, n from fits f join target g using (as_of) join now on now.as_of = f.as_of and now.variant = f.variant left join known k on k.as_of = f.as_of and k.q = g.q)"""


def mean_growth(spark: S, d: str) -> DataFrame:
    """date, m: mean growth over the series; one row a month."""
    g = panel.spine(t.monthly(spark, d)).withColumn("x", 100 * F.log(F.col("value") / F.lag("value").over(panel.over()))).where("x is not null")
    return g.groupBy("date").agg(F.avg("x").alias("m"))


def backtest_runs(spark: S, d: str) -> DataFrame:
    """as_of, variant, target, stage (months known of the target), forecast, n (quarters it is learnt from)."""
    mm = mean_growth(spark, d)
    span = t.monthly(spark, d).agg(F.max("date").alias("until"), F.add_months(F.min("date"), HISTORY).alias("since"))
    months = mm.join(F.broadcast(span))  # one row
    first = F.greatest(F.trunc(F.date_add("date", MONTH_LAG), "MM"), F.col("since"))
    asofs = F.filter(F.transform(F.sequence(first, F.greatest("until", first), F.expr("interval 1 month")), lambda x: F.last_day(x)), lambda x: (F.date_add("date", MONTH_LAG) <= x) & (x <= F.last_day("until")))
    q = calendar.q_index(F.col("date")).cast("int")
    known = months.select("date", "m", q.alias("q"), F.explode(asofs).alias("as_of")).groupBy("as_of", "q").agg(F.count("*").alias("stage"), F.avg("m").alias("qa"), F.max_by("m", "date").alias("last"))
    long = known.select("as_of", "q", "stage", F.inline(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(v).alias("x")) for v in ("qa", "last")))))
    y = t.growth(spark, d).where("growth is not null").select(F.col("q_index").cast("int").alias("q"), F.date_add("date", PRINT_LAG).alias("printed"), "growth")
    fits = long.join(y, "q").where("printed <= as_of").groupBy("as_of", "variant").agg(F.regr_slope("growth", "x").alias("b"), F.regr_intercept("growth", "x").alias("a"), F.count("*").alias("n")).where(F.col("n") >= LEAST)
    now = long.groupBy("as_of", "variant").agg(F.max(F.struct("q", "x", "stage")).alias("now"))
    target = calendar.q_index(F.col("as_of")).cast("int")
    runs = fits.join(now, ["as_of", "variant"]).withColumn("target", target)
    stage = F.when(F.col("now.q") == F.col("target"), F.col("now.stage")).otherwise(F.lit(0))
    return runs.select("as_of", "variant", "target", stage.alias("stage"), (F.col("a") + F.col("b") * F.col("now.x")).alias("forecast"), "n")


@query(f"with {GRID} select as_of, variant, target, stage, forecast, n from runs", ratios=("forecast",))
def backtest_grid(spark: S, d: str) -> DataFrame:
    """Pseudo-real-time forecasts of the current quarter at every month end, by variant."""
    return backtest_runs(spark, d)


@query(f"""with {GRID}, s as (select variant, stage, forecast - growth as e, growth from runs join y on y.q = runs.target) select variant, stage, count(*) as n, avg(e) as bias, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse, avg(case when sign(e + growth) = sign(growth) then 1.0 else 0.0 end) as direction from s group by 1, 2""", ratios=("bias", "mae", "rmse", "direction"))
def backtest_scores(spark: S, d: str) -> DataFrame:
    """Scores of the backtest by variant and months known, and how often the sign was right."""
    y = t.growth(spark, d).where("growth is not null").select(F.col("q_index").alias("target"), "growth")
    s = backtest_runs(spark, d).join(y, "target").withColumn("e", F.col("forecast") - F.col("growth"))
    return s.groupBy("variant", "stage").agg(*bands.scores(F.col("e")), F.avg(F.when(F.signum("forecast") == F.signum("growth"), 1.0).otherwise(0.0)).alias("direction"))


COMBINED = f"""{GRID}, v2 as (select * from runs where variant = 'qa'), v3 as (select * from runs where variant = 'last'),
    paired as (select v2.as_of, v2.target, v2.stage, v2.forecast as v2, arg_max(v3.forecast, v3.as_of) as v3_raw, max(v3.as_of) as v3_date from v2 left join v3 on v3.as_of <= v2.as_of and v2.as_of - v3.as_of <= 31 group by 1, 2, 3, 4),
    finals as (select target, arg_max(forecast, as_of) as final from v3 group by 1), miss as (select y.q, y.date + {PRINT_LAG} as printed, final - growth as miss from finals join y on y.q = finals.target),
    fixed as (select p.*, (select case when count(*) >= 4 then avg(miss) end from (select miss from miss where miss.printed <= p.as_of order by printed desc limit 8)) as correction from paired p),
    arms as (select *, v3_raw - coalesce(correction, 0) as v3, case when v3_raw is null then v2 else (v2 + v3_raw - coalesce(correction, 0)) / 2 end as combo from fixed)"""


def combined(spark: S, d: str) -> DataFrame:
    """The two arms of the backtest, combined."""
    runs = backtest_runs(spark, d)
    prints = t.growth(spark, d).where("growth is not null").select(F.col("q_index").alias("target"), F.date_add("date", PRINT_LAG).alias("printed"), "growth")
    return combine(runs.where("variant = 'qa'"), runs.where("variant = 'last'"), prints)


def combine(v2: DataFrame, v3: DataFrame, y: DataFrame, span: Callable[[Column], Column] | None = F.year) -> DataFrame:
    """as_of, target, stage, v2, v3_raw, v3_date, correction, v3, combo: the second arm no more than 31 days old, less the mean of its last 8 misses that had been printed (4 at least).

    v2, v3: as_of, target, stage, forecast, n. y: target, printed, growth. span: that of joins.as_of; without one the arms, a row a run, meet in one task and are read once.
    """
    v2, v3 = v2.withColumn("all", F.lit(1)), v3.withColumn("all", F.lit(1))
    paired = joins.as_of(v2.select("all", "as_of", "target", "stage", F.col("forecast").alias("v2")), v3.select("all", F.col("as_of").alias("as_of"), F.col("forecast").alias("raw"), F.col("as_of").alias("date"), "n"), ["all"], "as_of", ["raw", "date"], "n", 31, span)
    finals = v3.groupBy("target").agg(F.max_by("forecast", "as_of").alias("final"))
    misses = finals.join(y, "target").select("printed", (F.col("final") - F.col("growth")).alias("miss"))
    last = Window.orderBy("printed").rowsBetween(-7, 0)  # one row a quarter
    means = misses.select(F.lit(1).alias("all"), F.col("printed").alias("as_of"), F.when(F.count("*").over(last) >= 4, F.avg("miss").over(last)).alias("correction"))
    out = joins.as_of(paired, means, ["all"], "as_of", ["correction"], "correction", span=span).withColumnRenamed("right_correction", "correction")
    v3_fixed = F.col("right_raw") - F.coalesce("correction", F.lit(0.0))
    return out.select("as_of", "target", "stage", "v2", F.col("right_raw").alias("v3_raw"), F.col("right_date").alias("v3_date"), "correction", v3_fixed.alias("v3"), F.when(F.col("right_raw").isNull(), F.col("v2")).otherwise((F.col("v2") + v3_fixed) / 2).alias("combo"))


@query(f"with {COMBINED} select as_of, target, stage, v2, v3_raw, v3_date, correction, v3, combo from arms", ratios=("v2", "v3_raw", "correction", "v3", "combo"))
def combination_run(spark: S, d: str) -> DataFrame:
    """The combined estimate end to end: runs, pairing as of, bias correction, mean; one arm alone where the other is too old."""
    return combined(spark, d)


@query(f"""with {COMBINED}, s as (select unnest(['v2', 'v3_raw', 'v3', 'combo']) as arm, unnest([v2, v3_raw, v3, combo]) - growth as e from arms join y on y.q = arms.target) select arm, count(e) as n, avg(e) as bias, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse, quantile_cont(abs(e), 0.68) as p68, quantile_cont(abs(e), 0.95) as p95 from s group by 1""", ratios=("bias", "mae", "rmse", "p68", "p95"))
def arm_scores(spark: S, d: str) -> DataFrame:
    """The four arms scored from one pass: unpivoted, then aggregated; with the bands of their errors."""
    y = t.growth(spark, d).where("growth is not null").select(F.col("q_index").alias("target"), "growth")
    return scored(combined(spark, d), y)


def scored(arms: DataFrame, y: DataFrame) -> DataFrame:
    """By arm, its errors' scores and bands; y: target, growth."""
    rows = arms.join(y, "target").select("growth", F.inline(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(a).alias("x")) for a in ("v2", "v3_raw", "v3", "combo")))))
    e = F.col("x") - F.col("growth")
    return rows.withColumn("e", e).groupBy("arm").agg(*bands.scores(F.col("e")), *bands.quantiles(F.col("e")))


@query(f"""with {COMBINED}, s as (select as_of, stage, combo, abs(combo - growth) as e, y.date + {PRINT_LAG} as printed from arms join y on y.q = arms.target), w as (select a.as_of, a.combo, a.stage, count(s.e) as n, quantile_cont(s.e, 0.68) as p68 from arms a left join s on s.printed <= a.as_of and s.stage = a.stage group by 1, 2, 3),
    p as (select a.as_of, quantile_cont(s.e, 0.68) as p68, count(s.e) as n from arms a left join s on s.printed <= a.as_of group by 1) select w.as_of, w.combo, coalesce(case when w.n >= 8 then w.p68 end, case when p.n >= 8 then p.p68 end) as half, case when w.n >= 8 then 'stage' when p.n >= 8 then 'pooled' else 'none' end as basis from w join p using (as_of)""", ratios=("combo", "half"))
def real_time_bands(spark: S, d: str) -> DataFrame:
    """Half width of each run's 68 percent band from the errors printed by then: of its stage where there are eight, else pooled, else none."""
    arms = combined(spark, d)
    y = t.growth(spark, d).where("growth is not null").select(F.col("q_index").alias("target"), F.date_add("date", PRINT_LAG).alias("printed"), "growth")
    past = arms.join(y, "target").select("printed", F.col("stage").alias("of"), F.abs(F.col("combo") - F.col("growth")).alias("e"))
    ledger = past.agg(F.collect_list(F.struct("printed", "of", "e")).alias("ledger"))  # one row an as-of date
    seen = F.filter("ledger", lambda x: x["printed"] <= F.col("as_of"))
    own = F.filter(seen, lambda x: x["of"] == F.col("stage"))

    def quantile(rows: Column, p: float) -> Column:
        es = F.array_sort(F.transform(rows, lambda x: x["e"]))
        at = (F.size(es) - 1) * p
        low = F.floor(at).cast("int")
        a, b = F.get(es, low), F.get(es, F.least(low + 1, F.size(es) - 1))
        return a + (b - a) * (at - low)

    basis = F.when(F.size(own) >= 8, "stage").when(F.size(seen) >= 8, "pooled").otherwise("none")
    half = F.when(F.size(own) >= 8, quantile(own, 0.68)).when(F.size(seen) >= 8, quantile(seen, 0.68))
    return arms.join(F.broadcast(ledger)).select("as_of", "combo", half.alias("half"), basis.alias("basis"))


@query(f"""with {COMBINED} select as_of, kind, target, value, months, basis from (select as_of, 'current' as kind, target, combo as value, stage as months, case when v3_raw is null then 'one arm' else 'mean' end as basis from arms union all select as_of, 'next', target + 1, v3, 0, case when v3 is null then 'refused' else 'one arm' end from arms)""", ratios=("value",))
def horizon_entries(spark: S, d: str) -> DataFrame:
    """Two horizons of each run: the current one from both arms, the next from the second alone with no months known; refused where it has none."""
    c = combined(spark, d)
    one = F.struct(F.lit("current").alias("kind"), F.col("target").alias("target"), F.col("combo").alias("value"), F.col("stage").alias("months"), F.when(F.col("v3_raw").isNull(), "one arm").otherwise("mean").alias("basis"))
    two = F.struct(F.lit("next").alias("kind"), (F.col("target") + 1).alias("target"), F.col("v3").alias("value"), F.lit(0).cast("bigint").alias("months"), F.when(F.col("v3").isNull(), "refused").otherwise("one arm").alias("basis"))
    return c.select("as_of", F.inline(F.array(one, two)))


@query(f"""with {GRID} select variant, target, as_of, forecast, forecast - lag(forecast) over (partition by variant, target order by as_of) as change, row_number() over (partition by variant, target order by as_of desc) = 1 as final, cast(datediff('day', as_of, (select max(y.date) from y where y.q = target) + {PRINT_LAG}) as integer) as days_to_release from runs""", ratios=("forecast", "change"))
def estimate_paths(spark: S, d: str) -> DataFrame:
    """How each quarter's estimate moved from run to run, which was the last, and the days left to its release."""
    w = Window.partitionBy("variant", "target").orderBy("as_of")
    y = t.growth(spark, d).where("growth is not null").select(F.col("q_index").alias("target"), F.date_add("date", PRINT_LAG).alias("printed"))
    rows = backtest_runs(spark, d).join(y, "target", "left")
    last = F.row_number().over(Window.partitionBy("variant", "target").orderBy(F.desc("as_of"))) == 1
    return rows.select("variant", "target", "as_of", "forecast", (F.col("forecast") - F.lag("forecast").over(w)).alias("change"), last.alias("final"), F.datediff("printed", "as_of").alias("days_to_release"))
