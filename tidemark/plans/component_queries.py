"""The first model by component: fitted at each year's start on what was published by then, tracked weekly through each quarter, added up.

A component is a region: its monthly series are its nations', its quarterly target the orders of its customers.
A (component, year) is a group and takes every row published by that year's end, since a model learns from all its past.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators import components, joins
from tidemark.plans import backtest_queries as backtest
from tidemark.plans.kernel_queries import growth_rows, monthly_panel
from tidemark.plans.registry import query
from tidemark.sources import tables as t

S = SparkSession
TARGET, WHOLE = "target", "whole"
TOP = 5


def component_levels(spark: S, d: str) -> DataFrame:
    """component, quarter, date (the quarter's last month), value, published; one row a component and quarter."""
    day = F.col("o_orderdate").cast("date")
    orders = t.table(spark, d, "orders").groupBy("o_custkey", calendar.q_index(day).alias("quarter")).agg(F.sum("o_totalprice").alias("value"))
    regions = t.table(spark, d, "nation").join(t.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("component"))
    owners = t.table(spark, d, "customer").join(regions, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "component")
    sums = orders.join(owners, F.col("o_custkey") == F.col("c_custkey")).groupBy("component", "quarter").agg(F.sum("value").alias("value"))
    return sums.select("component", "quarter", calendar.quarter_end_month(F.col("quarter")).alias("date"), "value", calendar.release_date(F.col("quarter")).alias("published"))


def component_rows(spark: S, d: str) -> DataFrame:
    """component, key, date, x (growth in per cent), published: the series, and the target under its own key."""
    lags = t.registry(spark, d).select("key", "lag_days")
    series = monthly_panel(spark, d).join(lags, "key").select(F.col("category").alias("component"), "key", "date", "x", F.date_add(F.last_day("date"), F.col("lag_days")).alias("published"))
    w = Window.partitionBy("component").orderBy("quarter")
    grown = component_levels(spark, d).withColumn("x", F.when(F.lag("quarter").over(w) == F.col("quarter") - 1, 100 * (F.col("value") / F.lag("value").over(w) - 1)))
    return series.unionByName(grown.where("x is not null").select("component", F.lit(TARGET).alias("key"), "date", "x", "published"))


def whole_rows(spark: S, d: str) -> DataFrame:
    """The same rows for the whole: all series under one component, and the whole's growth."""
    whole = F.lit(WHOLE).alias("component")
    series = growth_rows(spark, d).join(t.registry(spark, d).select("key", "lag_days"), "key").select(whole, "key", "date", "x", F.date_add(F.last_day("date"), F.col("lag_days")).alias("published"))
    own = t.growth(spark, d).where("growth is not null").select(whole, F.lit(TARGET).alias("key"), "date", F.col("growth").alias("x"), calendar.release_date(F.col("q_index")).alias("published"))
    return series.unionByName(own)


def by_year(rows: DataFrame) -> DataFrame:
    """rows with year, each in every year from its publication on; years are those of the months that the series hold."""
    years = rows.where(F.col("key") != TARGET).agg(F.max(F.year("date")).alias("_last"))  # one row
    dated = rows.join(F.broadcast(years)).where(F.year("published") <= F.col("_last"))
    return dated.withColumn("year", F.explode(F.sequence(F.year("published"), F.col("_last")))).drop("_last")


def panel_of(pdf: pd.DataFrame) -> tuple[components.Panel, list, list[str]]:
    """The group as months x (series, target), its months up to the year's end, and the names of its columns."""
    year = int(pdf["year"].iloc[0])
    dates = list(pd.date_range(min(pdf["date"]), dt.date(year, 12, 1), freq="MS").date)
    keys = [*sorted(set(pdf["key"]) - {TARGET}), TARGET]
    place, at = {k: j for j, k in enumerate(keys)}, {k: i for i, k in enumerate(dates)}
    i, j = pdf["date"].map(at).to_numpy(), pdf["key"].map(place).to_numpy()
    values, published = np.full((len(dates), len(keys)), np.nan), np.full((len(dates), len(keys)), np.inf)
    values[i, j], published[i, j] = pdf["x"], [p.toordinal() for p in pdf["published"]]
    return components.Panel(values, published), dates, keys


def quarters_of(year: int, dates: list) -> list[tuple[int, int, list[dt.date]]]:
    """Each of the year's quarters: its index, the row of its last month, and its weekly run dates."""
    out = []
    for q in range(4):
        day, end = dt.date(year, 3 * q + 1, 1), dt.date(year + (q == 3), 3 * q + 4 if q < 3 else 1, 1)
        if day >= dates[0]:
            out.append((4 * year + q, dates.index(dt.date(year, 3 * q + 3, 1)), [day + dt.timedelta(7 * k) for k in range((end - day).days // 7 + 1) if day + dt.timedelta(7 * k) < end]))
    return out


Answer = Callable[[components.Panel, list, list[str], components.Fitted | None, int], list[dict]]


def each_model(rows: DataFrame, answer: Answer, schema: str) -> DataFrame:
    """component and year with what answer tells of its model; one task a group, groups stay apart."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        year = int(pdf["year"].iloc[0])
        panel, dates, keys = panel_of(pdf)
        fit = components.fitted(panel, dt.date(year, 1, 1).toordinal() - 1)
        out = pd.DataFrame(answer(panel, dates, keys, fit, year), columns=names)
        return out.assign(component=pdf["component"].iloc[0], year=year)[["component", "year", *names]]

    return by_year(rows).repartition(64, "component", "year").groupBy("component", "year").applyInPandas(run, f"component string, year int, {schema}")


def runs(rows: DataFrame) -> DataFrame:
    """component, year, quarter, run_date, nowcast with deviation and bands, releases (new cells since the run before)."""

    def answer(panel: components.Panel, dates: list, keys: list[str], fit: components.Fitted | None, year: int) -> list[dict]:
        out = []
        for quarter, row, days in quarters_of(year, dates) if fit else ():
            for day, (run, cells) in zip(days, components.tracked(panel, fit, row, [x.toordinal() for x in days]), strict=True):
                out.append({"quarter": quarter, "run_date": day, "releases": len(cells), **run})
        return out

    return each_model(rows, answer, "quarter int, run_date date, nowcast double, deviation double, low68 double, high68 double, low95 double, high95 double, releases int")


def released(rows: DataFrame) -> DataFrame:
    """component, year, quarter, run_date, key, date, forecast, actual, weight, impact of every release."""

    def answer(panel: components.Panel, dates: list, keys: list[str], fit: components.Fitted | None, year: int) -> list[dict]:
        out = []
        for quarter, row, days in quarters_of(year, dates) if fit else ():
            for day, (_, cells) in zip(days, components.tracked(panel, fit, row, [x.toordinal() for x in days]), strict=True):
                out += [{"quarter": quarter, "run_date": day, "key": keys[c["column"]], "date": dates[c["row"]], **c} for c in cells]
        return out

    return each_model(rows, answer, "quarter int, run_date date, key string, date date, forecast double, actual double, weight double, impact double")


def evolution(tracked: DataFrame) -> DataFrame:
    """Runs with the change since the quarter's run before and since its first."""
    w = Window.partitionBy("component", "quarter").orderBy("run_date")
    return tracked.withColumns({"nowcast_change": F.col("nowcast") - F.lag("nowcast").over(w), "cumulative_change": F.col("nowcast") - F.first("nowcast").over(w)})


def contributions(tracked: DataFrame, levels: DataFrame) -> DataFrame:
    """component, quarter, run_date, last_quarter, level, share, growth, contribution_pp, contribution_pct, total.

    Shares are those of the last levels published by the run date, over the components with a run and a level; total is the sum of
    contributions, and contribution_pct the part of it (null where it is 0). level: the last published one grown by the estimate.
    A component's rows meet in one task: a run a week. Splitting them by span would read the runs, and so fit the models, twice.
    """
    known = joins.as_of(tracked.select("component", "quarter", "run_date", "nowcast", F.col("run_date").alias("published")), levels, ["component"], "published", ["quarter", "value"], "quarter").where("right_value is not null")
    w = Window.partitionBy("quarter", "run_date")  # a row a component
    share = F.col("right_value") / F.sum("right_value").over(w)
    parts = known.withColumn("share", share).withColumn("contribution_pp", F.col("share") * F.col("nowcast"))
    total = F.sum("contribution_pp").over(w)
    return parts.select("component", "quarter", "run_date", F.col("right_quarter").alias("last_quarter"), (F.col("right_value") * (1 + F.col("nowcast") / 100)).alias("level"), "share", F.col("nowcast").alias("growth"), "contribution_pp", F.when(total != 0, 100 * F.col("contribution_pp") / total).alias("contribution_pct"), total.alias("total"))


def largest(news: DataFrame, top: int = TOP) -> DataFrame:
    """The releases with the largest impacts of each component and quarter that moved its estimate; ties by run, key and month."""
    w = Window.partitionBy("component", "quarter").orderBy(F.abs("impact").desc(), "run_date", "key", "date")
    return news.where("impact <> 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


@query()
def component_models(spark: S, d: str) -> DataFrame:
    """Diagnostics of each component's model by year: quarters learnt from, log likelihood, rounds, status, factors, weak factors, share explained; status is unknown where there is too little history."""

    def answer(panel: components.Panel, dates: list, keys: list[str], fit: components.Fitted | None, year: int) -> list[dict]:
        known = int((~np.isnan(panel.known(dt.date(year, 1, 1).toordinal() - 1)[:, -1])).sum())
        if fit is None:
            return [{"quarters": known, "status": "unknown"}]
        loadings, explained = components.identified(fit.learnt, fit.model)
        m = fit.model
        return [{"quarters": known, "status": "converged" if m.converged else "not_converged", "log_likelihood": m.loglik[-1], "iterations": len(m.loglik), "series": len(loadings), "factors": loadings.shape[1], "weak_factors": int(((loadings**2).sum(0) < components.WEAK).sum()), "explained": float(explained[:-1].mean()), "target_explained": float(explained[-1])}]

    out = each_model(component_rows(spark, d), answer, "quarters int, status string, log_likelihood double, iterations double, series double, factors double, weak_factors double, explained double, target_explained double")
    counts = ["iterations", "series", "factors", "weak_factors"]
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")).cast("int" if c in counts else "double") for c in ("log_likelihood", *counts, "explained", "target_explained")})


@query()
def component_loadings(spark: S, d: str) -> DataFrame:
    """The five series that each factor of a component's model loads on most."""

    def answer(panel: components.Panel, dates: list, keys: list[str], fit: components.Fitted | None, year: int) -> list[dict]:
        if fit is None:
            return []
        loadings, _ = components.identified(fit.learnt, fit.model)
        return [{"factor": j + 1, "key": keys[fit.used[i]], "loading": v} for (i, j), v in np.ndenumerate(loadings)]

    w = Window.partitionBy("component", "year", "factor").orderBy(F.abs("loading").desc(), "key")
    return each_model(component_rows(spark, d), answer, "factor int, key string, loading double").withColumn("place", F.row_number().over(w)).where(F.col("place") <= TOP)


@query()
def component_evolution(spark: S, d: str) -> DataFrame:
    """Weekly estimates of each component's quarter, from its first day to its last, with bands and changes."""
    return evolution(runs(component_rows(spark, d))).drop("year")


@query()
def component_contributions(spark: S, d: str) -> DataFrame:
    """What each component adds to the whole's growth, at every run."""
    return contributions(runs(component_rows(spark, d)), component_levels(spark, d))


@query()
def component_releases(spark: S, d: str) -> DataFrame:
    """The five releases that moved each component's quarter most."""
    return largest(released(component_rows(spark, d))).drop("year")


@query()
def complete_nowcasts(spark: S, d: str) -> DataFrame:
    """Each quarter of the whole as last estimated: growth and level by adding up components, number of runs, change since the first run, the component that adds most."""
    parts = contributions(runs(component_rows(spark, d)), component_levels(spark, d))
    whole = parts.groupBy("quarter", "run_date").agg(F.count("*").alias("components"), F.first("total").alias("growth"), F.sum("level").alias("level"), F.max_by("component", F.struct(F.abs("contribution_pp"), F.col("component"))).alias("largest"))
    last, first = (lambda c: F.max_by(c, "run_date")), (lambda c: F.min_by(c, "run_date"))
    return whole.groupBy("quarter").agg(F.max("run_date").alias("run_date"), F.count("*").alias("runs"), last("components").alias("components"), last("growth").alias("growth"), last("level").alias("level"), (last("growth") - first("growth")).alias("change"), last("largest").alias("largest"))


def printed(spark: S, d: str) -> DataFrame:
    return t.growth(spark, d).where("growth is not null").select(F.col("q_index").alias("target"), calendar.release_date(F.col("q_index")).alias("printed"), "growth")


def arms(spark: S, d: str) -> DataFrame:
    """The components' sum as the first arm and the whole's own model as the second, paired, corrected and combined by run date."""
    stage = ((F.month("as_of") - 1) % 3 + 1).alias("stage")  # month of the quarter
    arm = lambda df, x: df.select(F.col("run_date").alias("as_of"), F.col("quarter").alias("target"), F.col(x).alias("forecast"), F.lit(1).cast("bigint").alias("n")).select("as_of", "target", stage, "forecast", "n")
    sums = contributions(runs(component_rows(spark, d)), component_levels(spark, d)).groupBy("quarter", "run_date").agg(F.first("total").alias("total"))
    return backtest.combine(arm(sums, "total"), arm(runs(whole_rows(spark, d)), "nowcast"), printed(spark, d), None)


@query()
def model_combination(spark: S, d: str) -> DataFrame:
    """The weekly estimate of the whole from two models: components added up, and one model of all series less its mean miss; combined where both are there."""
    return arms(spark, d)


@query()
def model_arm_scores(spark: S, d: str) -> DataFrame:
    """Both models' arms and their combination scored against what was printed."""
    return backtest.scored(arms(spark, d), printed(spark, d).select("target", "growth"))
