"""Queries that run numeric kernels: one group, one task; the panels they take are small and of fixed shape."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import bayes, dynamic, kernels, panel
from tidemark.plans.registry import query
from tidemark.plans.registry import registered as registry_query
from tidemark.sources import tables as t
from tidemark.streaming.ledger import shared_dir

S = SparkSession

#: Lengths of a chain, as in the reference: its short one, which the query runs, and production's.
SHORT = {"draws": 200, "burn": 100, "thin": 1}
PRODUCTION = {"draws": 10_000, "burn": 8_000, "thin": 2}
#: Bootstrap replications of a series, as in the reference, and the groups (seeds) they are spread over.
BOOTSTRAP_REPS = 1000
BOOTSTRAP_SEEDS = 10
#: Tasks over which chains are dealt by hash; a prime, as fewer keys then meet in one.
TASKS = 97


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: a small table that is used several times is written to the shared folder and read again."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def growth_rows(spark: S, d: str) -> DataFrame:
    """Monthly growth of each series with the panel's mean growth, ready for regressions.

    The monthly panel, a row a series and month, is stored: the steps after it use it several times, and the line items are read once.
    """
    w = Window.partitionBy("key").orderBy("date")
    g = panel.spine(stored(t.monthly(spark, d), "monthly")).withColumn("x", 100 * F.log(F.col("value") / F.lag("value").over(w))).where("x is not null")
    return g.join(g.groupBy("date").agg(F.avg("x").alias("m")), "date").select("key", "date", "x", "m")


def wide(pdf: pd.DataFrame, value: str = "x") -> tuple[np.ndarray, list[str]]:
    w = pdf.pivot(index="date", columns="key", values=value).sort_index()
    return w.to_numpy(), list(w.columns)


def standard(y: np.ndarray) -> np.ndarray:
    sd = np.nanstd(y, axis=0, ddof=1)
    return (y - np.nanmean(y, axis=0)) / np.where(sd > 0, sd, 1)


@query()
def hac_wald_gate(spark: S, d: str) -> DataFrame:
    """Per series: regression on the panel mean and its lags, HAC covariance, Wald test that all slopes are 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y, m = pdf["x"].to_numpy(), pdf["m"].to_numpy()
        x = np.column_stack([np.ones(len(y) - 2), m[2:], m[1:-1], m[:-2]])
        beta, e, inverse = kernels.ols(y[2:], x)
        stat, p = kernels.wald(beta, kernels.hac(x, e, inverse), np.eye(4)[1:])
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "slope": [beta[1]], "wald": [stat], "p": [p], "keep": [p < 0.1]})

    return growth_rows(spark, d).groupBy("key").applyInPandas(run, "key string, slope double, wald double, p double, keep boolean")


@query()
def unit_roots(spark: S, d: str) -> DataFrame:
    """Dickey-Fuller and KPSS statistics and the first autocorrelations of each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("date")["x"].to_numpy()
        tau, lags = kernels.adf(y)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "adf": [tau], "lags": [lags], "kpss": [kernels.kpss(y)], "acf1": [kernels.acf(y, 1)[1]], "pacf2": [kernels.pacf(y, 2)[2]]})

    return growth_rows(spark, d).groupBy("key").applyInPandas(run, "key string, adf double, lags int, kpss double, acf1 double, pacf2 double")


@query()
def umidas(spark: S, d: str) -> DataFrame:
    """Quarterly growth on the monthly lags of the panel mean, for each as-of stage (months of the quarter known)."""
    m = growth_rows(spark, d).groupBy("date").agg(F.first("m").alias("m"))
    stacked = m.select((F.year("date") * 4 + F.quarter("date") - 1).alias("q_index"), (2 - (F.month("date") - 1) % 3).alias("k"), "m").groupBy("q_index").pivot("k", [0, 1, 2]).agg(F.first("m"))
    rows = t.growth(spark, d).join(stacked, "q_index").where("growth is not null").select("q_index", "growth", F.col("0").alias("k0"), F.col("1").alias("k1"), F.col("2").alias("k2"))
    stages = rows.withColumn("stage", F.explode(F.array(*map(F.lit, (1, 2, 3)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stage = int(pdf["stage"].iloc[0])
        pdf = pdf.dropna().sort_values("q_index")
        y = pdf["growth"].to_numpy()
        lags = pdf[["k2", "k1", "k0"][:stage]].to_numpy()
        x = np.column_stack([np.ones(len(y)), lags.mean(1) if stage == 3 else lags])
        out = []
        for n in range(12, len(y)):  # each forecast from the quarters before it alone
            beta, _, _ = kernels.ols(y[:n], x[:n])
            out.append((stage, int(pdf["q_index"].iloc[n]), float(x[n] @ beta), float(y[n]), float(y[:n].mean())))
        return pd.DataFrame(out, columns=["stage", "q_index", "forecast", "actual", "naive"])

    return stages.groupBy("stage").applyInPandas(run, "stage int, q_index int, forecast double, actual double, naive double")


def monthly_panel(spark: S, d: str) -> DataFrame:
    """Growth of series with their category; categories of one series have no common factor and are left out."""
    rows = growth_rows(spark, d).join(t.registry(spark, d).select("key", "category"), "key")
    several = rows.groupBy("category").agg(F.count_distinct("key").alias("n")).where("n > 1").select("category")
    return rows.join(several, "category", "left_semi")


@query()
def pca_factors(spark: S, d: str) -> DataFrame:
    """First two principal factors of each category's series, their variance shares, the chosen number of factors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, keys = wide(pdf)
        y = np.nan_to_num(standard(y))
        r = min(2, len(keys))
        _, loadings, share = kernels.principal(y, r)
        chosen = kernels.factor_count(y, min(3, len(keys) - 1))
        return pd.DataFrame([(pdf["category"].iloc[0], k, j, loadings[i, j], share[j], chosen) for i, k in enumerate(keys) for j in range(r)], columns=["category", "key", "factor", "loading", "share", "chosen"])

    return monthly_panel(spark, d).groupBy("category").applyInPandas(run, "category string, key string, factor int, loading double, share double, chosen int")


@query()
def real_time_factor(spark: S, d: str) -> DataFrame:
    """EM dynamic factor of each category: filtered (no look-ahead) and smoothed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, _ = wide(pdf)
        fit = kernels.em_factor(standard(y), 1, 20)
        dates = sorted(pdf["date"].unique())
        f, s = fit["filtered"][:, 0], fit["smoothed"][:, 0]
        return pd.DataFrame({"category": pdf["category"].iloc[0], "date": dates, "filtered": f, "smoothed": s})

    return monthly_panel(spark, d).groupBy("category").applyInPandas(run, "category string, date date, filtered double, smoothed double")


@query()
def factor_news(spark: S, d: str) -> DataFrame:
    """What the last three months' cells of each series change in the expected value of the category's first series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, keys = wide(pdf)
        y = standard(y)
        old = y.copy()
        old[-3:] = np.nan
        impact = kernels.news(old, y, kernels.em_factor(old, 1, 20), len(y) - 1, 0)
        return pd.DataFrame({"category": pdf["category"].iloc[0], "key": keys, "impact": [impact[k] for k in range(len(keys))]})

    return monthly_panel(spark, d).groupBy("category").applyInPandas(run, "category string, key string, impact double")


def chains(spark: S, d: str, draws: int, burn: int, thin: int, seeds: int = 3) -> DataFrame:
    """(category, seed, point, p16, p84, vol): a chain is a grouping key, its seed comes from it.

    Chains are dealt over a fixed number of tasks: their few rows would else be put together in one, one chain after another.
    """
    groups = monthly_panel(spark, d).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).repartition(TASKS, "category", "seed")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, _ = wide(pdf)
        got = kernels.gibbs_factor(standard(y), draws, burn, int(pdf["seed"].iloc[0]), thin)
        low, high = np.percentile(got["draws"], [16, 84])
        return pd.DataFrame({"category": [pdf["category"].iloc[0]], "seed": [int(pdf["seed"].iloc[0])], "point": [float(np.median(got["draws"]))], "p16": [low], "p84": [high], "vol": [float(got["vol"].mean())]})

    return groups.groupBy("category", "seed").applyInPandas(run, "category string, seed int, point double, p16 double, p84 double, vol double")


@query()
def gibbs_chains(spark: S, d: str) -> DataFrame:
    """Bayesian factor of each category by parallel chains of the short length."""
    return chains(spark, d, **SHORT)


def bootstrapped(spark: S, d: str, replications: int = BOOTSTRAP_REPS, seeds: int = BOOTSTRAP_SEEDS) -> DataFrame:
    """(key, stat, p): (key, seed) groups share the replications."""
    reps = growth_rows(spark, d).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        seed = int(pdf["seed"].iloc[0])
        own = replications // seeds + (seed < replications % seeds)
        stat, draws = kernels.bootstrap_mse_f(pdf["x"].to_numpy(), pdf[["m"]].to_numpy(), len(pdf) - 20, own, seed)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "stat": [stat], "above": [int((draws > stat).sum())], "reps": [len(draws)]})

    each = reps.groupBy("key", "seed").applyInPandas(run, "key string, stat double, above int, reps int")
    return each.groupBy("key").agg(F.first("stat").alias("stat"), (F.sum("above") / F.sum("reps")).alias("p"))


@query()
def bootstrap_gain(spark: S, d: str) -> DataFrame:
    """MSE-F of each series' panel-mean regression with its bootstrap chance; replications are grouping keys."""
    return bootstrapped(spark, d)


#: Lags of the panel mean beside a series' own last value, and months ahead, of the models that the path bootstrap tests.
MODELS, HORIZONS, DRAWS = {"mean": 1, "two means": 2}, (1, 3), ("residual", "normal")
TESTED = 20


@query()
def bootstrap_paths(spark: S, d: str) -> DataFrame:
    """MSE-F of each series' forecasts by the panel mean's lags, by model and horizon, with its chance under paths generated from the null model, by kind of
    draw; 1,000 paths each, dealt over seeds. (series, model, horizon, draw, seed) are grouping keys; series of under 45 months are left out."""
    grid = [(m, n, h, k, s) for m, n in MODELS.items() for h in HORIZONS for k in DRAWS for s in range(4)]
    rows = growth_rows(spark, d).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("date", "x", "m"))).alias("rows")).where("size(rows) >= 45")  # a series' months
    cases = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(n).alias("lags"), F.lit(h).alias("horizon"), F.lit(k).alias("draw"), F.lit(s).alias("seed")) for m, n, h, k, s in grid))
    each = rows.select("key", F.col("rows.x").alias("x"), F.col("rows.m").alias("m"), F.inline(cases)).repartition(64, "key", "seed", "model", "horizon", "draw")

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                y, m = np.array(r.x), np.array(r.m)
                paths = dynamic.null_paths(y, m, BOOTSTRAP_REPS // 4, r.draw, np.random.default_rng([r.seed, r.lags, r.horizon]))
                stat = dynamic.mse_f(y[None], m[None], r.lags, r.horizon, TESTED)[0]
                out.append((r.key, r.model, r.horizon, r.draw, stat, int((dynamic.mse_f(*paths, r.lags, r.horizon, TESTED) > stat).sum())))
            yield pd.DataFrame(out, columns=["key", "model", "horizon", "draw", "stat", "above"])

    parts = each.mapInPandas(run, "key string, model string, horizon int, draw string, stat double, above int")
    return parts.groupBy("key", "model", "horizon", "draw").agg(F.first("stat").alias("stat"), (F.sum("above") / (BOOTSTRAP_REPS // 4 * 4)).alias("p"))


@query()
def dynamic_shocks(spark: S, d: str) -> DataFrame:
    """What each series' surprise added to each month's update of its category's factor: two static factors driven by one shock, by EM, identified."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, keys = wide(pdf)
        y = standard(y)
        m = dynamic.identified(dynamic.estimated(y, 1, 1, 2))
        news, parts, updates = dynamic.contributions(y, m)
        dates = sorted(pdf["date"].unique())
        i, j = np.nonzero(~np.isnan(news))
        return pd.DataFrame({"category": pdf["category"].iloc[0], "date": [dates[k] for k in i], "key": [keys[k] for k in j], "surprise": news[i, j], "contribution": parts[i, j, 0], "update": updates[i, 0]})

    return monthly_panel(spark, d).groupBy("category").applyInPandas(run, "category string, date date, key string, surprise double, contribution double, update double")


@query()
def news_decomposition(spark: S, d: str) -> DataFrame:
    """Why each category's estimate moved between two vintages: old, parameters, revisions, releases; and each released cell's weight and impact."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, keys = wide(pdf)
        y_new = standard(y)
        y_old = y_new.copy()
        y_old[-6:-3] *= 0.9  # what the older vintage had before its revision
        y_old[-3:] = np.nan
        old, new = (bayes.model(kernels.em_factor(v, 1, 20)) for v in (y_old, y_new))
        rows, cells = bayes.news_rows(y_old, y_new, old, new, len(y) - 1, 0)
        name = pdf["category"].iloc[0]
        out = [(name, part, None, None, None, None, value) for part, value in rows.items()]
        out += [(name, "cell", keys[c["series"]], len(y) - c["row"], c["forecast"], c["weight"], c["impact"]) for c in cells]
        return pd.DataFrame(out, columns=["category", "part", "key", "months_ago", "forecast", "weight", "value"]).astype({"months_ago": "Int32"})

    return monthly_panel(spark, d).groupBy("category").applyInPandas(run, "category string, part string, key string, months_ago int, forecast double, weight double, value double")


@query()
def volatility_states(spark: S, d: str) -> DataFrame:
    """Volatility, outlier scale and the chance of no outlier of each series' growth, by Gibbs over the mixture; 200 sweeps after 100."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        x = pdf["x"].to_numpy() - pdf["x"].mean()
        got = bayes.volatility_chain(x, SHORT["draws"], SHORT["burn"], 1)
        return pd.DataFrame({"key": pdf["key"], "date": pdf["date"], "sigma": got["sigma"], "scale": got["scale"], "plain": got["plain"]})

    return growth_rows(spark, d).groupBy("key").applyInPandas(run, "key string, date date, sigma double, scale double, plain double")


@query()
def dynamic_factors(spark: S, d: str) -> DataFrame:
    """Dynamic eigenvalues of each category's series and the number of dynamic factors they speak for."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, keys = wide(pdf)
        y = np.nan_to_num(standard(y))
        m = int(np.sqrt(len(y)))
        got = kernels.spectral(y, 1, m)
        return pd.DataFrame({"category": pdf["category"].iloc[0], "place": np.arange(1, len(keys) + 1), "eigenvalue": got["mean"], "share": got["share"], "chosen": kernels.dynamic_count(y, 3, m)})

    return monthly_panel(spark, d).groupBy("category").applyInPandas(run, "category string, place int, eigenvalue double, share double, chosen int")


@query()
def robust_errors(spark: S, d: str) -> DataFrame:
    """Standard errors of each series' slope on the panel mean, by kernel and residual scaling, with the automatic bandwidth.

    Scalings EH to ES are those of kernels.scaled_residuals; FE takes the errors of recursive one-step forecasts, trimmed by a tenth.
    """
    kinds = [(k, r) for k in ("truncated", "bartlett", "parzen", "tukey", "qs") for r in ("EH", "EB", "ET", "ED", "EM", "ES", "FE")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y, x = pdf["x"].to_numpy(), np.column_stack([np.ones(len(pdf)), pdf["m"]])
        beta, e, inverse = kernels.ols(y, x)
        h = np.einsum("ij,jk,ik->i", x, inverse, x)
        out = []
        for kind, scaling in kinds:
            scores = kernels.forecast_scores(y, x) if scaling == "FE" else x * kernels.scaled_residuals(e, h, scaling)[:, None]
            width = kernels.automatic_bandwidth(scores[:, 1:], kind)
            cov = inverse @ kernels.long_run(scores, max(0, min(len(scores) - 2, int(width))), kind) @ inverse
            out.append((pdf["key"].iloc[0], kind, scaling, float(beta[1]), float(width), float(np.sqrt(max(cov[1, 1], 0)))))
        return pd.DataFrame(out, columns=["key", "kernel", "scaling", "slope", "bandwidth", "error"])

    return growth_rows(spark, d).groupBy("key").applyInPandas(run, "key string, kernel string, scaling string, slope double, bandwidth double, error double")


@query()
def recursive_errors(spark: S, d: str) -> DataFrame:
    """Standardised errors of recursive one-step forecasts of each series by the panel mean, with their sums so far (a test of stable slopes)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        x = np.column_stack([np.ones(len(pdf)), pdf["m"]])
        if len(pdf) < 4:
            return pd.DataFrame({"key": [], "date": [], "error": [], "path": []})
        e = kernels.recursive_residuals(pdf["x"].to_numpy(), x)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "date": pdf["date"].to_numpy()[2:], "error": e, "path": np.cumsum(e) / e.std(ddof=1)})

    return growth_rows(spark, d).groupBy("key").applyInPandas(run, "key string, date date, error double, path double")


def mixed_panel(spark: S, d: str) -> DataFrame:
    """Monthly growth by category, with the quarterly target's growth in its last months as one more series of each."""
    rows = monthly_panel(spark, d).select("category", "key", "date", "x")
    target = t.growth(spark, d).where("growth is not null").select(F.lit("target").alias("key"), "date", F.col("growth").alias("x"))
    return rows.unionByName(rows.select("category").distinct().join(F.broadcast(target)).select("category", "key", "date", "x"))  # a few categories by one row a quarter


@query()
def mixed_chains(spark: S, d: str) -> DataFrame:
    """Density of each category's estimate of the quarterly target in its last month, by chains of the mixed-frequency model; seeds are grouping keys."""
    groups = mixed_panel(spark, d).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, keys = wide(pdf)
        order = [k for k, name in enumerate(keys) if name != "target"] + [keys.index("target")]
        mean, sd = np.nanmean(y[:, order], 0), np.nanstd(y[:, order], 0, ddof=1)
        z = (y[:, order] - mean) / sd
        seed = int(pdf["seed"].iloc[0])
        got = bayes.mixed_chain(z, 1, SHORT["draws"], SHORT["burn"], seed)
        last = mean[-1] + sd[-1] * got["last"][:, 0]
        p = np.percentile(last, [2.5, 16, 50, 84, 97.5])
        return pd.DataFrame([(pdf["category"].iloc[0], seed, *p, got["loadings"][:, -1].mean(), got["sigma"][-1])], columns=["category", "seed", "p2", "p16", "p50", "p84", "p97", "loading", "vol"])

    return groups.groupBy("category", "seed").applyInPandas(run, "category string, seed int, p2 double, p16 double, p50 double, p84 double, p97 double, loading double, vol double")


@query()
def activity_index(spark: S, d: str) -> DataFrame:
    """Index of activity: the ten series that pass the Wald gate and matter most make one dynamic factor, filtered, so that no month looks ahead.

    The ten are chosen before they meet, so the group holds ten series however many there are.
    """
    gate = registry_query("hac_wald_gate")(spark, d).where("keep").orderBy(F.desc("wald"), "key").limit(10).select("key")
    chosen = growth_rows(spark, d).join(F.broadcast(gate), "key").select("key", "date", "x", F.lit(1).alias("all"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, keys = wide(pdf)
        if len(keys) < 2:
            return pd.DataFrame({"date": [], "activity": [], "series": []})
        z = standard(y)
        f = kernels.em_factor(z, 1, 30)["filtered"][:, 0]
        sign = -1 if np.corrcoef(f, np.nanmean(z, 1))[0, 1] < 0 else 1
        return pd.DataFrame({"date": sorted(pdf["date"].unique()), "activity": sign * f, "series": len(keys)})

    return chosen.groupBy("all").applyInPandas(run, "date date, activity double, series int")  # ten series
