"""Queries that score estimates: errors, bands, calibration, track records, revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import bands
from tidemark.operators import joins
from tidemark.plans.registry import query
from tidemark.sources import tables as t

S = SparkSession
SCORES = ("bias", "mae", "rmse")
#: Errors by series and month: the first print as the forecast, the latest value as the truth, in percent.
ERRORS = "(select key, date, cast(year(date) as integer) as year, cast(month(date) % 3 as integer) as stage, 100 * (first / latest - 1) as error, first, latest from revisions where first is not null)"


def errors(spark: S, d: str) -> DataFrame:
    e = 100 * (F.col("first") / F.col("latest") - 1)
    return t.revisions(spark, d).where("first is not null").select("key", "date", F.year("date").alias("year"), (F.month("date") % 3).alias("stage"), e.alias("error"), "first", "latest")


@query(f"""select key, count(error) as n, avg(error) as bias, avg(abs(error)) as mae, sqrt(avg(error * error)) as rmse, corr(first, latest) as correlation, corr(first, latest) ** 2 as r2, stddev_samp(first) / stddev_samp(latest) as dispersion,
    median(abs(error)) as median_ae, avg(case when sign(first - b) = sign(latest - b) then 1.0 else 0.0 end) as hit_rate, sum(first * first) / sum(latest * latest) as rsq from (select *, lag(latest) over (partition by key order by date) as b from {ERRORS}) group by key""",
       ratios=(*SCORES, "correlation", "r2", "dispersion", "median_ae", "hit_rate", "rsq"))
def accuracy(spark: S, d: str) -> DataFrame:
    """Bias, MAE, RMSE, median error, correlation, dispersion and hit rate of each series."""
    before = F.lag("latest").over(Window.partitionBy("key").orderBy("date"))
    e = errors(spark, d).withColumn("b", before)
    hit = F.when(F.signum(F.col("first") - F.col("b")) == F.signum(F.col("latest") - F.col("b")), 1.0).otherwise(0.0)
    return e.groupBy("key").agg(*bands.scores(F.col("error")), F.corr("first", "latest").alias("correlation"), F.pow(F.corr("first", "latest"), 2).alias("r2"), (F.stddev_samp("first") / F.stddev_samp("latest")).alias("dispersion"),
        F.percentile(F.abs("error"), F.lit(0.5)).alias("median_ae"), F.avg(hit).alias("hit_rate"), (F.sum(F.col("first") * F.col("first")) / F.sum(F.col("latest") * F.col("latest"))).alias("rsq"))


@query(f"select stage, count(error) as n, avg(error) as bias, avg(abs(error)) as mae, sqrt(avg(error * error)) as rmse, quantile_cont(abs(error), 0.68) as p68, quantile_cont(abs(error), 0.95) as p95 from {ERRORS} group by grouping sets ((), (stage))", ratios=(*SCORES, "p68", "p95"))
def stage_bands(spark: S, d: str) -> DataFrame:
    """Empirical error bands, pooled and by stage, in one pass with grouping sets."""
    return errors(spark, d).groupingSets([[], ["stage"]], "stage").agg(*bands.scores(F.col("error")), *bands.quantiles(F.col("error")))


@query(f"""select w as sample, count(error) as n, avg(error) as bias, avg(abs(error)) as mae, sqrt(avg(error * error)) as rmse, avg(error) ** 2 + var_pop(error) as mse_parts from {ERRORS} join (values ('full', 0), ('recent', 1998), ('last', 2000)) v(w, y) on year >= y group by w""", ratios=(*SCORES, "mse_parts"))
def overlapping_windows(spark: S, d: str) -> DataFrame:
    """Scores over three overlapping samples; each row names its samples, so the data are read once."""
    samples = F.filter(F.array(F.lit("full"), F.when(F.col("year") >= 1998, "recent"), F.when(F.col("year") >= 2000, "last")), lambda x: x.isNotNull())
    e = errors(spark, d).withColumn("sample", F.explode(samples))
    return e.groupBy("sample").agg(*bands.scores(F.col("error")), (F.pow(F.avg("error"), 2) + F.var_pop("error")).alias("mse_parts"))


@query(f"""select key, avg(case when abs(error) <= p68 then 1.0 else 0.0 end) as cover68, avg(case when abs(error) <= p95 then 1.0 else 0.0 end) as cover95 from {ERRORS} cross join (select quantile_cont(abs(error), 0.68) as p68, quantile_cont(abs(error), 0.95) as p95 from {ERRORS}) group by key""", ratios=("cover68", "cover95"))
def band_coverage(spark: S, d: str) -> DataFrame:
    """Share of errors inside the pooled bands."""
    e = errors(spark, d)
    both = e.join(F.broadcast(e.agg(*bands.quantiles(F.col("error")))))  # one row
    inside = lambda p: F.avg(F.when(F.abs("error") <= F.col(p), 1.0).otherwise(0.0))
    return both.groupBy("key").agg(inside("p68").alias("cover68"), inside("p95").alias("cover95"))


@query(f"""select key, n, bias, sd, bias / (sd / sqrt(n)) as t, abs(bias / (sd / sqrt(n))) > 1.96 as significant, g1 as skew, g2 as kurt, n / 6.0 * (m3 * m3 / m2 ** 3 + (m4 / m2 ** 2 - 3) ** 2 / 4) as jb, exp(-(n / 6.0 * (m3 * m3 / m2 ** 3 + (m4 / m2 ** 2 - 3) ** 2 / 4)) / 2) as jb_p from (
    select key, count(*) as n, avg(error) as bias, stddev_samp(error) as sd, skewness(error) as g1, kurtosis(error) as g2, avg((error - m) ** 2) as m2, avg((error - m) ** 3) as m3, avg((error - m) ** 4) as m4 from (select *, avg(error) over (partition by key) as m from {ERRORS}) group by key)""", ratios=("bias", "sd", "t", "skew", "kurt", "jb", "jb_p"))
def error_distribution(spark: S, d: str) -> DataFrame:
    """t statistic of the bias, bias-adjusted skewness and kurtosis, Jarque-Bera with its chance."""
    n = F.col("n")
    m = errors(spark, d).groupBy("key").agg(F.count("*").alias("n"), F.avg("error").alias("bias"), F.stddev_samp("error").alias("sd"), F.skewness("error").alias("s"), F.kurtosis("error").alias("k"))
    jb = n / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4)
    tt = F.col("bias") / (F.col("sd") / F.sqrt(n))
    return m.select("key", "n", "bias", "sd", tt.alias("t"), (F.abs(tt) > 1.96).alias("significant"), (F.col("s") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6)).alias("kurt"), jb.alias("jb"), F.exp(-jb / 2).alias("jb_p"))


@query("""select as_of, count(*) as n, avg(miss) as correction from (select m.date as as_of, r.miss, row_number() over (partition by m.date order by r.release_date desc) as k from misses m join misses r on r.release_date <= m.date) where k <= 8 group by as_of having count(*) >= 4""", ratios=("correction",))
def rolling_miss(spark: S, d: str) -> DataFrame:
    """As-of mean of the last 8 misses that had been released; fewer than 4 give none."""
    m = t.misses(spark, d)
    pairs = m.select(F.col("date").alias("as_of")).join(F.broadcast(m.select("release_date", "miss")), F.col("release_date") <= F.col("as_of"))  # one row a quarter
    nth = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("release_date")))
    return pairs.withColumn("k", nth).where("k <= 8").groupBy("as_of").agg(F.count("*").alias("n"), F.avg("miss").alias("correction")).where("n >= 4")


@query("""select key, count(*) as n, avg(100 * (latest / first - 1)) as mean_revision from (select *, row_number() over (partition by key order by date desc) as k from revisions where first is not null and date <= (select max(date) - interval 12 month from revisions)) where k <= 40 group by key having count(*) >= 8""", ratios=("mean_revision",))
def mean_revision(spark: S, d: str) -> DataFrame:
    """Mean revision over the last 40 settled months of each series."""
    r = t.revisions(spark, d)
    settled = r.where("first is not null").join(F.broadcast(r.agg(F.add_months(F.max("date"), -12).alias("until"))), F.col("date") <= F.col("until"))
    last = settled.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("date")))).where("k <= 40")
    return last.groupBy("key").agg(F.count("*").alias("n"), F.avg(100 * (F.col("latest") / F.col("first") - 1)).alias("mean_revision")).where("n >= 8")


@query("""select q_index, sum(n * n - l * l) over (order by q_index) as cssfed, avg(miss) over (order by q_index rows between unbounded preceding and 1 preceding) as expanding_bias from (
    select q_index, miss, growth_mean - actual as n, miss as l from (select *, avg(actual) over (order by q_index rows between 40 preceding and 1 preceding) as growth_mean from misses) where growth_mean is not null)""", ratios=("cssfed", "expanding_bias"))
def cumulative_errors(spark: S, d: str) -> DataFrame:
    """Cumulative difference of squared errors of two naive benchmarks (mean of 40 quarters, last growth); expanding bias."""
    w = Window.orderBy("q_index")
    m = t.misses(spark, d).withColumn("mean", F.avg("actual").over(w.rowsBetween(-40, -1))).where("mean is not null")
    diff = F.pow(F.col("mean") - F.col("actual"), 2) - F.pow("miss", 2)
    return m.select("q_index", F.sum(diff).over(w).alias("cssfed"), F.avg("miss").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("expanding_bias"))


@query("""select user_id, run_date, value, value - lag(value) over w as change, value - first_value(value) over w as since_first from (select user_id, run_date, avg(value) as value from runs_a group by 1, 2) window w as (partition by user_id order by run_date)""", ratios=("value", "change", "since_first"))
def vintage_history(spark: S, d: str) -> DataFrame:
    """Change of each vintage from the one before and from the first."""
    w = Window.partitionBy("user_id").orderBy("run_date")
    v = t.runs(spark, d, "view").groupBy("user_id", "run_date").agg(F.avg("value").alias("value"))
    return v.select("user_id", "run_date", "value", (F.col("value") - F.lag("value").over(w)).alias("change"), (F.col("value") - F.first("value").over(w)).alias("since_first"))


@query("""select key, date, latest, latest - b as change, 100 * (latest / nullif(b, 0) - 1) as pct from (select *, lag(latest) over (partition by key order by date) as b, row_number() over (partition by key order by date desc) as k from revisions) where k = 1""", levels=("latest", "change"), ratios=("pct",))
def indicator_table(spark: S, d: str) -> DataFrame:
    """Latest value of each series with its change and percent change."""
    w = Window.partitionBy("key").orderBy("date")
    r = t.revisions(spark, d).withColumn("b", F.lag("latest").over(w))
    return joins.latest(r, ["key"], F.desc("date")).select("key", "date", "latest", (F.col("latest") - F.col("b")).alias("change"), (100 * (F.col("latest") / F.nullif(F.col("b"), F.lit(0.0)) - 1)).alias("pct"))


@query(f"select stage, key, impact from (select stage, key, sum(error) as impact, row_number() over (partition by stage order by abs(sum(error)) desc, key) as k from {ERRORS} group by stage, key) where k <= 5", ratios=("impact",))
def top_impacts(spark: S, d: str) -> DataFrame:
    """Five largest impacts of each stage, by size."""
    i = errors(spark, d).groupBy("stage", "key").agg(F.sum("error").alias("impact"))
    return i.withColumn("k", F.row_number().over(Window.partitionBy("stage").orderBy(F.desc(F.abs("impact")), "key"))).where("k <= 5").drop("k")


TRACK = """select q_index, model, actual, (model + mean4) / 2 as combo, (model + mean4) / 2 - actual as error from (select *, avg(actual) over (order by q_index rows between 4 preceding and 1 preceding) as mean4 from misses) where mean4 is not null"""


@query(f"""select count(*) as n, avg(error) as bias, avg(abs(error)) as mae, sqrt(avg(error * error)) as rmse, quantile_cont(abs(error), 0.68) as p68, quantile_cont(abs(error), 0.95) as p95, avg(abs(error)) - avg(abs(model - actual)) as edge,
    count(*) filter (abs(error) < abs(model - actual)) as closer from ({TRACK})""", ratios=("bias", "mae", "rmse", "p68", "p95", "edge"))
def track_record(spark: S, d: str) -> DataFrame:
    """Published record of the combined estimate: two cheap arms, their mean, its errors, bands and edge over one arm."""
    mean4 = F.avg("actual").over(Window.orderBy("q_index").rowsBetween(-4, -1))
    m = t.misses(spark, d).withColumn("mean4", mean4).where("mean4 is not null").withColumn("error", (F.col("model") + F.col("mean4")) / 2 - F.col("actual"))
    naive = F.abs(F.col("model") - F.col("actual"))
    return m.agg(*bands.scores(F.col("error")), *bands.quantiles(F.col("error")), (F.avg(F.abs("error")) - F.avg(naive)).alias("edge"), F.count(F.when(F.abs("error") < naive, 1)).alias("closer"))


@query("""select key, regr_slope(latest, first) as slope, regr_intercept(latest, first) as intercept, regr_r2(latest, first) as r2, regr_count(latest, first) as n from revisions group by key""", ratios=("slope", "r2"), levels=("intercept",))
def simple_regression(spark: S, d: str) -> DataFrame:
    """Regression of the latest value on the first print, by series."""
    r = t.revisions(spark, d).where("first is not null")
    return r.groupBy("key").agg(F.regr_slope("latest", "first").alias("slope"), F.regr_intercept("latest", "first").alias("intercept"), F.regr_r2("latest", "first").alias("r2"), F.regr_count("latest", "first").alias("n"))
