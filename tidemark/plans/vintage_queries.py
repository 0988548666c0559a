"""Queries on vintages and published records: nearest and final vintages, carried components, stage fallbacks, payload rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import joins
from tidemark.plans.registry import query
from tidemark.plans.score_queries import ERRORS, errors
from tidemark.sources import tables as t

S = SparkSession


@query("""select q_index, run_date, value from (select q.q_index, r.run_date, r.value, row_number() over (partition by q.q_index order by abs(r.run_date - q.target), r.run_date, r.event_id) as n
    from (select q_index, date '2024-01-01' + q_index % 28 as target from target_q) q cross join runs_a r) where n = 1""", ratios=("value",))
def nearest_vintage(spark: S, d: str) -> DataFrame:
    """The run nearest in days to each target date: the last at or before it and the first at or after it, by two as-of joins, then the nearer (the earlier of equals)."""
    target = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("q_index") % 28).cast("int"))
    q = t.target_q(spark, d).select("q_index", target.alias("target"))
    daily = joins.latest(t.runs(spark, d, "view"), ["run_date"], F.col("event_id")).select("run_date", "event_id", "value")
    day = lambda c, sign: (sign * F.datediff(c, F.lit("1970-01-01").cast("date"))).alias("at")
    one = F.lit(1).alias("all")  # all are of one key, so years are split

    def side(sign: int) -> DataFrame:
        found = joins.as_of(q.select(one, "q_index", "target", day("target", sign)), daily.select(one, day("run_date", sign), "run_date", "value", "event_id"), ["all"], "at", ["run_date", "value"], "event_id", span=lambda c: F.floor(c / 365))
        return found.where("right_run_date is not null").select("q_index", "target", F.col("right_run_date").alias("run_date"), F.col("right_value").alias("value"))

    return joins.latest(side(1).unionByName(side(-1)), ["q_index"], F.abs(F.datediff("run_date", "target")), F.col("run_date")).select("q_index", "run_date", "value")


@query("""select user_id, run_date, value, releases from (select user_id, run_date, value, releases, row_number() over (partition by user_id, releases order by run_date desc, event_id desc) as n from (
    select *, cast(date_trunc('week', run_date) + interval 7 day as date) as releases from runs_a)) where n = 1""", ratios=("value",))
def final_vintages(spark: S, d: str) -> DataFrame:
    """The last run strictly before each weekly release, by key."""
    releases = F.date_add(F.trunc("run_date", "week"), 7)
    r = t.runs(spark, d, "view").withColumn("releases", releases)
    return joins.latest(r, ["user_id", "releases"], F.desc("run_date"), F.desc("event_id")).select("user_id", "run_date", "value", "releases")


@query(f"""select key, coalesce(s.n >= 12, false) as by_stage, coalesce(case when s.n >= 12 then s.sd end, p.sd) as sd, coalesce(case when s.n >= 12 then s.bias end, p.bias) as bias from (select distinct key from registry) k
    left join (select key, stddev_samp(error) as sd, avg(error) as bias, count(*) as n from {ERRORS} where stage = 0 and year >= 1999 group by key) s using (key) cross join (select stddev_samp(error) as sd, avg(error) as bias from {ERRORS} where year >= 1999) p""", ratios=("sd", "bias"))
def stage_parameters(spark: S, d: str) -> DataFrame:
    """Error parameters of a stage where it has at least 12 errors, else the pooled ones."""
    e = errors(spark, d).where("year >= 1999")
    stage = e.where("stage = 0").groupBy("key").agg(F.stddev_samp("error").alias("s_sd"), F.avg("error").alias("s_bias"), F.count("*").alias("n"))
    pooled = e.agg(F.stddev_samp("error").alias("p_sd"), F.avg("error").alias("p_bias"))
    both = t.registry(spark, d).select("key").join(stage, "key", "left").join(F.broadcast(pooled))  # one row
    ok = F.coalesce(F.col("n") >= 12, F.lit(False))
    return both.select("key", ok.alias("by_stage"), F.when(ok, F.col("s_sd")).otherwise(F.col("p_sd")).alias("sd"), F.when(ok, F.col("s_bias")).otherwise(F.col("p_bias")).alias("bias"))


@query("""select key, date, case when prior = date - interval 1 month then value - b end as change, case when prior = date - interval 1 month and b > 0 and value >= 0 then 100 * (value / b - 1) end as pct from (
    select *, lag(date) over w as prior, lag(value) over w as b from (select * from panel where value is not null) window w as (partition by key order by date))""", levels=("change",), ratios=("pct",))
def exact_period_changes(spark: S, d: str) -> DataFrame:
    """Changes only where the period before is there."""
    from tidemark.plans.panel_queries import gappy

    w = Window.partitionBy("key").orderBy("date")
    p = gappy(spark, d).where("value is not null").withColumns({"prior": F.lag("date").over(w), "b": F.lag("value").over(w)})
    exact = F.col("prior") == F.add_months("date", -1)
    return p.select("key", "date", F.when(exact, F.col("value") - F.col("b")).alias("change"), F.when(exact & (F.col("b") > 0) & (F.col("value") >= 0), 100 * (F.col("value") / F.col("b") - 1)).alias("pct"))


@query("""select user_id, day, last_value(v ignore nulls) over w as carried, cast(day - last_value(case when v is not null then day end ignore nulls) over w as integer) as stale_days from (
    select u.user_id, days.day, r.v from (select distinct user_id from runs_a) u cross join (select cast(unnest(generate_series(date '2024-01-01', date '2024-01-31', interval 1 day)) as date) as day) days
    left join (select user_id, run_date, avg(value) as v from runs_a group by 1, 2) r on r.user_id = u.user_id and r.run_date = days.day) window w as (partition by user_id order by day)""", ratios=("carried",))
def carried_component(spark: S, d: str) -> DataFrame:
    """The prior component carried to each day, with its age."""
    r = t.runs(spark, d, "view").groupBy("user_id", F.col("run_date").alias("day")).agg(F.avg("value").alias("v"))
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))).alias("day")
    spine = r.select("user_id").distinct().select("user_id", days).join(r, ["user_id", "day"], "left")
    w = Window.partitionBy("user_id").orderBy("day")
    return spine.select("user_id", "day", F.last("v", True).over(w).alias("carried"), F.datediff("day", F.last(F.when(F.col("v").isNotNull(), F.col("day")), True).over(w)).alias("stale_days"))


@query("""select q_index, growth from growth g where growth is not null and q_index not in (select q_index from growth where q_index % 3 = 0) and date + 60 - date <= 80 and q_index > (select min(q_index) + 4 from growth)""", ratios=("growth",))
def append_first_prints(spark: S, d: str) -> DataFrame:
    """New quarters to append to the first-release table: not yet in it and printed less than 80 days after."""
    g = t.growth(spark, d)
    known = g.where("q_index % 3 = 0").select("q_index")
    start = g.agg((F.min("q_index") + 4).alias("s"))
    fresh = g.where("growth is not null").withColumn("printed", F.date_add("date", 60)).where("datediff(printed, date) <= 80")
    return fresh.join(known, "q_index", "left_anti").join(F.broadcast(start), F.col("q_index") > F.col("s")).select("q_index", "growth")


@query("""select rule, q_index from (select 'band' as rule, q_index from (select q_index, growth, growth - p as lo, growth + case when q_index % 5 = 0 then -p else p end as hi from growth cross join (select quantile_cont(abs(miss), 0.68) as p from misses) where growth is not null) where not (lo < growth and growth < hi)
    union all select 'mean', q_index from (select q_index, (model + actual) / 2 + case when q_index % 7 = 0 then 0.01 else 0 end as combo, model, actual from misses) where abs(combo - (model + actual) / 2) > 1e-4 union all select 'gap', q_index from (select q_index, lag(q_index) over (order by q_index) as b from target_q) where b is not null and q_index <> b + 1)""")
def payload_problems(spark: S, d: str) -> DataFrame:
    """Rules of a published payload as rows, on records with faults put in: band order, mean of the parts, no gap."""
    m = t.misses(spark, d)
    p = m.agg(F.percentile(F.abs("miss"), F.lit(0.68)).alias("p"))
    g = t.growth(spark, d).where("growth is not null").join(F.broadcast(p))  # one row
    hi = F.col("growth") + F.when(F.col("q_index") % 5 == 0, -F.col("p")).otherwise(F.col("p"))
    band = g.where(~((F.col("growth") - F.col("p") < F.col("growth")) & (F.col("growth") < hi))).select(F.lit("band").alias("rule"), "q_index")
    combo = (F.col("model") + F.col("actual")) / 2 + F.when(F.col("q_index") % 7 == 0, 0.01).otherwise(0.0)
    mean = m.where(F.abs(combo - (F.col("model") + F.col("actual")) / 2) > 1e-4).select(F.lit("mean").alias("rule"), "q_index")
    gap = t.target_q(spark, d).withColumn("b", F.lag("q_index").over(Window.orderBy("q_index"))).where("b is not null and q_index <> b + 1").select(F.lit("gap").alias("rule"), "q_index")
    return band.unionByName(mean).unionByName(gap)


@query("""select q_index, actual, avg(miss) over (order by q_index rows between unbounded preceding and 2 preceding) as expanding, avg(miss) over (order by q_index rows between 9 preceding and 2 preceding) as rolling from misses""", ratios=("actual", "expanding", "rolling"))
def real_time_bias(spark: S, d: str) -> DataFrame:
    """Expanding and rolling mean of the misses already released when each quarter is estimated."""
    w = Window.orderBy("q_index")
    return t.misses(spark, d).select("q_index", "actual", F.avg("miss").over(w.rowsBetween(Window.unboundedPreceding, -2)).alias("expanding"), F.avg("miss").over(w.rowsBetween(-9, -2)).alias("rolling"))
