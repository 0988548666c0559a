"""Queries on panels: spine, shifts, joins, point-in-time cuts, guards, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import joins, panel
from tidemark.plans.registry import query
from tidemark.sources import tables as t

S = SparkSession
STEP = "interval 1 month"


def gappy(spark: S, sf_dir: str) -> DataFrame:
    """The panel on its spine, without the fifth and tenth month of each year."""
    return panel.spine(t.monthly(spark, sf_dir)).withColumn("value", F.when(F.month("date") % 5 != 0, F.col("value")))


@query("select * from monthly", levels=("value",))
def long_panel(spark: S, d: str) -> DataFrame:
    """Canonical long table: key, date, value."""
    return t.monthly(spark, d)


@query("select key, date, value, value is null as missing from panel", levels=("value",))
def dense_spine(spark: S, d: str) -> DataFrame:
    """Month spine left-joined with every series."""
    return gappy(spark, d).withColumn("missing", F.col("value").isNull())


@query("select date, " + ", ".join(f"sum(value) filter (category = '{c}') as {c.replace(' ', '_').lower()}" for c in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " from monthly join registry using (key) group by date",
       levels=("africa", "america", "asia", "europe", "middle_east"))
def wide_panel(spark: S, d: str) -> DataFrame:
    """Pivot of the long panel, one column a category; the columns are listed, so one pass does."""
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = t.monthly(spark, d).join(t.registry(spark, d), "key").groupBy("date").pivot("category", names).agg(F.sum("value"))
    return wide.toDF("date", *(n.replace(" ", "_").lower() for n in names))


@query("select key, date, 'first' as release, first as value from revisions where first is not null union all select key, date, 'latest', latest from revisions", levels=("value",))
def untidy_panel(spark: S, d: str) -> DataFrame:
    """Unpivot of two columns to long rows, without the missing."""
    return t.revisions(spark, d).unpivot(["key", "date"], ["first", "latest"], "release", "value").where("value is not null")


@query("""select key, date, tcode, case tcode when 'lin' then value when 'chg' then value - b when 'pch' then 100 * (value / nullif(b, 0) - 1) else 100 * (power(value / nullif(b, 0), 12) - 1) end as x
    from (select p.*, tcode, lag(value) over (partition by p.key order by date) as b from dense p join registry r on p.key = r.key)""", levels=("x",))
def transform_panel(spark: S, d: str) -> DataFrame:
    """lin, chg, pch, pca by the registry's code, on the dense spine."""
    return panel.transformed(panel.spine(t.monthly(spark, d)).join(t.registry(spark, d), "key")).select("key", "date", "tcode", "x")


@query("""select key, date, t1, t2, t3, t4, t2 - lag(t2) over w as t5, t3 - lag(t3) over w as t6, t4 - lag(t4) over w as t7 from (
    select key, date, t1, t1 - lag(t1) over w as t2, t1 - lag(t1, 4) over w as t3, t1 - lag(t1, 12) over w as t4 from (select key, date, ln(case when value > 0 then value end) as t1 from panel)
    window w as (partition by key order by date)) window w as (partition by key order by date)""", ratios=tuple(f"t{k}" for k in range(1, 8)))
def log_differences(spark: S, d: str) -> DataFrame:
    """t1 to t7: levels, changes over 1, 4 and 12 months and changes of those, of logs."""
    return panel.differences(gappy(spark, d)).select("key", "date", *(f"t{k}" for k in range(1, 8)))


@query("""select key, date, 100 * value / nullif(lag(value) over w, 0) - 100 as m1, 100 * value / nullif(lag(value, 3) over w, 0) - 100 as m3, 100 * value / nullif(lag(value, 12) over w, 0) - 100 as m12
    from dense window w as (partition by key order by date)""", ratios=("m1", "m3", "m12"))
def percent_growth(spark: S, d: str) -> DataFrame:
    """Growth over n months, n = 1, 3, 12."""
    w = panel.over()
    return panel.spine(t.monthly(spark, d)).select("key", "date", *((100 * panel.ratio(F.col("value"), F.lag("value", n).over(w)) - 100).alias(f"m{n}") for n in (1, 3, 12)))


@query("""select key, date, case when rms > 0 then c / rms end as scaled from (select *, sqrt(sum(c * c) over (partition by key) / (count(c) over (partition by key) - 1)) as rms from (
    select key, date, value - case when nth <= n - 23 then ahead else last end as c from (select *, avg(case when nth > n - 24 then value end) over (partition by key) as last from (
    select *, count(*) over (partition by key) as n, row_number() over (partition by key order by date) as nth, avg(value) over (partition by key order by date rows between current row and 23 following) as ahead from panel))))""", ratios=("scaled",))
def rolling_scale(spark: S, d: str) -> DataFrame:
    """Forward rolling mean removed (24 months, the last window near the end), over the root mean square."""
    return panel.rolling_scaled(gappy(spark, d), 24).select("key", "date", "scaled")


@query("select key, date, (value - avg(value) over (partition by key)) / case when stddev_samp(value) over (partition by key) > 0 then stddev_samp(value) over (partition by key) else 1 end as z from panel", ratios=("z",))
def standardise(spark: S, d: str) -> DataFrame:
    """z scores with one degree of freedom, missing values ignored."""
    return panel.standardised(gappy(spark, d)).select("key", "date", "z")


@query("""select key, date, coalesce(value, va + (date - da) / cast(db - da as double) * (vb - va)) as filled, value is null as was_missing from (
    select *, last_value(case when value is not null then date end ignore nulls) over b as da, last_value(value ignore nulls) over b as va,
    first_value(case when value is not null then date end ignore nulls) over f as db, first_value(value ignore nulls) over f as vb from panel
    window b as (partition by key order by date rows between unbounded preceding and current row), f as (partition by key order by date rows between current row and unbounded following))""", ratios=("filled",))
def interpolate_gaps(spark: S, d: str) -> DataFrame:
    """Interior gaps, linear in days; ends stay missing."""
    return panel.interpolated(gappy(spark, d)).select("key", "date", "filled", F.col("value").isNull().alias("was_missing"))


@query("""select key, date, value, 100 * value / cpi as real from (select p.key, p.date, value, last_value(c ignore nulls) over (partition by p.key order by p.date rows between unbounded preceding and current row) as cpi
    from panel p left join (select date, 100 * value / first_value(value) over (order by date) as c from target_q) q on p.date = q.date) where cpi is not null""", levels=("value",), ratios=("real",))
def deflate_step(spark: S, d: str) -> DataFrame:
    """Nominal over a quarterly index carried on as a step, so nothing looks ahead."""
    index = t.target_q(spark, d).select("date", (100 * F.col("value") / F.first("value").over(Window.orderBy("date"))).alias("c"))
    both = panel.carried(gappy(spark, d).join(F.broadcast(index), "date", "left"), "c", "cpi")  # index: one row a quarter
    return both.where("cpi is not null").select("key", "date", "value", (100 * F.col("value") / F.col("cpi")).alias("real"))


@query("""with o as (select key, date, first as old from revisions where first > 0), n as (select key, date, value as new from monthly where date >= date '1997-01-01'),
    j as (select key, date, new, old from n full join o using (key, date)), f as (select *, count(case when new > 0 and old > 0 then 1 end) over (partition by key) as overlap,
    exp(avg(case when new > 0 and old > 0 then ln(new / old) end) over (partition by key)) as factor, min(case when new is not null then date end) over (partition by key) as start from j)
    select key, date, coalesce(new, case when date < start and overlap >= 6 then old * factor end) as value, overlap, new is null as from_old from f where coalesce(new, case when date < start and overlap >= 6 then old * factor end) is not null""", levels=("value",))
def splice(spark: S, d: str) -> DataFrame:
    """Older tier rescaled by the geometric mean ratio over the overlap."""
    old = t.revisions(spark, d).where("first > 0").select("key", "date", F.col("first").alias("value"))
    return panel.spliced(t.monthly(spark, d).where("date >= date'1997-01-01'"), old)


@query("""select m.key, m.date, a.asof, m.value, date_add(m.date, to_days(r.lag_days)) <= a.asof as by_date, last_day(m.date) + r.lag_days <= a.asof as by_month_end
    from monthly m join registry r on m.key = r.key cross join (select last_day(date) as asof from months) a where m.date + r.lag_days <= a.asof""", levels=("value",))
def as_of_cut(spark: S, d: str) -> DataFrame:
    """What had been published at each month's end, by date + lag and by month end + lag; the as-of dates from a row's release on are listed with it."""
    data = t.monthly(spark, d)
    ends = data.agg(F.max("date").alias("until"))  # one row
    cut = data.join(t.registry(spark, d), "key").withColumn("released", F.expr("date_add(date, lag_days)")).join(F.broadcast(ends)).where("released <= last_day(until)")
    asof = F.explode(F.transform(F.sequence(F.trunc("released", "MM"), "until", F.expr("interval 1 month")), lambda x: F.last_day(x))).alias("asof")
    return cut.select("key", "date", "value", "lag_days", asof).select("key", "date", "asof", "value", F.lit(True).alias("by_date"), (F.expr("date_add(last_day(date), lag_days)") <= F.col("asof")).alias("by_month_end"))


@query("""select key, as_of, max(date) as last_date, cast(as_of - max(date) as integer) as age_days, cast(as_of - max(date) as integer) > any_value(lag_days) + 31 + 21 as stale from (
    select m.key, m.date, a.as_of, r.lag_days from monthly m join registry r on m.key = r.key cross join (select last_day(date) as as_of from months) a
    where r.key <> 'NATION_3' and m.date + r.lag_days <= a.as_of or r.key = 'NATION_3' and m.date <= date '1996-01-01' and m.date <= a.as_of) group by key, as_of""")
def freshness(spark: S, d: str) -> DataFrame:
    """Age of each series at every month end against lag + interval + 21 days: an as-of join, linear in the rows."""
    data = t.monthly(spark, d)
    ends = data.agg(F.min("date").alias("since"), F.max("date").alias("until"))  # one row
    months = F.explode(F.transform(F.sequence("since", "until", F.expr("interval 1 month")), lambda x: F.last_day(x))).alias("as_of")
    registry = t.registry(spark, d).select("key", "lag_days")
    grid = data.select("key").distinct().join(registry, "key").join(F.broadcast(ends)).select("key", "lag_days", months)
    released = data.join(registry, "key").where("key <> 'NATION_3' or date <= date'1996-01-01'").select("key", F.when(F.col("key") == "NATION_3", F.col("date")).otherwise(F.expr("date_add(date, lag_days)")).alias("as_of"), "date", F.datediff("date", F.lit("1970-01-01").cast("date")).alias("n"))
    seen = joins.as_of(grid, released, ["key"], "as_of", ["date"], "n").where("right_date is not null").withColumnRenamed("right_date", "last_date")
    age = F.datediff("as_of", "last_date")
    return seen.select("key", "as_of", "last_date", age.alias("age_days"), (age > F.col("lag_days") + 52).alias("stale"))


@query("""select key, count(*) as rows, count(value) as present, count(*) - count(value) as missing, min(case when value is not null then date end) as first_date, max(case when value is not null then date end) as last_date,
    max(gap) as longest_gap from (select key, date, value, case when value is not null then cast(date_diff('month', lag(date) over (partition by key, value is not null order by date), date) as integer) end as gap from panel) group by key""")
def data_quality(spark: S, d: str) -> DataFrame:
    """Counts, ends and the longest gap of each series."""
    w = Window.partitionBy("key", F.col("value").isNotNull()).orderBy("date")
    gap = F.when(F.col("value").isNotNull(), F.months_between("date", F.lag("date").over(w)).cast("int"))
    seen = F.when(F.col("value").isNotNull(), F.col("date"))
    return gappy(spark, d).withColumn("gap", gap).groupBy("key").agg(F.count("*").alias("rows"), F.count("value").alias("present"), (F.count("*") - F.count("value")).alias("missing"), F.min(seen).alias("first_date"), F.max(seen).alias("last_date"), F.max("gap").alias("longest_gap"))


@query("""select 'grid' as rule, key, cast(date as varchar) as detail from (select key, date, lag(date) over (partition by key order by date) as b from (select * from panel where value is not null)) where b is not null and date <> b + interval 1 month
    union all select 'duplicate', key, cast(date as varchar) from monthly group by key, date having count(*) > 1
    union all select 'coverage', key, cast(count(first) as varchar) from revisions group by key having count(first) < count(latest)""")
def violations(spark: S, d: str) -> DataFrame:
    """Guards as rows: broken month grid, duplicate dates, fewer first prints than values. Empty means all pass."""
    seen = gappy(spark, d).where("value is not null")
    grid = seen.withColumn("b", F.lag("date").over(panel.over())).where("b is not null and date <> add_months(b, 1)").select(F.lit("grid").alias("rule"), "key", F.col("date").cast("string").alias("detail"))
    twice = t.monthly(spark, d).groupBy("key", "date").count().where("count > 1").select(F.lit("duplicate").alias("rule"), "key", F.col("date").cast("string").alias("detail"))
    fewer = t.revisions(spark, d).groupBy("key").agg(F.count("first").alias("f"), F.count("latest").alias("l")).where("f < l").select(F.lit("coverage").alias("rule"), "key", F.col("f").cast("string").alias("detail"))
    return grid.unionByName(twice).unionByName(fewer)


PAIR_SQL = """select a.user_id, a.event_id, a.run_date, a.value, b.event_id as right_event_id, b.value as right_value from (
    select a.*, (select max(b.ts) from runs_b b where b.user_id = a.user_id and b.ts <= a.ts {cut}) as at from runs_a a) a
    left join (select user_id, ts, max(event_id) as event_id, arg_max(value, event_id) as value from runs_b group by 1, 2) b on a.user_id = b.user_id and b.ts = a.at"""


@query(PAIR_SQL.format(cut="and cast(a.ts as date) - cast(b.ts as date) <= 7"), levels=("value", "right_value"))
def as_of_pair(spark: S, d: str) -> DataFrame:
    """Each run with the latest partner run at or before it, no more than 7 days old."""
    out = joins.as_of(t.runs(spark, d, "view"), t.runs(spark, d, "click"), ["user_id"], "ts", ["event_id", "value"], "event_id", 7, lambda c: F.date_trunc("week", c))
    return out.select("user_id", "event_id", "run_date", "value", "right_event_id", "right_value")


@query(PAIR_SQL.format(cut=""), levels=("value", "right_value"))
def as_of_latest(spark: S, d: str) -> DataFrame:
    """The same without a tolerance."""
    out = joins.as_of(t.runs(spark, d, "view"), t.runs(spark, d, "click"), ["user_id"], "ts", ["event_id", "value"], "event_id", span=lambda c: F.date_trunc("week", c))
    return out.select("user_id", "event_id", "run_date", "value", "right_event_id", "right_value")


@query("select a.user_id, a.run_date, avg(a.value) as v2, avg(b.value) as v3, (avg(a.value) + avg(b.value)) / 2 as combo from runs_a a join runs_b b on a.user_id = b.user_id and a.run_date = b.run_date group by 1, 2", ratios=("v2", "v3", "combo"))
def pair_equal(spark: S, d: str) -> DataFrame:
    """Inner pair of two models' runs of one day; each side is aggregated before the join."""
    one = t.runs(spark, d, "view").groupBy("user_id", "run_date").agg(F.avg("value").alias("v2"))
    two = t.runs(spark, d, "click").groupBy("user_id", "run_date").agg(F.avg("value").alias("v3"))
    return one.join(two, ["user_id", "run_date"]).withColumn("combo", (F.col("v2") + F.col("v3")) / 2)


@query("""with b as (select key, date, first as value from revisions where first is not null and month(date) <> 3), a as (select key, date, latest as value from revisions where month(date) <> 4)
    select key, date, b.value as before, a.value as after, case when b.key is null then 'added' when a.key is null then 'dropped' else 'changed' end as change from b full join a using (key, date) where b.key is null or a.key is null or b.value is distinct from a.value""", levels=("before", "after"))
def snapshot_changes(spark: S, d: str) -> DataFrame:
    """Full-outer difference of two snapshots."""
    r = t.revisions(spark, d)
    before = r.where("first is not null and month(date) <> 3").select("key", "date", F.round("first", 6).alias("value"))
    return joins.changes(before, r.where("month(date) <> 4").select("key", "date", F.round("latest", 6).alias("value")), ["key", "date"])


@query("select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders)")
def cache_missing(spark: S, d: str) -> DataFrame:
    """Anti join: what the cache lacks."""
    return t.table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(t.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("select key, date, latest from revisions r where exists (select 1 from revisions f where f.key = r.key and f.date = r.date and f.first is not null)", levels=("latest",))
def common_periods(spark: S, d: str) -> DataFrame:
    """Semi join: only periods that both have."""
    r = t.revisions(spark, d)
    return r.select("key", "date", "latest").join(r.where("first is not null").select("key", "date"), ["key", "date"], "left_semi")


@query("""select g.q_index, g.value, p.value as year_ago, 100 * (g.value / p.value - 1) as yoy, m.miss from target_q g left join target_q p on p.q_index = g.q_index - 4 left join misses m on m.q_index = g.q_index""", levels=("value", "year_ago"), ratios=("yoy", "miss"))
def finals_with_year_ago(spark: S, d: str) -> DataFrame:
    """Finals with the level four quarters before and the benchmark, by two left joins."""
    q = t.target_q(spark, d)
    ago = q.select((F.col("q_index") + 4).alias("q_index"), F.col("value").alias("year_ago"))
    return q.join(ago, "q_index", "left").join(t.misses(spark, d).select("q_index", "miss"), "q_index", "left").select("q_index", "value", "year_ago", (100 * (F.col("value") / F.col("year_ago") - 1)).alias("yoy"), "miss")


@query("""select coalesce(a.key, b.key) as key, a.lag_days, b.supplier_days from (select key, lag_days from registry where lag_days < 50) a full join
    (select n_name as key, cast(count(*) as bigint) as supplier_days from supplier join nation on s_nationkey = n_nationkey where n_name <> 'NATION_18' group by 1) b on a.key = b.key""")
def merge_registries(spark: S, d: str) -> DataFrame:
    """Outer merge of two registries on a mapped key."""
    two = t.table(spark, d, "supplier").join(t.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("n_name <> 'NATION_18'").groupBy(F.col("n_name").alias("key")).agg(F.count("*").alias("supplier_days"))
    return t.registry(spark, d).where("lag_days < 50").select("key", "lag_days").join(two, "key", "full")


@query("""select user_id, run_date, source, event_id, value from (select *, row_number() over (partition by user_id, run_date order by prio, event_id desc) as n from (
    select user_id, run_date, event_id, value, 'live' as source, 1 as prio from runs_b union all select user_id, run_date, event_id, value, 'backfilled', 2 from runs_a)) where n = 1""", levels=("value",))
def priority_merge(spark: S, d: str) -> DataFrame:
    """One row a key by source priority, then the newest: live beats backfilled."""
    live = t.runs(spark, d, "click").withColumns({"source": F.lit("live"), "prio": F.lit(1)})
    both = live.unionByName(t.runs(spark, d, "view").withColumns({"source": F.lit("backfilled"), "prio": F.lit(2)}))
    return joins.latest(both, ["user_id", "run_date"], F.col("prio"), F.desc("event_id")).select("user_id", "run_date", "source", "event_id", "value")


@query("select key, date, coalesce(l.v, s.first) as value from revisions s left join (select key, date, latest as v from revisions where month(date) = 12) l using (key, date) union all select 'NEW', date '2030-01-01', 1.0", levels=("value",))
def upsert_rows(spark: S, d: str) -> DataFrame:
    """Keyed upsert: fresh rows replace stored ones, others stay."""
    r = t.revisions(spark, d)
    fresh = r.where("month(date) = 12").select("key", "date", F.col("latest").alias("value")).unionByName(spark.sql("select 'NEW' as key, date'2030-01-01' as date, 1.0D as value"))
    return joins.upsert(r.select("key", "date", F.col("first").alias("value")), fresh, ["key", "date"])


@query("select key, cast(year(date) * 4 + quarter(date) - 1 as integer) as q_index, avg(value) as value, count(value) as months from panel group by 1, 2", ratios=("value",))
def to_quarters(spark: S, d: str) -> DataFrame:
    """Monthly to quarterly means with the number of months that have data."""
    return gappy(spark, d).groupBy("key", (F.year("date") * 4 + F.quarter("date") - 1).alias("q_index")).agg(F.avg("value").alias("value"), F.count("value").alias("months"))


@query("""select q.q_index, m.key, max(case when date_diff('month', m.date, q.date) = 0 then m.value end) as k0, max(case when date_diff('month', m.date, q.date) = 1 then m.value end) as k1, max(case when date_diff('month', m.date, q.date) = 2 then m.value end) as k2
    from target_q q join panel m on date_diff('month', m.date, q.date) between 0 and 2 group by 1, 2""", levels=("k0", "k1", "k2"))
def mixed_lags(spark: S, d: str) -> DataFrame:
    """Quarter rows with monthly lags 0 to 2: a month names its quarter, so this is one aggregation, not a range join."""
    quarter = F.year("date") * 4 + F.quarter("date") - 1
    lag = 2 - (F.month("date") - 1) % 3
    q = t.target_q(spark, d).select("q_index")
    stacked = gappy(spark, d).withColumns({"q_index": quarter, "k": lag}).groupBy("q_index", "key").agg(*(F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"k{k}") for k in range(3)))
    return stacked.join(F.broadcast(q), "q_index", "left_semi")


@query("""select key, value is null as missing, min(date) as first, max(date) as last, count(*) as n from (select *, sum(c) over (partition by key order by date) as run from (
    select *, case when (value is null) is not distinct from lag(value is null) over (partition by key order by date) then 0 else 1 end as c from panel)) group by key, run, value is null""")
def broken_runs(spark: S, d: str) -> DataFrame:
    """Stretches of present and of missing values."""
    return panel.runs_of(gappy(spark, d).withColumn("missing", F.col("value").isNull()), "key", "date", "missing")


@query("""select key, date, case when date between date '1997-03-01' and date '1997-07-01' then null else value end as masked, coalesce(value, avg(value) over (partition by key)) as mean_filled,
    coalesce(value, median(value) over (partition by key)) as median_filled, coalesce(value, 0) as zero_filled from panel""", levels=("masked", "zero_filled"), ratios=("mean_filled", "median_filled"))
def mask_and_impute(spark: S, d: str) -> DataFrame:
    """A window of months masked for all series; mean, median and zero imputation."""
    w = Window.partitionBy("key")
    return gappy(spark, d).select("key", "date", F.when(~F.col("date").between(F.lit("1997-03-01").cast("date"), F.lit("1997-07-01").cast("date")), F.col("value")).alias("masked"), F.coalesce("value", F.avg("value").over(w)).alias("mean_filled"), F.coalesce("value", F.percentile("value", F.lit(0.5)).over(w)).alias("median_filled"), F.coalesce("value", F.lit(0.0)).alias("zero_filled"))


@query("select key, date, value, nth from (select *, row_number() over (partition by key order by value desc, date) as nth from monthly) where nth <= 5", levels=("value",))
def top_values(spark: S, d: str) -> DataFrame:
    """Top 5 of each series, ties by date."""
    return t.monthly(spark, d).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("value"), "date"))).where("nth <= 5")
