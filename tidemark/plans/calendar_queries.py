"""Queries on dates, labels, rates and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import bands, calendar
from tidemark.plans.registry import query
from tidemark.sources import tables as t

S = SparkSession
DAYS = "(select distinct cast(o_orderdate as date) as day from orders)"


def days(spark: S, d: str) -> DataFrame:
    return t.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()


@query("""select q_index, date as end_month, cast(q_index // 4 as varchar) || 'Q' || cast(q_index % 4 + 1 as varchar) as label, cast(q_index // 4 as varchar) || ' Q' || cast(q_index % 4 + 1 as varchar) as spaced,
    cast((q_index - 4) // 4 as varchar) || 'Q' || cast((q_index - 4) % 4 + 1 as varchar) as year_ago, cast(rd + cast((10 - dayofweek(rd)) % 7 as integer) as date) as release from (select *, cast(date + interval 3 month as date) as rd from target_q)""")
def quarter_calendar(spark: S, d: str) -> DataFrame:
    """Labels in both spellings, the label a year before, and the release date rule; labels parse back to the index."""
    i = F.col("q_index")
    q = t.target_q(spark, d).select("q_index", F.col("date").alias("end_month"), calendar.quarter_label(i).alias("label"), calendar.quarter_label(i, True).alias("spaced"), calendar.quarter_label(i - 4).alias("year_ago"), calendar.release_date(i).alias("release"))
    return q.where((calendar.parsed_quarter(F.col("label")) == i) & (calendar.parsed_quarter(F.col("spaced")) == i) & (calendar.quarter_end_month(i) == F.col("end_month")))


@query(f"""select m, cast(m + cast((9 - dayofweek(m)) % 7 as integer) + 7 as date) as second_tuesday, cast(m + cast((8 - dayofweek(m)) % 7 as integer) as date) as first_monday,
    cast(last_day(m) - cast((dayofweek(last_day(m)) - 5 + 7) % 7 as integer) as date) as last_friday, cast(m + case dayofweek(m) when 6 then 2 when 0 then 1 else 0 end as date) as first_workday,
    cast(least(last_day(cast(m + interval 1 month as date)), cast(m + interval 1 month as date) + 30) as date) as shifted, cast(year(m) * 12 + month(m) - 1 as integer) as month_idx from (select distinct cast(date_trunc('month', day) as date) as m from {DAYS})""")
def weekday_rules(spark: S, d: str) -> DataFrame:
    """n-th and last weekdays, first working day, month shifts that clamp the day, month index."""
    m = F.col("m")
    months = days(spark, d).select(F.trunc("day", "MM").alias("m")).distinct()
    return months.select("m", calendar.nth_weekday(m, "Tue", 2).alias("second_tuesday"), calendar.nth_weekday(m, "Mon", 1).alias("first_monday"), calendar.last_weekday(m, "Fri").alias("last_friday"), calendar.first_workday(m).alias("first_workday"), F.last_day(F.add_months(m, 1)).alias("shifted"), (F.year(m) * 12 + F.month(m) - 1).alias("month_idx"))


@query("""select y as year, cast(make_date(y, cast(mo as integer), cast(da as integer)) + 1 as date) as easter_monday from (select y, (h + l - 7 * mm + 114) // 31 as mo, (h + l - 7 * mm + 114) % 31 + 1 as da from (
    select *, (a + 11 * h + 22 * l) // 451 as mm from (select *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 as l from (select *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 as h from (
    select y, y % 19 as a, y // 100 as b, y % 100 as c from (select distinct cast(year(o_orderdate) as integer) + 20 as y from orders))))))""")
def easter(spark: S, d: str) -> DataFrame:
    """Easter Monday of each year."""
    years = t.table(spark, d, "orders").select((F.year("o_orderdate") + 20).alias("year")).distinct()
    return years.withColumn("easter_monday", calendar.easter_monday(F.col("year")))


@query("""select q.q_index, m.monday, cast(greatest(0, least(3, date_diff('month', q.first, m.monday))) as integer) as months_known, cast(q.release - m.monday as integer) as days_to_release from (
    select q_index, cast(date - interval 2 month as date) as first, cast(date + interval 100 day as date) as release from target_q) q join (select cast(unnest(generate_series((select date_trunc('week', min(date) - interval 3 month) from target_q), (select max(date) + interval 110 day from target_q), interval 7 day)) as date) as monday) m
    on m.monday >= q.first and m.monday < q.release""")
def mondays(spark: S, d: str) -> DataFrame:
    """Weekly as-of Mondays of each quarter until its release, months of data known, days left: a sequence, not a join."""
    q = t.target_q(spark, d).select("q_index", F.add_months("date", -2).alias("first"), F.date_add("date", 100).alias("release"))
    q = q.withColumn("monday", F.explode(F.sequence(F.next_day(F.date_sub("first", 1), "Mon"), F.date_sub("release", 1), F.expr("interval 7 day"))))
    known = F.greatest(F.lit(0), F.least(F.lit(3), F.months_between(F.trunc("monday", "MM"), "first").cast("int")))
    return q.select("q_index", "monday", known.alias("months_known"), F.datediff("release", "monday").alias("days_to_release"))


@query("""select g.q_index, growth, 100 * (power(1 + growth / 100, 4) - 1) as annualised, case when growth > -100 then 100 * (power(1 + growth / 100, 0.25) - 1) end as qoq, value / (1 + growth / 100) as previous,
    growth - 0.144 as lo68, growth + 0.144 as hi68, growth - 1.959964 * s as lo95, growth + 1.959964 * s as hi95 from growth g cross join (select stddev_samp(growth) as s from growth) where growth is not null""",
       levels=("previous",), ratios=("growth", "annualised", "qoq", "lo68", "hi68", "lo95", "hi95"))
def rates_and_bands(spark: S, d: str) -> DataFrame:
    """Annualised and quarterly rates, the level before, fixed and normal bands."""
    g = t.growth(spark, d).where("growth is not null")
    sd = g.agg(F.stddev_samp("growth").alias("s"))
    x = F.col("growth")
    return g.join(F.broadcast(sd)).select("q_index", "growth", bands.qoq_to_annualised(x).alias("annualised"), bands.annualised_to_qoq(x).alias("qoq"), bands.previous_level(F.col("value"), x).alias("previous"), (x - 0.144).alias("lo68"), (x + 0.144).alias("hi68"), (x - 1.959964 * F.col("s")).alias("lo95"), (x + 1.959964 * F.col("s")).alias("hi95"))


@query("""select q_index, 100 * (value / lag(value, 4) over w - 1) as yoy, 100 * ((1 + growth / 100) * (1 + lag(growth, 1) over w / 100) * (1 + lag(growth, 2) over w / 100) * (1 + lag(growth, 3) over w / 100) - 1) as chained
    from growth window w as (order by q_index)""", ratios=("yoy", "chained"))
def year_on_year(spark: S, d: str) -> DataFrame:
    """Growth over the same quarter last year, direct and compounded from four quarters."""
    w = Window.orderBy("q_index")
    four = F.aggregate(F.array(*(F.lag("growth", k).over(w) for k in range(4))), F.lit(1.0), lambda a, x: a * (1 + x / 100))
    return t.growth(spark, d).select("q_index", (100 * (F.col("value") / F.lag("value", 4).over(w) - 1)).alias("yoy"), (100 * (four - 1)).alias("chained"))


@query("""select q_index, 100 * exp(sum(ln(1 + coalesce(growth, 0) / 100)) over (order by q_index)) as idx, 100 * exp(sum(ln(1 + coalesce(growth, 0) / 100)) over (order by q_index)) * a / max(case when q_index = l then c end) over () as anchored
    from (select *, 100 * exp(sum(ln(1 + coalesce(growth, 0) / 100)) over (order by q_index)) as c, max(q_index) over () as l, last_value(value) over (order by q_index rows between unbounded preceding and unbounded following) as a from growth)""", ratios=("idx",), levels=("anchored",))
def growth_index(spark: S, d: str) -> DataFrame:
    """Cumulative product of growth, and rescaled to the last level."""
    w = Window.orderBy("q_index")
    idx = 100 * F.exp(F.sum(F.log(1 + F.coalesce("growth", F.lit(0.0)) / 100)).over(w))
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.growth(spark, d).withColumn("idx", idx).select("q_index", "idx", (F.col("idx") * F.last("value").over(every) / F.last("idx").over(every)).alias("anchored"))


@query("select key, lag_days, tcode, category, case when tcode in ('lin', 'chg') then 31 else 91 end as interval_days, lag_days + case when tcode in ('lin', 'chg') then 31 else 91 end + 21 as max_age from registry")
def registry_rules(spark: S, d: str) -> DataFrame:
    """Release interval and oldest age of each registered series."""
    every = F.when(F.col("tcode").isin("lin", "chg"), 31).otherwise(91)
    return t.registry(spark, d).withColumn("interval_days", every).withColumn("max_age", F.col("lag_days") + every + 21)
