"""The first-print recorder run over the backtest's as-of dates: prints, misses by variant, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators import prints
from tidemark.plans import backtest_queries as backtest
from tidemark.plans.registry import query
from tidemark.sources import tables as t

S = SparkSession

#: Stated run by run, as the weekly job would go: what is newest at each run decides.
RECORDED = f"""{backtest.GRID}, lv as (select q_index as quarter, value, cast(date + interval 3 month + to_days(cast((10 - isodow(date + interval 3 month)) % 7 as integer)) as date) as release from target_q),
    newest as (select as_of, max(quarter) as quarter from asofs join lv on release <= as_of group by 1),
    met as (select quarter, min(as_of) as recorded from newest group by 1),
    seen as (select quarter, min(as_of) as run from asofs join lv on release <= as_of group by 1),
    told as (select lv.quarter, lv.release, s.run as recorded, case when s.run is null then 'no run' when m.quarter is null then 'superseded' when p.quarter is null then 'no preceding quarter' when s.run - lv.release > {prints.MAX_AGE_DAYS} then 'stale' else 'recorded' end as status,
        round(100 * (lv.value / p.value - 1), 4) as g from lv left join met m using (quarter) left join seen s using (quarter) left join lv p on p.quarter = lv.quarter - 1),
    prints as (select quarter, release, recorded, status, case when status = 'recorded' then g end as first_print from told),
    ledger as (select v.variant, p.quarter, p.release, r.run_date, r.model, p.first_print, round(r.model - p.first_print, 4) as miss, case when r.model is null then 'no live estimate' else 'appended' end as status
        from (select distinct variant from runs) v cross join (select * from prints where first_print is not null) p
        left join (select runs.variant, runs.target, max(as_of) as run_date, arg_max(forecast, as_of) as model from runs join lv on lv.quarter = runs.target and runs.as_of < lv.release group by 1, 2) r on r.variant = v.variant and r.target = p.quarter)"""


def levels(spark: S, d: str) -> DataFrame:
    """quarter, value, release of the target."""
    return t.target_q(spark, d).select(F.col("q_index").alias("quarter"), "value", calendar.release_date(F.col("q_index")).alias("release"))


def run_dates(spark: S, d: str) -> DataFrame:
    """Month ends of the panel from the first as-of date of the backtest on."""
    ends = t.monthly(spark, d).agg(F.add_months(F.min("date"), backtest.HISTORY).alias("since"), F.max("date").alias("until")).where("since <= until")  # one row
    return ends.select(F.explode(F.sequence("since", "until", F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("run_date"))


def ledger(spark: S, d: str) -> DataFrame:
    h = backtest.backtest_runs(spark, d).select("variant", "target", F.col("as_of").alias("run_date"), F.lit(0).alias("seq"), F.col("forecast").alias("estimate"), F.lit("nowcast").alias("kind"), F.lit(False).alias("backfilled"))
    return prints.misses(prints.first_prints(levels(spark, d), run_dates(spark, d)), h, ["variant"])


@query(f"with {RECORDED} select quarter, release, recorded, status, first_print from prints")
def first_print_records(spark: S, d: str) -> DataFrame:
    """What the recorder did with each quarter: recorded as first print, or why not."""
    return prints.first_prints(levels(spark, d), run_dates(spark, d))


@query(f"with {RECORDED} select variant, quarter, release, run_date, model, first_print, miss, status from ledger", ratios=("model",))
def first_print_misses(spark: S, d: str) -> DataFrame:
    """Each variant's last estimate before a print, less the print."""
    return ledger(spark, d)


@query(f"""with {RECORDED}, ranked as (select v.variant, a.as_of, l.quarter, l.miss, row_number() over (partition by v.variant, a.as_of order by l.release desc) as n from (select distinct variant from ledger where miss is not null) v cross join asofs a
        left join ledger l on l.variant = v.variant and l.miss is not null and l.release <= a.as_of)
    select variant, as_of as run_date, case when count(miss) >= {prints.LEAST} then round(sum(cast(round(10000 * miss) as bigint)) / count(miss)) / 10000 end as pp, cast(count(miss) as integer) as n, case when count(miss) >= {prints.LEAST} then min(quarter) end as first_quarter, case when count(miss) >= {prints.LEAST} then max(quarter) end as last_quarter
    from ranked where n <= {prints.WINDOW} group by 1, 2""")
def first_print_corrections(spark: S, d: str) -> DataFrame:
    """The correction in force at each run date: the mean of the last eight misses printed by then."""
    return prints.corrections(ledger(spark, d), run_dates(spark, d), ["variant"])
