"""Small queries: relative errors, weights, limits, rules for dates and variants, tiers of an index, masks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators import panel
from tidemark.plans.panel_queries import gappy
from tidemark.plans.registry import query
from tidemark.plans.score_queries import ERRORS, errors
from tidemark.plans.source_queries import cells
from tidemark.sources import tables as t

S = SparkSession


@query(f"""select key, sqrt(avg(abs(error))) as rmae, sqrt(avg(abs(naive))) / sqrt(avg(abs(error))) - 1 as rel_rmae, avg(naive * naive) / avg(error * error) - 1 as rel_mse,
    sqrt(avg(naive * naive)) / sqrt(avg(error * error)) - 1 as rel_rmse, sum(first * first) / sum(latest * latest) as rsq, avg(error * error) as mse
    from (select *, 100 * (b / latest - 1) as naive from (select *, lag(latest) over (partition by key order by date) as b from {ERRORS}) where b is not null) group by key""",
    ratios=("rmae", "rel_rmae", "rel_mse", "rel_rmse", "rsq", "mse"))
def relative_errors(spark: S, d: str) -> DataFrame:
    """Root of the mean absolute error, mean squared error, how much larger those of no change are (relative to the first), and the uncentred share of squares."""
    e = errors(spark, d).withColumn("b", F.lag("latest").over(Window.partitionBy("key").orderBy("date"))).where("b is not null")
    naive = 100 * (F.col("b") / F.col("latest") - 1)
    square = lambda c: F.avg(c * c)
    g = e.groupBy("key").agg(
        F.sqrt(F.avg(F.abs("error"))).alias("rmae"), F.sqrt(F.avg(F.abs(naive))).alias("rmae2"), square(F.col("error")).alias("mse"), square(naive).alias("mse2"),
        (F.sum(F.col("first") * F.col("first")) / F.sum(F.col("latest") * F.col("latest"))).alias("rsq"),
    )
    more = lambda second, first: (second - first) / first
    return g.select("key", "rmae", more(F.col("rmae2"), F.col("rmae")).alias("rel_rmae"), more(F.col("mse2"), F.col("mse")).alias("rel_mse"), more(F.sqrt("mse2"), F.sqrt("mse")).alias("rel_rmse"), "rsq", "mse")


def relative_error(got: Column, wanted: Column) -> Column:
    """Relative, absolute where the wanted value is next to nothing."""
    return F.when(F.abs(wanted) < 1e-8, F.abs(got)).otherwise(F.abs(got - wanted) / F.abs(wanted))


@query("""select q_index, e, e <= 0.05 as ok from (select q_index, case when abs(w) < 1e-8 then abs(g) else abs(g - w) / abs(w) end as e from (select q_index, case when q_index % 9 = 0 then 0 else actual end as w, case when q_index % 9 = 0 then 0.001 when q_index % 4 = 0 then actual * 1.1 else actual * 1.01 end as g from misses))""", ratios=("e",))
def parity(spark: S, d: str) -> DataFrame:
    """Reproduced against published values, within five percent."""
    i, a = F.col("q_index"), F.col("actual")
    wanted = F.when(i % 9 == 0, 0.0).otherwise(a)
    got = F.when(i % 9 == 0, 0.001).when(i % 4 == 0, a * 1.1).otherwise(a * 1.01)
    return t.misses(spark, d).select("q_index", relative_error(got, wanted).alias("e")).withColumn("ok", F.col("e") <= 0.05)


@query(f"""select metric, value, recorded, abs(value - recorded) <= 0.02 * abs(recorded) as ok from (select unnest(['mae', 'rmse', 'bias']) as metric, unnest([mae, rmse, bias]) as value, unnest([mae * 1.01, rmse * 1.5, bias]) as recorded from (select avg(abs(error)) as mae, sqrt(avg(error * error)) as rmse, avg(error) as bias from {ERRORS}))""", ratios=("value", "recorded"))
def regression_gate(spark: S, d: str) -> DataFrame:
    """Metrics of a run against recorded ones, two percent allowed."""
    e = F.col("error")
    m = errors(spark, d).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))
    rows = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), (F.col(k) * w).alias("recorded")) for k, w in (("mae", 1.01), ("rmse", 1.5), ("bias", 1.0))))
    return m.select(F.inline(rows)).withColumn("ok", F.abs(F.col("value") - F.col("recorded")) <= 0.02 * F.abs("recorded"))


@query("""select n, k, case when n % 2 = 1 then 1 - abs(k - (n + 1) / 2.0) / ((n + 1) / 2.0) else 1 - abs(k - (n + 1) / 2.0) / (n / 2.0) end as triangle, x / sum(x) over (partition by n) as almon, y / sum(y) over (partition by n) as beta, greatest(0, 1 - abs(z)) as bartlett,
    case when abs(z) <= 0.5 then 1 - 6 * z * z + 6 * abs(z) ** 3 when abs(z) <= 1 then 2 * (1 - abs(z)) ** 3 else 0 end as parzen, case when abs(z) <= 1 then (1 + cos(pi() * z)) / 2 else 0 end as tukey from (
    select n, k, exp(0.1 * k - 0.05 * k * k) as x, greatest(1e-6, least(1 - 1e-6, (k - 1) / (n - 1.0))) ** 1.0 * (1 - greatest(1e-6, least(1 - 1e-6, (k - 1) / (n - 1.0)))) ** 4.0 as y, k / 4.0 as z from (select cast(r_regionkey as integer) + 3 as n from region), unnest(generate_series(1, n)) as u(k))""", ratios=("triangle", "almon", "beta", "bartlett", "parzen", "tukey"))
def lag_weights(spark: S, d: str) -> DataFrame:
    """Triangular window, exponential Almon and beta lag weights, and kernel weights, by length: arrays, no Python."""
    n = F.col("n")
    rows = t.table(spark, d, "region").select((F.col("r_regionkey") + 3).cast("int").alias("n"))
    ks = F.sequence(F.lit(1), n)
    clip = lambda k: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (k - 1) / (n - 1)))
    almon = F.transform(ks, lambda k: F.exp(0.1 * k - 0.05 * k * k))
    beta = F.transform(ks, lambda k: clip(k) * F.pow(1 - clip(k), 4.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    z = lambda k: k / 4
    parzen = lambda k: F.when(z(k) <= 0.5, 1 - 6 * F.pow(z(k), 2) + 6 * F.pow(z(k), 3)).when(z(k) <= 1, 2 * F.pow(1 - z(k), 3)).otherwise(0.0)
    tukey = lambda k: F.when(z(k) <= 1, (1 + F.cos(F.pi() * z(k))) / 2).otherwise(0.0)
    half = F.when(n % 2 == 1, (n + 1) / 2).otherwise(n / 2)
    parts = F.arrays_zip(
        ks.cast("array<bigint>").alias("k"), F.transform(ks, lambda k: 1 - F.abs(k - (n + 1) / 2) / half).alias("triangle"), F.transform(almon, lambda x: x / total(almon)).alias("almon"), F.transform(beta, lambda x: x / total(beta)).alias("beta"),
        F.transform(ks, lambda k: F.greatest(F.lit(0.0), 1 - z(k))).alias("bartlett"), F.transform(ks, parzen).alias("parzen"), F.transform(ks, tukey).alias("tukey"),
    )
    return rows.select("n", F.inline(parts))


ACF = """with g as (select key, date, 100 * ln(value / lag(value) over (partition by key order by date)) as x from dense), u as (select key, date, x - avg(x) over (partition by key) as u, count(*) over (partition by key) as n, row_number() over (partition by key order by date) as t from g where x is not null),
    r as (select a.key, l.lag, sum(a.u * b.u) / max(v.v) as acf, max(a.n) as n from u a join (select unnest(generate_series(1, 4)) as lag) l on true join u b on b.key = a.key and b.t = a.t - l.lag join (select key, sum(u * u) as v from u group by 1) v on v.key = a.key group by 1, 2)"""


@query(f"{ACF} select key, lag, acf, 1.959963984540054 / sqrt(n) as white, 1.959963984540054 * sqrt((1 + 2 * (sum(acf * acf) over (partition by key order by lag) - acf * acf)) / n) as ma from r", ratios=("acf", "white", "ma"))
def acf_limits(spark: S, d: str) -> DataFrame:
    """Autocorrelations of each series' growth, with white-noise and moving-average limits."""
    w = Window.partitionBy("key").orderBy("date")
    every = Window.partitionBy("key")
    g = panel.spine(t.monthly(spark, d)).withColumn("x", 100 * F.log(F.col("value") / F.lag("value").over(w))).where("x is not null")
    u = g.withColumn("u", F.col("x") - F.avg("x").over(every))
    products = u.select("key", "u", *((F.col("u") * F.lag("u", k).over(w)).alias(f"p{k}") for k in range(1, 5)))
    sums = products.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("u") * F.col("u")).alias("v"), *(F.sum(f"p{k}").alias(f"p{k}") for k in range(1, 5)))
    long = sums.select("key", "n", F.posexplode(F.array(*(F.col(f"p{k}") / F.col("v") for k in range(1, 5)))).alias("at", "acf")).withColumn("lag", (F.col("at") + 1).cast("bigint"))
    before = F.coalesce(F.sum(F.col("acf") * F.col("acf")).over(Window.partitionBy("key").orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    z = 1.959963984540054
    return long.select("key", "lag", "acf", (z / F.sqrt("n")).alias("white"), (z * F.sqrt((1 + 2 * before) / F.col("n"))).alias("ma"))


@query("""with e as (select y, cast(make_date(y, cast((h + l - 7 * mm + 114) // 31 as integer), cast((h + l - 7 * mm + 114) % 31 + 1 as integer)) + 1 as date) as easter from (
        select *, (a + 11 * h + 22 * l) // 451 as mm from (select *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 as l from (select *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 as h from (
        select y, y % 19 as a, y // 100 as b, y % 100 as c from (select unnest(range(1980, 2100)) as y)))))),
    r as (select key, lag_days, n_nationkey % 3 as kind from registry join nation on n_name = key),
    k as (select r.*, m.date as m1, cast(m.date + interval 1 month as date) as m2 from r cross join (select distinct date from monthly) m),
    x as (select *, cast(m2 + cast((8 - dayofweek(m2)) % 7 as integer) as date) as monday from k)
    select key, kind, m1 as month, cast(case kind when 0 then m2 + cast((10 - dayofweek(m2)) % 7 as integer) when 1 then last_day(m1) + lag_days
        else case when month(m1) = 12 then monday + 7 when month(m2) in (8, 10) or monday = easter then monday + 1 else monday end end as date) as release
    from x join e on e.y = year(monday)""")
def release_rules(spark: S, d: str) -> DataFrame:
    """Release of each series' every month by its rule: a weekday of the month after, a lag in days, or the first Monday, a day later where that is a bank
    holiday (August, October) or Easter Monday, a week later for December."""
    r = t.registry(spark, d).join(t.table(spark, d, "nation").select(F.col("n_name").alias("key"), (F.col("n_nationkey") % 3).alias("kind")), "key")
    m1, m2 = F.col("month"), F.add_months("month", 1)
    monday = calendar.nth_weekday(m2, "Mon", 1)
    holiday = F.month(m2).isin(8, 10) | (monday == calendar.easter_monday(F.year(m2)))
    third = F.when(F.month(m1) == 12, F.date_add(monday, 7)).when(holiday, F.date_add(monday, 1)).otherwise(monday)
    release = F.when(F.col("kind") == 0, calendar.nth_weekday(m2, "Wed", 1)).when(F.col("kind") == 1, F.date_add(F.last_day(m1), F.col("lag_days"))).otherwise(third)
    months = t.monthly(spark, d).select(F.col("date").alias("month")).distinct()  # one row a month
    return r.join(F.broadcast(months)).select("key", "kind", "month", release.alias("release"))


@query(f"""with e as (select *, row_number() over (partition by key order by date desc) as back, date >= (select min(date) + cast((max(date) - min(date)) // 2 as integer) from {ERRORS}) as post from {ERRORS}),
    v as (select key as variant, sqrt(avg(error * error) filter (post)) as pc, sqrt(avg(error * error)) as whole, sqrt(avg(error * error) filter (back <= 8)) as oos from e group by key),
    b as (select sqrt(avg(error * error) filter (post)) as pc, sqrt(avg(error * error)) as whole, sqrt(avg(error * error) filter (back <= 8)) as oos from e),
    x as (select variant, v.pc - b.pc as d_pc, v.whole - b.whole as d_full, v.oos - b.oos as d_oos from v cross join b)
    select *, case when d_pc is null then 'none' when d_pc < 0 and d_full <= 0 and d_oos <= 0 then 'keep in all' when d_pc < 0 and d_full <= 0.02 then 'keep' else 'none' end as verdict from x""", ratios=("d_pc", "d_full", "d_oos"))
def variant_grid(spark: S, d: str) -> DataFrame:
    """Each series' errors against all of them, as a variant against the baseline, in the later half, over all and in the last 8 months; what is kept:
    better in the later half without a material loss (over 0.02) over all, or better in all three."""
    e = errors(spark, d).withColumn("back", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("date"))))
    half = e.agg(F.expr("date_add(min(date), cast(floor(datediff(max(date), min(date)) / 2) as int))").alias("half"))  # one row
    e = e.join(F.broadcast(half)).withColumn("post", F.col("date") >= F.col("half"))
    rmse = lambda keep: F.sqrt(F.avg(F.when(keep, F.col("error") * F.col("error"))))
    windows = {"pc": F.col("post"), "full": F.lit(True), "oos": F.col("back") <= 8}
    base = e.agg(*(rmse(w).alias(f"b_{k}") for k, w in windows.items()))  # one row
    v = e.groupBy(F.col("key").alias("variant")).agg(*(rmse(w).alias(k) for k, w in windows.items())).join(F.broadcast(base))
    v = v.select("variant", *((F.col(k) - F.col(f"b_{k}")).alias(f"d_{k}") for k in windows))
    better = F.col("d_pc") < 0
    verdict = F.when(better & (F.col("d_full") <= 0) & (F.col("d_oos") <= 0), "keep in all").when(better & (F.col("d_full") <= 0.02), "keep").otherwise("none")
    return v.withColumn("verdict", verdict)


# Tiers of a price index (1 the newest and preferred); how far each reaches depends here on the length of the series' name, so that overlaps differ.
TIERS = """s as (select min(date) as m from monthly), c as (select key, date, 50 + cast(round(value) as bigint) % 100 as v, cast(length(key) as integer) as k, date_diff('month', m, date) as mo from monthly cross join s),
    t as (select key, date, v, 1 as tier from c where mo >= 48 union all select key, date, v, 2 from c where mo >= 24 and mo < 46 + 2 * k % 12 and k <> 8 union all select key, date, v, 3 from c where mo < 20 + 5 * (k % 7))"""
#: Months that two tiers must share.
LEAST_OVERLAP = 6


def index_tiers(spark: S, d: str) -> DataFrame:
    """key, date, v, tier (1 preferred)."""
    c = cells(spark, d).select("key", "date", (50 + F.col("v") % 100).alias("v"), F.length("key").alias("k"))
    first = c.agg(F.min("date").alias("m"))  # one row
    c = c.join(F.broadcast(first)).withColumn("at", F.months_between("date", "m").cast("int"))
    reach = {1: F.col("at") >= 48, 2: (F.col("at") >= 24) & (F.col("at") < 46 + 2 * F.col("k") % 12) & (F.col("k") != 8), 3: F.col("at") < 20 + 5 * (F.col("k") % 7)}
    tiers = F.array(*(F.when(w, F.lit(tier)) for tier, w in reach.items()))
    return c.select("key", "date", "v", F.explode(F.array_compact(tiers)).alias("tier"))


def admitted(tiers: DataFrame, most: int, least: int = LEAST_OVERLAP) -> DataFrame:
    """key, admitted (tiers, newest first), why: tiers walked from the oldest (`most`) to the newest (1). The oldest that has anything is the base; a newer one
    is admitted if it shares `least` months with the last admitted, else it is skipped and the walk goes on. tiers: key, date, tier."""
    order = range(most, 0, -1)
    has = tiers.groupBy("key", "date").agg(*(F.max(F.when(F.col("tier") == k, 1)).alias(f"t{k}") for k in order))
    shared = [F.count(F.when(F.col(f"t{i}") + F.col(f"t{j}") == 2, 1)).alias(f"n{i}{j}") for i in order for j in order if i < j]
    n = has.groupBy("key").agg(*(F.count(f"t{k}").alias(f"n{k}") for k in order), *shared)
    last, kept, why = F.lit(0), F.array().cast("array<int>"), F.array().cast("array<string>")
    for k in order:
        overlap = F.lit(0)
        for j in range(most, k, -1):
            overlap = F.when(last == j, F.col(f"n{k}{j}")).otherwise(overlap)
        empty, base = F.col(f"n{k}") == 0, (F.col(f"n{k}") > 0) & (last == 0)
        fits = ~empty & (base | (overlap >= least))
        said = F.when(empty, F.lit(f"tier {k} has nothing")).when(~fits, F.concat(F.lit(f"tier {k} shares "), overlap.cast("string"), F.lit(" months with tier "), last.cast("string")))
        why = F.when(said.isNotNull(), F.array_append(why, said)).otherwise(why)
        kept = F.when(fits, F.array_prepend(kept, F.lit(k))).otherwise(kept)
        last = F.when(fits, k).otherwise(last)
    return n.select("key", kept.alias("admitted"), why.alias("why"))


ADMITTED = f"""{TIERS}, n as (select key, count(*) filter (tier = 1) as n1, count(*) filter (tier = 2) as n2, count(*) filter (tier = 3) as n3 from t group by 1),
    o as (select a.key, count(*) filter (a.tier = 1 and b.tier = 2) as n12, count(*) filter (a.tier = 1 and b.tier = 3) as n13, count(*) filter (a.tier = 2 and b.tier = 3) as n23 from t a join t b on a.key = b.key and a.date = b.date and a.tier < b.tier group by 1),
    w as (select n.*, coalesce(n12, 0) as n12, coalesce(n13, 0) as n13, n3 > 0 as in3, n2 > 0 and (n3 = 0 or coalesce(n23, 0) >= 6) as in2, coalesce(n23, 0) as n23 from n left join o using (key)),
    x as (select *, case when in2 then 2 when in3 then 3 else 0 end as base from w), y as (select *, n1 > 0 and (base = 0 or case base when 2 then n12 else n13 end >= 6) as in1 from x)"""


@query(f"""with {ADMITTED} select key, concat_ws(',', case when in1 then '1' end, case when in2 then '2' end, case when in3 then '3' end) as admitted,
    concat_ws('; ', case when n3 = 0 then 'tier 3 has nothing' end, case when n2 = 0 then 'tier 2 has nothing' when not in2 then 'tier 2 shares ' || n23 || ' months with tier 3' end,
        case when n1 = 0 then 'tier 1 has nothing' when not in1 then 'tier 1 shares ' || case base when 2 then n12 else n13 end || ' months with tier ' || base end) as why from y""")
def admitted_tiers(spark: S, d: str) -> DataFrame:
    """Which tiers of an index hang together, and why others are skipped."""
    return admitted(index_tiers(spark, d), 3).select("key", F.array_join("admitted", ",").alias("admitted"), F.array_join("why", "; ").alias("why"))


@query(f"""with {ADMITTED}, g as (select t.key, t.date, max(v) filter (tier = 1 and in1) as a, max(v) filter (tier = 2 and in2) as b, max(v) filter (tier = 3 and in3) as c from t join y using (key) group by 1, 2),
    f1 as (select key, exp(avg(case when a is not null and b is not null then ln(a / cast(b as double)) end)) as f, min(date) filter (a is not null) as s from g group by 1),
    z as (select g.key, date, coalesce(cast(a as double), case when s is null then b when date < s then b * f end) as y, c, case when a is not null then 1 when b is not null and (s is null or date < s) then 2 end as src from g join f1 using (key)),
    f2 as (select key, exp(avg(case when y is not null and c is not null then ln(y / c) end)) as f, min(date) filter (y is not null) as s from z group by 1)
    select key, src as tier, min(date) as first, max(date) as last, count(*) as n, sum(value) as total from (
        select z.key, date, coalesce(y, case when s is null then c when date < s then c * f end) as value, coalesce(src, 3) as src from z join f2 using (key)) where value is not null group by 1, 2""", levels=("total",))
def tiered_index(spark: S, d: str) -> DataFrame:
    """Admitted tiers spliced, newest first, each older one rescaled by the geometric mean ratio to what stands where both have months; what each tier contributes."""
    tiers = index_tiers(spark, d)
    kept = tiers.join(admitted(tiers, 3).select("key", "admitted"), "key").where(F.array_contains("admitted", F.col("tier")))
    wide = kept.groupBy("key", "date").agg(*(F.max(F.when(F.col("tier") == k, F.col("v").cast("double"))).alias(f"v{k}") for k in (1, 2, 3)))
    every = Window.partitionBy("key")
    y = wide.withColumns({"y": F.col("v1"), "tier": F.when(F.col("v1").isNotNull(), 1)})
    for k in (2, 3):
        old = F.col(f"v{k}")
        y = y.withColumns({"factor": F.exp(F.avg(F.when(F.col("y").isNotNull() & old.isNotNull(), F.log(F.col("y") / old))).over(every)), "start": F.min(F.when(F.col("y").isNotNull(), F.col("date"))).over(every)})
        new = F.when(F.col("start").isNull(), old).when(F.col("date") < F.col("start"), old * F.col("factor"))
        y = y.select("key", "date", "v1", "v2", "v3", F.coalesce("y", new).alias("y"), F.coalesce("tier", F.when(new.isNotNull(), k)).alias("tier"))
    return y.where("y is not null").groupBy("key", "tier").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"), F.sum("y").alias("total"))


@query("""select key, date, block, cast(case when block = 'pandemic' and not (date between date '1996-03-01' and date '1997-12-01') then 0 else 1 end as double) as active, case when date between date '1996-03-01' and date '1997-12-01' then cast(year(date) * 4 + quarter(date) - 1 - (1996 * 4 + 0) as integer) end as dummy
    from (select key, date, unnest(['global', 'pandemic']) as block from panel)""")
def block_masks(spark: S, d: str) -> DataFrame:
    """Factors by block: one that holds only in a window of months is zero outside it; the quarter's dummy inside."""
    p = gappy(spark, d).select("key", "date", F.explode(F.array(F.lit("global"), F.lit("pandemic"))).alias("block"))
    inside = F.col("date").between(F.lit("1996-03-01").cast("date"), F.lit("1997-12-01").cast("date"))
    return p.select("key", "date", "block", F.when((F.col("block") == "pandemic") & ~inside, 0.0).otherwise(1.0).alias("active"), F.when(inside, (calendar.q_index(F.col("date")) - 1996 * 4).cast("int")).alias("dummy"))


@query("""select key, date, mode, case mode when 'none' then value when 'growth' then 100 * (value / nullif(b, 0) - 1) else (value - m) / s end as x from (select *, lag(value) over (partition by key order by date) as b, avg(value) over (partition by key) as m, stddev_samp(value) over (partition by key) as s from dense), unnest(['none', 'growth', 'standardize']) as u(mode)""", levels=("x",))
def transform_modes(spark: S, d: str) -> DataFrame:
    """A panel as it is, as growth, or standardised: the mode is a key."""
    every = Window.partitionBy("key")
    p = panel.spine(t.monthly(spark, d))
    v = F.col("value")
    b, m, s = F.lag("value").over(panel.over()), F.avg("value").over(every), F.stddev_samp("value").over(every)
    forms = F.array(*(F.struct(F.lit(k).alias("mode"), x.alias("x")) for k, x in (("none", v), ("growth", 100 * (panel.ratio(v, F.col("b")) - 1)), ("standardize", (v - F.col("m")) / F.col("s")))))
    return p.withColumns({"b": b, "m": m, "s": s}).select("key", "date", F.inline(forms))


@query("""select key, date, value from (select key, date, value, row_number() over (partition by key, date order by place) as n from (
    select key, date, cast(round(value) as double) as value, 1 as place from monthly where month(date) % 3 = 0 union all select key, date, cast(round(value) as double) + 0.5, 2 from monthly where month(date) <> 5
    union all select key, date, cast(round(value) as double) + 7, 3 from monthly)) where n = 1""", levels=("value",))
def cleaned_rows(spark: S, d: str) -> DataFrame:
    """Raw rows cleaned: dates and numbers read from text, rows without either dropped, of several rows of a series and day the first as delivered."""
    c = cells(spark, d).withColumn("on", F.date_format("date", "yyyy-MM-dd"))
    text = lambda v: v.cast("string")
    first = c.where("month(date) % 3 = 0").select("key", "on", text(F.col("v")).alias("value"), F.lit(1).alias("place"))
    second = c.select("key", F.when(F.month("date") == 5, "n/a").otherwise(F.col("on")).alias("on"), F.concat(text(F.col("v")), F.lit(".5")).alias("value"), F.lit(2).alias("place"))
    third = c.select("key", "on", text(F.col("v") + 7).alias("value"), F.lit(3).alias("place"))
    void = c.select("key", "on", F.lit("-").alias("value"), F.lit(0).alias("place"))
    return cleaned(first.unionByName(second).unionByName(third).unionByName(void))


def cleaned(raw: DataFrame) -> DataFrame:
    """key, date, value of raw rows (key, on, value as text; place: the order of delivery)."""
    rows = raw.select("key", F.col("on").try_cast("date").alias("date"), F.col("value").try_cast("double").alias("value"), "place").dropna(subset=["date", "value"])
    return rows.groupBy("key", "date").agg(F.min_by("value", "place").alias("value"))


@query("""select page_id, cast(line as bigint) as line, count(*) as chars, string_agg(c, '' order by pos) as text from (select page_id, pos, substr(html, pos, 1) as c, round((pos * 7 % 41 + (pos % 3) * 0.4) / 3.2) as line from (select page_id, html, unnest(generate_series(1, greatest(60, length(html)))) as pos from pages where page_id < 100000)) group by 1, 2""")
def clustered_lines(spark: S, d: str) -> DataFrame:
    """Characters with positions gathered into lines: equal heights within a tolerance make a line, read from left to right. A page without text has lines of null.

    Whole texts are read; a page has 60 positions at least, those past its text are empty. Rows with the same page_id share its lines, at one position in order of their characters.
    All pages are read. The SQL stops at page_id 100,000, so they agree on tables of up to 100,000 pages.
    """
    pos = np.arange(1, 124)  # heights come again after 41 * 3 positions
    line_at = np.floor((pos * 7 % 41 + pos % 3 * 0.4) / 3.2 + 0.5).astype(np.uint8)
    upto = np.vstack([np.zeros(14, int), np.cumsum(line_at[:, None] == np.arange(14), axis=0)])  # positions of each line among the first n

    def gathered(texts: list[str], blank: int) -> list[tuple[int, int, str | None]]:
        """(line, chars, text) from the texts of a page and the number of its rows without."""
        chars = upto[60] * blank + sum(upto[-1] * (n // 123) + upto[n % 123] for n in (max(60, len(x)) for x in texts))
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        line = np.concatenate([np.resize(line_at, len(x)) for x in ["", *texts]])
        if len(texts) > 1:
            order = np.lexsort((code, np.concatenate([np.arange(len(x)) for x in texts])))
            code, line = code[order], line[order]
        text = code[np.argsort(line, kind="stable")].tobytes().decode("utf-32-le")
        ends = [0, *np.cumsum(np.bincount(line, minlength=14)).tolist()]
        return [(k, n, text[ends[k] : ends[k + 1]] if texts else None) for k, n in enumerate(chars.tolist())]

    rows = F.udf(gathered, "array<struct<line: bigint, chars: bigint, text: string>>", useArrow=True)
    pages = t.table(spark, d, "pages").groupBy("page_id").agg(F.collect_list("html").alias("texts"), F.count_if(F.col("html").isNull()).alias("blank"))
    return pages.select("page_id", F.inline(rows("texts", "blank")))


@query("""select event_id, k, cast(k % 7 as integer) as depth_a, 'k' as path from (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where event_type = 'view')""")
def flattened(spark: S, d: str) -> DataFrame:
    """A nested record as flat columns, its names joined by two underscores, by its schema alone."""
    e = t.table(spark, d, "events").where("event_type = 'view'").select("event_id", F.from_json("props", "k bigint").alias("props"))
    nested = e.select("event_id", F.struct("props", F.struct((F.col("props.k") % 7).cast("int").alias("a")).alias("depth")).alias("r"))
    flat = flat_columns(nested)
    return flat.select("event_id", F.col("r__props__k").alias("k"), F.col("r__depth__a").alias("depth_a"), F.lit("k").alias("path"))


def flat_columns(df: DataFrame) -> DataFrame:
    """Every struct field, however deep, as a column of its path."""

    def paths(fields, at: str = "") -> list[str]:  # noqa: ANN001
        return [p for f in fields for p in (paths(f.dataType.fields, f"{at}{f.name}.") if hasattr(f.dataType, "fields") else [at + f.name])]

    return df.select(*(F.col(p).alias(p.replace(".", "__")) for p in paths(df.schema.fields)))


@query("""select event_id, v, decimals, clean from (select event_id, v, cast(case when strpos(v, '.') > 0 then length(v) - strpos(v, '.') else 0 end as integer) as decimals, cast(v as double) as clean from (select event_id, case when event_id % 3 = 0 then cast(cast(round(value) as bigint) as varchar) else cast(cast(round(value) as bigint) as varchar) || '.25' end as v from events where event_type = 'click'))""", ratios=("clean",))
def printed_decimals(spark: S, d: str) -> DataFrame:
    """Decimals of a printed number, and the number."""
    e = t.table(spark, d, "events").where("event_type = 'click'").select("event_id", F.concat(F.round("value").cast("bigint").cast("string"), F.when(F.col("event_id") % 3 == 0, "").otherwise(".25")).alias("v"))
    return e.select("event_id", "v", F.length(F.split_part("v", F.lit("."), F.lit(2))).alias("decimals"), F.col("v").try_cast("double").alias("clean"))


@query("""select 'current' as horizon, 'mean of ' || cast(count(*) as varchar) || ' errors, 68 and 95 percent bands' as basis, count(*) as n from misses union all select 'next', 'pooled, fewer than 12 errors', count(*) from misses where q_index % 3 = 0 having count(*) < 12""")
def band_basis(spark: S, d: str) -> DataFrame:
    """What a band rests on, in words; horizons with too few errors say so."""
    m = t.misses(spark, d)
    rows = m.select(F.explode(F.when(F.col("q_index") % 3 == 0, F.array(F.lit("current"), F.lit("next"))).otherwise(F.array(F.lit("current")))).alias("horizon")).groupBy("horizon").agg(F.count("*").alias("n"))
    few = F.when(F.col("n") < 12, "pooled, fewer than 12 errors").otherwise(F.concat(F.lit("mean of "), F.col("n").cast("string"), F.lit(" errors, 68 and 95 percent bands")))
    return rows.select("horizon", few.alias("basis"), "n").where("horizon = 'current' or n < 12")


@query("""with f as (select key, date, cast(round(value) as bigint) as v, cast(length(key) as integer) % 5 as k, row_number() over (partition by key order by date) as n, max(date) over () as m, count(*) over (partition by key) as total from monthly),
    c as (select key, date, v + case when k = 0 and n = 3 then 1 else 0 end as v, n from f where k <> 2 and (k = 1 or n <= total - 12) union all
        select key, cast(m + interval 1 month as date), 1, total + 1 from f where k = 1 and n = 1)
    select key, count(c.n) as n, count(*) filter (c.v = f.v and c.date = f.date) as same, count(c.n) = count(*) filter (c.v = f.v and c.date = f.date) as prefix from (select distinct key from f) k left join c using (key) left join f using (key, n) group by key""")
def prefix_check(spark: S, d: str) -> DataFrame:
    """Whether a cut series is the head of the full one, place by place, dates and values: only then does the cut explain what a tier lacks. None is the head of all."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy("date"))
    k = F.length("key") % 5
    full = cells(spark, d).withColumns({"n": nth, "total": F.count("*").over(Window.partitionBy("key"))})
    end = full.agg(F.add_months(F.max("date"), 1).alias("end"))  # one row
    cut = full.where((k != 2) & ((k == 1) | (F.col("n") <= F.col("total") - 12))).select("key", "date", (F.col("v") + F.when((k == 0) & (F.col("n") == 3), 1).otherwise(0)).alias("v"))
    longer = full.where((k == 1) & (F.col("n") == 1)).join(F.broadcast(end)).select("key", F.col("end").alias("date"), F.lit(1).cast("bigint").alias("v"))
    return prefixes(cut.unionByName(longer), full.select("key", "date", "v"))


def prefixes(cut: DataFrame, full: DataFrame) -> DataFrame:
    """key, n, same, prefix: rows of each key's cut and how many are those of the full series at the same place. Both: key, date, v."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy("date"))
    head = full.withColumn("n", nth).withColumnsRenamed({"date": "f_date", "v": "f_v"})
    both = full.select("key").distinct().join(cut.withColumn("n", nth), "key", "left").join(head, ["key", "n"], "left")
    same = (F.col("date") == F.col("f_date")) & F.col("v").eqNullSafe(F.col("f_v"))
    return both.groupBy("key").agg(F.count("n").alias("n"), F.count(F.when(same, 1)).alias("same")).withColumn("prefix", F.col("n") == F.col("same"))


@query("""with s as (select q_index, unnest([1, 2, 3]) as seed, model, actual from misses), m as (select q_index, avg(model + (seed - 2) * 0.1) as model, count(*) as seeds, any_value(actual) as actual from s where not (q_index % 5 = 0 and seed = 3) group by 1)
    select q_index, model, seeds, actual, model - actual as miss, abs((model - actual) - round(model - actual, 4)) <= 1e-4 as identity from m where seeds >= 2""", ratios=("model", "actual", "miss"))
def seed_misses(spark: S, d: str) -> DataFrame:
    """Final estimates averaged over seeds, quarters that several seeds have, and their misses against first prints."""
    s = t.misses(spark, d).select("q_index", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seed"), "model", "actual").where("not (q_index % 5 = 0 and seed = 3)")
    m = s.groupBy("q_index").agg(F.avg(F.col("model") + (F.col("seed") - 2) * 0.1).alias("model"), F.count("*").alias("seeds"), F.first("actual").alias("actual")).where("seeds >= 2")
    miss = F.col("model") - F.col("actual")
    return m.select("q_index", "model", "seeds", "actual", miss.alias("miss"), (F.abs(miss - F.round(miss, 4)) <= 1e-4).alias("identity"))


@query("""select name, rows from (select unnest(['gdp', 'latest', 'missing']) as name, unnest([(select count(*) from target_q), 1, 0]) as rows)""")
def optional_payloads(spark: S, d: str) -> DataFrame:
    """JSON documents by an explicit schema; one that isn't there is an empty table of that schema, not an error."""
    from pyspark.errors import AnalysisException

    from tidemark.streaming.ledger import shared_dir

    path = shared_dir(spark, "documents")
    q = t.target_q(spark, d).select(F.col("q_index").cast("int").alias("q_index"), F.round("value").cast("bigint").alias("v"))
    q.write.json(f"{path}/gdp")
    q.orderBy(F.desc("q_index")).limit(1).write.json(f"{path}/latest")

    def read(name: str) -> DataFrame:
        kind = "q_index int, v bigint"
        try:
            found = spark.read.schema(kind).json(f"{path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = spark.createDataFrame([], kind)
        return found.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")

    return read("gdp").unionByName(read("latest")).unionByName(read("missing"))


@query("""select date, value, 'business confidence' as name, 'net balance' as unit, date >= date '1998-01-01' as fresh from (select date, cast(cast(round(sum(value)) as bigint) % 161 - 80 as double) as value from monthly where date >= date '1994-01-01' group by 1)""")
def manual_series(spark: S, d: str) -> DataFrame:
    """A series kept by hand: from its start on, with constant columns, and whether a month is recent enough to be used."""
    c = t.monthly(spark, d).where("date >= date'1994-01-01'").groupBy("date").agg((F.round(F.sum("value")).cast("bigint") % 161 - 80).cast("double").alias("value"))
    return c.select("date", "value", F.lit("business confidence").alias("name"), F.lit("net balance").alias("unit"), (F.col("date") >= F.lit("1998-01-01").cast("date")).alias("fresh"))
