"""Queries on what is published: payloads and refusals, logs and manifests, and the values that a page shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import bands, calendar, display
from tidemark.operators import joins
from tidemark.plans.registry import query
from tidemark.plans.source_queries import cells
from tidemark.sources import publication
from tidemark.sources import tables as t
from tidemark.streaming.ledger import shared_dir

S = SparkSession


def horizon(kind: str, point: Column, p68: Column, p95: Column, previous: Column) -> Column:
    """One horizon's entry of a payload: growth, annualised, level and both bands."""
    return F.struct(
        F.lit(kind).alias("kind"), F.round(point, 4).alias("qoq"), F.round(bands.qoq_to_annualised(point), 4).alias("annualised"), F.round(previous * (1 + point / 100), 0).alias("level"),
        F.array(F.round(point - p68, 4), F.round(point + p68, 4)).alias("ci_68"), F.array(F.round(point - p95, 4), F.round(point + p95, 4)).alias("ci_95"),
    )


DOCUMENT = "status string, reason string, q_index int, quarter string, horizons array<struct<kind:string,qoq:double,annualised:double,level:double,ci_68:array<double>,ci_95:array<double>>>"


@query("""with p as (select quantile_cont(abs(miss), 0.68) as p68, quantile_cont(abs(miss), 0.95) as p95 from misses), m as (select m.*, g.value, p68, p95 from misses m join growth g using (q_index) cross join p)
    select q_index, case when q_index % 6 = 0 then 'refused' else 'ok' end as status, case when q_index % 6 = 0 then 'stale: the panel is over 21 days old' end as reason, kind, qoq, annualised, level, lo, hi from (
    select q_index, 'current' as kind, round(model, 4) as qoq, round(100 * (power(1 + model / 100, 4) - 1), 4) as annualised, round(value * (1 + model / 100)) as level, round(model - p68, 4) as lo, round(model + p95, 4) as hi from m where q_index % 6 <> 0
    union all select q_index, 'next', round(model / 2, 4), round(100 * (power(1 + model / 200, 4) - 1), 4), round(value * (1 + model / 200)), round(model / 2 - p68, 4), round(model / 2 + p95, 4) from m where q_index % 6 <> 0
    union all select q_index, null, null, null, null, null, null from m where q_index % 6 = 0)""", ratios=("qoq", "annualised", "lo", "hi"), levels=("level",))
def payload_documents(spark: S, d: str) -> DataFrame:
    """Nested payloads of both horizons, or a refusal with its reason, written as JSON and read back by a schema."""
    path = shared_dir(spark, "payload")
    p = t.misses(spark, d).agg(*bands.quantiles(F.col("miss")))
    m = t.misses(spark, d).join(t.growth(spark, d).select("q_index", "value"), "q_index").join(F.broadcast(p))  # one row
    point = F.col("model")
    two = F.array(horizon("current", point, F.col("p68"), F.col("p95"), F.col("value")), horizon("next", point / 2, F.col("p68"), F.col("p95"), F.col("value")))
    refused = F.col("q_index") % 6 == 0
    doc = m.select(F.when(refused, "refused").otherwise("ok").alias("status"), F.when(refused, "stale: the panel is over 21 days old").alias("reason"), "q_index", calendar.quarter_label(F.col("q_index")).alias("quarter"), F.when(~refused, two).alias("horizons"))
    doc.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    back = spark.read.text(path).select(F.from_json("value", DOCUMENT).alias("x")).select("x.*")
    return back.select("q_index", "status", "reason", F.inline_outer("horizons")).select("q_index", "status", "reason", "kind", "qoq", "annualised", "level", F.get("ci_68", F.lit(0)).alias("lo"), F.get("ci_95", F.lit(1)).alias("hi"))


@query("""select key, n, first_month, last_month, last_value, last_value - second as change from (select key, cast(least(50, count(*)) as integer) as n, strftime(min(date) filter (k <= 50), '%Y-%m') as first_month, strftime(max(date), '%Y-%m') as last_month,
    max(v) filter (k = 1) as last_value, max(v) filter (k = 2) as second from (select key, date, cast(round(value) as bigint) as v, row_number() over (partition by key order by date desc) as k from monthly) group by key)""")
def indicator_documents(spark: S, d: str) -> DataFrame:
    """The last 50 observations of each series as one document, and what a reader takes from it."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("date")))
    recent = cells(spark, d).withColumn("k", nth).where("k <= 50")
    points = F.array_sort(F.collect_list(F.struct(F.date_format("date", "yyyy-MM").alias("month"), F.col("v").alias("value"))))  # 50 at most
    doc = recent.groupBy("key").agg(points.alias("points")).select(F.to_json(F.struct("key", "points")).alias("document"))
    back = doc.select(F.from_json("document", "key string, points array<struct<month:string,value:bigint>>").alias("x")).select("x.*")
    at = lambda n: F.get("points", F.size("points") - n)
    return back.select("key", F.size("points").alias("n"), F.get("points", F.lit(0))["month"].alias("first_month"), at(1)["month"].alias("last_month"), at(1)["value"].alias("last_value"), (at(1)["value"] - at(2)["value"]).alias("change"))


@query("""select user_id, run_date, n, delta, case when delta is null then 'first' when abs(delta) > 50 then 'large' else 'small' end as size from (select user_id, run_date, n, n - lag(n) over (partition by user_id order by run_date) as delta from (
    select user_id, run_date, cast(sum(round(value)) as bigint) as n from runs_a group by 1, 2))""")
def tracking_log(spark: S, d: str) -> DataFrame:
    """A typed log to which runs are appended week by week, made empty where there is none; each row's change from the one before."""
    path = shared_dir(spark, "tracking")
    kind = "user_id bigint, run_date date, n bigint"
    spark.createDataFrame([], kind).write.csv(path, header=True)
    v = t.runs(spark, d, "view").groupBy("user_id", "run_date").agg(F.sum(F.round("value")).cast("bigint").alias("n"))
    v.where("weekofyear(run_date) % 2 = 0").write.mode("append").csv(path, header=True)
    v.where("weekofyear(run_date) % 2 = 1").write.mode("append").csv(path, header=True)
    log = spark.read.csv(path, schema=kind, header=True)
    delta = F.col("n") - F.lag("n").over(Window.partitionBy("user_id").orderBy("run_date"))
    return log.withColumn("delta", delta).withColumn("size", F.when(F.col("delta").isNull(), "first").when(F.abs("delta") > 50, "large").otherwise("small"))


@query("""select page_id, octet_length(encode(html)) as bytes, sha256(html) as sha256, case when page_id % 10 = 3 then 'changed' when page_id % 10 = 7 then 'missing' else 'same' end as state from pages""")
def manifest_check(spark: S, d: str) -> DataFrame:
    """A manifest of sizes and digests, and what was delivered held against it."""
    pages = t.table(spark, d, "pages").select("page_id", "html")
    manifest = pages.select("page_id", F.octet_length("html").cast("bigint").alias("bytes"), F.sha2("html", 256).alias("sha256"))
    delivered = pages.where("page_id % 10 <> 7").select("page_id", F.sha2(F.when(F.col("page_id") % 10 == 3, F.concat("html", F.lit(" "))).otherwise(F.col("html")), 256).alias("got"))
    state = F.when(F.col("got").isNull(), "missing").when(F.col("got") != F.col("sha256"), "changed").otherwise("same")
    return manifest.join(delivered, "page_id", "left").select("page_id", "bytes", "sha256", state.alias("state"))


def growth_words(x: Column) -> Column:
    """What a quarter's growth is called."""
    return F.when(x > 1.5, "Strong growth expected").when(x > 0.5, "Moderate growth expected").when(x > 0, "Modest growth expected").otherwise("Contraction expected")


def year_words(x: Column) -> Column:
    """What a year's growth says of the economy."""
    return F.when(x > 2.5, "strong").when(x > 1.5, "healthy").otherwise("modest")


@query("""select q_index, '- ' || case when growth > 1.5 then 'Strong growth expected' when growth > 0.5 then 'Moderate growth expected' when growth > 0 then 'Modest growth expected' else 'Contraction expected' end
    || ': ' || cast(q_index // 4 as varchar) || 'Q' || cast(q_index % 4 + 1 as varchar) || case when yoy is null then '' else '; year-on-year growth of ' || printf('%.2f', floor(yoy * 100 + 0.5) / 100) || '% indicates '
    || case when yoy > 2.5 then 'strong' when yoy > 1.5 then 'healthy' else 'modest' end || ' annual performance' end as line from (select q_index, growth, 100 * (value / lag(value, 4) over (order by q_index) - 1) as yoy from growth) where growth is not null""")
def summary_lines(spark: S, d: str) -> DataFrame:
    """Report lines: what a quarter's growth is called, and the year's."""
    yoy = 100 * (F.col("value") / F.lag("value", 4).over(Window.orderBy("q_index")) - 1)  # one row a quarter
    g = t.growth(spark, d).withColumn("yoy", yoy).where("growth is not null")
    year = F.concat(F.lit("; year-on-year growth of "), display.fixed(F.col("yoy"), 2), F.lit("% indicates "), year_words(F.col("yoy")), F.lit(" annual performance"))
    return g.select("q_index", F.concat(F.lit("- "), growth_words(F.col("growth")), F.lit(": "), calendar.quarter_label(F.col("q_index")), F.coalesce(year, F.lit(""))).alias("line"))


# What a page shows: units and ids as providers write them, dealt over the series here.
WRITTEN = ("Percent", "Millions of Dollars", "Thousands", "index", "net balance", "hours (thousands)", "Number ", "$bn", "ratio")
IDS = ("cpi", "employment", "nab_cu", "gdp", "hours", "aig_pmi", "credit")


def named_units(spark: S, d: str) -> DataFrame:
    """key, date, id, unit as shown, v, c (the change)."""
    c = cells(spark, d).join(t.table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("k")), "key")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), F.col("k") % len(names) + 1)
    n = c.select("key", "date", pick(IDS).alias("id"), pick(WRITTEN).alias("unit"), (F.col("v") % 100_000 * F.when(F.col("k") % 9 == 5, 37).otherwise(1)).cast("double").alias("v"))
    n = n.withColumn("unit", display.canonical_unit(display.display_unit(F.col("id"), F.col("unit"))))
    return n.withColumn("c", F.col("v") - F.lag("v").over(Window.partitionBy("key").orderBy("date")))


UNITS = """(select m.key, m.date, ['cpi', 'employment', 'nab_cu', 'gdp', 'hours', 'aig_pmi', 'credit'][n_nationkey % 7 + 1] as id, case when n_nationkey % 7 = 2 then 'percent'
    else ['Percent', '$ millions', '000s persons', 'index', 'net balance', 'hours (thousands)', 'count', '$bn', 'ratio'][n_nationkey % 9 + 1] end as unit,
    cast(round(value) as bigint) % 100000 * case when n_nationkey % 9 = 5 then 37 else 1 end as v from monthly m join nation n on n.n_name = m.key)"""
CHANGED = f"(select *, v - lag(v) over (partition by key order by date) as c from {UNITS})"
UP = "floor({0} + 0.5)"  # halves go up
TENTH, HUNDREDTH = "printf('%.1f', floor(({0}) * 10 + 0.5) / 10)", "printf('%.2f', floor(({0}) * 100 + 0.5) / 100)"
SIGN = "case when c > 0 then '+' when c < 0 then '\u2212' else '' end"


@query(f"""select key, date, unit,
    case lower(unit) when 'percent' then {TENTH.format('v')} || '%' when '$ millions' then '$' || format('{{:,}}', v) || 'M' when '$bn' then '$' || format('{{:,}}', v) || 'bn' when '000s persons' then format('{{:,}}', v) || 'k'
        when 'hours (thousands)' then case when v >= 1000000 then {HUNDREDTH.format('v / 1e6')} || 'bn hrs' when v >= 1000 then {TENTH.format('v / 1e3')} || 'm hrs' else format('{{:,}}', v) || 'k hrs' end
        when 'count' then format('{{:,}}', v) when 'net balance' then cast(v as varchar) when 'index' then {TENTH.format('v')} else format('{{:,}}', v) end as level,
    case when c is null then null else {SIGN} || case lower(unit) when 'percent' then {TENTH.format('abs(c)')} || 'pp'
        when '$ millions' then '$' || case when abs(c) >= 1000 then {TENTH.format('abs(c) / 1e3')} || 'bn' when abs(c) >= 100 then cast(abs(c) as varchar) || 'M' else {TENTH.format('abs(c)')} || 'M' end
        when '$bn' then '$' || {TENTH.format('abs(c)')} || 'bn' when '000s persons' then case when abs(c) >= 1000 then {TENTH.format('abs(c) / 1e3')} || 'm' else {TENTH.format('abs(c)')} || 'k' end
        when 'hours (thousands)' then case when abs(c) >= 1000000 then {HUNDREDTH.format('abs(c) / 1e6')} || 'bn hrs' when abs(c) >= 1000 then {TENTH.format('abs(c) / 1e3')} || 'm hrs' else cast(abs(c) as varchar) || 'k hrs' end
        when 'count' then format('{{:,}}', abs(c)) when 'net balance' then cast(abs(c) as varchar) || ' pts' when 'index' then {TENTH.format('abs(c)')} || ' pts' else {TENTH.format('abs(c)')} end end as change,
    case when lower(unit) in ('percent', 'net balance') then null when unit = 'index' and id <> 'cpi' then null when v - c = 0 then null when c is null then null when c = 0 then '0.00%'
        else {SIGN} || {HUNDREDTH.format('abs(c / cast(v - c as double) * 100)')} || '%' end as relative from {CHANGED}""")
def display_values(spark: S, d: str) -> DataFrame:
    """Levels, changes and percent changes as a page shows them, by unit and series."""
    n, unit, c = named_units(spark, d), F.col("unit"), F.col("c")
    before = F.col("v") - c
    relative = F.when(display.has_percent(F.col("id"), unit) & (before != 0), display.shown_percent(c / before * 100))
    return n.select("key", "date", "unit", display.shown_level(F.col("v"), unit).alias("level"), display.shown_change(c, unit).alias("change"), relative.alias("relative"))


@query(f"""select key, any_value(id) as id, any_value(unit) as unit, any_value(case when lower(unit) in ('percent', 'net balance') then 'level' when id = 'employment' then 'bars' when id in ('cpi', 'gdp', 'hours', 'credit') then 'growth' else 'level' end) as chart,
    any_value(case when lower(unit) in ('percent', 'net balance') then null when id = 'gdp' then 'q' when id in ('cpi', 'employment', 'hours', 'credit') then 'm' end) as frequency from {CHANGED} group by key""")
def chart_choice(spark: S, d: str) -> DataFrame:
    """Which chart a series gets: bars of changes for employment, growth for listed series unless they are rates, levels else; and the frequency of changes."""
    n = named_units(spark, d).groupBy("key").agg(F.first("id").alias("id"), F.first("unit").alias("unit"))
    return n.select("key", "id", "unit", display.chart_kind(F.col("id"), F.col("unit")).alias("chart"), display.chart_frequency(F.col("id"), F.col("unit")).alias("frequency"))


NICE = f"[{', '.join(repr(m * 10.0**k) for k in range(9) for m in display.RANGE_STEPS[:-1])}]"
STEPS = f"[{', '.join(f'{m * 10.0**k:.12f}' for k in range(-6, 9) for m in display.AXIS_STEPS)}]"


@query(f"""with p as (select q_index // 4 as year, greatest(1, max(abs(model)), max(abs(actual)), max(abs(model - 1)), max(abs(model + 1))) as largest, least(0, min(actual), min(model)) as low, greatest(0, max(actual), max(model)) as high, 60 + 40 * (q_index // 4 % 4) as height from misses group by 1, 5),
    s as (select *, greatest(3, least(6, cast(floor(height / 26) as integer) + 1)) as most from p),
    b as (select *, list_filter(cast({NICE} as double[]), lambda b: b >= largest)[1] as bound, list_filter(cast({STEPS} as double[]), lambda s: s >= (high - low) / (most - 1) and ceil(high / s) - floor(low / s) + 1 <= most)[1] as step from s)
    select year, bound, floor(low / step) * step as low, ceil(high / step) * step as high, step from b""", ratios=("bound", "low", "high", "step"))
def axis_bounds(spark: S, d: str) -> DataFrame:
    """Of each year's page: one bound for all quarters and bands on both sides of zero, and an axis over zero and all points with as many ticks as its height allows."""
    edges = F.array("model", "actual", F.col("model") - 1, F.col("model") + 1)
    m = t.misses(spark, d).select(F.floor(F.col("q_index") / 4).cast("int").alias("year"), F.array_max(F.transform(edges, F.abs)).alias("edge"), "model", "actual")
    g = m.groupBy("year").agg(F.max("edge").alias("largest"), F.collect_list("model").alias("models"), F.collect_list("actual").alias("actuals"))  # four quarters a year
    axis = display.evolution_axis(F.concat("models", "actuals"), (60 + 40 * (F.col("year") % 4)).cast("double"))
    return g.select("year", display.range_bound(F.col("largest")).alias("bound"), axis.alias("axis")).select("year", "bound", F.col("axis.min").alias("low"), F.col("axis.max").alias("high"), F.col("axis.step").alias("step"))


@query("""select user_id, shown, cast(row_number() over (order by shown desc nulls last, lower(name), user_id) as integer) as place from (
    select user_id, 'User ' || cast(user_id % 7 as varchar) as name, case when user_id % 5 in (1, 3, 4) then cast(max(ts) as date) when user_id % 3 = 0 then date '2024-01-01' end as shown from events group by user_id)""")
def update_order(spark: S, d: str) -> DataFrame:
    """Indicators by the day their page was checked, else its release: newest first, none last, then name and id; days and times in ISO form count, others are none."""
    e = t.table(spark, d, "events").groupBy("user_id").agg(F.max("ts").cast("date").alias("last"))
    day, k = F.date_format("last", "yyyy-MM-dd"), F.col("user_id") % 5
    checked = F.when(k == 0, "2024-02-30").when(k == 1, F.concat(day, F.lit("T08:30:00Z"))).when(k == 2, F.concat(day, F.lit("T99:00"))).otherwise(day)
    release = F.when(F.col("user_id") % 3 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-1-1"))
    shown = F.coalesce(display.stored_day(checked), display.stored_day(release))
    named = e.select("user_id", F.concat(F.lit("User "), (F.col("user_id") % 7).cast("string")).alias("name"), shown.alias("shown"))
    return named.select("user_id", "shown", F.row_number().over(Window.orderBy(F.col("shown").desc_nulls_last(), F.lower("name"), "user_id")).alias("place"))  # one row an indicator


@query("""select q_index, case when q_index % 5 <> 0 then lo end as lo, case when q_index % 5 <> 0 then hi end as hi, age >= 10 as stale, case when month(date + interval 3 month) = month(rel) then rel end as release from (
    select q_index, date, miss - 1 as lo, miss + 1 as hi, q_index % 21 as age, cast(date + interval 3 month + to_days(cast(case when q_index % 4 = 0 then 40 else 5 end as integer)) as date) as rel from misses)""", ratios=("lo", "hi"))
def shown_bands(spark: S, d: str) -> DataFrame:
    """A band counts only where both ends are numbers and in order, a release only inside its expected month; ten days make a page stale."""
    m = t.misses(spark, d)
    broken = F.col("q_index") % 5 == 0
    lo, hi = F.col("miss") - 1, F.when(broken, F.col("miss") - 2).otherwise(F.col("miss") + 1)
    month = F.add_months("date", 3)
    rel = F.date_add(month, F.when(F.col("q_index") % 4 == 0, 40).otherwise(5))
    valid = F.coalesce(lo <= hi, F.lit(False))
    return m.select("q_index", F.when(valid, lo).alias("lo"), F.when(valid, hi).alias("hi"), (F.col("q_index") % 21 >= 10).alias("stale"), F.when(F.trunc(rel, "MM") == F.trunc(month, "MM"), rel).alias("release"))


@query("""with g as (select q_index, growth, value from growth where growth is not null), c as (select q_index, (model + actual) / 2 as combo, model from misses) select g.q_index, coalesce(case when g.q_index % 3 <> 0 then combo end, model, g.growth) as shown,
    case when g.q_index % 3 <> 0 and combo is not null then 'combination' when model is not null then 'model' else 'print' end as chosen, 100 * (g.value / p.value - 1) as yoy from g left join c using (q_index) left join g p on p.q_index = g.q_index - 4""", ratios=("shown", "yoy"))
def monitor_view(spark: S, d: str) -> DataFrame:
    """What a monitor shows of each quarter: the combination where there is one, else the model, else the print; with the change on the year."""
    g = t.growth(spark, d).where("growth is not null").select("q_index", "growth", "value")
    c = t.misses(spark, d).select("q_index", F.when(F.col("q_index") % 3 != 0, (F.col("model") + F.col("actual")) / 2).alias("combo"), "model")
    ago = g.select((F.col("q_index") + 4).alias("q_index"), F.col("value").alias("ago"))
    both = g.join(c, "q_index", "left").join(ago, "q_index", "left")
    chosen = F.when(F.col("combo").isNotNull(), "combination").when(F.col("model").isNotNull(), "model").otherwise("print")
    return both.select("q_index", F.coalesce("combo", "model", "growth").alias("shown"), chosen.alias("chosen"), (100 * (F.col("value") / F.col("ago") - 1)).alias("yoy"))


@query("""select key, case when r.lag_days % 10 = 5 then cast(m.last + lag_days + 31 as date) else s.sibling end as next_release, m.last > p.last as updated from (select key, max(date) as last from monthly group by 1) m join registry r using (key)
    join (select category, max(cast(x.last + y.lag_days + 31 as date)) as sibling from (select key, max(date) as last from monthly group by 1) x join registry y using (key) where y.lag_days % 10 = 5 group by category) s on s.category = r.category
    join (select key, max(date) as last from monthly where month(date) <> 12 group by 1) p using (key)""")
def next_releases(spark: S, d: str) -> DataFrame:
    """Next release by a series' own rule, else that of a sibling of its category; marked as updated where its last month is later than in the payload before."""
    data = t.monthly(spark, d)
    last = data.groupBy("key").agg(F.max("date").alias("last"), F.max(F.when(F.month("date") != 12, F.col("date"))).alias("before")).where("before is not null")
    both = last.join(t.registry(spark, d), "key")
    own = F.when(F.col("lag_days") % 10 == 5, F.expr("date_add(last, lag_days + 31)"))
    sibling = both.groupBy("category").agg(F.max(own).alias("sibling")).where("sibling is not null")
    return both.join(sibling, "category").select("key", F.coalesce(own, "sibling").alias("next_release"), (F.col("last") > F.col("before")).alias("updated"))


@query("""select user_id, run_date, value, horizon, kind from (select user_id, run_date, value, case when event_id % 2 = 0 then 'current' else 'next' end as horizon, case when event_id % 3 = 0 then 'backfilled' else 'live' end as kind, row_number() over (partition by user_id, run_date order by case when event_id % 3 = 0 then 1 else 0 end, event_id desc) as n from runs_a) where n = 1""", ratios=("value",))
def migrated_runs(spark: S, d: str) -> DataFrame:
    """Old runs without the newer fields get their defaults, newer ones keep theirs; then live beats backfilled by key."""
    r = t.runs(spark, d, "view")
    old = r.where("event_id % 6 = 2 or event_id % 6 = 4").select("user_id", "run_date", "event_id", "value")  # before the fields were there: current, live
    new = r.where("not (event_id % 6 = 2 or event_id % 6 = 4)").select("user_id", "run_date", "event_id", "value", F.when(F.col("event_id") % 2 == 0, "current").otherwise("next").alias("horizon"), F.when(F.col("event_id") % 3 == 0, "backfilled").otherwise("live").alias("kind"))
    every = new.unionByName(old, allowMissingColumns=True).withColumns({"horizon": F.coalesce("horizon", F.lit("current")), "kind": F.coalesce("kind", F.lit("live"))})
    return joins.latest(every, ["user_id", "run_date"], F.when(F.col("kind") == "live", 0).otherwise(1), F.desc("event_id")).select("user_id", "run_date", "value", "horizon", "kind")


@query("""select key, date, versions, first_v, last_v, last_v <> first_v as revised from (select key, date, cast(case when month(date) % 2 = 0 then 2 else 1 end as bigint) as versions, v as first_v, case when month(date) % 2 = 0 and v % 3 = 0 then v + 1 else v end as last_v from (select key, date, cast(round(value) as bigint) as v from monthly))""")
def revision_snapshots(spark: S, d: str) -> DataFrame:
    """Dated snapshots appended as partitions; versions of each month, its first and its last value."""
    path = shared_dir(spark, "snapshots")
    c = cells(spark, d)
    c.write.parquet(f"{path}/vintage_date=2026-01-05")
    c.where("month(date) % 2 = 0").withColumn("v", F.col("v") + F.when(F.col("v") % 3 == 0, 1).otherwise(0)).write.parquet(f"{path}/vintage_date=2026-02-02")
    every = spark.read.schema("key string, date date, v bigint, vintage_date date").parquet(path)
    g = every.groupBy("key", "date").agg(F.count("*").alias("versions"), F.min_by("v", "vintage_date").alias("first_v"), F.max_by("v", "vintage_date").alias("last_v"))
    return g.withColumn("revised", F.col("last_v") != F.col("first_v"))


@query("""select year(date) * 12 + month(date) as month, key, value from monthly""", levels=("value",))
def publication_round(spark: S, d: str) -> DataFrame:
    """The panel published in two versions, the second added to the first, and read back by the newest manifest."""
    publication.register(spark)
    path = shared_dir(spark, "publication")
    m = t.monthly(spark, d).select((F.year("date") * 12 + F.month("date")).cast("bigint").alias("month"), "key", "value")
    middle = m.agg(F.expr("cast((min(month) + max(month)) / 2 as bigint)").alias("middle"))  # one row
    halves = m.join(F.broadcast(middle))
    halves.where("month <= middle").drop("middle").write.format("publication").mode("overwrite").save(path)
    halves.where("month > middle").drop("middle").write.format("publication").mode("append").save(path)
    return spark.read.format("publication").schema(m.schema).load(path)
