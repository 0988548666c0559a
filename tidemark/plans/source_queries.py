"""Queries on sources: bindings of many series, survey and release texts, model specifications, files written and read back.

The tables stand in for recordings: a query writes its cells, lines or documents as a recording would have them
(through Spark, in the shared folder where files are needed), reads them by the library's readers, and its SQL gives
what must come out straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators import joins
from tidemark.plans.registry import query
from tidemark.sources import bindings, readers
from tidemark.sources import tables as t
from tidemark.streaming.ledger import shared_dir

S = SparkSession
#: Break of the spliced series in the tables' years.
SPLICED = "1995-07-01"
COLUMNS = bindings.columns()
_NUMBER = {c: k for k, c in enumerate(COLUMNS)}
_BOUND = ", ".join(f"('{key}', '{how}', 'NATION_{_NUMBER[a] % 25}', {'null' if b is None else f"'NATION_{_NUMBER[b] % 25}'"})" for key, _, _, how, a, b in bindings.BINDINGS)


def cells(spark: S, d: str) -> DataFrame:
    """key, date, v: the monthly panel in whole numbers, which print alike everywhere."""
    return t.monthly(spark, d).select("key", "date", F.round("value").cast("bigint").alias("v"))


def recorded(spark: S, d: str) -> DataFrame:
    """Raw cells as providers record them: every column has the numbers of one nation, dates are texts in three forms."""
    kinds = {c: how for *_, how, a, b in bindings.BINDINGS for c in (a, b) if c}
    rows = [(c, f"NATION_{k % 25}", kinds[c], next(p for _, p, _, _, a, b in bindings.BINDINGS if c in (a, b)), k % 3 != 0) for c, k in _NUMBER.items()]
    named = spark.createDataFrame(rows, "column string, key string, how string, provider string, adjusted boolean").join(cells(spark, d), "key")
    end = F.last_day("date")
    text = F.when(F.col("provider") == "abs", F.date_format("date", "yyyy-MM")).when(F.month("date") % 2 == 0, F.date_format(end, "dd-MMM-yyyy")).otherwise(F.date_format(end, "dd/MM/yyyy"))
    v = F.when(F.col("how") == "negated", -F.col("v")).otherwise(F.col("v"))
    one = lambda kind, day, x: F.struct(F.lit(kind).cast("string").alias("series_type"), day.alias("raw_date"), x.cast("string").alias("raw_value"))
    sort = F.when(F.col("how") == "mean", F.array(one(None, F.date_format("date", "dd-MMM-yyyy"), v), one(None, F.date_format(F.date_add("date", 9), "dd-MMM-yyyy"), v + 10)))
    sort = sort.when((F.col("provider") == "abs") & F.col("adjusted"), F.array(one("Seasonally Adjusted", text, v), one("Original", text, v + 1)))
    sort = sort.otherwise(F.array(one("Original", text, v), F.struct(F.lit("Original").alias("series_type"), F.lit("notes").alias("raw_date"), F.lit("n.a.").alias("raw_value"))))
    return named.select("column", F.inline(sort))


BOUND = f"""with r(key, how, a, b) as (values {_BOUND}), c as (select key as nation, date, cast(round(value) as bigint) as v from monthly)
    select r.key, m.date, cast(case how when 'sum' then a.v + b.v when 'spread' then a.v - b.v when 'splice' then case when m.date < date '{SPLICED}' then a.v else b.v end when 'mean' then a.v + 5 else a.v end as double) as value
    from r cross join months m left join c a on a.nation = r.a and a.date = m.date left join c b on b.nation = r.b and b.date = m.date
    where case how when 'sum' then a.v + b.v when 'spread' then a.v - b.v when 'splice' then case when m.date < date '{SPLICED}' then a.v else b.v end else a.v end is not null"""


@query(BOUND)
def bound_series(spark: S, d: str) -> DataFrame:
    """All bound series (plain, negated, monthly mean, spliced, summed, spread) from raw cells, by one plan."""
    return bindings.bound(recorded(spark, d), SPLICED)


@query(f"with r(key, how, a, b) as (values {_BOUND}) select key, 'no rows' as reason from r where key not in (select key from ({BOUND}))")
def refused_series(spark: S, d: str) -> DataFrame:
    """Bindings that must stop a run."""
    return bindings.refused(bindings.bound(recorded(spark, d), SPLICED))


@query("""with q as (select date, 100 * value / first_value(value) over (order by date) as c from target_q), s as (select m.date, coalesce(last_value(c ignore nulls) over (order by m.date rows between unbounded preceding and current row), first_value(c ignore nulls) over (order by m.date rows between current row and unbounded following)) as cpi
    from months m left join q on q.date = m.date) select key, v.date, value / cpi * 100 as real from monthly v join s on s.date = v.date where cpi is not null""", levels=("real",))
def real_spending(spark: S, d: str) -> DataFrame:
    """Nominal over a quarterly index carried as a step, flat beyond both ends: no month sees a later index."""
    q = t.target_q(spark, d).select("date", (100 * F.col("value") / F.first("value").over(Window.orderBy("date"))).alias("c"))
    data = t.monthly(spark, d)
    months = data.agg(F.explode(F.sequence(F.min("date"), F.max("date"), F.expr("interval 1 month"))).alias("date"))
    w = Window.orderBy("date")  # one row a month
    step = months.join(q, "date", "left").select("date", F.coalesce(F.last("c", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("c", True).over(w.rowsBetween(0, Window.unboundedFollowing))).alias("cpi"))
    return data.join(F.broadcast(step), "date").where("cpi is not null").select("key", "date", (F.col("value") / F.col("cpi") * 100).alias("real"))


@query("""with v as (select key, date, cast(round(value) as double) as value from monthly where month(date) <> 2) select key, date, value, key = 'NATION_7' as drifted, 'https://tables/' || key as locator from v""")
def stored_vintage(spark: S, d: str) -> DataFrame:
    """A vintage as files: long CSV and a manifest of locators, read back with a schema; drift of a locator is flagged."""
    path = shared_dir(spark, "vintage")
    panel = cells(spark, d).where("month(date) <> 2").select("key", "date", F.col("v").cast("double").alias("value"))
    readers.write_vintage(panel, f"{path}/series")
    registry = panel.select("key").distinct().withColumn("locator", F.concat(F.lit("https://tables/"), "key"))
    registry.withColumn("locator", F.when(F.col("key") == "NATION_7", "https://old").otherwise(F.col("locator"))).write.json(f"{path}/manifest")
    manifest = spark.read.schema("key string, locator string").json(f"{path}/manifest")
    drift = readers.locator_drift(registry, manifest).select("key", F.lit(True).alias("drifted"))
    return readers.read_vintage(spark, f"{path}/series").join(registry, "key").join(drift, "key", "left").select("key", "date", "value", F.coalesce("drifted", F.lit(False)).alias("drifted"), "locator")


# Survey texts: a monthly table (three months a line), quarterly appendix lines under a month header, and prose bullets.
def survey_lines(spark: S, d: str) -> DataFrame:
    """report, n, line."""
    c = cells(spark, d).withColumn("x", (F.col("v") % 161 - 80).cast("int"))
    at = lambda f: F.date_format("date", f)
    table = c.groupBy("key", F.year("date").alias("y"), F.quarter("date").alias("q")).agg(F.array_sort(F.collect_list(F.struct("date", "x"))).alias("p")).where("size(p) = 3")
    head = F.concat(F.lit("Index       "), F.array_join(F.transform("p", lambda r: F.date_format(r["date"], "MMM yyyy")), "   "))
    body = F.concat(F.col("key"), F.lit(" (net balance)   "), F.array_join(F.transform("p", lambda r: r["x"].cast("string")), "   "))
    monthly = table.select(F.concat(F.lit("m-"), "key", F.lit("-"), "y", F.lit("-"), "q").alias("report"), F.inline(F.array(F.struct(F.lit(1).alias("n"), head.alias("line")), F.struct(F.lit(2).alias("n"), body.alias("line")))))
    appendix = c.where("month(date) % 3 = 0").select(F.concat(F.lit("q-"), "key", F.lit("-"), at("yyyyMM")).alias("report"), F.inline(F.array(F.struct(F.lit(1).alias("n"), F.concat(F.lit("Appendix "), at("yyyy"), F.lit("m"), F.month("date").cast("string")).alias("line")), F.struct(F.lit(2).alias("n"), F.concat(F.col("key"), F.lit("  "), (F.col("x") + 1).cast("string")).alias("line")))))
    bullet = c.where("month(date) = 1").select(F.concat(F.lit("b-"), "key", F.lit("-"), at("yyyyMM")).alias("report"), F.lit(1).alias("n"), F.concat(F.lit("- In "), at("MMMM yyyy"), F.lit(", "), F.col("key"), F.lit(" moved to "), (F.col("x") + 2).cast("string"), F.lit(" points")).alias("line"))
    return monthly.unionByName(appendix).unionByName(bullet)


def parsed_survey(lines: DataFrame, low: int = -80, high: int = 80) -> DataFrame:
    """key, date, value, prio (1 quarterly, 2 table, 3 bullet): headers are carried to the lines below; values out of range go."""
    number = r"[-+]?\d+(?:\.\d+)?"
    w = Window.partitionBy("report").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    heads = F.when(line.startswith("Index"), F.regexp_extract_all(line, F.lit(r"([A-Z][a-z]{2} \d{4})"), F.lit(1)))
    month = F.when(line.rlike(r"\d{4}m\d{1,2}$"), F.regexp_extract(line, r"(\d{4}m\d{1,2})$", 1))
    rows = lines.withColumns({"heads": F.last(heads, True).over(w), "month": F.last(month, True).over(w)})
    body = F.regexp_replace(line, r"^\S+ \(net balance\)", "")
    table = rows.where(line.contains("(net balance)") & F.col("heads").isNotNull()).select(F.regexp_extract(line, r"^(\S+)", 1).alias("key"), F.inline(F.arrays_zip(F.col("heads").alias("at"), F.regexp_extract_all(body, F.lit(number), F.lit(0)).alias("v"))), F.lit(2).alias("prio")).withColumn("date", F.try_to_timestamp(F.concat(F.lit("1 "), "at"), F.lit("d MMM yyyy")).cast("date"))
    under = rows.where(F.col("month").isNotNull() & line.rlike(rf"^\S+ +{number}$")).select(F.regexp_extract(line, r"^(\S+)", 1).alias("key"), F.regexp_extract(line, rf"({number})$", 1).alias("v"), F.lit(1).alias("prio"), F.make_date(F.split("month", "m")[0].cast("int"), F.split("month", "m")[1].cast("int"), F.lit(1)).alias("date"))
    prose = rows.where(line.startswith("- In ")).select(F.regexp_extract(line, r", (\S+) moved", 1).alias("key"), F.regexp_extract(line, rf"to ({number}) points", 1).alias("v"), F.lit(3).alias("prio"), F.try_to_timestamp(F.concat(F.lit("1 "), F.regexp_extract(line, r"In ([A-Z][a-z]+ \d{4})", 1)), F.lit("d MMMM yyyy")).cast("date").alias("date"))
    every = table.select("key", "date", "v", "prio").unionByName(under.select("key", "date", "v", "prio")).unionByName(prose.select("key", "date", "v", "prio"))
    return every.select("key", "date", readers.number(F.col("v")).alias("value"), "prio").where(F.col("value").between(low, high))


SURVEY = """c as (select key, date, cast(cast(round(value) as bigint) % 161 - 80 as integer) as x from monthly), full_q as (select key, year(date) as y, quarter(date) as q from c group by 1, 2, 3 having count(*) = 3),
    every as (select key, date, x + 1 as value, 1 as prio from c where month(date) % 3 = 0 and x + 1 <= 80 union all select c.key, date, x, 2 from c join full_q f on f.key = c.key and f.y = year(date) and f.q = quarter(date)
    union all select key, date, x + 2, 3 from c where month(date) = 1 and x + 2 <= 80)"""


@query(f"with {SURVEY} select key, date, cast(value as double) as value, prio from every")
def survey_values(spark: S, d: str) -> DataFrame:
    """Numbers of survey texts: three months a table line, appendix lines under a month header, prose bullets; range guard."""
    return parsed_survey(survey_lines(spark, d))


@query(f"""with {SURVEY}, best as (select key, date, value, prio from (select *, row_number() over (partition by key, date order by prio) as n from every) where n = 1), old as (select key, date, cast(x as double) - 3 as value from c where year(date) = (select min(year(date)) from c))
    select coalesce(b.key, o.key) as key, coalesce(b.date, o.date) as date, coalesce(b.value, o.value) as value, coalesce(b.prio, 0) as prio from best b full join old o on o.key = b.key and o.date = b.date""")
def survey_merged(spark: S, d: str) -> DataFrame:
    """Best source of each month, merged into what is stored: new wins, and no stored month is lost."""
    best = joins.latest(parsed_survey(survey_lines(spark, d)), ["key", "date"], F.col("prio"))
    first = cells(spark, d).agg(F.min(F.year("date")).alias("first"))  # one row
    stored = cells(spark, d).join(F.broadcast(first)).where("year(date) = first").select("key", "date", (F.col("v") % 161 - 83).cast("double").alias("value"), F.lit(0).alias("prio"))
    return joins.upsert(stored, best, ["key", "date"])


@query("""select key, date, cast(value as double) as value from (select key, date, v as value, case when month(date) = 6 then 9.0 else round(100.0 * (v / cast(lag(v) over w as double) - 1), 1) end as printed, 100.0 * (v / cast(lag(v) over w as double) - 1) as implied
    from (select key, date, 100 + cast(round(value) as bigint) % 100 as v from monthly) window w as (partition by key order by date)) where value between 40 and 220 and (implied is null or abs(implied - printed) <= 3)""")
def checked_lines(spark: S, d: str) -> DataFrame:
    """Lines 'Mon-yy level change%': a level is kept in its range and where the printed change is the implied one, by 3 points."""
    w = Window.partitionBy("key").orderBy("date")
    c = cells(spark, d).select("key", "date", (100 + F.col("v") % 100).alias("v"))
    change = F.when(F.month("date") == 6, F.lit(9.0)).otherwise(F.round(100.0 * (F.col("v") / F.lag("v").over(w) - 1), 1))
    lines = c.withColumn("change", change).select("key", F.concat(F.date_format("date", "MMM-yy"), F.lit("  "), "v", F.lit("   "), F.coalesce(F.format_string("%.1f%%", "change"), F.lit("n/a"))).alias("line"))
    pattern = r"^([A-Z][a-z]{2}-\d{2})\s+(\d+)\s+(\S+)$"
    rows = lines.select("key", F.try_to_timestamp(F.concat(F.lit("1-"), F.regexp_replace(F.regexp_replace(F.regexp_extract("line", pattern, 1), r"-([7-9]\d)$", "-19$1"), r"-([0-6]\d)$", "-20$1")), F.lit("d-MMM-yyyy")).cast("date").alias("date"), F.regexp_extract("line", pattern, 2).cast("double").alias("value"), readers.number(F.rtrim(F.regexp_replace(F.regexp_extract("line", pattern, 3), "%", ""))).alias("printed"))
    implied = 100.0 * (F.col("value") / F.lag("value").over(w) - 1)
    return rows.withColumn("implied", implied).where("value between 40 and 220 and (implied is null or abs(implied - printed) <= 3)").select("key", "date", "value")


@query("""select key, date, 60 + cast(round(value) as bigint) % 85 as value, month(date) % 6 = 5 as provisional from monthly where date <= (select max(cast(o_orderdate as date)) from orders)""")
def year_tables(spark: S, d: str) -> DataFrame:
    """An HTML table of years by months to long rows; ** marks a provisional value; future months and values out of 50 to 150 are refused."""
    c = cells(spark, d)
    cell = F.concat(F.lit("<td>"), F.coalesce((60 + F.col("v") % 85).cast("string"), F.lit("")), F.when(F.month("date") % 6 == 5, "**").otherwise(""), F.lit("</td>"))
    by_year = c.select("key", F.year("date").alias("y"), F.month("date").alias("m"), cell.alias("cell")).groupBy("key", "y").agg(F.map_from_entries(F.collect_list(F.struct("m", "cell"))).alias("cells"))  # twelve at most
    row = F.concat(F.lit("<tr><th>"), "y", F.lit("</th>"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.coalesce(F.element_at("cells", m), F.lit("<td></td>"))), ""), F.lit("</tr>"))
    pages = by_year.groupBy("key").agg(F.concat(F.lit("<table>"), F.array_join(F.array_sort(F.collect_list(row)), "\n"), F.lit("</table>")).alias("html"))
    rows = pages.select("key", F.explode(F.regexp_extract_all("html", F.lit("(<tr>.*?</tr>)"), F.lit(1))).alias("tr"))
    rows = rows.select("key", F.regexp_extract("tr", r"<th>(\d{4})</th>", 1).cast("int").alias("y"), F.posexplode(F.regexp_extract_all("tr", F.lit("<td>([^<]*)</td>"), F.lit(1))).alias("m", "cell"))
    value = F.regexp_replace("cell", r"\*+$", "").try_cast("bigint")
    rows = rows.select("key", F.make_date("y", F.col("m") + 1, F.lit(1)).alias("date"), value.alias("value"), F.col("cell").endswith("**").alias("provisional"))
    now = t.table(spark, d, "orders").agg(F.max(F.col("o_orderdate").cast("date")).alias("now"))  # one row
    return rows.where("value between 50 and 150").join(F.broadcast(now)).where("date <= now").drop("now")


@query("""select q_index, cast(q_index // 4 as varchar) || 'Q' || cast(q_index % 4 + 1 as varchar) as quarter, case when q_index % 4 = 1 then 'May' else 'Nov' end as edition, round(growth, 1) as forecast from growth where growth is not null and q_index % 4 in (1, 3) and q_index % 8 <> 1""", ratios=("forecast",))
def benchmark_rows(spark: S, d: str) -> DataFrame:
    """Forecast tables by caption, with a Unicode minus; only target quarters that the cache lacks are read; Q2 is May's edition and Q4 November's."""
    g = t.growth(spark, d).where("growth is not null")
    edition = lambda i: F.when(i % 4 == 1, "May").when(i % 4 == 3, "Nov")
    number = F.regexp_replace(F.format_string("%.1f", F.round("growth", 1)), "-", "−")
    pages = g.where("q_index % 4 in (1, 3)").select("q_index", F.concat(F.lit("<table><caption>Other</caption><tr><td>GDP</td><td>9.9</td></tr></table><table><caption>Output growth and inflation</caption><tr><td>CPI</td><td>1.0</td></tr><tr><td>GDP</td><td>"), number, F.lit("</td></tr></table>")).alias("html"))
    cached = g.where("q_index % 8 = 1").select("q_index")
    table = F.regexp_extract("html", "<table><caption>Output growth and inflation</caption>(.*?)</table>", 1)
    cell = F.regexp_extract(table, "<tr><td>GDP</td><td>([^<]*)</td>", 1)
    value = F.regexp_replace(cell, "−", "-").try_cast("double")
    i = F.col("q_index")
    return pages.join(cached, "q_index", "left_anti").select("q_index", calendar.quarter_label(i).alias("quarter"), edition(i).alias("edition"), value.alias("forecast"))


@query("""select key, cast(last_day(max(date)) + 10 as date) as released, cast(last_day(max(date)) + 40 as date) as next from monthly group by key""")
def release_pages(spark: S, d: str) -> DataFrame:
    """Release and next release dates from pages: series that share a page read it once, and get its dates back."""
    last = t.monthly(spark, d).groupBy("key").agg(F.max("date").alias("date"))
    urls = last.select("key", F.concat(F.lit("https://releases/"), F.date_format("date", "yyyy-MM")).alias("url"), "date")
    show = lambda n: F.date_format(F.date_add(F.last_day("date"), n), "dd/MM/yyyy")
    pages = urls.select("url", F.concat(F.lit("<p>Release date:</p><b>"), show(10), F.lit("</b><p>Next Release</p> "), show(40)).alias("html")).distinct()
    found = lambda label: F.try_to_timestamp(F.regexp_extract("html", rf"{label}[^0-9]*(\d\d/\d\d/\d{{4}})", 1), F.lit("dd/MM/yyyy")).cast("date")
    return urls.select("key", "url").join(pages.select("url", found("Release date").alias("released"), found("Next Release").alias("next")), "url").select("key", "released", "next")


@query(r"""select page_id, regexp_extract(html, 'href="([^"]+)"', 1) as first_link, len(list_filter(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda x: x like '/%')) as own_links from pages""")
def landing_links(spark: S, d: str) -> DataFrame:
    """First link of each page, and how many lead to its own site."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return t.table(spark, d, "pages").select("page_id", F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"), F.size(F.filter(links, lambda x: x.startswith("/"))).cast("bigint").alias("own_links"))


@query("""select date, cast(1000 + v as double) as value, 'history' as source from (select date, cast(round(sum(value)) as bigint) % 14500 as v from monthly where date < date '1998-01-01' group by date) where 1000 + v <= 15000
    union all select max(date), 2500.0, 'latest' from monthly""")
def price_history(spark: S, d: str) -> DataFrame:
    """A Latin-1 CSV of year, month and price with thousands marks; a newest value is added only if it is later than the history."""
    path = shared_dir(spark, "prices")
    c = t.monthly(spark, d).groupBy("date").agg((F.round(F.sum("value")).cast("bigint") % 14500 + 1000).alias("v"))
    c.where("date < date'1998-01-01'").select(F.year("date").alias("Année"), F.date_format("date", "MMMM").alias("Month"), F.format_number("v", 0).alias("Price")).write.option("encoding", "ISO-8859-1").csv(path, header=True)
    raw = spark.read.option("encoding", "ISO-8859-1").csv(path, header=True)
    day = F.try_to_timestamp(F.concat(F.lit("1 "), "Month", F.lit(" "), raw.columns[0]), F.lit("d MMMM yyyy")).cast("date")
    history = raw.select(day.alias("date"), F.regexp_replace("Price", "[^0-9.]", "").try_cast("double").alias("value"), F.lit("history").alias("source")).where("value between 1000 and 15000")
    scraped = c.agg(F.max("date").alias("date")).select("date", F.lit(2500.0).alias("value"), F.lit("latest").alias("source"))
    newer = scraped.join(F.broadcast(history.agg(F.max("date").alias("h"))), F.col("date") > F.col("h")).drop("h")  # one row
    return history.unionByName(newer)


SPEC_CODES = {"m": "monthly", "q": "quarterly"}


@query("""with s as (select n_nationkey as row, n_name as key, case when n_nationkey % 6 = 5 then 'x' when n_nationkey % 3 = 0 then 'q' else 'm' end as f, n_nationkey % 4 as w, case n_nationkey % 4 when 0 then 'lin' when 1 then 'chg' when 2 then 'pch' else 'pca' end as tcode, n_nationkey % 5 as trend from nation)
    select key, case f when 'm' then 'monthly' else 'quarterly' end as frequency, cast(case w when 1 then null when 0 then 0 else 1 end as double) as block, case when tcode = 'pch' then trend / 12.0 else cast(trend as double) end as trend,
    cast(row_number() over (order by case f when 'm' then 0 else 1 end, row) as integer) as place from s where f <> 'x'""", ratios=("trend",))
def model_spec(spark: S, d: str) -> DataFrame:
    """A specification file: columns in any case, codes to labels, stable order by frequency (unknown ones are dropped), trend of pch a twelfth, block 1 free and above 1 fixed at 1."""
    path = shared_dir(spark, "spec")
    n = F.col("n_nationkey")
    code = F.when(n % 6 == 5, "x").when(n % 3 == 0, "q").otherwise("m")
    kind = F.element_at(F.array(*map(F.lit, ("lin", "chg", "pch", "pca"))), n % 4 + 1)
    t.table(spark, d, "nation").select(n.alias("RowNo"), F.col("n_name").alias("SeriesID"), code.alias("FREQUENCY"), (n % 4).alias("Block0_Global"), kind.alias("transformation"), (n % 5).alias("Trend")).write.csv(path, header=True)
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*(c.lower() for c in raw.columns)).withColumns({c: F.col(c).cast("int") for c in ("rowno", "block0_global", "trend")})
    rank = F.array_position(F.array(*map(F.lit, SPEC_CODES)), F.col("frequency"))
    labels = F.create_map(*(F.lit(x) for kv in SPEC_CODES.items() for x in kv))
    block = F.when(F.col("block0_global") > 1, 1.0).when(F.col("block0_global") == 0, 0.0)
    trend = F.col("trend") / F.when(F.col("transformation") == "pch", 12.0).otherwise(1.0)
    kept = raw.where(rank > 0).withColumn("place", F.row_number().over(Window.orderBy(rank, "rowno")))  # a model's rows are few
    return kept.select(F.col("seriesid").alias("key"), F.element_at(labels, F.col("frequency")).alias("frequency"), block.alias("block"), trend.alias("trend"), "place")


@query("""with n as (select m.key as nation, cast(m.date - to_months(cast(100 * (n_nationkey // 5) as integer)) as date) as date, cast(n_nationkey % 5 as integer) as series, cast(cast(round(value) as bigint) % (case when n_nationkey % 5 = 0 then 300 else 161 end) - 80 as double) as value from monthly m join nation on n_name = m.key),
    v as (select series, case when series = 1 and month(date) = 7 then date + 3 else date end as date, value from n where not (series = 2 and year(date) > 1980)),
    o as (select series, date, value + case when month(date) % 4 = 0 then 0.5 else 0 end as value from n where month(date) <> 2)
    select series, rows, off_first, outside, rows >= 300 and repeated = 0 and off_first = 0 and outside = 0 as ok, changed, gained, dropped from (
        select series, count(v.value) as rows, count(v.value) - count(distinct case when v.value is not null then date end) as repeated, count(*) filter (v.value is not null and day(date) <> 1) as off_first, count(*) filter (v.value < -80 or v.value > 80) as outside,
            count(*) filter (o.value <> v.value) as changed, count(*) filter (o.value is null) as gained, count(*) filter (v.value is null) as dropped
        from (select series, date, value from v) v full join o using (series, date) group by series)""")
def synced_series(spark: S, d: str) -> DataFrame:
    """Stored series replaced by newer ones, each only if it has 300 rows, no day twice, firsts of months alone and values from -80 to 80; what the newer changes, adds and drops.

    A series is the nations of a residue one after another, 100 months apart.
    """
    k = F.col("n_nationkey")
    n = t.monthly(spark, d).join(t.table(spark, d, "nation").select(F.col("n_name").alias("key"), k), "key")
    n = n.select((k % 5).alias("series"), F.expr("add_months(date, -100 * cast(floor(n_nationkey / 5) as int))").alias("date"), (F.round("value").cast("bigint") % F.when(k % 5 == 0, 300).otherwise(161) - 80).cast("double").alias("value"))
    newer = n.where("not (series = 2 and year(date) > 1980)").withColumn("date", F.when((F.col("series") == 1) & (F.month("date") == 7), F.date_add("date", 3)).otherwise(F.col("date")))
    older = n.where("month(date) <> 2").withColumn("value", F.col("value") + F.when(F.month("date") % 4 == 0, 0.5).otherwise(0.0))
    return synced(newer, older)


def synced(newer: DataFrame, older: DataFrame, least: int = 300, low: float = -80, high: float = 80) -> DataFrame:
    """Whether each newer series may replace the older one, and what it changes. Both: series, date, value."""
    both = newer.join(older.withColumnRenamed("value", "old"), ["series", "date"], "full")
    there, v = F.col("value").isNotNull(), F.col("value")
    count = lambda c: F.count(F.when(c, 1))
    g = both.groupBy("series").agg(
        count(there).alias("rows"), F.count_distinct(F.when(there, F.col("date"))).alias("days"), count(there & (F.dayofmonth("date") != 1)).alias("off_first"), count((v < low) | (v > high)).alias("outside"),
        count(v != F.col("old")).alias("changed"), count(F.col("old").isNull()).alias("gained"), count(~there).alias("dropped"),
    )
    ok = (F.col("rows") >= least) & (F.col("rows") == F.col("days")) & (F.col("off_first") == 0) & (F.col("outside") == 0)
    return g.select("series", "rows", "off_first", "outside", ok.alias("ok"), "changed", "gained", "dropped")


@query("""with o as (select as_of, cast(date_trunc('month', as_of) as date) as m, cast(cast(date_trunc('month', as_of) as date) + cast((9 - dayofweek(cast(date_trunc('month', as_of) as date))) % 7 as integer) + 7 as date) as second from (select distinct cast(date_trunc('week', o_orderdate) as date) as as_of from orders))
    select as_of, expected, last, last < expected as late from (select as_of, cast(case when as_of >= second + 2 then m - interval 1 month else m - interval 2 month end as date) as expected, cast(m - interval (case when month(m) % 3 = 0 then 3 else 1 end) month as date) as last from o)""")
def survey_freshness(spark: S, d: str) -> DataFrame:
    """Month a survey should have by an as-of date (second Tuesday and two days' grace), and whether the data is behind it."""
    o = t.table(spark, d, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "week").alias("as_of")).distinct().withColumn("m", F.trunc("as_of", "MM"))
    due = F.date_add(calendar.nth_weekday(F.col("m"), "Tue", 2), 2)
    expected = F.add_months("m", F.when(F.col("as_of") >= due, -1).otherwise(-2))
    last = F.add_months("m", F.when(F.month("m") % 3 == 0, -3).otherwise(-1))
    return o.select("as_of", expected.alias("expected"), last.alias("last")).withColumn("late", F.col("last") < F.col("expected"))


@query("""select key, 'v1' as state, count(*) as n from monthly where month(date) <> 7 and date < date '1997-01-01' group by key union all select key, 'added', count(*) from monthly where month(date) <> 7 and date >= date '1997-01-01' group by key""")
def cached_source(spark: S, d: str) -> DataFrame:
    """A cached source: stored rows stay, only later ones are fetched and appended; rows before the start date are not asked for."""
    path = shared_dir(spark, "cache")
    c = cells(spark, d).where("month(date) <> 7")
    c.where("date < date'1997-01-01'").withColumn("state", F.lit("v1")).write.parquet(path)
    stored = spark.read.schema("key string, date date, v bigint, state string").parquet(path)
    until = stored.groupBy("key").agg(F.max("date").alias("until"))
    fresh = c.join(until, "key", "left").where("until is null or date > until").select("key", "date", "v", F.lit("added").alias("state"))
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(stored.schema).parquet(path).groupBy("key", "state").agg(F.count("*").alias("n"))
