"""File sources: CSV series, ragged tables, release pages, vintages, ledgers. Each gives long rows or rows of broken rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DATE_NAMES = ("date", "ref_date", "time")
LONG = "key string, date date, value double"
FIRST_RELEASE = "quarter string, qoq_pct double, release_date date, source string"
MISSES = "quarter string, release_date date, model_qoq_pct double, first_print_qoq_pct double, miss_pp double, source string"


def number(c: Column) -> Column:
    """A double; text that isn't a number and NaN are null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def period(c: Column) -> Column:
    """'2026-05' and '2026-05-01' to that month, '2026Q2' and '2026 Q2' to the quarter's last month; else null."""
    month = F.when(c.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), F.trunc(F.concat(F.substring(c, 1, 7), F.lit("-01")).try_cast("date"), "MM"))
    quarter = F.when(c.rlike(r"^\d{4} ?Q[1-4]$"), F.make_date(F.substring(c, 1, 4).cast("int"), 3 * F.right(c, F.lit(1)).cast("int"), F.lit(1)))
    return F.coalesce(month, quarter)


def day(c: Column) -> Column:
    """dd/mm/yyyy or dd-Mon-yyyy."""
    parse = lambda f: F.try_to_timestamp(c, F.lit(f)).cast("date")
    return F.coalesce(parse("d/M/yyyy"), parse("d-MMM-yyyy"))


def keep_last(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("_n = 1").drop("_n")


def read_series(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV of one series: the date column is found by its name, the first other one has the values."""
    raw = spark.read.csv(path, header=True)
    date = next((c for c in raw.columns if c.lower() in DATE_NAMES), None)
    values = [c for c in raw.columns if c != date]
    if date is None or not values:
        raise ValueError(f"{path}: no date or no value column among {raw.columns}")
    rows = raw.select(F.lit(key).alias("key"), F.coalesce(period(F.col(date)), F.trunc(day(F.col(date)), "MM")).alias("date"), number(F.col(values[0])).alias("value"), F.monotonically_increasing_id().alias("_at"))
    return keep_last(rows.where("date is not null"), ["key", "date"], F.col("_at")).select("key", "date", "value")


def read_column(spark: SparkSession, path: str, series: str) -> DataFrame:
    """One named column of a wide CSV, indexed by period labels. A file of one column under another name is refused."""
    raw = spark.read.csv(path, header=True)
    if series not in raw.columns:
        raise ValueError(f"{path} has no column {series}")
    rows = raw.select(F.lit(series).alias("key"), period(F.col(raw.columns[0])).alias("date"), number(F.col(series)).alias("value"), F.monotonically_increasing_id().alias("_at"))
    return keep_last(rows.where("date is not null"), ["key", "date"], F.col("_at")).select("key", "date", "value")


def read_ragged(spark: SparkSession, path: str, series: str) -> DataFrame:
    """A CSV with notes above its header: the row that starts with 'Series ID' names the columns, data rows start with a digit."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\r?\n")).alias("line")).where("line <> ''")
    cells = F.split("line", ",", -1)
    place = lines.where(F.lower("line").startswith("series id,")).select(F.array_position(F.transform(cells, F.trim), F.lit(series)).alias("place"))
    data = lines.where(F.col("line").rlike("^[0-9]")).join(F.broadcast(place))  # one header row
    first = F.get(cells, F.lit(0))
    return data.where("place > 0").select(F.lit(series).alias("key"), F.coalesce(F.trunc(day(first), "MM"), period(first)).alias("date"), number(F.get(cells, F.col("place").cast("int") - 1)).alias("value")).where("date is not null")


def prefer_adjusted(rows: DataFrame, kind: str = "kind", adjusted: str = "Seasonally Adjusted") -> DataFrame:
    """Only adjusted rows of a key that has any, else all."""
    has = F.max((F.col(kind) == adjusted).cast("int")).over(Window.partitionBy("key"))
    return rows.withColumn("_has", has).where((F.col("_has") == 0) | (F.col(kind) == adjusted)).drop("_has")


def meta_tag(html: str, name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col(html), f'<meta[^>]*name="{name}"[^>]*content="([^"]*)"', 1), F.lit(""))


def trade_release(pages: DataFrame, html: str = "html") -> DataFrame:
    """Reference month and issue date of a release page, from its meta tags; a page whose issue isn't later is refused as null."""
    month, issued = period(F.substring(meta_tag(html, "dcterms.temporal"), 1, 7)), F.substring(meta_tag(html, "dcterms.issued"), 1, 10).try_cast("date")
    return pages.withColumns({"reference": month, "issued": issued}).withColumn("ok", F.coalesce(F.col("issued") > F.col("reference"), F.lit(False)))


def read_vintage(spark: SparkSession, path: str) -> DataFrame:
    """The long rows that write_vintage has stored."""
    return spark.read.csv(path, schema=LONG, header=True)


def write_vintage(panel: DataFrame, path: str) -> None:
    """Tidy long CSV, one folder; nulls are empty cells."""
    panel.select("key", F.date_format("date", "yyyy-MM-dd").alias("date"), "value").write.csv(path, header=True)


def locator_drift(registry: DataFrame, manifest: DataFrame) -> DataFrame:
    """Series whose locator in a stored vintage isn't the registry's; must be empty."""
    both = registry.select("key", F.col("locator").alias("now")).join(manifest.select("key", F.col("locator").alias("stored")), "key", "full")
    return both.where(~F.col("now").eqNullSafe(F.col("stored")))


def first_release_problems(rows: DataFrame) -> DataFrame:
    """Duplicate and missing quarters of a first-release table."""
    q = rows.select("quarter", (F.substring("quarter", 1, 4).cast("int") * 4 + F.right("quarter", F.lit(1)).cast("int") - 1).alias("q"))
    twice = q.groupBy("quarter").count().where("count > 1").select(F.lit("duplicate").alias("rule"), "quarter")
    gap = q.distinct().withColumn("b", F.lag("q").over(Window.orderBy("q"))).where("q > b + 1").select(F.lit("gap before").alias("rule"), "quarter")
    return twice.unionByName(gap)


def miss_problems(rows: DataFrame) -> DataFrame:
    """Ledger rows whose miss isn't model less print, and duplicates."""
    wrong = rows.where(F.abs(F.col("miss_pp") - (F.col("model_qoq_pct") - F.col("first_print_qoq_pct"))) > 1e-4).select(F.lit("identity").alias("rule"), "quarter")
    return wrong.unionByName(rows.groupBy("quarter").count().where("count > 1").select(F.lit("duplicate").alias("rule"), "quarter"))


def payload(panel: DataFrame, last: int = 50) -> DataFrame:
    """One JSON document a series with its last observations in order: what a site reads."""
    recent = panel.where("value is not null").withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("date")))).where(F.col("_n") <= last)
    points = F.array_sort(F.collect_list(F.struct(F.date_format("date", "yyyy-MM").alias("month"), "value")))
    return recent.groupBy("key").agg(points.alias("points")).select("key", F.to_json(F.struct("key", "points")).alias("document"))
