"""Queries on text and JSON sources: pages, properties, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources import tables as t

S = SparkSession


@query(r"""select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, cast(len(regexp_extract_all(html, '<a href="[^"]*"')) as integer) as links,
    regexp_extract(url, '^https?://([^/]+)', 1) as host from pages""")
def page_meta(spark: S, d: str) -> DataFrame:
    """Title, language, number of links and host of each page, by patterns in the JVM."""
    return t.table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit('<a href="[^"]*"'), F.lit(0))).alias("links"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("select event_type, cast(json_extract_string(props, '$.k') as integer) as k, count(*) as n, avg(value) as mean from events group by 1, 2", ratios=("mean",))
def json_properties(spark: S, d: str) -> DataFrame:
    """A typed field of a JSON column, aggregated."""
    e = t.table(spark, d, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"), "value")
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query(r"select conv_id, turn, role, cast(len(regexp_extract_all(text, '[0-9]+')) as integer) as numbers, regexp_extract(text, '([0-9]+)[^0-9]*$', 1) as last_number from conversations")
def numbers_in_text(spark: S, d: str) -> DataFrame:
    """How many numbers a message has, and the last."""
    return t.table(spark, d, "conversations").select("conv_id", "turn", "role", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("numbers"), F.regexp_extract("text", "([0-9]+)[^0-9]*$", 1).alias("last_number"))


@query("select run_date, horizon, sum(value) as value, count(*) as n from (select run_date, unnest(['current', 'next']) as horizon, unnest([value, value / 2]) as value from runs_a) group by 1, 2", ratios=("value",))
def payload_horizons(spark: S, d: str) -> DataFrame:
    """A nested payload of horizons, exploded to rows."""
    h = F.array(F.struct(F.lit("current").alias("horizon"), F.col("value").alias("value")), F.struct(F.lit("next").alias("horizon"), (F.col("value") / 2).alias("value")))
    return t.runs(spark, d, "view").select("run_date", F.inline(h)).groupBy("run_date", "horizon").agg(F.sum("value").alias("value"), F.count("*").alias("n"))


@query("select user_id, list_sort(list(distinct event_type)) as kinds, cast(date_trunc('day', min(ts)) as date) as first_day, max(ts) as last_ts from events group by user_id")
def run_archive(spark: S, d: str) -> DataFrame:
    """Kinds of runs, first day and last instant of each key."""
    return t.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"), F.min("ts").cast("date").alias("first_day"), F.max("ts").alias("last_ts"))
