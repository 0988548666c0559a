"""Readers: Parquet tables and the derived long tables that queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month(c: str) -> Column:
    return F.trunc(F.col(c).cast("date"), "MM")


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the nation of their supplier; only the columns that a panel needs are read."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_discount", "l_linestatus", "l_shipdate")
    nations = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return items.join(nations, F.col("l_suppkey") == F.col("s_suppkey"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long panel: key, date (first of month), value."""
    return shipped(spark, sf_dir).groupBy(F.col("n_name").alias("key"), month("l_shipdate").alias("date")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))


def target_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarterly target: q_index, date (last month of the quarter), value."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").groupBy((F.year(day) * 4 + F.quarter(day) - 1).alias("q_index"), F.add_months(F.trunc(day, "quarter"), 2).alias("date")).agg(F.sum("o_totalprice").alias("value"))


def growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target with its quarter-on-quarter growth; one row a quarter, so one window partition is small."""
    w = Window.orderBy("q_index")
    return target_q(spark, sf_dir).withColumn("growth", 100 * (F.col("value") / F.lag("value").over(w) - 1))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a series: publication lag, transformation, category."""
    kind = F.element_at(F.array(*map(F.lit, ("lin", "chg", "pch", "pca"))), F.col("n_nationkey") % 4 + 1)
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_name").alias("key"), (15 + 5 * (F.col("n_nationkey") % 10)).cast("int").alias("lag_days"), kind.alias("tcode"), F.col("r_name").alias("category"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First print and latest value of each series and month."""
    first = F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")))
    return shipped(spark, sf_dir).groupBy(F.col("n_name").alias("key"), month("l_shipdate").alias("date")).agg(first.alias("first"), F.sum("l_extendedprice").alias("latest"))


def runs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Model runs: user_id, event_id, run_date, ts, value."""
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", "event_id", F.col("ts").cast("date").alias("run_date"), "ts", "value")


def misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of misses: last quarter's growth as the model, this quarter's as what was printed."""
    w = Window.orderBy("q_index")
    both = growth(spark, sf_dir).select("q_index", "date", F.date_add("date", 60).alias("release_date"), F.lag("growth").over(w).alias("model"), F.col("growth").alias("actual"))
    return both.where("model is not null").withColumn("miss", F.col("model") - F.col("actual"))
