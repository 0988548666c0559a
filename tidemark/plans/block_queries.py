"""The block model over vintages of the panel: loadings, refusals and densities."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import chain_runs
from tidemark.plans.kernel_queries import growth_rows
from tidemark.plans.registry import query
from tidemark.sources import tables as t
from tidemark.streaming import ledger

S = SparkSession

#: (burn, draws) of a cold and of a warm chain; short, so quantiles are rough: 16 to 84 per cent from 60 draws are off by about a sixth of a deviation.
COLD, WARM = (60, 30), (15, 30)
SEEDS = 2
#: Vintages that are estimated, one a quarter, newest last.
VINTAGES = 3
#: Days from a quarter's end to its first print.
TARGET_LAG = 60
#: Mean loading of the target on the global block under which a chain is refused.
FLOOR = 0.05


def vintage_dates(spark: S, d: str, count: int = VINTAGES, step: int = 3) -> list[dt.date]:
    """The ends of the panel's last quarters of months."""
    last = growth_rows(spark, d).agg(F.max("date").alias("m")).select(*(F.last_day(F.add_months("m", -step * k)).alias(f"v{k}") for k in range(count))).first()
    return sorted(v for v in last if v is not None)


def vintage_rows(spark: S, d: str, vintages: list[dt.date]) -> DataFrame:
    """as_of, key, category, date, x: what had been published of each series at each vintage, the quarterly target in its last months."""
    series = growth_rows(spark, d).join(t.registry(spark, d).select("key", "category", "lag_days"), "key").select("key", "category", "date", "x", "lag_days")
    target = t.growth(spark, d).where("growth is not null").select(F.lit(chain_runs.TARGET).alias("key"), F.lit("target").alias("category"), "date", F.col("growth").alias("x"), F.lit(TARGET_LAG).alias("lag_days"))
    every = series.unionByName(target).withColumn("as_of", F.explode(F.array(*map(F.lit, vintages))))
    return every.where(F.date_add(F.last_day("date"), F.col("lag_days")) <= F.col("as_of")).select("as_of", "key", "category", "date", "x")


def estimated(spark: S, d: str, vintages: list[dt.date], folder: str | None = None) -> DataFrame:
    return chain_runs.advanced(vintage_rows(spark, d, vintages), vintages, SEEDS, folder or ledger.shared_dir(spark, "chains"), COLD, WARM)


@query()
def block_loadings(spark: S, d: str) -> DataFrame:
    """Posterior loadings of each series on each block, by vintage and seed; every vintage's chain starts from the one before."""
    each = chain_runs.loadings(estimated(spark, d, vintage_dates(spark, d)))
    return each.groupBy("as_of", "seed", "key", "block").agg(F.avg("loading").alias("loading"), F.stddev("loading").alias("deviation"), F.count("*").alias("draws"))


@query()
def block_refusals(spark: S, d: str) -> DataFrame:
    """Which chains have lost the target's tie to the global block."""
    return chain_runs.refusals(estimated(spark, d, vintage_dates(spark, d)), FLOOR)


@query()
def block_density(spark: S, d: str) -> DataFrame:
    """Quantiles of the target's estimate at each vintage, from the draws of the oldest one's chains that aren't refused; nothing is estimated again."""
    vintages = vintage_dates(spark, d)
    draws = estimated(spark, d, vintages[:1])
    good = chain_runs.refusals(draws, FLOOR).where("not refused").select("as_of", "seed")
    values = chain_runs.density(vintage_rows(spark, d, vintages), draws.join(good, ["as_of", "seed"], "left_semi"))
    p = F.percentile("value", F.array(*map(F.lit, (0.025, 0.16, 0.5, 0.84, 0.975)))).alias("p")
    return values.groupBy("as_of").agg(p, F.count("*").alias("draws")).select("as_of", *(F.col("p")[k].alias(n) for k, n in enumerate(("p2", "p16", "p50", "p84", "p97"))), "draws")
