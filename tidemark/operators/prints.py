"""The first-print recorder: what was printed first, how far the estimate was off, and the correction that follows.

A job that runs weekly would append to these ledgers run by run. Here all runs are one plan: each quarter finds the first run
at or after its release, since later runs can only meet it older or behind a newer quarter, and says what that run did with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import joins

#: A print older than this may have been revised.
MAX_AGE_DAYS = 80
WINDOW, LEAST = 8, 4


def published(live: DataFrame, recorded: DataFrame) -> DataFrame:
    """The live table where it holds any value, else the recorded one; basis says which. Both: quarter, value, release."""
    some = live.where("value is not null")
    any_live = some.select(F.lit(1).alias("_one")).limit(1)
    stale = recorded.where("value is not null").withColumn("_one", F.lit(1)).join(F.broadcast(any_live), "_one", "left_anti").drop("_one")  # one row at most
    return some.withColumn("basis", F.lit("live")).unionByName(stale.withColumn("basis", F.lit("recorded")))


def first_prints(levels: DataFrame, runs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """quarter, release, recorded (date of the run), status, first_print (growth in per cent, 4 places; null unless recorded).

    levels: quarter (index), value, release, one row a quarter; quarters without value don't count. runs: run_date. known: quarters recorded before.
    status, the first that holds: known; no run (none since the release); superseded (a newer quarter was out at the first run);
    no preceding quarter; stale (over 80 days old at the first run); recorded.
    """
    order = Window.orderBy("quarter")  # one row a quarter
    g = levels.where("value is not null").select("quarter", "release", "value", *(F.lag(c).over(order).alias(f"_{c}") for c in ("quarter", "value")), F.lead("release").over(order).alias("_next"))
    back = lambda c: -F.datediff(c, F.lit("1970-01-01").cast("date"))
    one = F.lit(1).alias("_one")
    due = joins.as_of(g.withColumn("_one", one).withColumn("_back", back("release")), runs.select(one, "run_date", back("run_date").alias("_back")), ["_one"], "_back", ["run_date"], "_back", span=lambda c: F.floor(c / 365))
    if known is None:
        due = due.withColumn("_known", F.lit(None).cast("int"))
    else:
        due = due.join(known.select("quarter").distinct().withColumn("_known", F.lit(1)), "quarter", "left")
    run = F.col("right_run_date")
    status = (
        F.when(F.col("_known").isNotNull(), "known").when(run.isNull(), "no run").when(F.col("_next") <= run, "superseded")
        .when(F.col("_quarter").isNull() | (F.col("_quarter") != F.col("quarter") - 1), "no preceding quarter").when(F.datediff(run, "release") > MAX_AGE_DAYS, "stale").otherwise("recorded")
    )
    return due.select("quarter", "release", run.alias("recorded"), status.alias("status"), (100 * (F.col("value") / F.col("_value") - 1)).alias("g")).select("quarter", "release", "recorded", "status", F.when(F.col("status") == "recorded", F.round("g", 4)).alias("first_print"))


def misses(prints: DataFrame, history: DataFrame, by: list[str], known: DataFrame | None = None) -> DataFrame:
    """By model and printed quarter: release, run_date, model, first_print, miss (4 places) and status (appended, or no live estimate).

    prints: quarter, release, first_print; those without a print are left out. history: by, target, run_date, seq, estimate, kind, backfilled.
    The estimate is the last that a reader saw before the print: of a live nowcast, dated before the release; of equals the first by seq.
    known: by, quarter, release, the ledger so far: only quarters released after its last one are appended.
    """
    due = prints.where("first_print is not null").select("quarter", "release", "first_print")
    models = history.select(*by).distinct()
    due = due.join(F.broadcast(models)) if by else due  # one row a model and quarter: what comes out
    if known is not None:
        floor = known.groupBy(*by).agg(F.max("release").alias("_floor"))
        due = (due.join(floor, by, "left") if by else due.join(F.broadcast(floor))).where("_floor is null or release > _floor").drop("_floor")
    live = history.where("not coalesce(backfilled, false) and coalesce(kind, 'nowcast') = 'nowcast' and estimate is not null").withColumnRenamed("target", "quarter")
    last = live.join(due.select(*by, "quarter", "release"), [*by, "quarter"]).where("run_date < release").groupBy(*by, "quarter").agg(F.max_by(F.struct("run_date", "estimate"), F.struct("run_date", -F.col("seq"))).alias("_run"))
    out = due.join(last, [*by, "quarter"], "left")
    model = F.col("_run.estimate")
    return out.select(*by, "quarter", "release", F.col("_run.run_date").alias("run_date"), model.alias("model"), "first_print", F.round(model - F.col("first_print"), 4).alias("miss"), F.when(model.isNull(), "no live estimate").otherwise("appended").alias("status"))


def corrections(ledger: DataFrame, runs: DataFrame, by: list[str], window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """By model and run date: pp (mean of the last `window` misses printed by then, 4 places), n, first_quarter, last_quarter; all but n null under `least` misses.

    A model without any miss has no rows.
    """
    if window < 1 or least < 1:
        raise ValueError(f"window and least must be at least 1, got {window} and {least}")
    kept = ledger.where("miss is not null")
    parts = F.round(10_000 * F.col("miss")).cast("long")  # misses have 4 places: whole numbers add up in any order
    w = Window.partitionBy(*by).orderBy("release").rowsBetween(1 - window, 0)
    enough = lambda c: F.when(F.count("*").over(w) >= least, c)
    means = kept.select(*by, F.col("release").alias("run_date"), enough(F.round(F.sum(parts).over(w) / F.count("*").over(w)) / 10_000).alias("pp"), F.count("*").over(w).cast("int").alias("n"), enough(F.first("quarter").over(w)).alias("first_quarter"), enough(F.col("quarter")).alias("last_quarter"))
    grid = runs.select("run_date").distinct().join(F.broadcast(kept.select(*by).distinct())) if by else runs.select("run_date").distinct()  # what comes out
    out = joins.as_of(grid, means, by, "run_date", ["pp", "n", "first_quarter", "last_quarter"], "last_quarter")
    return out.select(*by, "run_date", F.col("right_pp").alias("pp"), F.coalesce("right_n", F.lit(0)).alias("n"), F.col("right_first_quarter").alias("first_quarter"), F.col("right_last_quarter").alias("last_quarter"))
