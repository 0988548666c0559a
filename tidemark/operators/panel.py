"""Operators on the long panel (key, date, value): spine, shifts, rolling scale, interpolation, splicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine(panel: DataFrame, key: str = "key", date: str = "date", value: str = "value") -> DataFrame:
    """Every key at every month between the panel's first and last: shifts by rows are then shifts by months."""
    ends = panel.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    months = ends.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias(date))
    keys = panel.select(key).distinct()
    return keys.join(F.broadcast(months)).join(panel.select(key, date, value), [key, date], "left")  # months: one row a month


def over(key: str = "key", date: str = "date") -> Window:
    return Window.partitionBy(key).orderBy(date)


def ratio(now: Column, before: Column) -> Column:
    """now / before, null where either is missing or before is 0."""
    return F.when(before != 0, now / before)


def transformed(panel: DataFrame, code: str = "tcode", step: int = 1, periods: int = 12, value: str = "value") -> DataFrame:
    """Per row's code: lin level, chg change, pch percent change, pca percent change at annual rate."""
    before = F.lag(value, step).over(over())
    r = ratio(F.col(value), before)
    return panel.withColumn("x", F.when(F.col(code) == "lin", F.col(value)).when(F.col(code) == "chg", F.col(value) - before).when(F.col(code) == "pch", 100 * (r - 1)).when(F.col(code) == "pca", 100 * (F.pow(r, periods // step) - 1)))


def differences(panel: DataFrame, value: str = "value") -> DataFrame:
    """t1 level, t2 one-month, t3 four-, t4 twelve-month change, t5 change of change, t6 and t7 change of t3 and t4; of logs."""
    log = F.when(F.col(value) > 0, F.log(value))
    w = over()
    first = panel.withColumn("t1", log)
    for name, k in (("t2", 1), ("t3", 4), ("t4", 12)):
        first = first.withColumn(name, F.col("t1") - F.lag("t1", k).over(w))
    for name, of in (("t5", "t2"), ("t6", "t3"), ("t7", "t4")):
        first = first.withColumn(name, F.col(of) - F.lag(of).over(w))
    return first


def rolling_scaled(panel: DataFrame, width: int, value: str = "value") -> DataFrame:
    """Centred on the mean of the window that begins at the row (the last window near the end), then over its root mean square."""
    w = Window.partitionBy("key").orderBy("date")
    n = F.count("*").over(Window.partitionBy("key"))
    nth = F.row_number().over(w)
    last = F.avg(F.when(F.col("_nth") > F.col("_n") - width, F.col(value))).over(Window.partitionBy("key"))
    ahead = F.avg(value).over(w.rowsBetween(0, width - 1))
    centred = panel.withColumns({"_n": n, "_nth": nth}).withColumn("centred", F.col(value) - F.when(F.col("_nth") <= F.col("_n") - width + 1, ahead).otherwise(last))
    every = Window.partitionBy("key")
    rms = F.sqrt(F.sum(F.col("centred") * F.col("centred")).over(every) / (F.count("centred").over(every) - 1))
    return centred.withColumn("scaled", F.when(rms > 0, F.col("centred") / rms)).drop("_n", "_nth")


def standardised(panel: DataFrame, value: str = "value") -> DataFrame:
    """(x - mean) / sd with one degree of freedom; a constant series has sd 1; under two observations null."""
    every = Window.partitionBy("key")
    sd = F.stddev_samp(value).over(every)
    return panel.withColumn("z", F.when(F.count(value).over(every) >= 2, (F.col(value) - F.avg(value).over(every)) / F.when(sd > 0, sd).otherwise(1.0)))


def interpolated(panel: DataFrame, value: str = "value", out: str = "filled") -> DataFrame:
    """Linear in days between the observations around an interior gap; ends stay null."""
    back = over().rowsBetween(Window.unboundedPreceding, 0)
    on = over().rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col(value).isNotNull(), F.struct("date", value))
    both = panel.withColumns({"_a": F.last(seen, True).over(back), "_b": F.first(seen, True).over(on)})
    share = F.datediff("date", "_a.date") / F.datediff("_b.date", "_a.date")
    line = F.col(f"_a.{value}") + share * (F.col(f"_b.{value}") - F.col(f"_a.{value}"))
    return both.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).otherwise(line)).drop("_a", "_b")


def carried(panel: DataFrame, value: str = "value", out: str = "carried") -> DataFrame:
    """The last observation, as a step."""
    return panel.withColumn(out, F.last(value, True).over(over().rowsBetween(Window.unboundedPreceding, 0)))


def spliced(new: DataFrame, old: DataFrame, least: int = 6) -> DataFrame:
    """new, with older months from old rescaled by the geometric mean ratio over at least `least` common months."""
    both = new.select("key", "date", F.col("value").alias("new")).join(old.select("key", "date", F.col("value").alias("old")), ["key", "date"], "full")
    every = Window.partitionBy("key")
    common = F.when((F.col("new") > 0) & (F.col("old") > 0), F.log(F.col("new") / F.col("old")))
    scaled = both.withColumns({"overlap": F.count(common).over(every), "factor": F.exp(F.avg(common).over(every)), "start": F.min(F.when(F.col("new").isNotNull(), F.col("date"))).over(every)})
    older = F.when((F.col("date") < F.col("start")) & (F.col("overlap") >= least), F.col("old") * F.col("factor"))
    return scaled.select("key", "date", F.coalesce("new", older).alias("value"), "overlap", F.col("new").isNull().alias("from_old")).where("value is not null")


def runs_of(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Stretches of equal values: key, value, first, last, n."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")
