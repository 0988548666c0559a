"""Series bindings: which column of which provider's table each series is, and how it is made from it.

A binding is a row, not a function: one plan reads the raw cells of all of them. A series is a column as it is
(`plain`), with its sign turned (`negated`), a day-by-day column's monthly mean (`mean`), one column until a
break and another from it on (`splice`), or the sum or difference of two columns in months that both have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import readers

# The providers' series identifiers, as published.
BINDINGS: list[tuple[str, str, str, str, str, str | None]] = [
    # key, provider, table, how, column, second column
    ("emp", "abs", "6202.0", "plain", "A84423043C", None),
    ("ft_emp", "abs", "6202.0", "plain", "A84423041X", None),
    ("pt_emp", "abs", "6202.0", "plain", "A84423042A", None),
    ("ue", "abs", "6202.0", "plain", "A84423050A", None),
    ("ud", "abs", "6202.0", "plain", "A85255719L", None),
    ("hours", "abs", "6202.0", "plain", "A84426277X", None),
    ("rt", "abs", "8501.0", "plain", "A3348585R", None),
    ("export", "abs", "5368.0", "plain", "A2718577A", None),
    ("import", "abs", "5368.0", "negated", "A2718603V", None),
    ("building_app", "abs", "8731.0", "plain", "A422070J", None),
    ("house_prices", "abs", "6416.0", "plain", "A83728455L", None),
    ("household_spending_nominal", "abs", "5682.0", "plain", "A130200584T", None),
    ("cpi_quarterly", "abs", "6401.0", "plain", "A2325846C", None),
    ("hs_ba", "abs", "8731.0", "plain", "A418431A", None),
    ("nh_ba", "abs", "8731.0", "plain", "A421265R", None),
    ("alt_add", "abs", "8731.0", "plain", "A419852T", None),
    ("non_res_ba", "abs", "8731.0", "plain", "A2413226R", None),
    ("credit", "rba", "d2", "splice", "DLCACN", "DLCACSFN"),
    ("credit_business", "rba", "d2", "splice", "DLCACBN", "DLCACSFBN"),
    ("credit_housing", "rba", "d2", "sum", "DLCACOHN", "DLCACIHN"),
    ("credit_personal", "rba", "d2", "plain", "DLCACOPN", None),
    ("fcmygbag3", "rba", "f2.1", "plain", "FCMYGBAG3", None),
    ("fcmygbag5", "rba", "f2.1", "plain", "FCMYGBAG5", None),
    ("fcmygbag10", "rba", "f2.1", "plain", "FCMYGBAG10", None),
    ("firmmbab90", "rba", "f1.1", "plain", "FIRMMBAB90", None),
    ("scrigbag3", "rba", "f2.1", "spread", "FCMYGBAG3", "FIRMMBAB90"),
    ("scrigbag5", "rba", "f2.1", "spread", "FCMYGBAG5", "FIRMMBAB90"),
    ("scrigbag10", "rba", "f2.1", "spread", "FCMYGBAG10", "FIRMMBAB90"),
    ("credit_card", "rba", "c1", "plain", "CCCCSTPVSA", None),
    ("debit_card", "rba", "c2", "plain", "CDCPTTVSA", None),
    ("icp", "rba", "i2", "plain", "GRCPAIAD", None),
    ("twi", "rba", "f11.1", "mean", "FXRTWI", None),
]
#: From here on the second column of a splice holds.
BREAK = "2019-07-01"


def columns() -> list[str]:
    """All columns that bindings name, in order of first use."""
    return list(dict.fromkeys(c for *_, a, b in BINDINGS for c in (a, b) if c))


def parts(spark: SparkSession, break_date: str = BREAK) -> DataFrame:
    """One row a binding and column: key, how, column, sign, months it holds for, and the columns a month needs."""
    rows = []
    for key, _, _, how, a, b in BINDINGS:
        need = 2 if how in ("sum", "spread") else 1
        rows.append((key, how, a, -1 if how == "negated" else 1, None, break_date if how == "splice" else None, need))
        if b:
            rows.append((key, how, b, -1 if how == "spread" else 1, break_date if how == "splice" else None, None, need))
    kind = "key string, how string, column string, sign int, since string, until string, need int"
    return spark.createDataFrame(rows, kind).withColumns({"since": F.to_date("since"), "until": F.to_date("until")})


def tidy(cells: DataFrame) -> DataFrame:
    """(column, date, first, mean) of raw cells (column, series_type, raw_date, raw_value): adjusted rows where a column has any, one row a month."""
    raw = F.col("raw_date")
    on = F.coalesce(readers.day(raw), readers.period(raw))
    adjusted = F.col("series_type") == "Seasonally Adjusted"
    has = F.max(F.coalesce(adjusted, F.lit(False))).over(Window.partitionBy("column"))
    rows = cells.select("column", "series_type", on.alias("day"), readers.number(F.col("raw_value")).alias("value")).withColumn("has", has).where(~F.col("has") | adjusted)
    return rows.where("day is not null and value is not null").groupBy("column", F.trunc("day", "MM").alias("date")).agg(F.min_by("value", "day").alias("first"), F.avg("value").alias("mean"))


def bound(cells: DataFrame, break_date: str = BREAK) -> DataFrame:
    """key, date, value of all bindings from one pass over the cells; a series without a cell has no rows."""
    rows = tidy(cells).join(parts(cells.sparkSession, break_date), "column")
    rows = rows.where("(since is null or date >= since) and (until is null or date < until)")
    value = F.sum(F.col("sign") * F.when(F.col("how") == "mean", F.col("mean")).otherwise(F.col("first")))
    return rows.groupBy("key", "date").agg(value.alias("value"), F.count("*").alias("n"), F.first("need").alias("need")).where("n = need").select("key", "date", "value")


def refused(panel: DataFrame) -> DataFrame:
    """Series that must not be used: not above zero after their sign was turned, or without rows."""
    spark = panel.sparkSession
    negated = [k for k, _, _, how, *_ in BINDINGS if how == "negated"]
    wrong = panel.where(F.col("key").isin(negated) & (F.col("value") <= 0)).select("key").distinct().withColumn("reason", F.lit("not positive"))
    every = spark.createDataFrame([(b[0],) for b in BINDINGS], "key string")
    return wrong.unionByName(every.join(panel.select("key").distinct(), "key", "left_anti").withColumn("reason", F.lit("no rows")))
