"""Vintages as publication intervals: a value of a cell holds from the day it is published until the next one of that cell.

What was known at an as-of date is never copied out for each date. A value adds its part of a sum when it comes and takes it away when it
goes, so sums for all dates are running sums of these changes: rows grow with cells and revisions, not with cells times dates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(prints: DataFrame, keys: list[str], published: str = "published") -> DataFrame:
    """prints with `until`, the day from which a later print of the same cell holds (null for the last). Prints of one day: the order of `keys` decides nothing, so there must be one."""
    return prints.withColumn("until", F.lead(published).over(Window.partitionBy(*keys).orderBy(published)))


def changes(cells: DataFrame, keep: list[str], published: str = "published") -> DataFrame:
    """day, sign and the kept columns: each value once as +1 when it comes, and once as -1 when it goes."""
    both = F.array(F.struct(F.col(published).alias("day"), F.lit(1).alias("sign")), F.struct(F.col("until").alias("day"), F.lit(-1).alias("sign")))
    return cells.select(*keep, F.inline(both)).where("day is not null")


def running(moves: DataFrame, keys: list[str], terms: dict[str, Column], days: DataFrame) -> DataFrame:
    """keys, as_of and a running sum of sign * term for each term, at each of the days (as_of: a small table, one row a date).

    Days and changes meet in one ordered pass of each key.
    """
    sums = moves.groupBy(*keys, "day").agg(*(F.sum(F.col("sign") * t).alias(n) for n, t in terms.items())).withColumn("ask", F.lit(1))
    asked = moves.select(*keys).distinct().join(F.broadcast(days)).select(*keys, F.col("as_of").alias("day"), *(F.lit(0.0).alias(n) for n in terms), F.lit(2).alias("ask"))
    w = Window.partitionBy(*keys).orderBy("day", "ask").rowsBetween(Window.unboundedPreceding, 0)
    every = sums.unionByName(asked).select(*keys, "day", "ask", *(F.sum(n).over(w).alias(n) for n in terms))
    return every.where("ask = 2").select(*keys, F.col("day").alias("as_of"), *terms)


def simple_regression(n: str = "n", x: str = "x", y: str = "y", xx: str = "xx", xy: str = "xy", yy: str = "yy") -> dict[str, Column]:
    """slope, intercept and the squared t statistic of the slope, from sums; null with under three rows or without spread."""
    c = F.col
    sxx, sxy, syy = c(xx) - c(x) * c(x) / c(n), c(xy) - c(x) * c(y) / c(n), c(yy) - c(y) * c(y) / c(n)
    good = (c(n) >= 3) & (sxx > 1e-9 * c(xx))
    slope = sxy / sxx
    rest = syy - slope * sxy
    return {"slope": F.when(good, slope), "intercept": F.when(good, (c(y) - slope * c(x)) / c(n)), "wald": F.when(good & (rest > 1e-9 * syy), slope * slope * sxx / (rest / (c(n) - 2)))}


def walked(moves: pd.DataFrame, days: list, answer: Callable[[object, np.ndarray], dict], rows: list, columns: list) -> Iterator[dict]:
    """One pass over the changes (day, row, column, value, sign) in order of days; at each as-of day the panel as it then was is handed to `answer`."""
    at_row, at_column = {r: k for k, r in enumerate(rows)}, {c: k for k, c in enumerate(columns)}
    panel = np.full((len(rows), len(columns)), np.nan)
    # what goes, goes before what comes on the same day
    order = moves.sort_values(["day", "sign"])
    day, i, j = order["day"].to_numpy(), order["row"].map(at_row).to_numpy(), order["column"].map(at_column).to_numpy()
    value = np.where(order["sign"].to_numpy() > 0, order["value"].to_numpy(dtype=float), np.nan)
    k = 0
    for as_of in sorted(days):
        while k < len(day) and day[k] <= as_of:
            panel[i[k], j[k]] = value[k]
            k += 1
        if (found := answer(as_of, panel)) is not None:
            yield found
