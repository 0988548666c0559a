"""Rates, levels and error bands as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def annualised_to_qoq(a: Column) -> Column:
    return F.when(a > -100, 100 * (F.pow(1 + a / 100, 0.25) - 1))


def qoq_to_annualised(q: Column) -> Column:
    return 100 * (F.pow(1 + q / 100, 4) - 1)


def previous_level(level: Column, q: Column) -> Column:
    return level / (1 + q / 100)


def signed_percent(x: Column) -> Column:
    return F.concat(F.when(x > 0, "+").otherwise(""), F.format_string("%.2f%%", x))


def scores(error: Column) -> list[Column]:
    """n, bias, mae, rmse of an error; missing errors don't count."""
    return [F.count(error).alias("n"), F.avg(error).alias("bias"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse")]


def quantiles(error: Column) -> list[Column]:
    return [F.percentile(F.abs(error), F.lit(0.68)).alias("p68"), F.percentile(F.abs(error), F.lit(0.95)).alias("p95")]
