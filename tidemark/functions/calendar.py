"""Calendar expressions: quarters, release dates, weekdays, Easter. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def q_index(day: Column) -> Column:
    return F.year(day) * 4 + F.quarter(day) - 1


def quarter_label(index: Column, spaced: bool = False) -> Column:
    return F.concat(F.floor(index / 4).cast("int").cast("string"), F.lit(" Q" if spaced else "Q"), (index % 4 + 1).cast("int").cast("string"))


def parsed_quarter(label: Column) -> Column:
    """'2026Q2' and '2026 Q2' to an index; anything else null."""
    ok = label.rlike(r"^\d{4} ?Q[1-4]$")
    return F.when(ok, F.substring(label, 1, 4).cast("int") * 4 + F.right(label, F.lit(1)).cast("int") - 1)


def quarter_end_month(index: Column) -> Column:
    return F.make_date(F.floor(index / 4).cast("int"), ((index % 4) * 3 + 3).cast("int"), F.lit(1))


def nth_weekday(month: Column, day: str, n: int) -> Column:
    """n-th weekday of the month of a first-of-month date."""
    return F.date_add(F.next_day(F.date_sub(month, 1), day), 7 * (n - 1))


def last_weekday(month: Column, day: str) -> Column:
    return F.next_day(F.date_sub(F.last_day(month), 7), day)


def rolled(day: Column) -> Column:
    """Saturday and Sunday roll to Monday."""
    return F.date_add(day, F.when(F.dayofweek(day) == 7, 2).when(F.dayofweek(day) == 1, 1).otherwise(0))


def first_workday(month: Column) -> Column:
    return rolled(month)


def release_date(index: Column) -> Column:
    """First Wednesday of the third month after the quarter's end."""
    return nth_weekday(F.add_months(quarter_end_month(index), 3), "Wed", 1)


def months_with_data(first: Column, through: Column) -> Column:
    gap = F.months_between(F.trunc(through, "MM"), F.trunc(first, "MM")).cast("int") + 1
    return F.greatest(F.lit(0), F.least(F.lit(3), gap))


def easter_monday(year: Column) -> Column:
    """Gregorian computus, the day after Easter Sunday."""
    whole = lambda x: F.floor(x).cast("int")
    a, b, c = year % 19, whole(year / 100), year % 100
    d, e = whole(b / 4), b % 4
    g = whole((8 * b + 13) / 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = whole(c / 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = whole((a + 11 * h + 22 * m) / 451)
    month = whole((h + m - 7 * n + 114) / 31)
    day = (h + m - 7 * n + 114) % 31 + 1
    return F.date_add(F.make_date(year, month, day), 1)
