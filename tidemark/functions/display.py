"""How a page shows levels, changes, axes and days; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that mean another unit, indices whose ratios mean something, series drawn as changes (by frequency), steps of axes.
ALIASES = {"millions of dollars": "$ millions", "thousands": "000s persons", "number": "count"}
RATIO_INDICES = ("cpi", "commodity_prices", "unit_labour_cost", "job_ads", "anz_ads")
CHANGE_CHARTS = {
    "credit_business": "m", "credit_card": "m", "credit_housing": "m", "credit": "m", "cpi": "m", "employment": "m",
    "ft_emp": "m", "hours": "m", "pt_emp": "m", "gdi": "q", "gdp": "q", "unit_labour_cost": "q",
}
RATES = ("percent", "%", "net balance")
RANGE_STEPS, AXIS_STEPS = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 7.5, 10.0), (1.0, 2.0, 2.5, 5.0)
MINUS = "−"


def display_unit(name: Column, unit: Column) -> Column:
    """A series' unit; one rate is delivered under a wrong one."""
    return F.when(name == "nab_cu", "percent").otherwise(unit)


def canonical_unit(unit: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return F.coalesce(F.element_at(names, F.lower(F.trim(unit))), unit)


def has_percent(name: Column, unit: Column) -> Column:
    """Whether a percent change makes sense: not of rates and balances, of indices only where they measure a level."""
    u = F.lower(F.trim(unit))
    return F.when(u.isin(*RATES), False).when(u == "index", name.isin(*RATIO_INDICES)).otherwise(True)


def fixed(x: Column, places: int) -> Column:
    """So many decimals; halves go up."""
    ten = 10.0**places
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f", F.floor(x * ten + 0.5) / ten))


def grouped(x: Column, most: int = 0) -> Column:
    """With thousands separators and at most so many decimals, none that are 0; halves go up."""
    ten = 10.0**most
    text = F.format_number(F.floor(x * ten + 0.5) / ten, most)
    return F.regexp_replace(text, r"\.?0+$", "") if most else text


def shown_level(x: Column, unit: Column) -> Column:
    u = F.lower(F.trim(unit))
    text = (
        F.when(u.isin("$ millions", "$m"), F.concat(F.lit("$"), grouped(x), F.lit("M")))
        .when(u == "$bn", F.concat(F.lit("$"), _tenth(x), F.lit("bn")))
        .when(u.isin("persons", "000s persons"), F.concat(_tenth(x), F.lit("k")))
        .when(u == "hours (thousands)", F.when(x >= 1e6, F.concat(fixed(x / 1e6, 2), F.lit("bn hrs"))).when(x >= 1000, F.concat(fixed(x / 1000, 1), F.lit("m hrs"))).otherwise(F.concat(grouped(x), F.lit("k hrs"))))
        .when(u.isin("dwellings", "count"), grouped(x))
        .when(u.isin("percent", "%"), F.concat(fixed(x, 1), F.lit("%")))
        .when(u == "net balance", fixed(x, 0))
        .when(u == "index", fixed(x, 1))
        .otherwise(F.when(x == F.floor(x), grouped(x)).otherwise(grouped(x, 3)))
    )
    return F.regexp_replace(text, r"^\$-", f"{MINUS}\\$")


def _tenth(x: Column) -> Column:
    return F.when(F.floor(x * 10 + 0.5) % 10 == 0, grouped(x)).otherwise(grouped(x, 1))


def shown_change(delta: Column, unit: Column) -> Column:
    """A change with its sign, scaled to thousands, millions or billions by its unit; null stays null."""
    u, size = F.lower(F.trim(unit)), F.abs(delta)
    sign = F.when(delta > 0, "+").when(delta < 0, MINUS).otherwise("")
    with_sign = lambda *parts: F.concat(sign, *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    dollars = F.when(size >= 1000, with_sign("$", fixed(size / 1000, 1), "bn")).when(size >= 100, with_sign("$", fixed(size, 0), "M")).otherwise(with_sign("$", fixed(size, 1), "M"))
    people = F.when(size >= 1000, with_sign(fixed(size / 1000, 1), "m")).otherwise(with_sign(fixed(size, 1), "k"))
    hours = F.when(size >= 1e6, with_sign(fixed(size / 1e6, 2), "bn hrs")).when(size >= 1000, with_sign(fixed(size / 1000, 1), "m hrs")).otherwise(with_sign(fixed(size, 0), "k hrs"))
    return (
        F.when(u.isin("$ millions", "$m"), dollars)
        .when(u == "$bn", with_sign("$", fixed(size, 1), "bn"))
        .when(u.isin("persons", "000s persons"), people)
        .when(u == "hours (thousands)", hours)
        .when(u.isin("dwellings", "count"), with_sign(grouped(size)))
        .when(u.isin("percent", "%"), with_sign(fixed(size, 1), "pp"))
        .when(u == "net balance", with_sign(fixed(size, 0), " pts"))
        .when(u == "index", with_sign(fixed(size, 1), " pts"))
        .otherwise(with_sign(fixed(size, 1)))
    )


def shown_percent(x: Column) -> Column:
    return F.when(x == 0, "0.00%").otherwise(F.concat(F.when(x > 0, "+").otherwise(MINUS), fixed(F.abs(x), 2), F.lit("%")))


def chart_kind(name: Column, unit: Column) -> Column:
    """bars of changes for employment, growth for the series that are drawn so (never of a rate), levels else."""
    rate = F.lower(F.trim(unit)).isin(*RATES)
    return F.when(rate, "level").when(name == "employment", "bars").when(name.isin(*CHANGE_CHARTS), "growth").otherwise("level")


def chart_frequency(name: Column, unit: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in CHANGE_CHARTS.items() for x in kv))
    return F.when(chart_kind(name, unit) != "level", F.element_at(names, name))


def range_bound(largest: Column) -> Column:
    """The bound of a scale that is the same on both sides of zero: at least 1, else the next of 1, 1.5, 2, 2.5, 3, 4, 5, 7.5, 10 times a power of ten."""
    steps = [m * 10.0**k for k in range(0, 9) for m in RANGE_STEPS[:-1]]
    return F.coalesce(F.element_at(F.filter(F.array(*map(F.lit, steps)), lambda b: b >= largest), 1), F.when(largest.isNull(), F.lit(1.0)).otherwise(largest))


def evolution_axis(values: Column, height: Column) -> Column:
    """struct(min, max, step) of an axis over zero and all values (array<double>): the least nice step whose ticks, 26 pixels apart at least, fit the height; 3 to 6 ticks."""
    good = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    low, high = F.least(F.lit(0.0), F.array_min(good)), F.greatest(F.lit(0.0), F.array_max(good))
    none, flat = F.size(good) == 0, low == high
    low, high = F.when(none, -1.0).when(flat, -0.1).otherwise(low), F.when(none, 1.0).when(flat, 0.1).otherwise(high)
    room = F.when(height > 0, height).otherwise(137.0)
    most = F.greatest(F.lit(3), F.least(F.lit(6), F.floor(room / 26).cast("int") + 1))
    steps = F.array(*(F.lit(m * 10.0**k) for k in range(-6, 9) for m in AXIS_STEPS))
    step = F.element_at(F.filter(steps, lambda s: (s >= (high - low) / (most - 1)) & (F.ceil(high / s) - F.floor(low / s) + 1 <= most)), 1)
    return F.struct((F.floor(low / step) * step).alias("min"), (F.ceil(high / step) * step).alias("max"), step.alias("step"))


def stored_day(text: Column) -> Column:
    """The day of an ISO day or time; null for days that don't exist, other forms, and times that can't be read."""
    head = F.substring(text, 1, 10)
    day = head.try_cast("date")
    real = text.rlike(r"^\d{4}-\d{2}-\d{2}($|T)") & (F.date_format(day, "yyyy-MM-dd") == head)
    return F.when(real & ((F.length(text) == 10) | text.try_cast("timestamp").isNotNull()), day)
