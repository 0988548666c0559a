"""Rules of display, splicing and guarding on hand-worked cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from tidemark.functions import display
from tidemark.plans import helper_queries as hq
from tidemark.plans import source_queries as sq

LEVELS = [
    (90459.0, "Millions of Dollars", "$90,459M"), (-12.0, "$m", "−$12M"), (1234.56, "$bn", "$1,234.6bn"), (20.0, "$bn", "$20bn"), (14623.45, "Thousands", "14,623.5k"),
    (2014342.0, "hours (thousands)", "2.01bn hrs"), (2014.0, "Hours (thousands) ", "2.0m hrs"), (812.4, "hours (thousands)", "812k hrs"), (15332.5, "number", "15,333"), (4.25, "%", "4.3%"),
    (-7.0, "net balance", "-7"), (101.25, "index", "101.3"), (1234.5, "ratio", "1,234.5"), (None, "%", None),
]
CHANGES = [
    (1250.0, "$ millions", "+$1.3bn"), (-250.4, "$m", "−$250M"), (12.34, "$m", "+$12.3M"), (0.0, "$m", "$0.0M"), (-1500.0, "000s persons", "−1.5m"), (14.6, "persons", "+14.6k"), (5321.0, "count", "+5,321"),
    (0.2, "percent", "+0.2pp"), (0.0, "%", "0.0pp"), (-3.0, "net balance", "−3 pts"), (1.5, "index", "+1.5 pts"), (0.5, "ratio", "+0.5"), (1500000.0, "hours (thousands)", "+1.50bn hrs"), (None, "index", None),
]


@pytest.mark.parametrize(("show", "cases"), [(display.shown_level, LEVELS), (display.shown_change, CHANGES)])
def test_values_by_unit(spark, show, cases):
    df = spark.createDataFrame([(k, x, u) for k, (x, u, _) in enumerate(cases)], "k int, x double, unit string")
    got = {r.k: r.s for r in df.select("k", show(F.col("x"), display.canonical_unit(F.col("unit"))).alias("s")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for *_, w in cases]


def test_percent_changes_and_charts(spark):
    rows = [("cpi", "index", True, "growth", "m"), ("nab_conf", "index", False, "level", None), ("employment", "000s persons", True, "bars", "m"), ("gdp", "$ millions", True, "growth", "q"), ("credit", "percent", False, "level", None), ("x", "count", True, "level", None)]
    df = spark.createDataFrame([(a, b) for a, b, *_ in rows], "id string, unit string")
    n, u = F.col("id"), F.col("unit")
    got = {r.id: tuple(r)[1:] for r in df.select("id", display.has_percent(n, u), display.chart_kind(n, u), display.chart_frequency(n, u)).collect()}
    assert got == {a: tuple(rest) for a, _, *rest in rows}
    unit = spark.createDataFrame([("nab_cu", "net balance")], "id string, unit string").select(display.display_unit(n, u)).first()[0]
    assert unit == "percent"
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.005,), (-2.5,)], "x double").select(display.shown_percent(F.col("x"))).collect()][0::2] == ["0.00%", "−2.50%"]


def test_axes(spark):
    bounds = {0.4: 1.0, 1.0: 1.0, 1.2: 1.5, 2.6: 3.0, 7.6: 10.0, 12.0: 15.0, 760.0: 1000.0}
    df = spark.createDataFrame([(x,) for x in bounds], "x double")
    assert {r.x: r.b for r in df.select("x", display.range_bound(F.col("x")).alias("b")).collect()} == bounds
    cases = [([0.2, 0.9], 137.0, (0.0, 1.0, 0.2)), ([-0.3, 0.5], 60.0, (-0.5, 0.5, 0.5)), ([], 137.0, (-1.0, 1.0, 0.5)), ([0.0], 137.0, (-0.1, 0.1, 0.05)), ([3.0, 12.0], 78.0, (0.0, 15.0, 5.0))]
    df = spark.createDataFrame([(k, v, h) for k, (v, h, _) in enumerate(cases)], "k int, v array<double>, h double")
    got = {r.k: tuple(r.a) for r in df.select("k", display.evolution_axis(F.col("v"), F.col("h")).alias("a")).collect()}
    for k, (_, _, want) in enumerate(cases):
        assert got[k] == pytest.approx(want), k


def test_stored_days(spark):
    cases = {"2024-02-29": dt.date(2024, 2, 29), "2024-02-30": None, "2024-2-3": None, "2024-05-06T08:30:00Z": dt.date(2024, 5, 6), "2024-05-06T99:00": None, "2024-05-06 08:30": None, "x": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.d for r in df.select("s", display.stored_day(F.col("s")).alias("d")).collect()} == cases


def months(first, n):
    return [dt.date(first + k // 12, k % 12 + 1, 1) for k in range(n)]


def test_tiers_are_walked_from_the_oldest(spark):
    m = months(2000, 60)
    tiers = {
        "all": {3: m[:20], 2: m[14:40], 1: m[34:]},
        "middle breaks": {3: m[:30], 2: m[27:40], 1: m[20:]},  # 2 shares three months with 3 and is skipped; 1 is held against 3
        "middle breaks, newest too": {3: m[:30], 2: m[27:40], 1: m[34:]},
        "no base": {2: m[10:40], 1: m[34:]},
        "newest alone": {1: m},
    }
    df = spark.createDataFrame([(k, d, t) for k, ts in tiers.items() for t, ds in ts.items() for d in ds], "key string, date date, tier int")
    got = {r.key: (r.admitted, r.why) for r in hq.admitted(df, 3).collect()}
    assert got["all"] == ([1, 2, 3], []) and got["no base"] == ([1, 2], ["tier 3 has nothing"])
    assert got["middle breaks"] == ([1, 3], ["tier 2 shares 3 months with tier 3"])
    assert got["middle breaks, newest too"] == ([3], ["tier 2 shares 3 months with tier 3", "tier 1 shares 0 months with tier 3"])
    assert got["newest alone"][0] == [1]


def test_prefixes(spark):
    m = months(2000, 6)
    full = [(k, d, float(n)) for k in ("same", "value", "date", "longer", "none", "shifted") for n, d in enumerate(m)]
    cut = [("same", m[0], 0.0), ("same", m[1], 1.0), ("value", m[0], 0.0), ("value", m[1], 9.0), ("date", m[0], 0.0), ("date", m[2], 1.0), *(("longer", d, float(n)) for n, d in enumerate(months(2000, 7))), ("shifted", m[1], 1.0)]
    kind = "key string, date date, v double"
    got = {r.key: (r.n, r.prefix) for r in hq.prefixes(spark.createDataFrame(cut, kind), spark.createDataFrame(full, kind)).collect()}
    assert got == {"same": (2, True), "value": (2, False), "date": (2, False), "longer": (7, False), "none": (0, True), "shifted": (1, False)}


def test_cleaned_keeps_the_first_and_decimals(spark):
    raw = [("a", "2000-01-01", "3.5", 1), ("a", "2000-01-01", "9", 2), ("a", "2000-02-30", "1", 3), ("a", "2000-03-01", "-", 4), ("a", "2000-03-01", "-2.25", 5), ("b", None, "1", 6)]
    rows = hq.cleaned(spark.createDataFrame(raw, "key string, on string, value string, place int")).collect()
    assert sorted(map(tuple, rows)) == [("a", dt.date(2000, 1, 1), 3.5), ("a", dt.date(2000, 3, 1), -2.25)]


def test_synced(spark):
    m = months(1990, 310)
    good = [(0, d, float(k % 80)) for k, d in enumerate(m)]
    rows = good + [(1, d, 1.0) for d in m[:299]] + [(2, d, 1.0) for d in m] + [(2, m[0], 2.0)] + [(3, d, 81.0 if k == 5 else 0.0) for k, d in enumerate(m)] + [(4, d.replace(day=2) if k == 7 else d, 0.0) for k, d in enumerate(m)]
    old = [(0, d, v + (k % 100 == 0)) for k, (_, d, v) in enumerate(good[:308])] + [(0, dt.date(1980, 1, 1), 1.0)]
    kind = "series int, date date, value double"
    got = {r.series: r for r in sq.synced(spark.createDataFrame(rows, kind), spark.createDataFrame(old, kind)).collect()}
    assert [got[k].ok for k in range(5)] == [True, False, False, False, False]
    assert (got[0].changed, got[0].gained, got[0].dropped, got[0].rows) == (4, 2, 1, 310) and got[3].outside == 1 and got[4].off_first == 1
