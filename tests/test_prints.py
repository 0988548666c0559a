"""The first-print recorder against hand-worked ledgers."""

import datetime as dt

import pytest
from pyspark.sql import Row
from tidemark.operators import prints

D = dt.date.fromisoformat
LEVELS = "quarter int, value double, release date"
#: Quarter indices run on; 104 is missing, so 105 has none before it.
ROWS = [(100, 50.0, D("2025-06-04")), (101, 51.0, D("2025-09-03")), (102, 51.51, D("2025-12-03")), (103, None, D("2026-03-04")), (105, 60.0, D("2026-09-02")), (106, 63.0, D("2026-12-02")), (107, 63.63, D("2027-03-03"))]


def told(spark, runs, known=None, rows=ROWS):
    k = None if known is None else spark.createDataFrame([(q,) for q in known], "quarter int")
    got = prints.first_prints(spark.createDataFrame(rows, LEVELS), spark.createDataFrame([(D(r),) for r in runs], "run_date date"), k).collect()
    return {r.quarter: (r.status, r.recorded and str(r.recorded), r.first_print) for r in got}


def test_what_the_recorder_does_with_each_quarter(spark):
    got = told(spark, ["2025-09-08", "2025-09-15", "2026-02-23", "2026-09-07", "2026-12-02"])
    assert got == {
        100: ("superseded", "2025-09-08", None),  # 101 was out before the first run
        101: ("recorded", "2025-09-08", 2.0),
        102: ("stale", "2026-02-23", None),  # 82 days
        105: ("no preceding quarter", "2026-09-07", None),
        106: ("recorded", "2026-12-02", 5.0),  # the day of the release
        107: ("no run", None, None),
    }
    assert told(spark, ["2026-02-21"])[102] == ("recorded", "2026-02-21", 1.0)  # 80 days
    assert told(spark, ["2025-09-08"], known=[101])[101] == ("known", "2025-09-08", None)
    assert told(spark, [])[101] == ("no run", None, None)
    assert told(spark, ["2025-09-08"], rows=[]) == {}


HISTORY = "m string, target int, run_date date, seq int, estimate double, kind string, backfilled boolean"


def test_misses_take_the_last_live_estimate_before_the_print(spark):
    p = spark.createDataFrame([(101, D("2025-09-03"), 2.0), (102, D("2025-12-03"), 1.0), (103, D("2026-03-04"), None)], "quarter int, release date, first_print double")
    h = [
        ("a", 101, D("2025-08-25"), 0, 1.5, "nowcast", False), ("a", 101, D("2025-09-01"), 1, 1.25, None, None), ("a", 101, D("2025-09-01"), 2, 9.0, "nowcast", False),
        ("a", 101, D("2025-09-02"), 3, 9.0, "nowcast", True), ("a", 101, D("2025-09-02"), 4, 9.0, "backcast", False), ("a", 101, D("2025-09-02"), 5, None, "nowcast", False), ("a", 101, D("2025-09-03"), 6, 9.0, "nowcast", False),
        ("b", 102, D("2025-12-01"), 0, 0.33333, "nowcast", False),
    ]
    hist = spark.createDataFrame(h, HISTORY)
    got = {(r.m, r.quarter): (r.status, r.model, r.miss) for r in prints.misses(p, hist, ["m"]).collect()}
    none = ("no live estimate", None, None)
    assert got == {("a", 101): ("appended", 1.25, -0.75), ("a", 102): none, ("b", 101): none, ("b", 102): ("appended", 0.33333, -0.6667)}
    floor = spark.createDataFrame([("a", 101, D("2025-09-03"))], "m string, quarter int, release date")
    assert {(r.m, r.quarter) for r in prints.misses(p, hist, ["m"], floor).collect()} == {("a", 102), ("b", 101), ("b", 102)}


def test_corrections_are_of_the_last_eight_printed(spark):
    rows = [(100 + k, D("2024-01-01") + dt.timedelta(91 * k), float(k)) for k in range(10)]
    ledger = spark.createDataFrame(rows, "quarter int, release date, miss double")
    dates = [rows[2][1], rows[3][1], rows[9][1] - dt.timedelta(1), rows[9][1], D("2023-01-01")]
    got = {r.run_date: (r.pp, r.n, r.first_quarter, r.last_quarter) for r in prints.corrections(ledger, spark.createDataFrame([(x,) for x in dates], "run_date date"), []).collect()}
    assert got == {dates[0]: (None, 3, None, None), dates[1]: (1.5, 4, 100, 103), dates[2]: (4.5, 8, 101, 108), dates[3]: (5.5, 8, 102, 109), dates[4]: (None, 0, None, None)}
    with pytest.raises(ValueError):
        prints.corrections(ledger, ledger, [], window=0)


def test_published_takes_the_recording_only_without_a_live_value(spark):
    live = spark.createDataFrame([(101, 2.0, D("2025-09-03"))], LEVELS)
    dead = spark.createDataFrame([(101, None, D("2025-09-03"))], LEVELS)
    old = spark.createDataFrame([(100, 1.0, D("2025-06-04")), (99, None, D("2025-03-05"))], LEVELS)
    assert prints.published(live, old).select("quarter", "basis").collect() == [Row(quarter=101, basis="live")]
    assert prints.published(dead, old).select("quarter", "basis").collect() == [Row(quarter=100, basis="recorded")]
