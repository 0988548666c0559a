"""Combination of two arms with planted gaps, stale runs and few misses."""

import datetime as dt

from tidemark.plans import backtest_queries as bq

RUNS = "as_of date, target int, stage int, forecast double, n bigint"


def test_gaps_stale_arms_and_few_misses(spark):
    ends = [dt.date(2000 + k // 12, k % 12 + 1, 28) for k in range(40)]
    v2 = [(d, k // 3, k % 3 + 1, 1.0, 9) for k, d in enumerate(ends)]
    v3 = [(d, k // 3, k % 3 + 1, 2.0, 9) for k, d in enumerate(ends) if k not in (10, 20, 21, 22)]
    y = [(q, dt.date(2000 + (3 * q + 4) // 12, (3 * q + 4) % 12 + 1, 1), 1.5) for q in range(12)]
    out = bq.combine(spark.createDataFrame(v2, RUNS), spark.createDataFrame(v3, RUNS), spark.createDataFrame(y, "target int, printed date, growth double"))
    got = {r.as_of: r for r in out.collect()}
    assert len(got) == 40
    one = got[ends[10]]  # the run of the month before is 30 days old
    assert one.v3_date == ends[9] and one.v3_raw == 2.0
    stale = got[ends[21]]
    assert stale.v3_raw is None and stale.combo == 1.0
    early, late = got[ends[8]], got[ends[39]]
    assert early.correction is None and early.combo == 1.5
    assert late.correction == 0.5 and late.v3 == 1.5 and late.combo == 1.25


def test_arms_in_one_task_equal_arms_split_by_year(spark):
    ends = [dt.date(2000, 1, 3) + dt.timedelta(7 * k) for k in range(150)]
    v2 = spark.createDataFrame([(d, k // 13, k % 3 + 1, float(k % 5), 9) for k, d in enumerate(ends)], RUNS)
    v3 = spark.createDataFrame([(d, k // 13, k % 3 + 1, float(k % 7), 9) for k, d in enumerate(ends) if k % 11 and not 60 < k < 70], RUNS)
    y = spark.createDataFrame([(q, ends[13 * q + 12] + dt.timedelta(50), 1.5) for q in range(11)], "target int, printed date, growth double")
    a, b = (sorted(bq.combine(v2, v3, y, s).collect()) for s in (None, lambda c: bq.F.year(c)))
    assert a == b and len(a) == 150 and any(r.v3_raw is None for r in a) and any(r.correction is not None for r in a)
    assert sum(r.n for r in bq.scored(bq.combine(v2, v3, y, None), y).collect() if r.arm == "v2") == 143
