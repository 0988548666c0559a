"""File sources on small hand-made files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from tidemark.sources import readers as r


def d(y, m, day=1):
    return dt.date(y, m, day)


def rows(df):
    return sorted((x.key, x.date, x.value) for x in df.collect())


def test_series_finds_its_date_column(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Ref_Date,value\n2020-01-01,1.5\n2020-02-01,n/a\n2020-02-01,2\n2020-03-01,NaN\nnotes,9\n")
    assert rows(r.read_series(spark, str(p), "a"))[:2] == [("a", d(2020, 1), 1.5), ("a", d(2020, 2), 2.0)]
    assert r.read_series(spark, str(p), "a").where("value is null").count() == 1
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        r.read_series(spark, str(tmp_path / "b.csv"), "b")


def test_quarters_land_on_their_last_month(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_text("Series ID,G1,G2\n2020Q1,-5,1\n2020 Q4,7,\n2020-13,1,1\n")
    assert rows(r.read_column(spark, str(p), "G1")) == [("G1", d(2020, 3), -5.0), ("G1", d(2020, 12), 7.0)]
    with pytest.raises(ValueError):
        r.read_column(spark, str(p), "G9")


def test_ragged_table(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("A TABLE,,\nTitle,One,Two\nSeries ID,AAA,BBB\n31/01/2020,1,2\n29-Feb-2020,3,\n\nend of table,,\n")
    got = {(x.date, x.value) for x in r.read_ragged(spark, str(p), "BBB").collect()}
    assert got == {(d(2020, 1), 2.0), (d(2020, 2), None)}
    assert r.read_ragged(spark, str(p), "CCC").count() == 0


def test_adjusted_rows_win(spark):
    df = spark.createDataFrame([("a", "Trend", 1), ("a", "Seasonally Adjusted", 2), ("b", "Original", 3)], "key string, kind string, v int")
    assert {x.v for x in r.prefer_adjusted(df).collect()} == {2, 3}


def test_release_page(spark):
    page = '<meta name="dcterms.temporal" content="2026-08"/><meta name="dcterms.issued" content="2026-10-02T11:30"/>'
    df = r.trade_release(spark.createDataFrame([(page,), (page.replace("2026-10", "2026-07"),), ("<p>",)], "html string"))
    assert [(x.reference, x.issued, x.ok) for x in df.collect()] == [(d(2026, 8), d(2026, 10, 2), True), (d(2026, 8), d(2026, 7, 2), False), (None, None, False)]


def test_vintage_round_trip_and_guards(spark, tmp_path):
    panel = spark.createDataFrame([("a", d(2020, 1), 1.0), ("a", d(2020, 2), None), ("b", d(2020, 1), -2.5)], r.LONG)
    r.write_vintage(panel, str(tmp_path / "v"))
    assert sorted(r.read_vintage(spark, str(tmp_path / "v")).collect(), key=str) == sorted(panel.collect(), key=str)
    one = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, locator string")
    two = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "w")], "key string, locator string")
    assert {x.key for x in r.locator_drift(one, two).collect()} == {"b", "c"}
    first = spark.createDataFrame([("2020Q1",), ("2020Q1",), ("2020Q2",), ("2020Q4",)], "quarter string")
    assert {tuple(x) for x in r.first_release_problems(first).collect()} == {("duplicate", "2020Q1"), ("gap before", "2020Q4")}
    miss = spark.createDataFrame([("2020Q1", 0.5, 0.2, 0.3), ("2020Q2", 0.5, 0.2, 0.4)], "quarter string, model_qoq_pct double, first_print_qoq_pct double, miss_pp double")
    assert [tuple(x) for x in r.miss_problems(miss).collect()] == [("identity", "2020Q2")]


def test_payload_has_the_last_points(spark):
    panel = spark.createDataFrame([("a", d(2020, m), float(m)) for m in range(1, 8)], r.LONG)
    got = json.loads(r.payload(panel, 3).select(F.col("document")).first()[0])
    assert got == {"key": "a", "points": [{"month": f"2020-0{m}", "value": float(m)} for m in (5, 6, 7)]}
