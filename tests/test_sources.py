"""Published tables by locator: retries, fallbacks, refused pages; what a bound series needs."""

import json

from tidemark.sources import bindings, published


def lines(spark, tmp_path, fallback=None, **files):
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    urls = {k: f"file://{tmp_path}/{k}" for k in [*files, "gone"]}
    published.register(spark)
    reader = spark.read.format("published").option("locators", json.dumps(urls)).option("attempts", "2").option("waits", "0")
    return reader.option("fallback", json.dumps({k: f"file://{tmp_path}/{v}" for k, v in (fallback or {}).items()})).load().collect()


def test_published_tables(spark, tmp_path):
    got = lines(spark, tmp_path, good="Series ID,A\n2026-05,1\n", page="<!DOCTYPE html><p>busy</p>", empty="")
    rows = {k: [(r.n, r.line) for r in got if r.locator == k and r.error is None] for k in ("good", "page", "empty", "gone")}
    assert rows["good"] == [(0, "Series ID,A"), (1, "2026-05,1")] and not rows["page"] and not rows["empty"] and not rows["gone"]
    errors = {r.locator: r.error for r in got if r.error}
    assert set(errors) == {"page", "gone"} and "HTML" in errors["page"]


def test_published_fallback(spark, tmp_path):
    got = lines(spark, tmp_path, fallback={"gone": "good"}, good="x,1\n")
    assert {(r.locator, r.source, r.line) for r in got} == {("good", "first", "x,1"), ("gone", "fallback", "x,1")}


def test_bindings_need_their_columns(spark):
    rows = [("A2718603V", "Original", "2026-05", "-3"), ("A2718603V", "Original", "2026-06", "4"), ("DLCACOHN", "Original", "31/05/2026", "5"), ("FCMYGBAG3", None, "31-May-2026", "4.5"), ("FIRMMBAB90", None, "31/05/2026", "4.0"), ("FXRTWI", None, "04-May-2026", "60"), ("FXRTWI", None, "05-May-2026", "n/a"), ("FXRTWI", None, "06-May-2026", "62")]
    panel = bindings.bound(spark.createDataFrame(rows, "column string, series_type string, raw_date string, raw_value string"))
    got = {(r.key, str(r.date)): r.value for r in panel.collect()}
    assert got == {("import", "2026-05-01"): 3, ("import", "2026-06-01"): -4, ("fcmygbag3", "2026-05-01"): 4.5, ("firmmbab90", "2026-05-01"): 4.0, ("scrigbag3", "2026-05-01"): 0.5, ("twi", "2026-05-01"): 61}
    refused = {r.key: r.reason for r in bindings.refused(panel).collect()}
    assert refused["import"] == "not positive" and refused["credit_housing"] == "no rows" and "twi" not in refused
