"""Every registered query against its SQL, at the smallest size; those without SQL for rows and invariants."""

import math

import duckdb
import numpy as np
import pytest
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return str(v) if v is not None and not isinstance(v, (int, bool, str)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(cell(row[names.index(c)]) for c in columns) for row in cur.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_kernel_queries_give_rows(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    assert rows and all(v is None or not isinstance(v, float) or math.isfinite(v) for r in rows for v in r)


def test_as_of_results_do_not_see_later_rows(spark):
    """Rows released after an as-of date never change what was known at it."""
    from tidemark.operators import joins

    left = spark.createDataFrame([(1, 10, 0), (1, 20, 1), (2, 5, 2)], "k int, at int, id int")
    right = spark.createDataFrame([(1, 10, "a", 1), (1, 12, "b", 2), (1, 12, "c", 3), (1, 30, "z", 4)], "k int, at int, v string, n int")
    # a row at the same instant counts, ties go to the later number
    out = joins.as_of(left, right, ["k"], "at", ["v"], "n")
    assert {r.id: r.right_v for r in out.collect()} == {0: "a", 1: "c", 2: None}
    again = joins.as_of(left, right.where("at < 25"), ["k"], "at", ["v"], "n")
    assert sorted(out.collect()) == sorted(again.collect())


def test_as_of_split_by_spans_equals_the_whole(spark):
    """A key's rows split by span give the same pairs, over empty spans, ties, nulls and keys on one side alone."""
    import random

    from pyspark.sql import functions as F
    from tidemark.operators import joins

    rnd = random.Random(3)
    at = lambda: rnd.choice([None, *range(0, 30), *range(70, 100)])
    left = spark.createDataFrame([(rnd.choice([1, 1, 1, 2, 3, None]), at(), i) for i in range(200)], "k int, at int, id int")
    right = spark.createDataFrame([(rnd.choice([1, 1, 1, 2, 4, None]), at(), f"v{i}", i) for i in range(60)], "k int, at int, v string, n int")
    plain = {}
    rights = right.collect()
    for r in left.collect():
        seen = [(x["at"], x["n"], x["v"]) for x in rights if x["k"] == r["k"] and x["at"] is not None and r["at"] is not None and x["at"] <= r["at"]]
        plain[r["id"]] = max(seen)[2] if seen else None
    for span in (None, lambda c: F.floor(c / 7), lambda c: F.floor(c / 1000), lambda c: c):
        out = joins.as_of(left, right, ["k"], "at", ["v"], "n", span=span)
        assert {r["id"]: r["right_v"] for r in out.collect()} == plain and out.count() == 200


def test_library_does_not_need_the_corpus_folder():
    import re
    from pathlib import Path

    root = Path(registry.__file__).parent.parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"tidemark\.llm", p.read_text())]


def test_bootstrap_has_the_references_replications(spark):
    """Chances are shares of 1,000 replications, all different, however they are dealt over seeds."""
    from tidemark.plans import kernel_queries

    p = [r.p * 1000 for r in kernel_queries.bootstrap_gain(spark, SF).collect()]
    assert all(abs(v - round(v)) < 1e-9 for v in p) and any(round(v) % 50 for v in p)
    few = [r.p * 7 for r in kernel_queries.bootstrapped(spark, SF, 7, 3).collect()]
    assert all(abs(v - round(v)) < 1e-9 for v in few)


def test_chains_have_the_references_short_length(spark):
    """Each seed's quantiles are those of 200 draws after 100 sweeps."""
    from tidemark.plans import kernel_queries

    got = {(r.category, r.seed): r for r in registry.queries()["gibbs_chains"](spark, SF).collect()}
    assert {s for _, s in got} == {0, 1, 2}
    y, _ = kernel_queries.wide(kernel_queries.monthly_panel(spark, SF).where("category = 'AFRICA'").toPandas())
    draws = kernel_queries.kernels.gibbs_factor(kernel_queries.standard(y), 200, 100, 1)["draws"]
    r = got["AFRICA", 1]
    assert len(draws) == 200 and all(math.isclose(a, b, abs_tol=1e-4) for a, b in zip((r.p16, r.point, r.p84), np.percentile(draws, [16, 50, 84]), strict=True))
