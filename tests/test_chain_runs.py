"""Chains over vintages: restarts, warm starts, refusals, densities against one process."""

import json

import numpy as np
import pandas as pd
import pytest
from tidemark.operators import blocks, chain_runs
from tidemark.plans import block_queries as bq

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    """Some series of the panel at two vintages."""
    vintages = bq.vintage_dates(spark, SF, 2)
    rows = bq.vintage_rows(spark, SF, vintages)
    keys = sorted(r.key for r in rows.where("category <> 'target'").select("key").distinct().collect())[:6]
    pdf = rows.where(rows.key.isin([*keys, "target"])).toPandas()
    return vintages, spark.createDataFrame(pdf, chain_runs.ROWS).cache(), pdf


def states(df):
    return {(r.as_of, r.seed, r.draw): bytes(r.state) for r in df.collect()}


def test_rows_are_what_was_published(given):
    vintages, _, pdf = given
    assert set(pdf["as_of"]) == set(vintages)
    own = pdf[pdf["key"] == "target"]
    for v in vintages:
        last = max(own[own["as_of"] == v]["date"])
        assert pd.Timestamp(last) + pd.offsets.MonthEnd(0) + pd.Timedelta(days=60) <= pd.Timestamp(v)


def test_stopped_run_goes_on_bit_for_bit(spark, given, tmp_path):
    vintages, rows, pdf = given
    whole = states(chain_runs.advanced(rows, vintages, 2, str(tmp_path / "a"), (3, 2), (1, 2)))
    folder = str(tmp_path / "b")
    chain_runs.advanced(rows, vintages[:1], 2, folder, (3, 2), (1, 2))
    again = states(chain_runs.advanced(rows, vintages, 2, folder, (3, 2), (1, 2)))
    assert whole == again and len(whole) == 8
    one = pdf[pdf["as_of"] == vintages[0]]
    plain = chain_runs.run_chain(one, 1, chain_runs.layout_of(one), None, 3, 2)
    # here numpy may use more threads than in a task, so sums can differ in their last places
    close = lambda raw, other: np.allclose(blocks.Chain.from_bytes(raw).load, blocks.Chain.from_bytes(other).load, atol=1e-6)
    assert all(close(p, whole[vintages[0], 1, k]) for k, p in enumerate(plain))
    assert blocks.Chain.from_bytes(whole[vintages[1], 1, 1]).sweeps == 8


def test_warm_chains_need_fewer_sweeps(given):
    """Distance of the volatilities from those of a long chain: a warm chain is nearer after 5 sweeps than a cold one."""
    vintages, _, pdf = given
    one, two = (pdf[pdf["as_of"] == v] for v in vintages)
    layout = chain_runs.layout_of(one)
    old = chain_runs.run_chain(one, 0, layout, None, 150, 1)[-1]
    vol = lambda raws: np.mean([np.log(blocks.Chain.from_bytes(r).sigma) for r in raws], 0)
    settled = vol(chain_runs.run_chain(two, 5, layout, None, 150, 100))
    warm, cold = (vol(chain_runs.run_chain(two, 0, layout, s, 0, 5)) for s in (old, None))
    assert np.abs(warm - settled).mean() < 0.8 * np.abs(cold - settled).mean()


def test_density_is_that_of_one_process(spark, given, tmp_path):
    vintages, rows, pdf = given
    draws = chain_runs.advanced(rows, vintages[:1], 2, str(tmp_path / "c"), (10, 5), (1, 2))
    want = {}
    for r in draws.collect():
        for v in vintages:
            want[v, r.seed, r.draw] = chain_runs.drawn_value(pdf[pdf["as_of"] == v], r.layout, bytes(r.state), v, r.seed, r.draw)
    for groups in (1, 3):
        got = {(r.as_of, r.seed, r.draw): r.value for r in chain_runs.density(rows, draws, groups).collect()}
        assert got.keys() == want.keys() and len(got) == 20 and np.allclose([got[k] for k in want], list(want.values()), atol=1e-6)


def test_refusals(spark, given, tmp_path):
    vintages, rows, _ = given
    draws = chain_runs.advanced(rows, vintages[:1], 1, str(tmp_path / "d"), (2, 2), (1, 2))
    r = draws.first()
    chain = blocks.Chain.from_bytes(bytes(r.state))
    chain.load[-1, 0] = 0.01
    low = spark.createDataFrame([(r.as_of, 9, 0, r.layout, chain.to_bytes())], chain_runs.DRAWS)
    assert [(x.seed, x.refused) for x in chain_runs.refusals(low, 0.05).collect()] == [(9, True)]
    load = {(x.key, x.block): x.loading for x in chain_runs.loadings(low).collect()}
    layout = json.loads(r.layout)
    assert load["target", "global"] == 0.01 and load[layout["keys"][0], "global"] == 1.0


def test_queries(spark):
    dens = {r.as_of: r for r in bq.block_density(spark, SF).collect()}
    assert all(r.p2 <= r.p16 <= r.p50 <= r.p84 <= r.p97 and r.draws in (30, 60) for r in dens.values())
    rows = bq.block_loadings(spark, SF).collect()
    assert len({r.as_of for r in rows}) == bq.VINTAGES and {r.seed for r in rows} == {0, 1}
    for r in rows:
        assert r.draws == 30
    named = [r for r in rows if r.deviation == 0]
    assert named and all(r.loading == 1 for r in named)
