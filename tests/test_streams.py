"""Streamed queries give the same rows however the table is cut into files and in whatever order these come."""

import os

import duckdb
import numpy as np
import pytest
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = ["streamed_ledger", "streamed_days", "streamed_pairs", "streamed_first_prints", "streamed_staleness", "streamed_states", "streamed_sliding"]


@pytest.fixture(scope="module")
def want():
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    sql = registry.oracle_sql()
    out = {}
    for name in NAMES:
        r = con.sql(sql[name])
        out[name] = (sorted(r.columns), r)
    return {name: (cols, sorted(map(repr, r.select(*cols).fetchall()))) for name, (cols, r) in out.items()}


def cut(tmp_path, order):
    """The table as five files, dated one minute after another."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SF}/events.parquet").sort_by("ts")
    n = table.num_rows
    pieces = [table.slice(k * n // 5, (k + 1) * n // 5 - k * n // 5) for k in range(5)]
    if order == "mixed":
        at = np.random.default_rng(0).permutation(n)
        whole = table.take(pa.array(at))
        pieces = [whole.slice(k * n // 5, (k + 1) * n // 5 - k * n // 5) for k in range(5)]
    folder = tmp_path / order
    (folder / "events.parquet").mkdir(parents=True)
    for k, piece in enumerate(reversed(pieces) if order == "reversed" else pieces):
        file = folder / "events.parquet" / f"part-{k}.parquet"
        pq.write_table(piece, file)
        os.utime(file, (1_700_000_000 + 60 * k,) * 2)
    return str(folder)


@pytest.mark.parametrize("order", ["in order", "reversed", "mixed"])
def test_all_rows_whatever_the_order(spark, tmp_path, want, order):
    folder = cut(tmp_path, order)
    for name in NAMES:
        cols, rows = want[name]
        got = sorted(repr(tuple(r)) for r in registry.queries()[name](spark, folder).select(*cols).collect())
        assert got == rows, name
