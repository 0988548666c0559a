"""Nearest neighbours against plain cosines of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import nearest

KIND = "vec_id bigint, embedding array<float>"


def plain(rows, asked, k=5):
    """query_id -> [(score, vec_id)], by all pairs."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in ok:
        if asked(q):
            found = out.setdefault(q, {})
            for i, b in ok:
                if i != q and len(a) == len(b):
                    score = float(np.clip(sum(a * b) / np.sqrt(sum(a * a) * sum(b * b)), -1, 1))
                    found[i] = max(score, found.get(i, -2.0))
    return {q: sorted(((s, i) for i, s in f.items()), key=lambda x: (-x[0], x[1]))[:k] for q, f in out.items() if f}


def given(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=1e-12)


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    return (centres[rng.integers(0, 20, n)] + 0.3 * rng.normal(size=(n, dim))).astype(np.float32)


def test_defined_cases(spark):
    x = clustered(400, 6).tolist()
    rows = [(k, v) for k, v in enumerate(x)]
    rows += [(1000 + k, x[0]) for k in range(300)]  # copies: ties by id
    rows += [(2000 + k, [2 * a for a in x[0]]) for k in range(20)] + [(2050, x[0]), (2050, x[0])]
    rows += [(3000, None), (3050, []), (3100, [0.0] * 6), (3150, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3200, [float("nan")] + [1.0] * 5), (3250, [float("inf")] + [1.0] * 5), (None, x[3])]
    rows += [(50, x[7]), (51, x[8])]  # ids with several vectors
    rows += [(3300, [1.0, 2.0])]  # another length
    df = spark.createDataFrame([(*r, r[0], "a") for r in rows], KIND + ", `Rank` bigint, `query_id` string").repartition(7)
    want = plain([r for r in rows if not r[1] or len(r[1]) == 6], lambda q: q % 50 == 0)
    same(given(nearest.nearest(df.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, factor=1.0)), want)
    same(given(nearest.nearest(df, F.col("vec_id") % 50 == 0)), want)
    assert nearest.nearest(df.limit(0)).count() == 0
    assert nearest.nearest(df.where("vec_id >= 3000 and vec_id < 3300")).count() == 0
    assert nearest.nearest(df.where("vec_id = 7")).count() == 0
    few = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])]
    same(given(nearest.nearest(spark.createDataFrame(few, KIND))), plain(few, lambda q: True))
    with pytest.raises(ValueError, match="factor"):
        nearest.nearest(df, factor=0.5)


def test_many_shards_are_exact(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_BYTES", 300 * 8 * 8)
    monkeypatch.setattr(nearest, "SAMPLE_BYTES", 200 * 8 * 8)
    monkeypatch.setattr(nearest, "LEAF", 16)
    rows = list(enumerate(clustered(3000, 8).tolist()))
    df = spark.createDataFrame(rows, KIND)
    same(given(nearest.nearest(df, F.col("vec_id") % 50 == 0, factor=1.0)), plain(rows, lambda q: q % 50 == 0))


def test_large_and_small_values(spark):
    rows = [(k, (np.array(v) * 10.0**e).tolist()) for k, (v, e) in enumerate([([1, 2, 3], 200), ([1, 2, 4], -200), ([3, 2, 1], 0), ([-1, 0, 2], 300)])]
    got = given(nearest.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")))
    same(got, plain([(k, (np.array(v) / np.abs(v).max()).tolist()) for k, v in rows], lambda q: True))


@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (1.5, 0.98), (3.0, 0.5)])
def test_recall_and_pruning_of_one_tree(factor, least):
    x = clustered(6000, 16, 3).astype(float)
    shard = nearest.Shard(np.arange(len(x)), x, leaf=64)
    seen = []
    q = np.arange(0, len(x), 50)
    visits = shard.tree.visits

    def counted(u, bound, factor, see):
        return visits(u, bound, factor, lambda leaf, rows: (seen.append(len(rows) * (shard.ends[leaf + 1] - shard.ends[leaf])), see(leaf, rows)))

    shard.tree.visits = counted
    best = shard.search(q, x[q], 5, factor, np.full(len(q), np.inf))
    u = nearest.units(x)
    near = u[q] @ u.T
    near[np.arange(len(q)), q] = -2
    want = np.argsort(-near, 1)[:, :5]
    recall = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(best.id, want, strict=True)])
    assert recall >= least
    share = sum(seen) / (len(q) * len(x))
    assert share < {1.0: 0.7, 1.5: 0.4, 3.0: 0.2}[factor]  # of all pairs


def test_recall_at_production_factor_on_the_given_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(path).collect()]
    u = nearest.units(np.array([v for _, v in rows], float))
    ids = np.array([i for i, _ in rows])
    got = given(nearest.nearest(spark.read.parquet(path), F.col("vec_id") % 50 == 0))
    assert len(got) == 40
    hits = 0
    for k in np.flatnonzero(ids % 50 == 0):
        near = u @ u[k]
        near[k] = -2
        hits += len(set(ids[np.argsort(-near)[:5]]) & {i for _, i in got[ids[k]]})
    assert hits / (5 * len(got)) >= 0.98
