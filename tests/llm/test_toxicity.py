"""Toxicity: held-out accuracy and defined cases."""

import zlib

import numpy as np
from tidemark.llm import queries
from tidemark.llm import toxicity as tx


def test_features():
    assert len(tx.features(b"")) == len(tx.features(b" \n")) == 0
    assert np.array_equal(tx.features("Ab  cd É".encode()), tx.features("ab\ncd É".encode()))
    assert len(tx.features(b"abcd")) == len({" abc", "abcd", "bcd "}) + len({" abcd", "abcd "})
    r = tx.ratios(np.array([[0.0, 4, 2], [4, 0, 2]]), (4, 4))
    assert r[0] > 0 > r[1] and abs(r[2]) < 1e-6


def test_held_out_accuracy(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rng = np.random.default_rng(1)
    rows = []
    for k in range(400):
        bad = bool(rng.random() < 0.2)
        text = " ".join(rng.choice(words, 30).tolist() + (["vilejerk"] if bad else []))
        rows.append((k, text, int(bad)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(1000, None), (1001, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 4 != 2] + [(5000, 1), (3, None)], "doc_id bigint, toxic int")
    out = {r.doc_id: r.score for r in tx.scored(docs, tx.trained(docs, labels)).collect()}
    assert all((out[k] >= tx.THRESHOLD) == bool(y) for k, _, y in rows)
    assert out[1000] == out[1001] < tx.THRESHOLD


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.score for r in tx.scored(docs, tx.trained(docs, none)).collect()] == [0.0, 0.0]
    assert tx.scored(docs.limit(0), tx.trained(docs, none)).count() == 0


def test_query(spark):
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in queries.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    known = [(r.predicted, labels[r.doc_id]) for r in rows if not r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in known) / len(known) > 0.97
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.9


def test_ratios_and_fit_against_plain_loops():
    """Features as strings, ratios by counters, and the same steps of the regression row by row."""
    import math
    from collections import Counter

    rng = np.random.default_rng(5)
    words = ["Alpha", "beta", "gamma ray", "délta", "omega"]
    texts = [" ".join(rng.choice(words, 6)) + (" vile" if k % 3 == 0 else "") for k in range(90)]
    y = np.array([float(k % 3 == 0) for k in range(90)])
    weights = np.where(y > 0, 0.5, 2.0)
    lower = [f" {' '.join(t.encode().lower().decode().split())} " for t in texts]
    grams = [sorted({t[k : k + n] for n in tx.SIZES for k in range(len(t) - n + 1)}) for t in lower]
    sets = [tx.features(t.encode()) for t in texts]
    assert [len(g) for g in grams] == [len(s) for s in sets]  # no two meet in a bucket here
    one, none = Counter(g for row, k in zip(grams, y, strict=True) if k for g in row), Counter(g for row, k in zip(grams, y, strict=True) if not k for g in row)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    ratio = {g: math.log((one[g] + 0.5) / (n1 + 1) / ((none[g] + 0.5) / (n0 + 1))) for g in one | none}
    counts = np.zeros((2, tx.BUCKETS))
    for s, k in zip(sets, y, strict=True):
        counts[int(k), s] += 1
    r = tx.ratios(counts, (n0, n1))
    for row, s in zip(grams, sets, strict=True):
        assert np.allclose(sorted(ratio[g] for g in row), np.sort(r[s]), atol=1e-5)

    w, b, seen, seen_b = dict.fromkeys(ratio, 0.0), 0.0, dict.fromkeys(ratio, 1e-2), 1e-2
    scale = [1 / max(1.0, math.sqrt(sum(ratio[g] ** 2 for g in row))) for row in grams]
    share, order = weights / weights.mean(), np.random.default_rng(0)
    for _ in range(tx.EPOCHS):
        for part in np.array_split(order.permutation(len(texts)), max(1, len(texts) // 64)):
            grad, total = Counter(), 0.0
            for k in part:
                z = b + sum(w[g] * ratio[g] for g in grams[k])
                step = share[k] * (1 / (1 + math.exp(-z)) - y[k]) / len(part)
                total += step
                for g in grams[k]:
                    grad[g] += step * scale[k] * ratio[g]
            for g, x in grad.items():
                if x:
                    x += tx.L2 * w[g]
                    seen[g] += x * x
                    w[g] -= 0.5 * x / math.sqrt(seen[g]) * 0.1
            seen_b += total**2
            b -= 0.5 * total / math.sqrt(seen_b)
    model = tx.fitted(r, sets, y, weights)
    for t, row in zip(texts, grams, strict=True):
        assert abs(model.score(t.encode()) - 1 / (1 + math.exp(-b - sum(w[g] * ratio[g] for g in row)))) < 1e-3


def test_very_long_text(spark):
    long = "plain words here " * 60_000 + "vilejerk"
    docs = spark.createDataFrame([(k, ("vilejerk " if k % 2 else "plain ") * 5) for k in range(40)] + [(99, long)], "doc_id bigint, text string")
    model = tx.trained(docs, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, toxic int"))
    got = {r.doc_id: r.score for r in tx.scored(docs, model).collect()}
    assert abs(got[99] - model.score(long.encode())) < 1e-12 and got[1] > 0.5 > got[0]
