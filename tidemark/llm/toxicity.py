"""Toxicity: character n-grams scaled by naive Bayes log-count ratios, and logistic regression on them.

A text's features are the distinct n-grams (n in `SIZES`) of its lower-cased
code points, hashed to `BUCKETS`. The classifier is fitted on at most `FIT_ROWS`
labelled rows of each label (a documented bound; the first by a hash of the id,
each label weighted back to its true share among all labelled rows), fewer where
their distinct features pass `FIT_FEATURES` (one row a label is always taken). Their
documents are counted by bucket and label; the log of the two smoothed shares
is a bucket's ratio r, and logistic regression has features x = r.

The sampled ids are at most 2 * FIT_ROWS, so they are broadcast to the scan of
the documents and no text is shuffled; the model is BUCKETS weights.

Defined cases: null and empty text has no features and gets the intercept's
score; rows with a null label or without a document aren't learnt from; several
labels of one document each count; without any sampled document every score is a half; without both labels the score is 1 where
all labels are 1, else 0. Repeated rows and null doc_ids are scored row by row.
Other columns pass through; one named score (in any case) comes back as score_in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Carried, arrow_map, as_bytes, released, stored, tuned

SIZES = (4, 5)
BUCKETS = 1 << 20
FIT_ROWS = 2500
#: Distinct features, over all rows of one label, that are fitted on: the bound of what meets in the task that fits (4 bytes each).
FIT_FEATURES = 16 << 20
EPOCHS = 8
L2 = 1e-4
SMOOTH = 0.5
THRESHOLD = 0.3

_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def features(text: bytes) -> np.ndarray:
    """Sorted distinct buckets of all n-grams; white space counts as one space."""
    words = b" ".join(text.lower().split())
    if not words:
        return np.empty(0, np.int32)
    codes = np.frombuffer(f" {words.decode('utf-8', 'replace')} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    found = []
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes), np.uint64)
        for n in range(1, max(SIZES) + 1):
            if len(codes) < n:
                break
            total = total[: len(codes) - n + 1] + codes[n - 1 :] * np.uint64(_FACTORS[n - 1])
            if n in SIZES:
                x = (total ^ (total >> np.uint64(29))) * np.uint64(_FACTORS[n % 8])
                found.append((x >> np.uint64(64 - 20)).astype(np.int32))
    return distinct(np.concatenate(found)) if found else np.empty(0, np.int32)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, text: bytes) -> float:
        z = self.intercept + float(self.weights[features(text)].sum(dtype=np.float64))
        return 1 / (1 + np.exp(-z)) if z > -700 else 0.0


def ratios(counts: np.ndarray, rows: tuple[int, int]) -> np.ndarray:
    """log of the share of label 1's documents over that of label 0's, by bucket; smoothed."""
    one = (counts[1] + SMOOTH) / (rows[1] + 2 * SMOOTH)
    none = (counts[0] + SMOOTH) / (rows[0] + 2 * SMOOTH)
    r = np.log(one / none)
    r[counts.sum(0) == 0] = 0
    return r.astype(np.float32)


def fitted(r: np.ndarray, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Logistic regression on x = r by AdaGrad over small batches, weights of rows averaged to 1."""
    weights = weights / weights.mean()
    w, b = np.zeros(len(r), np.float32), 0.0
    seen, seen_b = np.full(len(r), 1e-2, np.float32), 1e-2
    rng = np.random.default_rng(0)
    scale = np.array([1 / max(1.0, np.sqrt((r[d] ** 2).sum())) for d in docs])
    rate = 0.5
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 64)):
            lengths = [len(docs[k]) for k in part]
            ids = np.concatenate([docs[k] for k in part])
            row = np.repeat(np.arange(len(part)), lengths)
            z = b + np.bincount(row, w[ids] * r[ids], len(part))
            g = weights[part] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[part]) / len(part)
            grad = np.bincount(ids, (g * scale[part])[row] * r[ids], len(r)).astype(np.float32)
            used = np.flatnonzero(grad)
            grad = grad[used] + L2 * w[used]
            seen[used] += grad * grad
            w[used] -= rate * grad / np.sqrt(seen[used]) * 0.1
            seen_b += g.sum() ** 2
            b -= rate * g.sum() / np.sqrt(seen_b)
    return Model(w * r, float(b))


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """The model from labelled documents; pass only rows that may be learnt from."""
    spark = docs.sparkSession
    tuned(spark)
    own = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    total = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [own.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    sample = [(r.id, r.y) for p in parts for r in p.collect()]  # at most 2 * rows
    if not sample or len(total) < 2:
        share = float(total.get(1, 0) > 0)
        return Model(np.zeros(BUCKETS, np.float32), 30.0 if share else -800.0)
    chosen = F.broadcast(spark.createDataFrame(sample, "id bigint, y int"))
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), as_bytes(text).alias("raw")).join(chosen, "id").select("id", "y", "raw")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"id": batch.column(0), "y": batch.column(1), "f": [features(x.as_py()).tobytes() for x in batch.column(2)]}

    kept = stored(arrow_map(texts, run, "id bigint, y int, f binary"), "sample")  # at most 2 * rows texts
    order = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id", "f").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("f") / 4
    kept = kept.withColumns({"upto": F.sum(size).over(order), "own": size}).where((F.col("upto") <= FIT_FEATURES) | (F.col("upto") == F.col("own")))

    def fit(found: pa.Table) -> pa.Table:
        released()
        order = pc.sort_indices(found, [("id", "ascending"), ("y", "ascending"), ("f", "ascending")]).to_numpy()
        column = [np.frombuffer(x.as_buffer(), np.int32) for x in found.column("f")]  # no copies
        sets, y = [column[k] for k in order], found.column("y").to_numpy()[order]
        counts = np.zeros((2, BUCKETS))
        for one, k in zip(sets, y, strict=True):
            counts[k, one] += 1
        held = (max(1, int((y == 0).sum())), max(1, int((y == 1).sum())))
        model = fitted(ratios(counts, held), sets, y.astype(float), np.array([total[k] / held[k] for k in y]))
        return pa.table({"weights": pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), "intercept": [model.intercept]})

    # the bounded sample meets in one task, and only the weights come to the driver
    one = kept.select("id", "y", "f", F.lit(0).alias("all")).groupBy("all").applyInArrow(fit, "weights binary, intercept double").first()
    if one is None:  # no sampled row has a document
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return Model(np.frombuffer(one.weights, np.float32), one.intercept)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) added."""
    tuned(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = Carried(docs, "score")
    names = carried.inner

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {c: batch.column(k) for k, c in enumerate(names)} | {"score": [shared.value.score(x.as_py()) for x in batch.column(len(names))]}

    return carried.back(arrow_map(carried.docs.withColumn("raw", as_bytes(carried.of(text))), run, carried.schema("score double")))


def fold(doc_id: str = "doc_id", folds: int = 4) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
