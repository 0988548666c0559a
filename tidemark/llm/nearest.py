"""Nearest neighbours by cosine: vantage-point trees, one a shard, pruned by the triangle inequality.

Vectors of length one have the Euclidean distance d with d * d = 2 - 2 cos, a
metric with the order of the cosine. A node of a tree has a vantage point and
the ranges of distance from it to the vectors on its inner and outer side. A
query at distance d from the vantage point is at least max(d - high, low - d, 0)
from every vector of a side; a side is skipped where factor times that bound is
over the query's k-th best distance so far. Factor 1 is exact; larger factors
skip more and may lose neighbours.

1. Copies: of equal vectors only the k + 1 smallest ids can be found by a query
   (k others and its own), so each distinct vector keeps that many rows; the limit
   is applied before the shuffle too. No neighbour is lost by this.
2. A vantage-point tree over at most `SAMPLE_BYTES` of vectors (by a hash) is fitted on the
   driver; its leaves are the shards. Medians of the sample split dense regions as
   evenly as thin ones. Every row is indexed: it is dealt to its shard by distances.
3. A query's k-th best distance in the sample bounds its search from the start.
   Shards that the tree can't rule out get the query. Rows of a shard come first,
   then its queries, in batches: memory is that of a shard, whatever the queries.
4. In a shard, the tree is built over all its rows down to leaves of `LEAF`; a batch
   of queries goes down it together, each query to its own leaf first. In a leaf,
   products of all vectors and queries are one matrix product; those within 1e-9 of
   the query's k-th best are scored again, pair by pair, so that equal vectors have
   equal scores. The best of all shards meet by query.

Vectors without structure (random ones in 64 dimensions: neighbours at cosine 0.4)
let no exact tree skip much: then the work is that of all queries against all rows,
in blocks, each row's shard read once.

Defined cases: vectors that are null, empty, zero or hold null, NaN or infinity take
no part, nor do those whose length isn't the most common one (ties: the smaller).
Null ids take no part. A query's own rows are all rows with its id; repeated rows
(id and vector) are one; a repeated id with other vectors has the best score of any
pair. Ties go to the smaller id. With fewer than k candidates all come. Tables
without vectors give no rows. Only id and vector are read, so other columns,
whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, released, stored, tuned

#: Doubles of the sample that the shards are fitted on: 16,384 vectors of 64 dimensions.
SAMPLE_BYTES = 8 << 20
#: Doubles of a shard, about: 131,072 vectors of 64 dimensions.
SHARD_BYTES = 64 << 20
#: Shards aren't made smaller than this for the sake of parallel tasks.
LEAST_ROWS = 1 << 11
LEAF = 512
#: Queries that go down a tree together.
BATCH = 512
FACTOR = 1.5
#: Distances below carry rounding errors up to 1e-8 (a root of 1e-16).
SLACK = 1e-6


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring them near one: cosines don't change, squares can't overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows: sums in the order of the components, so equal rows have equal scores."""
    xy, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for a, b in zip(x.T, y.T, strict=True):
        xy += a * b
        xx += a * a
        yy += b * b
    return np.clip(xy / np.sqrt(xx * yy), -1.0, 1.0)


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def distances(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of length one."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (u @ v.T)))


@dataclass
class Tree:
    """Nodes in order of making. sides[k]: two of (low, high, node), node < 0: leaf -1 - node. A tree that is `open` holds for vectors beyond its own."""

    vantage: list[np.ndarray] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    sides: list[list[tuple[float, float, int]]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    root: int = -1
    open: bool = False

    @staticmethod
    def of(u: np.ndarray, leaf: int = LEAF, depth: int = 64, open: bool = False) -> Tree:
        tree = Tree(open=open)
        tree.root = tree._made(u, np.arange(len(u)), leaf, depth)
        return tree

    def _made(self, u: np.ndarray, rows: np.ndarray, leaf: int, depth: int) -> int:
        if len(rows) > leaf and depth > 0:
            far = distances(u[rows], u[rows[:1]])[:, 0]
            vantage = u[rows[int(far.argmax())]]
            d = distances(u[rows], vantage[None])[:, 0]
            radius = float(np.median(d))
            if radius == d.max():  # more than half at the same distance
                radius = float(d[d < radius].max(initial=-1.0))
            inner = d <= radius
            if inner.any():
                self.vantage.append(vantage)
                self.radius.append(radius)
                k = len(self.sides)
                self.sides.append([])
                for side, whole in ((inner, (0.0, radius)), (~inner, (radius, 2.0))):
                    low, high = whole if self.open else (float(d[side].min()), float(d[side].max()))
                    self.sides[k].append((low, high, self._made(u, rows[side], leaf, depth - 1)))
                return k
        self.leaves.append(rows)
        return -len(self.leaves)

    def home(self, u: np.ndarray) -> np.ndarray:
        """Leaf of each row by the radii alone."""
        at = np.full(len(u), self.root)
        d = distances(u, np.array(self.vantage)) if self.vantage else None
        while (open_ := np.flatnonzero(at >= 0)).size:
            for k in np.unique(at[open_]):
                mine = np.flatnonzero(at == k)
                at[mine] = np.where(d[mine, k] <= self.radius[k], self.sides[k][0][2], self.sides[k][1][2])
        return -1 - at

    def visits(self, u: np.ndarray, bound: Callable[[], np.ndarray], factor: float, see: Callable[[int, np.ndarray], None]) -> None:
        """see(leaf, queries) for all that aren't ruled out; bound() gives each query's k-th best distance so far."""
        d = distances(u, np.array(self.vantage)) if self.vantage else None
        todo = [(self.root, np.arange(len(u)), np.zeros(len(u)))]
        while todo:
            k, rows, least = todo.pop()
            near = least * factor <= bound()[rows] + SLACK
            rows, least = rows[near], least[near]
            if not rows.size:
                continue
            if k < 0:
                see(-1 - k, rows)
                continue
            for low, high, child in self.sides[k]:
                gap = np.maximum(d[rows, k] - high, low - d[rows, k])
                todo.append((child, rows, np.maximum(least, gap)))


class Best:
    """The k best of each query: score, then smaller id."""

    def __init__(self, n: int, k: int, bound: np.ndarray) -> None:
        self.k, self.first = k, bound
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def distance(self) -> np.ndarray:
        """Of the k-th, or what was known before where that is less."""
        worst = self.score[:, -1]
        return np.minimum(self.first, np.where(np.isfinite(worst), np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.maximum(worst, -1.0))), np.inf))

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched, row = np.unique(query, return_inverse=True)
        row = np.concatenate([row, np.repeat(np.arange(len(touched)), self.k)])
        scores, ids = np.concatenate([scores, self.score[touched].ravel()]), np.concatenate([ids, self.id[touched].ravel()])
        order = np.lexsort((-scores, ids, row))
        row, scores, ids = row[order], scores[order], ids[order]
        first = np.ones(len(row), bool)  # an id with several vectors counts once
        first[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
        row, scores, ids = row[first], scores[first], ids[first]
        order = np.lexsort((ids, -scores, row))
        row, scores, ids = row[order], scores[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        new = np.full((len(touched), self.k), -np.inf), np.full((len(touched), self.k), np.iinfo(np.int64).max)
        new[0][row[keep], rank[keep]], new[1][row[keep], rank[keep]] = scores[keep], ids[keep]
        self.score[touched], self.id[touched] = new


class Shard:
    """Vectors, their ids and a tree over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        x = scaled(vectors)
        u = units(x)
        self.tree = Tree.of(u, leaf)
        order = np.concatenate(self.tree.leaves)
        self.ids, self.x, self.u = ids[order], x[order], u[order]
        self.ends = np.concatenate([[0], np.cumsum([len(rows) for rows in self.tree.leaves])])

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float, bound: np.ndarray) -> Best:
        x = scaled(vectors)
        u = units(x)
        best = Best(len(ids), k, bound)

        def see(leaf: int, rows: np.ndarray) -> None:
            start, end = self.ends[leaf], self.ends[leaf + 1]
            near = u[rows] @ self.u[start:end].T
            limit = 1.0 - best.distance()[rows] ** 2 / 2 - 1e-9
            q, c = np.nonzero(near >= np.where(np.isfinite(limit), limit, -2.0)[:, None])
            other = ids[rows[q]] != self.ids[start + c]
            q, c = rows[q[other]], start + c[other]
            if q.size:
                best.add(q, self.ids[c], cosines(x[q], self.x[c]))

        home = self.tree.home(u)
        for leaf in np.unique(home):
            see(leaf, np.flatnonzero(home == leaf))

        def others(leaf: int, rows: np.ndarray) -> None:
            if (rows := rows[home[rows] != leaf]).size:
                see(leaf, rows)

        self.tree.visits(u, best.distance, factor, others)
        return best


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of packed doubles."""
    data = np.frombuffer(column.buffers()[2], np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return data[ends[0] : ends[-1]].view(np.float64).reshape(-1, dim) if len(column) else np.empty((0, dim))


def usable(vector: str) -> Column:
    """Whether a vector takes part, its length aside."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & finite & F.exists(x, lambda v: v != 0)


def nearest(rows: DataFrame, queries: Column | None = None, k: int = 5, factor: float = FACTOR, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each query. queries: which rows are searched for (all by default), in terms of vec_id and vector."""
    spark = rows.sparkSession
    if k < 1 or factor < 1:
        raise ValueError("k and factor must be 1 or more")
    tuned(spark)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    own = rows.where(F.col(vec_id).isNotNull() & F.coalesce(usable(vector), F.lit(False)))
    own = own.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), asked.alias("asked"))
    sizes = own.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return empty
    dim = sizes["dim"]
    own = own.where(F.size("vec") == dim)

    def packed(batch: pa.RecordBatch) -> Iterator[dict]:
        flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
        yield {"id": batch.column("id"), "asked": batch.column("asked"), "vec": [r.tobytes() for r in flat.reshape(-1, dim)]}

    binary = arrow_map(own, packed, "id bigint, asked boolean, vec binary")
    copies = Window.partitionBy("vec").orderBy("id")
    distinct = binary.select("id", "vec").dropDuplicates()
    kept = stored(distinct.withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k + 1).drop("place"), "vectors")
    n = kept.count()
    sample = kept.orderBy(F.xxhash64("vec"), "id").limit(max(1, SAMPLE_BYTES // (8 * dim))).toArrow()
    x = _vectors(sample.column("vec").combine_chunks(), dim)
    shards = max(1, -(-n * dim * 8 // SHARD_BYTES), min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    top = Tree.of(units(scaled(x)), leaf=1, depth=int(shards - 1).bit_length(), open=True)
    shared = spark.sparkContext.broadcast((top, Shard(sample.column("id").to_numpy(), x)))  # three times SAMPLE_BYTES at most

    def dealt(batch: pa.RecordBatch) -> Iterator[dict]:
        home = shared.value[0].home(units(scaled(_vectors(batch.column("vec"), dim))))
        yield {"shard": home, "bound": np.full(batch.num_rows, -1.0), "id": batch.column("id"), "vec": batch.column("vec")}

    def sent(batch: pa.RecordBatch) -> Iterator[dict]:
        top, known = shared.value
        vectors, ids = _vectors(batch.column("vec"), dim), batch.column("id").to_numpy()
        bound = known.search(ids, vectors, k, factor, np.full(len(ids), np.inf)).distance()
        pairs: list[tuple[int, np.ndarray]] = []
        top.visits(units(scaled(vectors)), lambda: bound, factor, lambda leaf, rows: pairs.append((leaf, rows)))
        for leaf, mine in pairs:
            yield {"shard": np.full(len(mine), leaf), "bound": bound[mine], "id": ids[mine], "vec": batch.column("vec").take(pa.array(mine))}

    kind = "shard int, bound double, id bigint, vec binary"
    asks = binary.where("asked").select("id", "vec").dropDuplicates()
    # a shard a partition; the bound of its rows is less than any query's, so they come first
    met = arrow_map(kept, dealt, kind).unionByName(arrow_map(asks, sent, kind)).repartitionById(len(top.leaves), F.col("shard")).sortWithinPartitions("shard", "bound")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = _searched(met, dim, k, factor).repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(met: DataFrame, dim: int, k: int, factor: float) -> DataFrame:
    """Best rows of each query in each shard of a table whose partitions have a shard's rows before its queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        at, ids, vectors, shard = None, [], [], None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def answered() -> Iterator[pa.RecordBatch]:
            if not held or shard is None:
                held.clear()
                return
            q, v, b = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            best = shard.search(q, v, k, factor, b)
            row, place = np.nonzero(np.isfinite(best.score))
            yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(best.id[row, place]), pa.array(best.score[row, place])], schema=schema)

        for batch in it:
            shards, bounds = batch.column("shard").to_numpy(), batch.column("bound").to_numpy()
            own, vecs = batch.column("id").to_numpy(), _vectors(batch.column("vec"), dim)
            for part in np.unique(shards):
                if part != at:
                    yield from answered()
                    at, ids, vectors, shard = part, [], [], None
                index, ask = (shards == part) & (bounds < 0), (shards == part) & (bounds >= 0)
                if index.any():
                    ids.append(own[index])
                    vectors.append(vecs[index])
                if ask.any():
                    if shard is None and ids:
                        shard = Shard(np.concatenate(ids), np.concatenate(vectors))
                        ids, vectors = [], []
                    held.append((own[ask], vecs[ask], bounds[ask]))
                    if sum(len(h[0]) for h in held) >= BATCH:
                        yield from answered()
        yield from answered()
        released()

    return met.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
