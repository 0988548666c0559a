"""Near-duplicates by bottom-k sketches from one hash function.

1. A document's set is its distinct word shingles, as 64-bit hashes; a mixing of
   these is the one hash function, and the k smallest values are the sketch.
   Documents with equal sets make a class; only the class's smallest id goes on.
2. Inverted lists of retained values: two sets of Jaccard 0.75 share at least
   `shared(n)` retained values (but for odds near 1e-6), so each set is listed
   under its rarest k - shared + 1 values only (prefix filter): values that many
   unlike documents hold are rarely among them.
3. In each list every member is paired with one hub, the member with the most
   common sketch. The sketch of the union, of a wider sketch that only listed
   sets have, estimates the Jaccard; pairs near the threshold or above are
   verified on full sets. Verified links make components.
4. Lists with members outside the hub's component are then compared in full, in
   blocks of bounded size: those members against all others of other components.
   Thus a group of m near copies costs m verifications and loses no link.
5. A list with over `OTHERS` members outside the hub's component (a passage that
   many unlike documents share) is not compared, so that no list has more than
   OTHERS comparisons a member. Its members go through steps 2 to 4 again, listed by longer sketches, of WIDE values, and those of lists that are
   still so large by their whole sets. The more values are known, the more of them
   similar sets must share (20 of 48, 157 of 256, three quarters of all), so
   fewer, rarer ones list a set: a passage lists no set of which it's under 41, 61
   and 75 %. What is left is compared, all of it: sets that nearly are similar.

Lists, classes and hubs may be large: they are counted before shuffles, joined
(skewed joins are split) or cut in blocks; no group is gathered in one task, and
no ids, links or sketches meet the driver.

Defined cases: null or empty text has an empty set and links with nothing; with
fewer words than a shingle has, the whole sequence is the one shingle; rows
with one id are one document if their texts are equal; equal sets link always.
Rows of one id with different texts are each returned, a link of any of them is
one of the id, and the least text (by bytes) is the one that is verified. A row
without an id links through an equal set only; its component is the set's, or null,
and kept is null. Only the id and the text are read, whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Hashes, arrow_map, as_bytes, mix, stored, tuned
from tidemark.llm.components import components

WORDS = 5
PERCENT = 75
K = 48
#: Retained values that similar sets share at least: 5 deviations under the mean of 0.75 K.
SHARED = 20
#: Values in the sketches of listed sets, from which the Jaccard is estimated.
WIDE = 256
#: Least estimates from K and from WIDE values that go on: 4.5 and 5 deviations under 0.75.
ESTIMATE = 0.47
WIDE_ESTIMATE = 0.61
#: Retained values that similar sets share at least, of WIDE: 5 deviations under 0.75 WIDE.
WIDE_SHARED = 157
#: Members of a list on either side of one block; pairs whose estimates are made at once.
BLOCK = 512
PAIRS = 1 << 13
#: Members outside the hub's component beyond which a list's members are listed again by more of their values.
OTHERS = 1024

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def shingles(text: bytes, hashes: Hashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    h = hashes.of(text.lower().split())
    if not len(h):
        return h
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total = (total ^ (total >> np.uint64(29))) * _FACTORS[-1] + h[k : len(h) - n + 1 + k] * _FACTORS[k % 6]
    return distinct(mix(total))


def shared(n: int) -> int:
    return min(SHARED, -(-PERCENT * n // 100))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored doc, n (set size), fp (hash of the set), sketch (the K smallest values, signed)."""
    hashes: list[Hashes] = []

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        if not hashes:
            hashes.append(Hashes())
        sets = [shingles(x.as_py(), hashes[0]) for x in batch.column(1)]
        yield {
            "doc": batch.column(0), "n": [len(s) for s in sets], "fp": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "sketch": [s[:K].view(np.int64) for s in sets],
        }

    return stored(arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc"), as_bytes(text).alias("raw")), run, "doc bigint, n bigint, fp binary, sketch array<bigint>"), "sketches")


def widened(texts: DataFrame, width: int | None = WIDE) -> DataFrame:
    """Stored rep, n and sketch, of up to `width` values (None: all), of the texts."""
    hashes: list[Hashes] = []

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        if not hashes:
            hashes.append(Hashes())
        sets = [shingles(x.as_py(), hashes[0]) for x in batch.column(1)]
        yield {"rep": batch.column(0), "n": [len(x) for x in sets], "sketch": [x[:width].view(np.int64) for x in sets]}

    return stored(arrow_map(texts.select("doc", "raw"), run, "rep bigint, n bigint, sketch array<bigint>"), "wide")


def estimate(a: str, b: str) -> F.Column:
    """Jaccard from two sketches: of the WIDE smallest values of the union, the share that both hold."""
    ordered = lambda x: F.transform(x, lambda v: v.bitwiseXOR(F.lit(-(2**63))))  # noqa: E731  signed order is then the unsigned one
    union = F.slice(F.array_sort(ordered(F.array_union(a, b))), 1, WIDE)
    return F.size(F.array_intersect(union, ordered(F.array_intersect(a, b)))) / F.size(union)


def fits(a: str, b: str) -> F.Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def listed(reps: DataFrame, width: int | None = K, least: int = SHARED) -> DataFrame:
    """Stored inverted lists (value, rep, n, weight): each set under its rarest values, of those that two sets hold.

    width: values in the sketches (None: all of the sets'); least: of these, how many similar sets share at least.
    """
    rows = reps.select("rep", "n", F.explode("sketch").alias("value"))
    common = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    held = rows.join(common, "value").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("held"))  # at most width
    size, need = F.col("n"), F.ceil(F.col("n") * PERCENT / 100)
    if width is not None:
        size, need = F.least(size, F.lit(width)), F.least(F.lit(least), need)
    keep = F.greatest(size - need + 1 - (size - F.size("held")), F.lit(0)).cast("int")  # values that no other set holds are the rarest
    weight = F.aggregate("held", F.lit(0).cast("bigint"), lambda s, x: s + x["df"])
    return stored(held.select("rep", "n", weight.alias("weight"), F.explode(F.slice("held", F.lit(1), keep)).alias("x")).select(F.col("x.value").alias("value"), "rep", "n", "weight"), "lists")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Stored links of the pairs (a, b) whose full sets are similar. texts: doc, raw."""
    left = texts.select(F.col("doc").alias("a"), F.col("raw").alias("raw_a"))
    right = texts.select(F.col("doc").alias("b"), F.col("raw").alias("raw_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "raw_a", "raw_b")
    held: list = []

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        if not held:
            held.extend([Hashes(), None, None])
        out: dict = {"a": [], "b": []}
        for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if held[1] != b:
                held[1:] = [b, shingles(y.as_py(), held[0])]
            if similar(shingles(x.as_py(), held[0]), held[2]):
                out["a"].append(a)
                out["b"].append(b)
        yield out

    return stored(arrow_map(both, run, "a bigint, b bigint"), "links")


def estimates(sketches: np.ndarray, sizes: np.ndarray, ns: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
    """Jaccard of pairs of rows of ascending sketches, padded with the largest number: of the union's k smallest, those in both."""
    sketches, sizes = sketches[:, :k], np.minimum(sizes, k)
    both = np.sort(np.concatenate([sketches[i], sketches[j]], 1), 1)
    again = both[:, 1:] == both[:, :-1]
    rank = np.arange(1, both.shape[1]) + 1 - np.cumsum(again, 1)  # distinct values up to here
    held = np.minimum(sizes[i] + sizes[j], both.shape[1])[:, None]  # beyond are pads
    real = np.arange(1, both.shape[1]) < held
    total = held[:, 0] - (again & real).sum(1)
    whole = (ns[i] <= k) & (ns[j] <= k)  # then all of both sets is there, and the value is exact
    return np.where(whole, (again & real).sum(1) / total, (again & real & (rank <= k)).sum(1) / np.minimum(total, k))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and the row of each."""
    one = column.combine_chunks()
    sizes = one.value_lengths().to_numpy(zero_copy_only=False)
    return one.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


def _apart(flat: np.ndarray, owner: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """The pairs in ok whose rows have no value in common: the most frequent values first, then only rows that are undecided."""
    _, at, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
    at, several = rank[at], int((often > 1).sum())  # what one row alone has makes no pair
    ok, start, width = ok.copy(), 0, 128
    while start < several and ok.any():
        rows = np.flatnonzero(ok.any(0) | ok.any(1))
        local = np.full(len(ok), -1)
        local[rows] = np.arange(len(rows))
        some = (at >= start) & (at < min(start + width, several)) & (local[owner] >= 0)
        m = np.zeros((len(rows), width), np.float32)
        m[local[owner[some]], at[some] - start] = 1
        ok[np.ix_(rows, rows)] &= m @ m.T == 0
        start, width = start + width, 4096
    return ok


def _likely(flat: np.ndarray, row: np.ndarray, n: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """The pairs in ok whose Jaccard over all values below one bound, under which each sketch is whole, isn't over 5 deviations short of the threshold."""
    rows = np.flatnonzero(ok.any(0) | ok.any(1))
    most = np.zeros(len(n), np.uint64)
    np.maximum.at(most, row, flat)
    cut = most[n > WIDE]
    keep = (flat <= cut.min()) if len(cut) else np.ones(len(flat), bool)
    local = np.full(len(n), -1)
    local[rows] = np.arange(len(rows))
    keep &= local[row] >= 0
    flat, owner = flat[keep], local[row[keep]]
    _, at, often = np.unique(flat, return_inverse=True, return_counts=True)
    place, common = np.cumsum(often > 1) - 1, np.zeros((len(rows), len(rows)), np.float32)
    several = often[at] > 1
    of, at = owner[several], place[at[several]]
    for start in range(0, int((often > 1).sum()), 4096):
        some = (at >= start) & (at < start + 4096)
        m = np.zeros((len(rows), 4096), np.float32)
        m[of[some], at[some] - start] = 1
        common += m @ m.T
    size = np.bincount(owner, minlength=len(rows))
    union = np.maximum(size[:, None] + size - common, 1)
    out = ok.copy()
    out[np.ix_(rows, rows)] &= common / union >= PERCENT / 100 - 5 * np.sqrt(0.1875 / union)
    return out


def _passing(sketches: np.ndarray, sizes: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose estimates pass, first by K values, then by WIDE."""
    keep = estimates(sketches, sizes, n, i, j, K) >= ESTIMATE
    i, j = i[keep], j[keep]
    if len(i):
        keep = estimates(sketches, sizes, n, i, j, WIDE) >= np.where(np.maximum(n[i], n[j]) <= WIDE, PERCENT / 100 - 1e-9, WIDE_ESTIMATE)
        i, j = i[keep], j[keep]
    return i, j


def _blocks(table: pa.Table) -> pa.Table:
    """Pairs of one block whose estimate passes: members of different components, not the hub (it met all members)."""
    rep, comp, n = (table.column(c).to_numpy() for c in ("rep", "comp", "n"))
    hub, other, kind = (table.column(c).to_numpy() for c in ("hub", "other", "kind"))
    small, large = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
    ok = (comp[:, None] != comp) & (100 * small >= PERCENT * large) & (rep != hub)[:, None] & (rep != hub) & (rep[:, None] < rep)
    if kind[0]:  # others against the hub's component
        ok &= other[:, None] != other
    if ok.any():  # a pair of several common lists is looked at in the one of the smallest value: it's in no list of a smaller one
        flat, owner = _flat(table.column("index"))
        smaller = flat < table.column("value")[0].as_py()
        ok = _apart(flat[smaller], owner[smaller], ok)
    flat, row = _flat(table.column("sketch"))
    if ok.sum() > PAIRS:
        ok = _likely(flat.view(np.uint64), row, n, ok)
    i, j = np.nonzero(ok)
    if len(i):
        order = np.lexsort((flat.view(np.uint64), row))
        sizes = np.bincount(row, minlength=len(rep))
        sketches = np.full((len(rep), WIDE), np.uint64(2**64 - 1))
        sketches[row, np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]] = flat.view(np.uint64)[order]
        found = [_passing(sketches, sizes, n, i[k : k + PAIRS], j[k : k + PAIRS]) for k in range(0, len(i), PAIRS)]
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"a": rep[i], "b": rep[j]})


def linked(lists: DataFrame, sketches: DataFrame, texts: DataFrame, links: DataFrame | None, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Links found so far and those of one set of lists; and the members of lists with too many comparisons, if there are any. last: all are compared."""
    hubs = lists.groupBy("value").agg(F.max(F.struct("weight", (-F.col("rep")).alias("id"), "n")).alias("h"), F.count("*").alias("m")).select("value", (-F.col("h.id")).alias("hub"), F.col("h.n").alias("hub_n"), "m").where("m > 1")
    stars = lists.join(hubs, "value").where(F.col("rep") != F.col("hub")).where(fits("n", "hub_n")).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    near = stars.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    first = verified(stored(near.where(estimate("sa", "sb") >= WIDE_ESTIMATE).select("a", "b"), "near"), texts)
    first = first if links is None else links.unionByName(first)

    reached = stored(components(first), "reached")
    named = lists.join(reached.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component", "weight")
    hub_comp = hubs.where("m > 2").join(reached.withColumnRenamed("node", "hub"), "hub", "left").select("value", "hub", "m", F.coalesce("component", "hub").alias("hub_comp"))
    marked = named.join(hub_comp, "value").withColumn("other", F.col("comp") != F.col("hub_comp"))
    open_ = stored(marked.where("other").groupBy("value").agg(F.count("*").alias("o")), "open")
    large = F.col("o") > OTHERS
    hot = None
    if not last and open_.where(large).limit(1).count():
        hot = lists.join(open_.where(large).select("value"), "value", "left_semi").select("rep").distinct()
        open_ = open_.where(~large)
    index = lists.groupBy("rep").agg(F.collect_list("value").alias("index"))  # what one set is listed under
    marked = marked.join(open_, "value").join(sketches.select("rep", "sketch"), "rep").join(index, "rep")
    n_other, n_main = F.ceil(F.col("o") / BLOCK).cast("int"), F.greatest(F.ceil((F.col("m") - F.col("o")) / BLOCK), F.lit(1)).cast("int")
    marked = marked.withColumns({"n_other": n_other, "n_main": n_main}).withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("other"), F.col("n_other")).otherwise(F.col("n_main"))).cast("int"))
    block = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    among = F.transform(upto("n_other"), lambda j: block(0, F.least("own", j), F.greatest("own", j)))
    across = F.when(F.col("other"), F.transform(upto("n_main"), lambda j: block(1, F.col("own"), j))).otherwise(F.transform(upto("n_other"), lambda i: block(1, i, F.col("own"))))
    spread = marked.withColumn("blk", F.explode(F.when(F.col("other"), F.concat(among, across)).otherwise(across))).select("value", "blk.kind", "blk.i", "blk.j", "rep", "comp", "n", "hub", "other", "sketch", "index")
    rest = spread.groupBy("value", "kind", "i", "j").applyInArrow(_blocks, "a bigint, b bigint").distinct()
    return first.unionByName(verified(stored(rest, "rest"), texts)), hot


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc (its id), n_shingles, component_id (the smallest id reachable), kept."""
    tuned(docs.sparkSession)
    sets = sketched(docs, doc_id, text)
    classes = sets.where("fp is not null").groupBy("fp").agg(F.min("doc").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = stored(classes, "classes")
    lists = listed(reps)
    members = lists.select(F.col("rep").alias("doc")).distinct()
    raw = docs.select(F.col(doc_id).cast("long").alias("doc"), as_bytes(text).alias("raw"))
    texts = stored(raw.join(members, "doc", "left_semi").groupBy("doc").agg(F.min("raw").alias("raw")), "texts")
    sketches = widened(texts)

    links, hot = linked(lists, sketches, texts, None, False)
    if hot is not None:
        links, hot = linked(listed(sketches.join(stored(hot, "hot"), "rep", "left_semi"), WIDE, WIDE_SHARED), sketches, texts, links, False)
    if hot is not None:
        whole = widened(texts.join(stored(hot, "hot").withColumnRenamed("rep", "doc"), "doc", "left_semi"), None)
        links, _ = linked(listed(whole, None), sketches, texts, links, True)

    joined = components(links)
    final = reps.select("fp", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("root"))
    out = sets.select("doc", "n", "fp").join(final, "fp", "left")
    root = F.coalesce("root", "doc")
    return out.select("doc", F.col("n").alias("n_shingles"), root.alias("component_id"), (F.col("doc") == root).alias("kept"))
