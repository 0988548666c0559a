r"""Spelling variant grouping: a trie self-join with active-node sets over the vocabulary.

`vocabulary` counts words: maximal runs `[A-Za-zÀ-ÿ]+`, A-Z lower-cased;
where 97 divides the crc32 of `<doc_id>:<run>` the run loses the code point at
crc32 mod length; of the results, those of at least 5 code points that occur at
least 3 times remain.

`near_pairs` finds all pairs that differ by one inserted, deleted or replaced
code point. The trie of all words is partitioned by prefix: a prefix is heavy
if more than `GROUP` words (or one in `SPLIT` of the vocabulary, if more) lie
below it, so there are at most `SPLIT` heavy prefixes of a length, whatever the
vocabulary. Two near words share a path down to their edit.

* Edit below the first prefix that isn't heavy: both are in that subtree, which
  one task joins with itself. Each node has its active nodes at distance one; a
  child's are: the children of its parent's active nodes by the same character, its
  larger siblings (replacement) and its parent (deletion). Where both ends are
  words, the pair is emitted. Only one direction of each edit is propagated, so each
  pair comes once.
* Edit at a heavy node: its children become active at distance one, from where only
  equal characters lead on. So both words have the same rest: they meet by a key of
  prefix and rest. A key has at most one word for each character of the alphabet
  (90) and one without, so no key is hot.

`grouped` adds to each word its near words' number, its form (the near word of
largest n, ties to the smallest, if that n is at least twice its own) and its root
(forms followed to the last). Each step doubles n, so a chain has fewer than 64
steps; pointers are doubled, at most 6 rounds.

Defined cases: null text has no words; a null id counts as an empty one; repeated
rows count each; an empty table gives an empty one; a word of any length is whole,
and a long word costs its length. Only id and text are read, so other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, released, stored, tuned

LEAST_CHARS = 5
LEAST_COUNT = 3
#: One run in so many, by hash, loses a code point.
SLIP = 97
#: Words below a prefix from which on it is split, at least; and at most so many prefixes of a length are.
GROUP = 20_000
SPLIT = 4096
#: Words that a counting task keeps before it hands its counts on.
HELD = 200_000


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least: int = LEAST_COUNT) -> DataFrame:
    """word, n."""
    tuned(docs.sparkSession)
    # a run is never longer after the slip, so shorter ones are no words
    pattern = re.compile("[a-zÀ-ÿ]{%d,}" % least_chars)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def flushed(counts: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)
        counts.clear()
        return out

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        counts: Counter = Counter()
        for batch in it:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(pattern.findall(raw.as_py().lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % SLIP == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_chars:
                            continue
                    counts[word] += n
                if len(counts) >= HELD:
                    yield flushed(counts)
        yield flushed(counts)
        released()

    found = docs.select(F.col(doc_id).cast("long").alias("doc"), as_bytes(text).alias("raw")).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Trie:
    """Words as sorted arrays of nodes: node 0 is the root, a level's nodes follow those of the level before."""

    def __init__(self, words: list[str]) -> None:
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        at = np.zeros(len(words), np.int64)  # each word's node so far
        parents, chars, levels, size = [], [], [], 1
        self.levels = levels  # (first, end) of each level's nodes below the root
        alive = np.arange(len(words))
        depth = 0
        while (alive := alive[lengths[alive] > depth]).size:
            key = at[alive] << 21 | codes[first[alive] + depth]
            steps, inverse = np.unique(key, return_inverse=True)
            parents.append(steps >> 21)
            chars.append(steps & 0x1FFFFF)
            at[alive] = size + inverse
            levels.append((size, size + len(steps)))
            size += len(steps)
            depth += 1
        self.parent = np.concatenate([[-1], *parents]).astype(np.int64)
        self.char = np.concatenate([[0], *chars]).astype(np.int64)
        self.key = self.parent << 21 | self.char  # ascending: parents are numbered level by level, each level's keys are sorted
        self.word = np.full(size, -1, np.int64)
        self.word[at] = np.arange(len(words))
        start = np.searchsorted(self.parent[1:], np.arange(size + 1)) + 1
        self.begin, self.end = start[:-1], start[1:]

    def child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child by a character, -1 where there is none."""
        key = node << 21 | char
        at = np.searchsorted(self.key[1:], key) + 1
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, at, -1)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts a, b, ...: index 0 a times, 1 b times, ..., and 0 to a - 1, 0 to b - 1, ..."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def self_join(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs at distance one among distinct words, each pair once."""
    trie = Trie(words)
    size = len(trie.parent)
    node, active = np.empty(0, np.int64), np.empty(0, np.int64)
    left, right = [], []
    for start, end in [(0, 1), *trie.levels]:
        # the children of each (node, active): the active node's child by the same character
        owner, step = spread(trie.end[node] - trie.begin[node])
        child = trie.begin[node][owner] + step
        same = trie.child(active[owner], trie.char[child])
        child, same = child[same >= 0], same[same >= 0]
        own = np.arange(start, end)
        mine, step = spread(trie.end[own] - trie.begin[own])
        fresh = trie.begin[own][mine] + step
        behind, step = spread(trie.end[own[mine]] - fresh - 1)  # larger siblings
        node = np.concatenate([child, fresh, fresh[behind]])
        active = np.concatenate([same, own[mine], fresh[behind] + 1 + step])
        both = np.unique(node * size + active)
        node, active = both // size, both % size
        hit = (trie.word[node] >= 0) & (trie.word[active] >= 0)
        left.append(trie.word[node[hit]])
        right.append(trie.word[active[hit]])
    return np.concatenate(left), np.concatenate(right)


def heavy_prefixes(words: DataFrame, group: int = GROUP, split: int = SPLIT) -> dict[int, set[str]]:
    """By length, the prefixes with more words below than a task takes: at most `split` of each length; the empty one is always heavy."""
    total = words.count()
    most = max(group, total // split)
    found: dict[int, set[str]] = {0: {""}}
    depth, step = 0, 4
    while found[depth] and total > most:
        below = words.where(F.length("word") > depth).where(F.substring("word", 1, depth).isin(list(found[depth])) if depth else F.lit(True))
        each = F.sequence(F.lit(depth + 1), F.least(F.length("word"), F.lit(depth + step)))
        prefixes = below.select("word", F.explode(each).alias("d")).select(F.expr("substring(word, 1, d)").alias("p"))
        found |= {d: set() for d in range(depth + 1, depth + step + 1)}
        for r in prefixes.groupBy("p").count().where(F.col("count") > most).collect():  # fewer than split of a length
            found[len(r.p)].add(r.p)
        depth, step = depth + step, 2 * step  # few jobs, however long a path
    return {d: p for d, p in found.items() if p}


def near_pairs(words: DataFrame, group: int = GROUP, split: int = SPLIT) -> DataFrame:
    """a, n_a, b, n_b: each pair of words at distance one, once. words: word, n."""
    tuned(words.sparkSession)
    heavy = heavy_prefixes(words, group, split)
    shared = words.sparkSession.sparkContext.broadcast(heavy)  # at most `split` prefixes of each length
    kind = pa.schema([("key", pa.string()), ("at", pa.int32()), ("cut", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])

    def dealt(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value
        for batch in it:
            key, at, cut, word, n = [], [], [], [], []
            for w, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                d = 0
                while d in heavy and d <= len(w) and w[:d] in heavy[d]:
                    key.append(f"{w[:d]}\0{w[d:]}")
                    cut.append(False)
                    at.append(d)
                    if d < len(w):
                        key.append(f"{w[:d]}\0{w[d + 1 :]}")
                        cut.append(True)
                        at.append(d)
                    d += 1
                if d <= len(w):
                    key.append(w[:d])
                    cut.append(False)
                    at.append(-1)
                added = len(key) - len(word)
                word += [w] * added
                n += [count] * added
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((key, at, cut, word, n), kind, strict=True)], schema=kind)

    rows = words.select("word", "n").mapInArrow(dealt, "key string, at int, cut boolean, word string, n bigint")
    rows = stored(rows, "prefixes")
    pair = "a string, n_a bigint, b string, n_b bigint"

    def joined(part: pa.Table) -> pa.Table:
        released()
        a, b = self_join(part.column("word").to_pylist())
        word, n = part.column("word").combine_chunks(), part.column("n").combine_chunks()
        return pa.table({"a": word.take(pa.array(a)), "n_a": n.take(pa.array(a)), "b": word.take(pa.array(b)), "n_b": n.take(pa.array(b))})

    below = rows.where("at < 0").select("key", "word", "n").groupBy("key").applyInArrow(joined, pair)
    return below.unionByName(_at_heavy(rows.where("at >= 0")))


def _at_heavy(rows: DataFrame) -> DataFrame:
    """Pairs whose first difference is at a heavy node: both lose a character there, or one does."""
    one = F.struct("word", "n")
    met = rows.groupBy("key", "at").agg(F.array_sort(F.collect_list(F.when(F.col("cut"), one))).alias("cut"), F.max(F.when(~F.col("cut"), one)).alias("whole"))
    met = met.where((F.size("cut") > 1) | ((F.size("cut") > 0) & F.col("whole").isNotNull()))
    char = lambda w: F.substring(w, F.col("at") + 1, F.lit(1))
    replaced = F.flatten(F.transform("cut", lambda x, i: F.transform(F.filter("cut", lambda y: y["word"] > x["word"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    shorter = F.transform(F.filter("cut", lambda x: F.col("whole").isNotNull() & (char(x["word"]) != char(F.col("whole.word")))), lambda x: F.struct(F.col("whole").alias("x"), x.alias("y")))
    pairs = met.select(F.explode(F.concat(replaced, shorter)).alias("p"))
    return pairs.select(F.col("p.x.word").alias("a"), F.col("p.x.n").alias("n_a"), F.col("p.y.word").alias("b"), F.col("p.y.n").alias("n_b"))


def grouped(words: DataFrame, group: int = GROUP, split: int = SPLIT) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word. words: word (distinct), n."""
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words, group, split)
    ends = lambda x, y: F.struct(F.col(x).alias("word"), F.col(f"n_{x}").alias("n"), F.col(y).alias("near"), F.col(f"n_{y}").alias("near_n"))
    both = pairs.select(F.explode(F.array(ends("a", "b"), ends("b", "a"))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    linked = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    large = -F.col("best.n") >= 2 * F.col("n")
    out = words.join(linked, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(large, F.col("best.word")).alias("form"), F.when(large, -F.col("best.n")).alias("form_n"),
    )
    out = stored(out, "forms")
    roots = followed(out.where("form is not null").select("word", F.col("form").alias("root")))
    return out.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def followed(links: DataFrame) -> DataFrame:
    """word, root: links (word, root) followed to the last, by doubling."""
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")
        links = links.select("word", "root")

