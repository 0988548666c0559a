"""Benchmark decontamination with a generalised suffix automaton.

The test items, as words, make one automaton; the words of each document are
streamed through it, which gives the longest match that ends at each word.
Where that reaches the window (13 words, or a whole shorter item) the words
of the window are hit.

The automaton holds at most `MAX_WORDS` words of items, so what is broadcast
is bounded; more items make more automata, whose hits are united.

Defined cases: null or empty text has no words and no hits; an item without
words, with null text or with a null id is ignored; repeated items with one id
count once; repeated documents each give a row; an empty table of items hits
nothing. Other columns of the documents pass through; one that has the name of an
added column (in any case) comes back with `_in` appended. Other columns of the
items are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Carried, arrow_map, as_bytes, tuned

WINDOW = 13
MAX_WORDS = 200_000
#: A document is contaminated where at least one word in so many is hit.
ONE_IN = 20
ADDED = ("n_words", "hit_spans", "n_hit", "items", "contaminated")
#: Lower-cases A-Z and makes every other byte below 0x80, but digits and a-z, a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SPANS = "array<struct<start:int,end:int>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Suffix automaton over word numbers of several items, with the items of each window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        known = [(k, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]) for k, ws in items if ws]
        self.shortest = min([window, *(len(ids) for _, ids in known)])
        for _, ids in known:
            last = 0
            for x in ids:
                last = self._add(last, x)
        #: By the state that holds a window: the items with it. Shorter items: by their state, with their length.
        self.whole: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        for key, ids in known:
            state = 0
            if len(ids) < window:
                for x in ids:
                    state = self.step[state][x]
                self.short.setdefault(state, (len(ids), set()))[1].add(key)
                continue
            for end, length in self._walk(ids):
                if length >= window:
                    self.whole.setdefault(self._holder(end), set()).add(key)

    def _add(self, last: int, x: int) -> int:
        if (old := self.step[last].get(x)) is not None:
            if self.length[old] == self.length[last] + 1:
                return old
            return self._split(last, x, old)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at != -1 and x not in self.step[at]:
            self.step[at][x] = new
            at = self.link[at]
        if at == -1:
            self.link[new] = 0
        else:
            old = self.step[at][x]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._split(at, x, old)
        return new

    def _state(self, length: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(0)
        return len(self.step) - 1

    def _split(self, at: int, x: int, old: int) -> int:
        """A state for the shorter strings of `old`, which end at `at` and then x."""
        copy = self._state(self.length[at] + 1, dict(self.step[old]))
        self.link[copy], self.link[old] = self.link[old], copy
        while at != -1 and self.step[at].get(x) == old:
            self.step[at][x] = copy
            at = self.link[at]
        return copy

    def _walk(self, ids: Iterable[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        state = length = 0
        for x in ids:
            while state and x not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if x in self.step[state]:
                state = self.step[state][x]
                length += 1
            yield state, length

    def _holder(self, state: int) -> int:
        """The state with the suffix of `window` words."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, disjoint hit ranges of words, items of which windows occur."""
        ws = words(text)
        ids = np.fromiter(map(self.vocabulary.get, ws, itertools.repeat(0)), np.int64, len(ws))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids != 0).view(np.int8), [0]])))
        found: set[str] = set()
        spans: list[tuple[int, int]] = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:  # no window has an unknown word
                continue
            for i, (state, length) in enumerate(self._walk(ids[a:b].tolist()), a + 1):
                reach = 0
                if length >= self.window:
                    found |= self.whole[self._holder(state)]
                    reach = self.window
                if self.short:
                    at = state
                    while at > 0:
                        if at in self.short and self.short[at][0] <= length:
                            found |= self.short[at][1]
                            reach = max(reach, self.short[at][0])
                        at = self.link[at]
                if reach:
                    if spans and i - reach <= spans[-1][1]:
                        start = min(spans[-1][0], i - reach)
                        while spans and spans[-1][1] >= start:
                            start = min(start, spans.pop()[0])
                        spans.append((start, i))
                    else:
                        spans.append((i - reach, i))
        return len(ws), spans, found


def automata(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> Iterator[Automaton]:
    """Automata of at most max_words words each (or one longer item), read item by item."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("k"), as_bytes(text).alias("t")).where(F.col("k").isNotNull())
    part: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in rows.toLocalIterator():
        ws = words(bytes(row.t))
        if part and size + len(ws) > max_words:
            yield Automaton(part, window)
            part, size = [], 0
        if ws:
            part.append((row.k, ws))
            size += len(ws)
    if part:
        yield Automaton(part, window)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW, max_words: int = MAX_WORDS, one_in: int = ONE_IN) -> DataFrame:
    """docs with n_words, hit_spans (ranges of words), n_hit, items (sorted ids) and contaminated added.

    contaminated: some word is hit and at least one in `one_in` of the words is (whole numbers only).
    Automata are built and broadcast one after another; the driver holds one at a time.
    """
    spark = docs.sparkSession
    tuned(spark)
    carried = Carried(docs, *ADDED)
    out, first = carried.docs, True
    for one in itertools.chain(automata(benchmark, item_id, text, window, max_words), [None]):
        if one is not None or first:
            out = _matched(spark, carried, out, one or Automaton([], window), carried.of(text), first)
            first = False
    width = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]))
    out = out.withColumns({"n_hit": width, "items": F.array_sort("items")}).withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))
    return carried.back(out)


def _matched(spark: SparkSession, carried: Carried, docs: DataFrame, automaton: Automaton, text: str, first: bool) -> DataFrame:
    """Adds what one automaton finds; the row goes through Python whole, so no join brings it back."""
    shared = spark.sparkContext.broadcast(automaton)
    names = carried.inner

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        has = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
        counts, spans, items = [], [], []
        for k, value in enumerate(has["raw"]):
            n, got, found = shared.value.hits(value.as_py())
            if not first:
                found |= set(has["items"][k].as_py())
                got = united([*got, *((s["start"], s["end"]) for s in has["hit_spans"][k].as_py())])
            counts.append(n)
            spans.append([{"start": a, "end": b} for a, b in got])
            items.append(sorted(found))
        yield {c: has[c] for c in names} | {"n_words": counts, "hit_spans": spans, "items": items}

    return arrow_map(docs.withColumn("raw", as_bytes(text)), run, carried.schema(f"n_words bigint, hit_spans {SPANS}, items array<string>"))


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest(items: F.Column) -> F.Column:
    return F.sha2(F.concat_ws(",", items), 256)


def without_spans(docs: DataFrame, text: str = "text", limit: int = WINDOW) -> DataFrame:
    """Cuts hit ranges of at least `limit` words, or all hit ranges where the document is contaminated.

    Takes what `contamination` gives; the words of a cut range go with what stands between them.
    """
    carried = Carried(docs)
    names, own, ranges, all_of = carried.inner, carried.of(text), carried.of("hit_spans"), carried.of("contaminated")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        has = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
        texts = []
        for raw, spans, every in zip(has["raw"], has[ranges], has[all_of], strict=True):
            raw = raw.as_py()
            cut = [(s["start"], s["end"]) for s in spans.as_py() if every.as_py() or s["end"] - s["start"] >= limit]
            texts.append((cut_words(raw, cut) if cut else raw).decode("utf-8", "replace"))
        yield {c: has[c] for c in names} | {own: texts}

    return carried.back(arrow_map(carried.docs.withColumn("raw", as_bytes(own)), run, carried.schema("")))


def cut_words(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    marks = np.concatenate([[0], (np.frombuffer(raw.translate(_TABLE), np.uint8) != 32).view(np.int8), [0]])
    edges = np.flatnonzero(np.diff(marks))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]])


def sha256_of(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
