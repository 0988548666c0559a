"""Sequence packing by non-negative least squares over length combinations.

1. Documents become token ids, cut into windows of `size` and a rest. Pieces,
   with the checksum of their ids, are stored; each knows its number among the
   pieces of its length in its task.
2. The histogram of lengths (at most `size` counts) goes to the driver. Shallow
   combinations of lengths that fill a window are enumerated, and non-negative
   least squares finds how often to repeat each. The repeats are rounded down,
   and what is left is packed greedily, combination by combination.
3. The plan is a table of at most a few thousand combinations: each piece finds
   its sequence and offset from its number among the pieces of its length.

Only the histogram and the plan, both bounded by `size`, meet the driver; no
length, however frequent, gathers in one task.

Defined cases: null text is empty; an empty document is its end token alone;
equal rows each give their own pieces; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, stored, tuned

SIZE = 2048
END_ID = 1
#: Lengths from which combinations of three are made, for each first length.
THIRDS = 6
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, nth bigint"


#: First bytes of characters from U+0280 on.
HIGH = re.compile(rb"[\xca-\xff]")
#: ASCII marks.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Characters by which byte-level models write the bytes that don't print.
SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def core_of(word: bytes) -> tuple[bytes, bytes]:
    """A word and its end: a full stop or comma after a letter or digit is a token of its own.

    Words are lower-cased (ASCII only) where the tokenizer would do the same: if all is under U+0280. In
    others a mark may join the letter before it first, and not every capital has the joined form of
    its small letter: they stay.
    """
    if b"<|" in word:  # may be a special token, which is told by its case
        return word, b""
    core, end = (word[:-1], word[-1:]) if len(word) > 1 and word[-1] in b".," and word[-2:-1].isalnum() else (word, b"")
    return core if HIGH.search(core) else core.lower(), end


def plain(word: bytes) -> tuple[bytes, bytes] | None:
    """Letters up to U+00FF in lower case, and the ASCII marks after them (either may lack); None of any other word.

    The tokenizer makes each of the two one pre-token: no letter follows a mark, so there is no contraction and no special token,
    and none of these characters joins another.
    """
    core = word.rstrip(MARKS)
    end = word[len(core) :]
    if core.isalpha() or not core:
        return core.lower(), end
    text = core.decode("utf-8", "replace")
    return (text.lower().encode(), end) if text.isalpha() and max(text) <= "\xff" else None


class Words:
    """Ids, as little-endian bytes, of text between white space; kept for frequent words and cores in two generations.

    The tokenizer never joins what white space divides, so a text's ids are those of its words. Plain words
    (nearly all) are lower-cased and divided as the tokenizer does it, and only its model is asked. Other new
    words are encoded together, and the offsets of the tokens tell which word each is of.
    """

    LIMIT = 400_000
    TOGETHER = 2000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Makes all words known."""
        if len(self.known) > self.LIMIT:
            self.older, self.known = self.known, {}
        known, others = self.known, []
        for w in self._new(words):
            if parts := plain(w):
                core, end = parts
                known[w] = self._token(core) + self._token(end) if core and end else self._token(core or end)
            else:
                others.append((w, *core_of(w)))
        missing = self._new({x for _, core, end in others for x in (core, end)})
        for k in range(0, len(missing), self.TOGETHER):
            self._encode(missing[k : k + self.TOGETHER])
        for w, core, end in others:
            known[w] = known[core] + known[end] if end else known[core]

    def _new(self, words: set[bytes]) -> list[bytes]:
        """Those of no generation; what only the older one knows is carried over."""
        out = []
        for w in words.difference(self.known):
            if (ids := self.older.get(w)) is None:
                out.append(w)
            else:
                self.known[w] = ids
        return out

    def _token(self, text: bytes) -> bytes:
        """Ids of one pre-token that is in lower case."""
        ids = self.known.get(text) or self.older.get(text)
        if ids is None:
            shown = text.decode("latin-1")
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown if text.isascii() else shown.translate(SHOWN))])
        self.known[text] = ids
        return ids

    def _encode(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        ids = np.array(got.ids, "<u4").tobytes()
        at = (4 * np.searchsorted(np.array([a for a, _ in got.offsets], np.int64), begin)).tolist()
        for k, w in enumerate(words):
            self.known[w] = ids[at[k] : at[k + 1]]

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text."""
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        for own in split:
            yield b"".join(map(get, own))


#: By a Python worker's tokenizer; a worker that is used again keeps what it has learnt.
_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def tokenized(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Stored pieces of all documents: windows of `size` ids and the rest."""
    end = np.array([end_id], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        part = TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for batch in it:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids([x.as_py() for x in batch.column(1)]), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, size):
                    length = min(size, total - start)
                    rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, part, seen[length]))
                    seen[length] += 1
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 5 else pa.int64()) for k, c in enumerate(columns)], names=[x.split()[0] for x in PIECES.split(", ")])

    return stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_bytes(text).alias("raw")).mapInArrow(run, PIECES), "pieces")


def combinations(lengths: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """Combinations of one to three present lengths that fill the window, or leave least of it."""
    has = set(lengths.tolist())
    out = {(size,)} & {(x,) for x in has}
    ordered = np.sort(lengths)
    for a in ordered.tolist():
        if size - a in has and a <= size - a:
            out.add((size - a, a))
        rest = size - a
        low = ordered[(ordered <= rest // 2)]
        if len(low):  # thirds spread over what fits
            for b in low[np.unique(np.linspace(0, len(low) - 1, THIRDS).astype(int))].tolist():
                if rest - b in has and a >= b:
                    out.add(tuple(sorted((a, b, rest - b), reverse=True)))
    return sorted(out)


def solved(combos: list[tuple[int, ...]], lengths: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeats x >= 0 of the combinations with the least |A x - counts|, by accelerated projected gradient."""
    at = {int(x): k for k, x in enumerate(lengths)}
    rows = np.array([at[x] for c in combos for x in c])
    cols = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    apply = lambda x: np.bincount(rows, x[cols], len(lengths))
    back = lambda r: np.bincount(cols, r[rows], len(combos))
    v = np.ones(len(combos))
    for _ in range(30):  # the largest eigenvalue, for the step
        v = back(apply(v))
        norm = np.linalg.norm(v)
        v /= norm
    step, x, y, t = 1 / (1.05 * norm), np.zeros(len(combos)), np.zeros(len(combos)), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(apply(y) - counts))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that use every piece of the histogram exactly once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out: list[tuple[tuple[int, ...], int]] = []

    def use(combo: tuple[int, ...], repeats: int) -> None:
        out.append((combo, repeats))
        for x in combo:
            left[x] -= repeats
            if not left[x]:
                del left[x]

    if size in left:
        use((size,), left[size])
    lengths = np.array(sorted(left), np.int64)
    if len(lengths) and (combos := combinations(lengths, size)):
        x = np.floor(solved(combos, lengths, np.array([left[int(n)] for n in lengths], float)) + 1e-6).astype(np.int64)
        for combo, repeats in sorted(zip(combos, x.tolist(), strict=True), key=lambda p: -p[1]):
            most = min((left.get(n, 0) // combo.count(n) for n in set(combo)), default=0)
            if (repeats := min(repeats, most)) > 0:
                use(combo, repeats)
    while left:  # the longest, filled with the longest that fit; as often as the counts allow
        present = sorted(left, reverse=True)
        combo, room, taken = [present[0]], size - present[0], {present[0]: 1}
        for n in present:
            while n <= room and taken.get(n, 0) < left[n]:
                combo.append(n)
                taken[n] = taken.get(n, 0) + 1
                room -= n
        use(tuple(combo), min(left[n] // k for n, k in taken.items()))
    return out


def slots(plan_: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first number, first sequence, offset): the pieces of a length, in order of their numbers, fill them."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for combo, repeats in plan_:
        offset = 0
        for n in combo:
            rows.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + repeats
            offset += n
        sequence += repeats
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tuned(spark)
    pieces = tokenized(docs, tokenizer, doc_id, text, size, end_id)
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    at = slots(plan(histogram, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(offsets, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("number"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            length, number = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                row = at[n][np.searchsorted(at[n][:, 0], number[own], "right") - 1]
                sequence[own], offset[own] = row[:, 1] + number[own] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], names=names)

    return numbered.mapInArrow(place, ", ".join(f"{n} bigint" for n in names))
