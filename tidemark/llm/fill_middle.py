r"""Fill-in-middle transformation over a run-length encoding of each text.

A text is stored as its maximal runs of one character class (white space
`[\x20\x09-\x0D]` or other): where each run starts and how many units end up to
and with it. Units are

* `word`: white space with the word after it; white space that ends the text is
  a unit of its own. A run ends one unit or none.
* `char`: code points. Runs are also cut where the UTF-8 width changes, so all
  units of a run have the same width.

A cut after u units binary-searches the cumulative counts for the run that holds
the u-th unit; its place in the run is then arithmetic (start + width * units,
at most the run's end). A cut costs log(runs), whatever the text's length.

Prefix, middle and suffix are the parts at two cuts drawn by hash of seed and
id. psm is `<P>`prefix`<S>`suffix`<M>`middle, spm `<S>`suffix`<P>`prefix`<M>`middle.
A text is left plain if it is empty, if it holds a sentinel, or by the draw.
A sentinel can't arise where parts meet: it would have to hold the `<` of
another sentinel past its first character. So output and form give back the text.

Defined cases: null text is empty; an empty text has no units; a null id is
drawn for as an empty one; repeated rows give equal rows; parts may be empty; a
very long text costs memory for its own bytes and about 11 bytes a character
while it is encoded. Other columns pass; one named output, form, n_units,
prefix_chars or middle_chars (in any case) comes back with `_in` appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Carried, arrow_map, as_bytes, tuned

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ADDED = ("output", "form", "n_units", "prefix_chars", "middle_chars")

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: UTF-8 width by first byte, 0 for the bytes that follow one.
_WIDTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, np.int8)


@dataclass
class Runs:
    """Runs of one text: byte offsets where they start (and the text's end), units up to and with each, bytes a unit (0: a run is at most one unit)."""

    start: np.ndarray
    upto: np.ndarray
    width: np.ndarray

    @property
    def units(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def offset(self, u: int) -> int:
        """Byte offset after the first u units."""
        if u <= 0:
            return 0
        k = int(np.searchsorted(self.upto, u))
        before = int(self.upto[k - 1]) if k else 0
        return int(self.start[k]) + (u - before) * int(self.width[k]) if self.width[k] else int(self.start[k + 1])


def runs(text: bytes, unit: str = "word") -> Runs:
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return Runs(np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int8))
    space = _SPACE[raw]
    change = space[1:] != space[:-1]
    if unit == "char":
        width = _WIDTH[raw]
        lead = np.flatnonzero(width)
        kind = width[lead]
        turn = lead[1:][kind[1:] != kind[:-1]]
        change[turn - 1] = True
    start = np.concatenate([[0], np.flatnonzero(change) + 1, [len(raw)]])
    if unit == "char":
        each = width[start[:-1]]
        return Runs(start, np.cumsum(np.diff(start) // each), each)
    ends = ~space[start[:-1]]
    ends[-1] = True
    return Runs(start, np.cumsum(ends), np.zeros(len(ends), np.int8))


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))  # the hex digest's groups of eight


def chars(text: bytes) -> int:
    return len(text) if text.isascii() else int(np.count_nonzero(_WIDTH[np.frombuffer(text, np.uint8)]))


def transformed(text: bytes, doc_id: int | None, seed: int, rate: int, spm: int, unit: str) -> tuple[bytes, str, int, int | None, int | None]:
    """output, form, units, code points of prefix and middle."""
    coded = runs(text, unit)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return text, "plain", coded.units, None, None
    first, second = sorted(h % (coded.units + 1) for h in (h1, h2))
    a, b = coded.offset(first), coded.offset(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < spm else "psm"
    output = SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if form == "spm" else PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return output, form, coded.units, chars(prefix), chars(middle)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, unit: str = "word") -> DataFrame:
    """docs with output, form, n_units, prefix_chars and middle_chars; rate: per cent of texts that change, spm: per cent of these in suffix-first form."""
    if unit not in ("word", "char"):
        raise ValueError(f"no such unit: {unit}")
    tuned(docs.sparkSession)
    carried = Carried(docs, *ADDED)
    names = carried.inner

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        found = [transformed(x.as_py(), k, seed, rate, spm, unit) for x, k in zip(batch.column("raw"), batch.column("key").to_pylist(), strict=True)]
        columns = zip(*found, strict=True)
        yield {c: batch.column(c) for c in names} | {c: pa.array(x, pa.binary()).cast(pa.string()) if c == "output" else list(x) for c, x in zip(ADDED, columns, strict=True)}

    own = carried.docs.withColumns({"key": F.col(carried.of(doc_id)).cast("long"), "raw": as_bytes(carried.of(text))})
    return carried.back(arrow_map(own, run, carried.schema("output string, form string, n_units bigint, prefix_chars bigint, middle_chars bigint")))


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone."""
    p, s, m = (F.instr(output, x.decode()) for x in (PREFIX, SUFFIX, MIDDLE))
    piece = lambda start, end: F.substring(output, start, end - start)
    middle = F.substring(output, m + 3, F.length(output))
    psm = F.concat(piece(F.lit(4), s), middle, piece(s + 3, m))
    spm = F.concat(piece(p + 3, m), middle, piece(F.lit(4), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
