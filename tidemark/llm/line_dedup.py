"""Line dedup over a sharded minimal perfect hash.

1. The distinct (line hash, document) pairs of all lines long enough are stored.
2. All distinct hashes, with their count of documents and the largest document
   id, are dealt to shards; a shard of them becomes a minimal perfect hash with
   arrays of fingerprints, counts and ids, one row of bytes.
3. Batches of documents probe the arrays of each shard. Each probe is of a line
   that the shard holds, so the perfect hash gives its own place and the count
   decides; the fingerprint only guards against a shard that isn't whole. What a
   shard answers is only the repeated lines, and each batch of texts drops them.

So lines are told apart by their 64-bit hashes alone: two different lines are
taken for one with odds of 2**-64 a pair. Nothing is collected: shards, probes and
batches are rows of bounded size, in as many partitions as there are. A very
frequent line is counted before the shuffle and probed once a batch.

Defined cases: null or empty text is one empty line; short lines stay; a
repeated row with one doc_id counts as one document and each row keeps or loses
its lines alike; a null doc_id counts as no document, and its lines that repeat
elsewhere go. Other columns pass through; one named n_lines or n_dropped (in any
case) comes back with `_in` appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import Carried, arrow_map, as_bytes, batches, mix, released, stored, tuned

MIN_CHARS = 20
MIN_DOCS = 3
#: Lines, counted once a document, of which one shard has its share of the distinct ones and of the probes.
SHARD_ROWS = 400_000
GAMMA = 1.7


class PerfectHash:
    """Minimal perfect hash of 64-bit keys: level by level, keys alone at their bit keep it; its rank is the index."""

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # bit array, ones before each 64 bits
        self.size = len(keys)
        rest, base = np.unique(keys.astype(np.uint64)), 0
        while len(rest):
            at = self._place(rest, len(self.levels), width := 64 * -(-int(GAMMA * len(rest) + 64) // 64))
            alone = np.bincount(at, minlength=width) == 1
            ones = alone.reshape(-1, 64).sum(1)
            self.levels.append((alone, base + np.concatenate([[0], np.cumsum(ones)[:-1]])))
            base += int(ones.sum())
            rest = rest[~alone[at]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, width: int) -> np.ndarray:
        return ((mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(20)) % np.uint64(width)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; of one that isn't in the set, some index or -1."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, before) in enumerate(self.levels):
            at = self._place(keys[left], level, len(bits))
            hit = bits[at]
            block = at[hit] >> 6
            inside = (bits.reshape(-1, 64)[block] & (np.arange(64) < (at[hit] & 63)[:, None])).sum(1)
            out[left[hit]] = before[block] + inside
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        """Sizes of the levels, then their bits; ranks are counted again when read."""
        head = np.array([self.size, len(self.levels), *(len(b) for b, _ in self.levels)], np.int64).tobytes()
        return head + b"".join(np.packbits(b).tobytes() for b, _ in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        self = cls(np.empty(0, np.uint64))
        self.size, n = np.frombuffer(raw, np.int64, 2).tolist()
        at, base = 16 + 8 * n, 0
        for width in np.frombuffer(raw, np.int64, n, 16).tolist():
            bits = np.unpackbits(np.frombuffer(raw, np.uint8, width // 8, at)).astype(bool)
            ones = bits.reshape(-1, 64).sum(1)
            self.levels.append((bits, base + np.concatenate([[0], np.cumsum(ones)[:-1]])))
            at, base = at + width // 8, base + int(ones.sum())
        return self


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ np.uint64(0xA5A5A5A55A5A5A5A)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def line_hash(key: bytes, least: int) -> int | None:
    """Signed hash of a key, None of one shorter than `least` code points."""
    if len(key) < least or not key.isascii() and sum(b & 0xC0 != 0x80 for b in key) < least:
        return None
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def _line_rows(min_chars: int):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        docs, hashes, parts = [], [], []
        for doc, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            found = {h for line in text.as_py().split(b"\n") if (h := line_hash(line_key(line), min_chars)) is not None}
            docs += [doc] * len(found)
            parts += [part] * len(found)
            hashes += found
        yield {"h": hashes, "doc": docs, "part": parts}

    return run


def _arrays(table: pa.Table) -> pa.Table:
    """The perfect hash of a shard's lines and their arrays, in its order."""
    released()
    keys = table.column("h").to_numpy().view(np.uint64)
    index = PerfectHash(keys)
    order = index.index(keys)
    prints, counts, last = np.empty(len(keys), np.uint32), np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64)
    prints[order], last[order] = fingerprint(keys), table.column("last").to_numpy()
    counts[order] = np.minimum(table.column("n").to_numpy(), 0xFFFFFFFF)
    return pa.table({"shard": table.column("shard")[:1], "hash": pa.array([index.to_bytes()], pa.binary()), "arrays": pa.array([prints.tobytes() + counts.tobytes() + last.tobytes()], pa.binary())})


def _probe(least: int):
    empty = pa.table({"h": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "last": pa.array([], pa.int64())})

    def run(arrays: pa.Table, lines: pa.Table) -> pa.Table:
        released()
        if not arrays.num_rows or not lines.num_rows:
            return empty
        index = PerfectHash.from_bytes(arrays.column("hash")[0].as_py())
        raw, n = arrays.column("arrays")[0].as_py(), index.size
        prints, counts, last = np.frombuffer(raw, np.uint32, n), np.frombuffer(raw, np.uint32, n, 4 * n), np.frombuffer(raw, np.int64, n, 8 * n)
        keys = lines.column("h").to_numpy()
        at = index.index(keys.view(np.uint64))
        if (at < 0).any() or (prints[at] != fingerprint(keys.view(np.uint64))).any():
            raise ValueError("a line is missing from its shard")
        hit = counts[at] >= least
        return pa.table({"h": keys[hit], "part": lines.column("part").to_numpy()[hit], "last": last[at[hit]]}, schema=empty.schema)

    return run


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with repeated lines dropped from the text, and n_lines and n_dropped added."""
    tuned(docs.sparkSession)
    carried = Carried(docs, "n_lines", "n_dropped")
    names, id_at, text_at = carried.inner, carried.of(doc_id), carried.of(text)
    n_parts = batches(carried.docs, text_at)
    part = F.pmod(F.xxhash64(id_at, text_at), F.lit(n_parts)).cast("int").alias("part")
    lines = stored(arrow_map(carried.docs.select(F.col(id_at).cast("long").alias("doc"), part, as_bytes(text_at).alias("raw")), _line_rows(min_chars), "h bigint, doc bigint, part int"), "lines")
    shards = max(1, -(-lines.count() // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard")
    dealt = lambda df, n, by: df.repartition(n, by).groupBy(by)  # noqa: E731  in as many partitions as there are groups, whatever the session's number
    counted = lines.select("h", "doc").dropDuplicates().groupBy("h").agg(F.count("doc").alias("n"), F.coalesce(F.max("doc"), F.lit(0)).alias("last"))
    arrays = dealt(counted.select("h", "n", "last", shard), shards, "shard").applyInArrow(_arrays, "shard int, hash binary, arrays binary")
    probes = lines.select("h", "part").dropDuplicates().select("h", "part", shard)
    hits = dealt(arrays, shards, "shard").cogroup(dealt(probes, shards, "shard")).applyInArrow(_probe(min_docs), "h bigint, part int, last bigint")
    kind = carried.schema("n_lines bigint, n_dropped bigint")
    own = to_arrow_schema(kind)

    def rebuilt(batch: pa.Table, found: pa.Table) -> pa.Table:
        released()
        last = dict(zip(found.column("h").to_pylist(), found.column("last").to_pylist(), strict=True))
        texts, n_lines, n_dropped = [], [], []
        for doc, raw in zip(batch.column("doc").to_pylist(), batch.column("raw"), strict=True):
            split = raw.as_py().split(b"\n")
            kept = [x for x in split if (h := line_hash(line_key(x), min_chars)) is None or last.get(h, doc) == doc] if last else split
            texts.append(b"\n".join(kept))
            n_lines.append(len(split))
            n_dropped.append(len(split) - len(kept))
        columns = {c: batch.column(c) for c in names} | {text_at: pa.array(texts, pa.binary()).cast(pa.string())}
        return pa.Table.from_arrays([*columns.values(), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], schema=own)

    gone = F.lit(None).cast("string").alias(text_at)  # the text travels once, as bytes
    texts = carried.docs.select(*(gone if c == text_at else F.col(c) for c in names), F.col(id_at).cast("long").alias("doc"), as_bytes(text_at).alias("raw"), part)
    return carried.back(dealt(texts, n_parts, "part").cogroup(dealt(hits, n_parts, "part")).applyInArrow(rebuilt, kind))
