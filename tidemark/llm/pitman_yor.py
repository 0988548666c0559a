"""Hierarchical Pitman-Yor language model over the bytes of texts.

A text is its lower-cased words, joined by spaces, then an end symbol: a text's
probability is that of its words in order, spelt out, so a word never seen in
training has one too. The restaurant of a context of `CONTEXT` bytes has that
of the context less its oldest byte as parent, down to the empty context, whose
parent is uniform: contexts with equal ends share parents.

Seating is sampled by Gibbs in blocks, a sweep going from the longest contexts
to the shortest. For each restaurant a gamma variable u is drawn given its number
of tables; given u, and the parent's predictive probability p of each dish, the
dishes are independent, and the tables t of a dish of c customers have weight
S(c, t) (d u p)**t with generalised Stirling numbers S. So all dishes of all
restaurants are drawn at once from their joint conditional given the parent's
probabilities. Up to `EXACT` customers t is drawn by inversion; beyond, S comes
from a series and a saddle point, and a draw from a logistic about the mode is
accepted or refused (Metropolis-Hastings). One thing is approximate: p is the
parent's predictive mean at its seating before the sweep, while the collapsed
chain would move the parent's seating with each table. Tables are the parent's
customers. Predictive parts are averaged over samples.

How it is spread: counts of (context, next byte) are summed by Spark; contexts
that end in the same `ROOT` bytes make a subtree whose restaurants are sampled in
one task. The restaurants of shorter contexts are shared by the subtrees: they
have at most 256**ROOT dishes whatever the input, and are sampled on the driver.
Seating of both is carried on from round to round. Only n-grams of training texts
have seats; those of held-out texts are looked up in the averaged model.

Scores come back by parts of documents: each part of texts is met by the values
of its own distinct words and n-grams, never by the whole model.

Defined cases: null and empty text is the end symbol alone; bytes 0xFE and 0xFF,
which UTF-8 never has, count as '?'; without training text every n-gram has
the uniform probability and every base count is 0; null doc_ids and repeated rows
are scored row by row; rows of a null `held` teach. Columns beyond doc_id and text
are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Hashes, as_bytes, batches, mix, stored, tuned

CONTEXT = 5
#: Length of the contexts at which subtrees begin.
ROOT = 3
SYMBOLS = 255
PAD, END = 0xFF, 0xFE
EXACT = 40
#: Strength and discount by the length of the context.
STRENGTH = (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)
DISCOUNT = (0.1, 0.2, 0.4, 0.6, 0.7, 0.8, 0.85, 0.85)
#: n-grams that one task samples together, about.
BUCKET_KEYS = 40_000
#: Dishes of one level whose Stirling numbers are kept from sweep to sweep, at most (some 300 bytes each).
CACHED = 400_000
ROUNDS = 2
#: Sweeps from the first seating; sweeps more after each change of the top; samples that are averaged.
BURN = 20
AGAIN = 4
SAMPLES = 4
PART_BYTES = 28 << 20
CHUNK_BYTES = 1 << 20
END_KEY = xxhash.xxh3_64_intdigest(b" end")  # no word has a space

_TABLE = bytes(c + 32 if 65 <= c <= 90 else 0x3F if c >= END else c for c in range(256))


def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log S(c, t): the ways, weighted, to seat c customers of one dish at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c, 1 : c + 2] + np.log(np.maximum(c - discount * t, 1e-300))
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], np.where(c >= t, stay, -np.inf))
    return out


def lgamma(x: np.ndarray) -> np.ndarray:
    y = np.array(x, float).reshape(-1)
    small = np.flatnonzero(y < 10)
    shift = np.prod(y[small, None] + np.arange(10), axis=1)
    y[small] += 10
    r = 1 / y
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + r / 12 - r**3 / 360 + r**5 / 1260
    out[small] -= np.log(shift)
    return out.reshape(np.shape(x))


class Stirling:
    """log S(c, t) of many customers, up to a constant for each c, without the table; and where S(c, t) x**t is largest.

    S(c, t) is c!/t! times the coefficient of z**c in F(z)**t, F(z) = (1 - (1 - z)**d) / d. Up to c**d tables the
    binomial series is summed; beyond it's the saddle point's value, moved to meet the series there. In y = -log(1 - z),
    c / t = m(y) holds at the saddle point, and at the mode also x F = t: both are read from one grid of y.
    """

    TERMS = 24

    def __init__(self, discount: float) -> None:
        self.d = discount
        y = np.geomspace(1e-7, 600, 1 << 15)
        g, z, m = self._at(y)
        self.y, self.m, self.log_m = y, m, np.log(np.maximum(m, 1))
        self.at_mode = g + math.log(discount) + np.log(m)
        self.narrow = 1 + np.gradient(g, y) * m / np.maximum(np.gradient(m, y), 1e-300)
        self.gamma = np.array([0 if (x := -discount * k).is_integer() else 1 / math.gamma(x) for k in range(1, self.TERMS + 1)])[:, None]

    def _at(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """At z = 1 - exp(-y): log F, log z, and the customers a table that have their saddle point here."""
        one, z = -np.expm1(-self.d * y), -np.expm1(-y)
        return np.log(one / self.d), np.log(z), self.d * z * np.exp((1 - self.d) * y) / one

    def prepared(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What holds for all t: the series' factors, one row a term; the largest t it is used for; the saddle point's shift."""
        k = np.arange(1, self.TERMS + 1)[:, None]
        factors, edge = np.exp(lgamma(c - self.d * k) - lgamma(c - self.d)) * self.gamma, np.floor(c**self.d)
        return factors, edge, self._few(edge, factors) - self._many(c, edge)

    def _few(self, t: np.ndarray, factors: np.ndarray) -> np.ndarray:
        total, choose = np.zeros(len(t)), np.ones(len(t))
        for k in range(self.TERMS):
            choose = choose * ((k - t) / (k + 1))
            total += choose * factors[k]
        return np.log(np.maximum(total, 1e-300)) - lgamma(t + 1) - t * math.log(self.d)

    def _many(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        y = np.maximum(np.interp(np.log(c / t), self.log_m, self.y), 1e-9)
        g, z, m = self._at(y)
        spread = np.maximum(t * m * (1 + (1 - self.d) * np.expm1(y) - m), 0)
        return t * g - c * z - lgamma(t + 1) - 0.5 * np.log(spread + 1 / 6)

    def log(self, c: np.ndarray, t: np.ndarray, ready: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        factors, edge, shift = ready
        out, low = np.empty(len(t)), t <= edge
        out[low] = self._few(t[low], factors[:, low])
        low = ~low
        out[low] = self._many(c[low], t[low]) + shift[low]
        return out

    def about(self, c: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mode of S(c, t) x**t, and the scale of a logistic as wide as the weights, a little more."""
        at = np.log(c * self.d / x)
        centre = np.maximum(c / np.interp(at, self.at_mode, self.m), 1)
        return centre - 0.5, 0.62 * np.sqrt(np.maximum(centre / np.interp(at, self.at_mode, self.narrow), 0.3))


def _logistic(t: np.ndarray, c: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """log probability that a logistic variable, rounded and held in 1..c, is t; precise in both tails."""
    low, high = np.where(t > 1, (t - 0.5 - centre) / scale, -1e4), np.where(t < c, (t + 0.5 - centre) / scale, 1e4)
    up = low > 0
    low, high = np.where(up, -high, low), np.where(up, -low, high)
    one = lambda v: 1 / (1 + np.exp(-np.clip(v, -690, 690)))
    return np.log(np.maximum(one(high) - np.where(low < -9e3, 0, one(low)), 1e-300))


class Seats:
    """Draws of the tables of dishes of one discount."""

    CLASSES = ((2, 5), (5, 13), (13, EXACT + 1))

    def __init__(self, discount: float) -> None:
        self.table, self.ways = stirling(discount), Stirling(discount)

    def classes(self, c: np.ndarray) -> list:
        """Rows by how they are drawn, with what depends on their customers alone; for as long as these stay the same."""
        out: list = []
        for low, high in self.CLASSES:
            for rows in _pieces(np.flatnonzero((c >= low) & (c < high)), 4_000):
                out.append((high, rows, np.ascontiguousarray(self.table[:, 1:high].T)[:, c[rows]]))
        for rows in _pieces(np.flatnonzero(c > EXACT), 4_000):
            own = c[rows].astype(float)
            out.append((0, rows, (own, self.ways.prepared(own))))
        return out

    def drawn(self, c: np.ndarray, t: np.ndarray, x: np.ndarray, rng: np.random.Generator, classes: list | None = None) -> np.ndarray:
        """Tables of each dish from weights S(c, t) x**t; t the present ones, which those of many customers may keep."""
        out = np.minimum(c, 1)
        for high, rows, ready in self.classes(c) if classes is None else classes:
            own = x[rows]
            if high:
                logit = np.arange(1, high)[:, None] * np.log(own) + ready
                chance = np.cumsum(np.exp(logit - logit.max(0)), 0)
                out[rows] = 1 + (chance < rng.random(len(rows)) * chance[-1]).sum(0)
                continue
            c_, held = ready
            centre, scale = self.ways.about(c_, own)
            chance = rng.random(len(rows))
            new = np.clip(np.floor(centre + scale * np.log(chance / (1 - chance) + 1e-300) + 0.5), 1, c_)
            old = np.clip(t[rows].astype(float), 1, c_)
            gain = self.ways.log(c_, new, held) - self.ways.log(c_, old, held) + (new - old) * np.log(own)
            gain += _logistic(old, c_, centre, scale) - _logistic(new, c_, centre, scale)
            out[rows] = np.where(np.log(rng.random(len(rows)) + 1e-300) < gain, new, old)
        return out


def _pieces(rows: np.ndarray, size: int) -> list[np.ndarray]:
    return np.array_split(rows, -(-len(rows) // size)) if len(rows) else []


_SEATS: dict[float, Seats] = {}


def seats_of(discount: float) -> Seats:
    if discount not in _SEATS:
        _SEATS[discount] = Seats(discount)
    return _SEATS[discount]


class Level:
    """The restaurants of contexts of one length, over sorted distinct n-grams: each is a dish of its context."""

    def __init__(self, keys: np.ndarray, length: int) -> None:
        self.keys, self.length = keys, length
        context = keys >> np.uint64(8)
        first = np.concatenate([[True], context[1:] != context[:-1]]) if len(keys) else np.zeros(0, bool)
        self.context, self.contexts = np.cumsum(first) - 1, context[first]
        self.c = self.t = np.zeros(len(keys), np.int64)
        self.classes: list | None = None

    def customers(self, c: np.ndarray, fixed: bool = False) -> None:
        """New customers; at first c**discount tables a dish. fixed: they stay the same for all sweeps."""
        first = np.round(c ** DISCOUNT[self.length]).astype(np.int64) if not self.t.any() else self.t
        self.c, self.t = c, np.clip(first, 1, c)
        self.classes = seats_of(DISCOUNT[self.length]).classes(c) if fixed and len(c) <= CACHED else None

    def seat(self, parent: np.ndarray, rng: np.random.Generator) -> None:
        s, d = STRENGTH[self.length], DISCOUNT[self.length]
        u = rng.standard_gamma(s / d + np.bincount(self.context, self.t, len(self.contexts)))
        self.t = seats_of(d).drawn(self.c, self.t, np.maximum(d * u[self.context] * parent, 1e-280), rng, self.classes)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Own part of each dish's probability, and each restaurant's share of the parent's."""
        s, d = STRENGTH[self.length], DISCOUNT[self.length]
        total = s + np.bincount(self.context, self.c, len(self.contexts))
        return (self.c - d * self.t) / total[self.context], (s + d * np.bincount(self.context, self.t, len(self.contexts))) / total


class Subtree:
    """Restaurants of contexts of `low` to `high` bytes over sorted distinct n-grams of high + 1 bytes, all with customers."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: int, high: int) -> None:
        self.counts, self.levels, self.up = counts, [Level(keys, high)], []
        for length in range(high - 1, low - 1, -1):
            shorter = self.levels[-1].keys & np.uint64((1 << 8 * (length + 1)) - 1)
            order = np.argsort(shorter, kind="stable")
            first = np.concatenate([[True], shorter[order][1:] != shorter[order][:-1]]) if len(order) else np.zeros(0, bool)
            up = np.empty(len(shorter), np.int64)
            up[order] = np.cumsum(first) - 1
            self.up.append(up)
            self.levels.append(Level(shorter[order][first], length))
        self.p = [np.empty(0)] * len(self.levels)
        self.mean: list[tuple[np.ndarray, np.ndarray]] = []

    def top(self) -> np.ndarray:
        return self.levels[-1].keys

    def top_tables(self) -> np.ndarray:
        return self.levels[-1].t

    def _fill(self, k: int) -> None:
        """Level k's customers from the tables of the longer contexts."""
        c = self.counts if k == 0 else np.bincount(self.up[k - 1], self.levels[k - 1].t, len(self.levels[k].keys)).astype(np.int64)
        if k or self.levels[0].c is not c:
            self.levels[k].customers(c, fixed=k == 0)

    def predict(self, above: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        """p: each dish's probability at each level; above: the parents' of the shortest contexts' dishes."""
        for k in range(len(self.levels) - 1, -1, -1):
            own, share = parts[k] if parts else self.levels[k].parts()
            above = self.p[k] = own + share[self.levels[k].context] * above
            if k:
                above = above[self.up[k - 1]]

    def sweep(self, above: np.ndarray, rng: np.random.Generator) -> None:
        """One Gibbs sweep from the longest contexts to the shortest; tables are the parent's customers."""
        for k, level in enumerate(self.levels):
            self._fill(k)
            level.seat(self.p[k + 1][self.up[k]] if k + 1 < len(self.levels) else above, rng)
        self.predict(above)

    def seats(self) -> bytes:
        return np.concatenate([level.t for level in self.levels]).astype(np.int32).tobytes()

    def seated(self, seats: bytes | None) -> None:
        """Tables as seats() gave them, or first ones."""
        t = np.frombuffer(seats, np.int32).astype(np.int64) if seats else None
        for k, level in enumerate(self.levels):
            if t is not None:
                level.t, t = t[: len(level.keys)], t[len(level.keys) :]
            self._fill(k)

    def sampled(self, above: np.ndarray, seed: int, burn: int = BURN, samples: int = SAMPLES, seats: bytes | None = None) -> None:
        """Sweeps, on from seats: p is the last sample's, mean has each level's parts averaged over the samples."""
        rng = np.random.default_rng(seed)
        self.seated(seats)
        self.predict(above)
        total: list = []
        for k in range(burn + samples):
            self.sweep(above, rng)
            if k >= burn:
                parts = [level.parts() for level in self.levels]
                total = [(a + x, b + y) for (a, b), (x, y) in zip(total, parts, strict=True)] if total else parts
        self.mean = [(a / samples, b / samples) for a, b in total]

    def chances(self, keys: np.ndarray, above: np.ndarray) -> np.ndarray:
        """Averaged predictive probability of any n-grams, seated or not; above: that of their ends at the parents."""
        for level, (own, share) in zip(reversed(self.levels), reversed(self.mean), strict=True):
            gram = keys & np.uint64((1 << 8 * (level.length + 1)) - 1) if level.length < 7 else keys
            above = _found(level.keys, own, gram, 0.0) + _found(level.contexts, share, gram >> np.uint64(8), 1.0) * above
        return above


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def sequence(raw: bytes) -> bytes:
    return b" ".join(raw.translate(_TABLE).split()) + bytes([END])


def windows(texts: list[bytes], context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """n-gram of each symbol of all texts, oldest byte first, and where each text's begin."""
    pad = bytes([PAD]) * context
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    n = len(data) - context
    keys = np.zeros(n, np.uint64)
    for k in range(context + 1):
        keys = (keys << np.uint64(8)) | data[k : n + k]
    begin = np.concatenate([[0], np.cumsum(lengths + context)])[:-1]
    keep = np.ones(n, bool)
    for k in range(context):  # windows that start in a text's last bytes reach into the next
        at = begin[1:] - 1 - k
        keep[at[at < n]] = False
    return keys[keep], np.concatenate([[0], np.cumsum(lengths)])[:-1]


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed weights."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


class Lookup:
    """Positions of known keys, found by hashing all queries at once, level by level."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.levels = keys, []
        left = np.arange(len(keys))
        while len(left):
            bits = max(4, int(1.5 * len(left)).bit_length())
            slots = np.zeros(1 << bits, np.int32)
            at = self._slot(keys[left], len(self.levels), bits)
            slots[at] = left
            self.levels.append((bits, slots))
            left = left[slots[at] != left]

    @staticmethod
    def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - bits)).astype(np.int64)

    def of(self, queries: np.ndarray) -> np.ndarray:
        out = np.full(len(queries), -1, np.int64)
        left = np.arange(len(queries))
        for level, (bits, slots) in enumerate(self.levels):
            own = queries[left] if level else queries
            got = slots[self._slot(own, level, bits)]
            hit = self.keys[got] == own
            out[left[hit]] = got[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


def _chunks(rows: Iterable[tuple], size: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += len(row[0])
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def _units(context: int) -> Callable[[pa.Table], pa.Table]:
    """The distinct words (kind 0) and n-grams (kind 1) of a part, with their counts in training texts."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        hashes = Hashes()
        found: dict[int, list] = {0: [], 1: []}
        rows = zip((x.as_py() for x in table.column("raw")), table.column("held").to_pylist(), strict=True)
        for chunk in _chunks(rows):
            for held in (False, True):
                texts = [t for t, h in chunk if h == held]
                if texts:
                    grams = counted(windows([sequence(t) for t in texts], context)[0])
                    words = counted(np.concatenate([hashes.of(t.translate(_LOWER).split()) for t in texts] + [np.full(len(texts), END_KEY, np.uint64)]))
                    for kind, (keys, n) in ((0, words), (1, grams)):
                        own = found[kind]
                        own.append((keys, np.zeros(len(keys), np.int64) if held else n))
                        while len(own) > 1 and len(own[-1][0]) * 2 > len(own[-2][0]):  # the pieces stay few and each under half of the one before
                            own[-2:] = [counted(*map(np.concatenate, zip(*own[-2:], strict=True)))]
        out = []
        for kind, own in found.items():
            keys, n = counted(np.concatenate([k for k, _ in own]), np.concatenate([n for _, n in own]))
            out.append(pa.table({"part": pa.array(np.full(len(keys), part, np.int32)), "kind": pa.array(np.full(len(keys), kind, np.int32)), "key": keys.view(np.int64), "n": n}))
        return pa.concat_tables(out)

    return run


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Top:
    """The restaurants of contexts shorter than ROOT, sampled on the driver: at most 256**ROOT dishes."""

    def __init__(self) -> None:
        self.tree = Subtree(np.empty(0, np.uint64), np.empty(0, np.int64), 0, ROOT - 1)
        self.seats: bytes | None = None
        self.tree.mean = [level.parts() for level in self.tree.levels]

    def sample(self, customers: DataFrame, seed: int) -> None:
        """customers: (gram, n), the tables that subtrees have of each dish."""
        got = customers.groupBy("gram").agg(F.sum("n").alias("n")).toArrow().sort_by("gram")
        keys = got.column("gram").to_numpy().astype(np.uint64)
        if not len(keys):
            return
        self.tree = Subtree(keys, got.column("n").to_numpy().astype(np.int64), 0, ROOT - 1)
        self.tree.sampled(np.full(len(self.tree.top()), 1 / SYMBOLS), seed, AGAIN if self.seats else BURN, SAMPLES, self.seats)
        self.seats = self.tree.seats()
        self.tree.levels[0].classes = None  # it goes to the tasks


def _subtree(context: int, top: Subtree, rnd: int, last: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Samples the subtrees of one bucket together: their restaurants don't meet below the top."""
    chances = (top.levels[0].keys, top.p[0])

    def run(key: tuple, table: pa.Table, seats: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        keys, n = counted(table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy())
        tree = Subtree(keys[n > 0], n[n > 0], ROOT, context)
        before = seats.column("seats")[0].as_py() if len(seats) else None
        if len(tree.counts):
            tree.sampled(_found(*chances, tree.top() & np.uint64((1 << 8 * ROOT) - 1), 1 / SYMBOLS), rnd * 1_000_003 + bucket, AGAIN if before else BURN, SAMPLES if last else 1, before)
        if last:
            if not len(tree.counts):
                tree.mean = [level.parts() for level in tree.levels]
            above = top.chances(keys & np.uint64((1 << 8 * ROOT) - 1), np.full(len(keys), 1 / SYMBOLS))
            return pa.table({"key": keys.view(np.int64), "value": np.log10(tree.chances(keys, above))})
        gram, at = np.unique((tree.top() & np.uint64((1 << 8 * ROOT) - 1)).astype(np.int32), return_inverse=True)
        tables = np.bincount(at, tree.top_tables(), len(gram)).astype(np.int64)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "gram": pa.array([gram]), "n": pa.array([tables]), "seats": pa.array([tree.seats()], pa.binary())})

    return run


def probabilities(grams: DataFrame, context: int = CONTEXT, rounds: int = ROUNDS) -> DataFrame:
    """(key, value): log10 of the averaged predictive probability of each n-gram's last byte; grams: key, n (0: not trained on)."""
    if not ROOT <= context <= 7:
        raise ValueError(f"contexts have {ROOT} to 7 bytes")
    trained = grams.where("n > 0")
    buckets = max(1, -(-trained.count() // BUCKET_KEYS))
    end = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * ROOT) - 1))

    def dealt(df: DataFrame):  # noqa: ANN202
        """By bucket, in as many partitions: few rows are much work here, so partitions aren't to be merged by their bytes."""
        return df.repartition(buckets, "bucket").groupBy("bucket")

    grouped = lambda df: dealt(df.withColumn("bucket", F.pmod(F.xxhash64(end), F.lit(buckets)).cast("int")))
    schema = "bucket int, gram array<int>, n array<bigint>, seats binary"
    seats = grams.sparkSession.createDataFrame([], schema)
    shrunk = math.prod(DISCOUNT[ROOT : context + 1])  # first tables of the subtrees, about
    top = Top()
    top.sample(trained.select(F.col("key").bitwiseAND(F.lit((1 << 8 * ROOT) - 1)).alias("gram"), F.ceil(F.pow("n", F.lit(shrunk))).alias("n")), 0)
    for k in range(rounds):
        seats = stored(grouped(trained).cogroup(dealt(seats)).applyInArrow(_subtree(context, top.tree, k, False), schema), "seats")
        top.sample(seats.select(F.inline(F.arrays_zip("gram", "n"))), k + 1)
    return grouped(grams).cogroup(dealt(seats)).applyInArrow(_subtree(context, top.tree, rounds, True), "key bigint, value double")


def scored(docs: DataFrame, held: F.Column, doc_id: str = "doc_id", text: str = "text", context: int = CONTEXT) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt from rows that aren't held."""
    spark = docs.sparkSession
    tuned(spark)
    parts = batches(docs, text, PART_BYTES)
    carried = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.pmod(F.xxhash64(doc_id, text), F.lit(parts)).cast("int").alias("part"), as_bytes(text).alias("raw"))
    dealt = lambda df: df.repartition(parts, "part").groupBy("part")  # noqa: E731  a part a task, about, whatever the session's number of partitions
    units = stored(dealt(carried).applyInArrow(_units(context), "part int, kind int, key bigint, n bigint"), "units", compression="zstd")
    words = units.where("kind = 0").groupBy("key").agg(F.sum("n").cast("double").alias("value"))
    words = stored(words, "words", compression="zstd")
    total = words.agg(F.sum("value").alias("n"), F.count(F.when(F.col("value") > 0, 1)).alias("v")).first()
    n_train, n_types = int(total.n or 0), int(total.v or 0)
    grams = stored(units.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "grams", compression="zstd")
    chances = stored(probabilities(grams, context), "chances", compression="zstd")
    values = words.withColumn("kind", F.lit(0)).unionByName(chances.withColumn("kind", F.lit(1)))
    answers = units.select("part", "kind", "key").join(values, ["kind", "key"]).select("part", "kind", "key", "value")
    floor = np.log10(n_train + n_types + 1)

    def run(batch: pa.Table, known: pa.Table) -> pa.Table:
        kinds, keys, value = known.column("kind").to_numpy(), known.column("key").to_numpy().view(np.uint64), known.column("value").to_numpy()
        find, has = {}, {}
        for kind in (0, 1):
            find[kind], has[kind] = Lookup(keys[kinds == kind]), value[kinds == kind]
        del known, kinds, keys, value
        hashes = Hashes()
        out: list[tuple] = []
        rows = zip((x.as_py() for x in batch.column("raw")), batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), strict=True)
        for chunk in _chunks(rows):
            keys, begin = windows([sequence(t) for t, _, _ in chunk], context)
            score = np.add.reduceat(has[1][find[1].of(keys)], begin)
            end = np.array([END_KEY], np.uint64)
            tokens = [np.concatenate([hashes.of(t.translate(_LOWER).split()), end]) for t, _, _ in chunk]
            sizes = np.array([len(x) for x in tokens])
            at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            counts = has[0][find[0].of(np.concatenate(tokens))]
            base = np.add.reduceat(np.log10(counts + 1), at) - sizes * floor
            seen = np.add.reduceat((counts > 0).astype(np.int64), at)
            out += zip((d for _, d, _ in chunk), (h for _, _, h in chunk), sizes.tolist(), seen.tolist(), base.tolist(), score.tolist(), strict=True)
        doc, held_, size, seen_, base_, score_ = zip(*out, strict=True) if out else ((),) * 6
        return pa.table({
            "doc_id": pa.array(doc, pa.int64()), "held_out": pa.array(held_, pa.bool_()), "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(seen_, pa.int64()),
            "train_tokens": pa.array([n_train] * len(doc), pa.int64()), "base_score": pa.array(base_, pa.float64()), "score": pa.array(score_, pa.float64()),
        })

    return dealt(carried).cogroup(dealt(answers)).applyInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
