r"""Secret scans with DataFrame functions only.

Base kinds are patterns (assignments, access keys, hex strings). The method adds
`entropy` spans: over candidate strings, a window of `WINDOW` characters slides
and its Shannon entropy is kept by incremental counts, for each character class
(hex digits, letters and digits, base64). A candidate whose highest entropy in
a class reaches that class's threshold is a span, unless the allow-list names
it or it overlaps a base span.

Positions come from the text between matches: the lengths of the pieces and of
the matches, added up, are the offsets, so nothing is searched twice.

Entropy of a window of W characters with counts c is log2 W - sum(c log2 c)/W.
A step adds g(c+1) - g(c) for the character that enters and g(c-1) - g(c) for
the one that leaves, where g(c) = c log2 c.

Defined cases: null text is empty, without spans; offsets are in code points,
end exclusive; ties (equal starts) are ordered by kind. Repeated rows give equal
rows. Other columns pass; one named spans_assign, spans_access, spans_hex or
spans_entropy (in any case) comes back with `_in` appended.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Carried

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a least length in the pattern drops just the runs that are too short.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: Only the start of a run is tried; a window fits in it.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Class: its characters and the least entropy, in bits, of a window all of its characters.
CLASSES = {
    "hex": ("0123456789abcdefABCDEF", 3.2),
    "alnum": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.9),
    "base64": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/=_-", 3.9),
}
#: Candidates that are never secrets: numbers, UUIDs, names and paths of letters alone (long ones of mixed letters reach the
#: threshold often; a random base64 string of 20 has no digit or sign once in 30 times, which is missed), placeholder and file-like strings.
ALLOW = (r"^[0-9]+$", r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", r"^[A-Za-z_/=+-]+$", r"(?i)example|placeholder|changeme|xxxx|your[_-]", r"^[a-z0-9]+(?:[-_/][a-z0-9]+){3,}$")


def found(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches; keep filters them by the match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    both = F.arrays_zip(hits.alias("hit"), F.slice(pieces, F.lit(1), F.size(hits)).alias("piece"))
    both = F.transform(both, lambda x: F.struct(x["hit"].alias("hit"), F.length(x["piece"]).alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

    every = F.aggregate(both, start, add, lambda acc: acc["out"])
    return F.filter(every, lambda s: keep(s["hit"])) if keep is not None else every


def guarded(text: Column, pattern: str, keep=None) -> Column:
    """As found, but a text without a match costs one search."""
    return F.when(text.rlike(pattern), found(text, pattern, keep=keep)).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def assign_keeps(hit: Column) -> Column:
    return F.length(F.regexp_extract(hit, ASSIGN, 1)) >= 6


def peak_entropy(text: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Highest entropy of a window of `window` characters that are all in the alphabet; -1 without one."""
    n = len(alphabet)
    g = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)))
    codes = F.transform(F.split(text, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(alphabet), c)))
    zero = F.array_repeat(F.lit(0), n)
    start = F.struct(
        F.lit(0).alias("i"), F.array().cast("array<int>").alias("last"), zero.alias("counts"), F.lit(0.0).cast("double").alias("sum"), F.lit(-1.0).cast("double").alias("best"),
    )

    def step(acc: Column, code: Column) -> Column:
        full = F.size(acc["last"]) == window
        old = F.when(full, F.element_at(acc["last"], 1)).otherwise(F.lit(0))
        # what leaves, then what enters; a character of another class empties the window
        out_c = F.when(old > 0, F.element_at(acc["counts"], F.greatest(old, F.lit(1)))).otherwise(F.lit(0))
        in_c = F.element_at(acc["counts"], F.greatest(code, F.lit(1))) - F.when(old == code, 1).otherwise(0)
        total = acc["sum"] + F.when(old > 0, F.get(g, out_c - 1) - F.get(g, out_c)).otherwise(0.0) + F.get(g, in_c + 1) - F.get(g, in_c)
        counts = F.transform(acc["counts"], lambda c, i: c + F.when(i + 1 == code, 1).otherwise(0) - F.when(i + 1 == old, 1).otherwise(0))
        last = F.concat(F.when(full, F.slice(acc["last"], 2, window - 1)).otherwise(acc["last"]), F.array(code))
        best = F.when(F.size(last) == window, F.greatest(acc["best"], F.lit(math.log2(window)) - total / window)).otherwise(acc["best"])
        here = F.struct((acc["i"] + 1).alias("i"), last.alias("last"), counts.alias("counts"), total.alias("sum"), best.alias("best"))
        none = F.struct((acc["i"] + 1).alias("i"), F.array().cast("array<int>").alias("last"), zero.alias("counts"), F.lit(0.0).cast("double").alias("sum"), acc["best"].alias("best"))
        return F.when(code == 0, none).otherwise(here)

    return F.aggregate(codes, start, step, lambda acc: acc["best"])


def high_entropy(hit: Column) -> Column:
    """Whether a candidate reaches the threshold of a class and no rule of the allow-list names it."""
    reached = [peak_entropy(hit, alphabet) >= least for alphabet, least in CLASSES.values()]
    named = [hit.rlike(p) for p in ALLOW]
    return F.when(_any(named), False).otherwise(_any(reached))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for x in tests[1:]:
        out = out | x
    return out


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with an array<struct<start, end>> for each kind: spans_assign, spans_access, spans_hex, spans_entropy."""
    carried = Carried(docs, *(f"spans_{k}" for k in KINDS))
    value = F.coalesce(F.col(carried.of(text)), F.lit(""))
    out = carried.docs.withColumns({
        "spans_assign": guarded(value, ASSIGN, assign_keeps),
        "spans_access": guarded(value, ACCESS),
        "spans_hex": guarded(value, HEX),
        "spans_entropy": guarded(value, CANDIDATE),
    })
    base = F.concat("spans_assign", "spans_access", "spans_hex")
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    out = out.withColumn("spans_entropy", F.filter(F.filter("spans_entropy", apart), lambda s: high_entropy(s["hit"])))
    return carried.back(out.withColumns({f"spans_{k}": F.transform(f"spans_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS}))


def listed(*kinds: str) -> Column:
    """kind:start:end of the spans of these kinds by start, then kind, comma-joined."""

    def named(n: int, kind: str) -> Column:
        return F.transform(f"spans_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"), F.lit(kind).alias("name")))

    every = F.array_sort(F.concat(*(named(n, k) for n, k in enumerate(kinds))))
    return F.concat_ws(",", F.transform(every, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))))


def redacted(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """What scan gives, with every span in the text replaced by the mask; overlapping spans become one."""
    every = F.array_sort(F.concat(*(f"spans_{k}" for k in KINDS)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(every, start, cut, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return docs.withColumn(text, F.when(F.size(every) > 0, whole).otherwise(F.col(text)))
