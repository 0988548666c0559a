"""Spelling variants against plain versions: all pairs by edit, counts by loops."""

import itertools
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import queries, spelling

WORDS = st.lists(st.text(st.sampled_from("abÀ"), min_size=1, max_size=7), max_size=60, unique=True)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def plain_groups(counts):
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        form = min(others, key=lambda x: (-counts[x], x), default=None)
        form = form if form is not None and counts[form] >= 2 * n else None
        out[w] = [w, n, len(others), form, counts.get(form)]
    for w in out:
        root = w
        while out[root][3] is not None:
            root = out[root][3]
        out[w] = (*out[w][:5], root)
    return out


@settings(max_examples=300, deadline=None)
@given(WORDS)
def test_self_join(words):
    words = sorted(words)
    left, right = spelling.self_join(words)
    got = [tuple(sorted((words[a], words[b]))) for a, b in zip(left, right, strict=True)]
    assert sorted(got) == sorted(p for p in itertools.combinations(words, 2) if near(*p))


@pytest.mark.parametrize("group", [1, 4, 10**6])
def test_groups_whatever_the_partition(spark, group):
    words = sorted({"".join(w) for n in (1, 2, 3, 4, 5) for w in itertools.product("abÉ", repeat=n)})
    counts = {w: zlib.crc32(w.encode()) % 50 + 1 for w in words} | {"x" * 300: 2, "x" * 299: 8, "x" * 298: 20}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = [tuple(r) for r in spelling.grouped(df, group, split=10**9).collect()]
    assert sorted(got) == sorted(plain_groups(counts).values())
    assert ("x" * 299, 8, 2, "x" * 298, 20, "x" * 298) in got


def test_pairs_come_once(spark):
    words = sorted({"".join(w) for n in (2, 3, 4) for w in itertools.product("ab", repeat=n)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    got = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(df, 3, 10**9).collect()]
    assert sorted(got) == sorted(p for p in itertools.combinations(words, 2) if near(*p))


ROWS = [(1, "Hello hello, HELLO hallo Hallo hallo helllo"), (2, None), (None, "hello hello École école"), (2, "hello hello École École"), (2, "hello hello École École"), (4, ""), (5, "a b c 12345 ×÷×÷× ×÷×÷× ×÷×÷×"), (6, "zebra " * 40_000), (7, "y" * 100_000 + " " + "y" * 100_000 + " " + "y" * 100_000)]


def test_vocabulary(spark):
    df = spark.createDataFrame([(*r, 0, "n") for r in ROWS], "doc_id bigint, text string, word int, n string")
    assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == plain_words(ROWS)
    assert spelling.vocabulary(df.limit(0)).count() == 0
    assert spelling.grouped(spelling.vocabulary(df.limit(0))).count() == 0


def test_slips(spark):
    rows = [(k % 7, f"planetary word{'abcdefghij'[k % 10]} comet") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain_words(rows)
    assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == want


def test_query_against_plain(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = plain_words(docs)
    got = {r.word: tuple(r) for r in queries.op11_spelling(spark, "/root/testdata/sf0.001").collect()}
    assert {w: r[1] for w, r in got.items()} == want
    some = sorted(want)[::40]
    for w in some:
        others = [x for x in want if near(w, x)]
        form = min(others, key=lambda x: (-want[x], x), default=None)
        assert got[w][2] == len(others)
        assert got[w][3] == (form if form is not None and want[form] >= 2 * want[w] else None)
