"""Fill-in-middle against a version that lists the units by pattern."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidemark.llm import fill_middle, queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from("ab <>PSM\n\té中\U0001f600 "), max_size=60)


def plain(doc_id, text, unit="word"):
    text = text or ""
    units = TOKEN.findall(text) if unit == "word" else list(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return text, "plain", len(units), None, None
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (f"<S>{s}<P>{p}<M>{m}", "spm", len(units), len(p), len(m)) if h[3] % 100 < 80 else (f"<P>{p}<S>{s}<M>{m}", "psm", len(units), len(p), len(m))


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(0, 10**9), st.sampled_from(["word", "char"]))
def test_parts(text, doc_id, unit):
    out, *rest = fill_middle.transformed(text.encode(), doc_id, 42, 50, 80, unit)
    assert (out.decode(), *rest) == plain(doc_id, text, unit)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.sampled_from(["word", "char"]))
def test_every_cut(text, unit):
    units = TOKEN.findall(text) if unit == "word" else list(text)
    coded = fill_middle.runs(text.encode(), unit)
    assert coded.units == len(units)
    assert [coded.offset(u) for u in range(len(units) + 1)] == [len("".join(units[:u]).encode()) for u in range(len(units) + 1)]


ROWS = [(k, t) for k, t in enumerate(["one two three  ", None, "", " \n ", "éè x中 y", "a <P> b", "w " * 300_000, "<<P a <S b > M> c", "same here now", "same here now"] * 4)] + [(None, "no id here"), (3, "again"), (3, "again")]


def test_rows(spark):
    df = spark.createDataFrame([(k, t, "a", 1) for k, t in ROWS], "doc_id bigint, text string, Form string, output int")
    out = fill_middle.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "Form_in", "output_in", "output", "form", "n_units", "prefix_chars", "middle_chars"]
    got = out.select("doc_id", "text", *fill_middle.ADDED, fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    for r, (k, t) in zip(sorted(got, key=key), sorted(ROWS, key=key), strict=True):
        assert (r.doc_id, r.text) == (k, t)
        assert (r.output, r.form, r.n_units, r.prefix_chars, r.middle_chars) == plain(k, t)
        assert r.back == (t or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="unit"):
        fill_middle.fill_in_middle(df, unit="line")


def test_query_against_plain(spark):
    rows = {r.doc_id: r for r in queries.op13_fill_middle(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d in docs:
        out, form, n, p, m = plain(d.doc_id, d.text)
        r = rows[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(d.text or ""))
