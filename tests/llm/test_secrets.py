"""Secret scans against a plain Python version."""

import hashlib
import math
import re

import pytest
from tidemark.llm import queries, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]


def entropy(s):
    best = -1.0
    for k in range(len(s) - secrets.WINDOW + 1):
        w = s[k : k + secrets.WINDOW]
        best = max(best, -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)))
    return best


def extra(text, spans):
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if any(a < m.end() and m.start() < b for a, _, b, _ in spans) or any(re.search(p, m[0]) for p in secrets.ALLOW):
            continue
        for alphabet, least in secrets.CLASSES.values():
            if max(map(entropy, re.split(f"[^{re.escape(alphabet)}]", m[0]))) >= least - 1e-9:
                yield (m.start(), 3, m.end(), "entropy")
                break


def expected(text):
    text = text or ""
    spans = base(text)
    full = sorted([*spans, *extra(text, spans)])
    name = lambda ss: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(ss))
    return (*(sum(k == x for _, _, _, k in full) for x in secrets.KINDS), hashlib.sha256(name(spans).encode()).hexdigest(), name(full))


CASES = [
    None, "", "plain words", 'password = "hunter22" and TOKEN:abcdef', "password=token:abcdefgh", "secret=short", "token==abcdef", "AKIA" + "A1" * 8, "AKIAAKIA" + "Z" * 14,
    "AKIA123", "x" + "0123456789abcdef" * 2 + "g", "é😀 api_key: 'abc.def-123'", "apikey:AKIA" + "B2" * 9, "aZ3kQ9xW1mN7pL5vT8rY2uB6", "visit a-b-c-d1-example-eeeeeeee", "12345678901234567890123",
    "token=" * 5 + "abcdefg", "k" * 30_000 + " secret: zzzzzzzz", "Qm9Zx7Lk2Pw8Rt5Yv1Nb4Hc6+/Jd3Fg0Sa=", "550e8400-e29b-41d4-a716-446655440000",
]


def test_scan_is_the_plain_version(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(CASES)] * 2, "doc_id bigint, text string, hit string")
    rows = secrets.scan(df).select("doc_id", *(f"spans_{k}" for k in secrets.KINDS), secrets.listed(*secrets.KINDS).alias("spans")).collect()
    for r in rows:
        want = expected(CASES[r.doc_id])
        assert tuple(len(r[f"spans_{k}"]) for k in secrets.KINDS) == want[:4], CASES[r.doc_id]
        assert r.spans == want[5], CASES[r.doc_id]
    assert len(rows) == 2 * len(CASES)


def test_query_on_documents(spark):
    from pathlib import Path

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test data")
    texts = {r.doc_id: r.text for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    rows = queries.op10_secrets(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_assign, r.n_access, r.n_hex, r.n_entropy, r.base_sha256, r.spans) == expected(texts[r.doc_id])


def test_redacted(spark):
    df = spark.createDataFrame([(1, "a password=abcdefg b"), (2, None), (3, "clean")], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in secrets.redacted(secrets.scan(df)).collect()} == {1: "a [secret] b", 2: None, 3: "clean"}


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
