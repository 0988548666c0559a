"""Line dedup, decontamination, archives and near-dedup: defined cases against SQL and plain versions."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import decontaminate, line_dedup, near_dedup, oracles, warc
from tidemark.llm.components import components


def sql(name, **tables):
    con = duckdb.connect()
    for t, (columns, rows) in tables.items():
        con.execute(f"create table {t} ({columns})")
        if rows:
            con.executemany(f"insert into {t} values ({', '.join('?' * len(rows[0]))})", rows)
    return con.execute(oracles.ORACLE[name]).to_arrow_table().to_pylist()


LONG = "a line that is long enough to count"
LINES = [(1, LONG + "\nx"), (2, f"  {LONG.upper()}\t\ny\n{LONG}"), (3, f"{LONG}\r"), (4, None), (5, ""), (6, "\n\n"), (7, "é" * 19), (8, "é" * 20), (9, "É" * 20), (10, "é" * 20 + "\n" + "é" * 20), (11, " " + "é" * 20), (12, "short\n" * 500)]


def test_line_dedup_is_the_sql(spark):
    df = spark.createDataFrame([(d, t, "p", 5) for d, t in LINES], "doc_id bigint, text string, part string, h int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "part", "h", "n_lines", "n_dropped"]
    rows = {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()}
    want = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in sql("op9_line_dedup", documents=("doc_id bigint, text varchar", LINES))}
    assert rows == want and rows[1][1] == 1 and rows[2][1] == 2
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_shards_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_ROWS", 12)
    rows = [(k, f"{LONG} number {k % 20}\n{LONG}") for k in range(90)] + [(None, LONG), (5, f"{LONG} number 5\n{LONG}")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    kept = {r.doc_id: r.text for r in got}
    assert len(got) == 92 and kept[None] == "" and kept[89].count(LONG) == 2 and kept[88] == f"{LONG} number 8" and kept[0] == ""


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.uint64)
    again = line_dedup.PerfectHash.from_bytes(line_dedup.PerfectHash(keys).to_bytes())
    assert sorted(again.index(keys).tolist()) == list(range(len(keys)))


ITEMS = [(1, " ".join(f"w{k}" for k in range(20))), (2, "Just four Words here"), (2, "Just four Words here"), (3, None), (4, "..."), (5, " ".join(f"w{k}" for k in range(5, 30))), (6, "w1 w2"), (10, "single")]


def test_decontamination_is_the_sql(spark):
    rng = random.Random(0)
    docs = [(0, None), (1, ""), (2, "no words: ... !"), (3, ITEMS[0][1]), (4, "x " * 500 + "just FOUR, words-here"), (5, "x single"), (6, "é-ü " + ITEMS[4][1] + ITEMS[5][1])]
    docs += [(k, " ".join(rng.choice([f"w{j}" for j in range(30)] + ["single", "just", "four", "words", "here"]) for _ in range(200)) + " " + " ".join(f"w{j}" for j in range(rng.randrange(10), 28))) for k in range(10, 30)]
    df = spark.createDataFrame([(*d, "i") for d in docs], "doc_id bigint, text string, items string")
    want = {r["doc_id"]: r for r in sql("op7_decontaminate", documents=("doc_id bigint, text varchar", docs), benchmark=("item_id bigint, text varchar", [x for x in ITEMS if x[0] != 3]))}
    for most in (decontaminate.MAX_WORDS, 22):  # one automaton, several
        got = decontaminate.contamination(df, spark.createDataFrame(ITEMS, "item_id bigint, text string"), max_words=most).withColumn("sha", decontaminate.digest("items")).collect()
        assert len(got) == len(docs)
        for r in got:
            w = want[r.doc_id]
            assert (r.n_words, r.n_hit, len(r["items"]), r.sha, r.contaminated) == (w["n_words"], w["n_hit"], w["n_items"], w["items_sha256"], w["contaminated"])
    none = decontaminate.contamination(df, spark.createDataFrame([], "item_id bigint, text string"))
    assert none.where("n_hit > 0 or contaminated").count() == 0
    cut = {r.doc_id: r.text for r in decontaminate.without_spans(decontaminate.contamination(df, spark.createDataFrame(ITEMS, "item_id bigint, text string"))).collect()}
    assert cut[3] == "" and cut[5] == "x " and cut[4].startswith("x x") and cut[1] == ""


PAGES = [(1, "u1", None), (2, "u2", ""), (3, "a\r\nb", "p" * 99), (4, "u", "p" * 99), (9, "u", "q" * 100), (5, "u", "q" * 100), (7, None, "q" * 100), (8, "u", "é" * 50), (6, "u", "é" * 50), (20, "u", "z" * 300_000), (21, "u", "one\r\n\r\ntwo " * 20)]


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    df = spark.createDataFrame([(*p, "d") for p in PAGES], "page_id bigint, url string, html string, digest string")
    archives = warc.write_archives(df)
    want = {r["page_id"]: tuple(r[k] for k in ("payload_bytes", "payload_digest", "record_type", "refers_to")) for r in sql("op8_warc", pages=("page_id bigint, url varchar, html varchar", PAGES))}
    got = warc.read_archives(archives).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(PAGES)
    assert {r.page_id: r.payload.decode() for r in got if r.record_type == "response"} == {p: h or "" for p, _, h in PAGES if want[p][2] == "response"}
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    for (raw,) in archives.select("bytes").collect():
        for k, (_, one) in enumerate(warc.read_archive(bytes(raw))):
            head, _ = warc.parsed(one)
            assert (head["WARC-Type"] == "warcinfo") == (k == 0) and one.startswith(b"WARC/1.1\r\n") and head["WARC-Date"] == warc.DATE and head["WARC-Record-ID"]
            if head["WARC-Type"] == "response":
                block = one.partition(b"\r\n\r\n")[2][:-4]
                assert head["Content-Type"].startswith("application/http") and block.startswith(b"HTTP/1.1 200 OK\r\n") and int(head["Content-Length"]) == len(block)
    raw = bytes(archives.first().bytes)
    assert raw[:4] == b"\x5d\x2a\x4d\x18"
    with pytest.raises(ValueError):
        list(warc.read_archive(raw[:-3]))


def test_urls_that_a_header_cannot_hold(spark):
    urls = ["http://a/b%20c?d=1#e", "http://a/\u2028x\x0by\x85\r\nWARC-Type: response", "http://\u00e9/ z", None]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("html", warc.F.lit("x")))).collect()
    found = {r.page_id: r.url for r in got}
    assert found == {k: warc.clean_url(u) for k, u in enumerate(urls)} and found[0] == urls[0] and found[3] == "" and all(u.isascii() and u.isprintable() for u in found.values())


def test_a_line_is_not_lost_where_fingerprints_are_equal(spark, monkeypatch):
    """Fingerprints all alike: each line still has its own place in its shard, so only lines in three documents go."""
    monkeypatch.setattr(line_dedup, "fingerprint", lambda keys: np.zeros(len(keys), np.uint32))
    rows = [(k, f"{LONG} number {k}\n{LONG}") for k in range(40)]
    keys = line_dedup.PerfectHash(np.arange(7, 50, dtype=np.uint64))
    assert sorted(keys.index(np.arange(7, 50, dtype=np.uint64)).tolist()) == list(range(43))
    table = line_dedup.pa.table({"shard": [0] * 3, "h": [1, 2, 3], "n": [1, 5, 1], "last": [10, 20, 30]})
    arrays = line_dedup._arrays(table)
    hits = line_dedup._probe(3)(arrays, line_dedup.pa.table({"h": line_dedup.pa.array([1, 2, 3]), "part": line_dedup.pa.array([0, 0, 0], line_dedup.pa.int32())}))
    assert hits.to_pylist() == [{"h": 2, "part": 0, "last": 20}]
    monkeypatch.undo()  # tasks have the real one
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {k: f"{LONG} number {k}" + (f"\n{LONG}" if k == 39 else "") for k in range(40)}


def test_very_long_texts(spark):
    """One text of 400,000 lines and one of 300,000 words beside small ones."""
    rows = [(1, "\n".join(f"a long line, of its own number {k % 1000}" for k in range(400_000))), (2, "a long line, of its own number 7"), (3, "a long line, of its own number 7"), (4, " ".join(f"w{k % 700}" for k in range(300_000)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (400_000, 400), 2: (1, 1), 3: (1, 0), 4: (1, 0)}
    found = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.contamination(df, spark.createDataFrame([(9, " ".join(f"w{k}" for k in range(690, 703)).replace("w700", "w0").replace("w701", "w1").replace("w702", "w2"))], "item_id bigint, text string")).collect()}
    assert found[4] == (300_000, 13 * (300_000 // 700)) and found[2] == (8, 0)
    pages = df.select(warc.F.col("doc_id").alias("page_id"), warc.F.lit("u").alias("url"), warc.F.col("text").alias("html"))
    assert {r.page_id: r.payload_bytes for r in warc.read_archives(warc.write_archives(pages)).collect()} == {d: len(t) for d, t in rows}


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, rng.randrange(1000, 1200)) for _ in range(300)] + [(5, 5), (3, 2000), (2000, 1999)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent if x != 5}


@pytest.mark.parametrize("others", [near_dedup.OTHERS, 5, 0])
def test_near_dedup_is_the_sql(spark, monkeypatch, others):
    """others: with few open members allowed a list, most are listed again by longer sketches, and again by whole sets."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "OTHERS", others)
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(5000)}"
    docs = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  b"), (5, "a b c d e"), (6, "a b c d e f"), (7, "x" * 5000)]
    source = [word() for _ in range(120)]
    shared = [word() for _ in range(60)]
    for k in range(40):  # copies of one text with changes: some pairs fall under the threshold
        own = list(source)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = word()
        docs.append((100 - k, " ".join(own)))
    for k in range(40):  # a passage that unlike texts share
        docs.append((200 + k, " ".join([*shared, *(word() for _ in range(rng.randrange(10, 60)))])))
    docs += [(300 + k, docs[10][1].upper()) for k in range(5)]
    want = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in sql("op6_near_dedup", documents=("doc_id bigint, text varchar", docs))}
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, doc int")
    got = near_dedup.deduplicated(df.repartition(3)).collect()
    assert {r.doc: (r.n_shingles, r.component_id, r.kept) for r in got} == want and len(got) == len(docs)
    assert near_dedup.deduplicated(df.limit(0)).count() == 0


def test_a_passage_of_many_unlike_texts_makes_no_pairs(spark, monkeypatch):
    """3,000 texts of 150 words share 90: by 48 values they are listed together, by 256 not at all; copies among them are found."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    shared = [word() for _ in range(90)]
    docs = [(k, " ".join([*shared, *(word() for _ in range(60))])) for k in range(3000)]
    docs += [(5000 + k, docs[k * 30][1] + " " + word()) for k in range(100)]
    seen = []
    real = near_dedup.listed
    monkeypatch.setattr(near_dedup, "listed", lambda *a: seen.append(real(*a)) or seen[-1])
    got = {r.doc: r.component_id for r in near_dedup.deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {d: d if d < 5000 else (d - 5000) * 30 for d, _ in docs}
    assert len(seen) == 2 and seen[0].groupBy("value").count().where("count > 2000").count() and not seen[1].groupBy("value").count().where("count > 10").count()


def test_near_dedup_rows_of_one_id_and_without_one(spark):
    rng = random.Random(6)
    one, two = (" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(2))
    rows = [(7, one), (7, two), (3, one + " more"), (9, two + " end"), (None, one), (None, "alone here"), (None, None), (11, None)]
    got = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    copy = 3 if one < two else 9  # of the least text of id 7, which is the one that is verified
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc in (7, copy)} == {min(7, copy)}
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc is None and r.n_shingles < 50) == [(0, None, None), (1, None, None)]
    assert [r.component_id for r in got if r.doc is None and r.n_shingles > 50] == [min(7, copy)] and [(r.component_id, r.kept) for r in got if r.doc == 11] == [(11, True)]
    assert got and near_dedup.deduplicated(spark.createDataFrame([(None, None)] * 3, "doc_id bigint, text string")).count() == 3


def test_pairs_without_a_common_value(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(2, 60))
        rows = [rng.choice(200, rng.integers(0, 12), replace=False) for _ in range(n)]
        flat, owner = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(n), [len(x) for x in rows])
        ok = (rng.random((n, n)) < 0.5) & ~np.eye(n, dtype=bool)
        want = [[bool(ok[a, b]) and not set(rows[a]) & set(rows[b]) for b in range(n)] for a in range(n)]
        assert near_dedup._apart(flat, owner, ok).tolist() == want


def test_likely_pairs_keep_all_similar_ones():
    """Sets of many sizes, some larger than their sketch: no pair of 0.75 or more is lost before its estimate."""
    rng = np.random.default_rng(1)
    sets = []
    for size in (40, 200, 300, 2000, 2400):
        base = rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2)
        for share in (1.0, 0.98, 0.93, 0.9, 0.6):
            kept = base[rng.random(size) < share]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, size - len(kept), dtype=np.uint64)])))
    sketches = [s[: near_dedup.WIDE] for s in sets]
    flat, row = np.concatenate(sketches), np.repeat(np.arange(len(sets)), [len(s) for s in sketches])
    n = np.array([len(s) for s in sets])
    got = near_dedup._likely(flat, row, n, ~np.eye(len(sets), dtype=bool))
    similar = np.array([[near_dedup.similar(a, b) for b in sets] for a in sets]) & ~np.eye(len(sets), dtype=bool)
    assert similar.sum() > 20 and (got | ~similar).all() and got[similar].all()
    lone = [k for k in range(len(sets)) if not similar[k].any()]
    assert got[np.ix_(lone, lone)].sum() <= 0.2 * len(lone) ** 2
