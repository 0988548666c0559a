"""Matroska: exact round trips, all lacings, unknown sizes, cut-off files."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import matroska as mk
from tidemark.llm import queries


def samples(raw):
    return b"".join(raw[p.offset : p.offset + p.size] for p in mk.parse(raw)[1])


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=5000), st.sampled_from([None, mk.XIPH, mk.EBML_LACING]), st.integers(1, 700), st.integers(1, 9))
def test_round_trip(data, kind, frame, laced):
    data = mk.padded(data)
    assert len(data) % 64 == 0 and data
    raw = mk.write(data, frame=frame, laced=laced, kind=kind)
    assert samples(raw) == data
    _, _, cues = mk.parse(raw)
    assert cues and all(raw[p : p + 4] == b"\x1f\x43\xb6\x75" for _, _, p in cues)


def test_times_tracks_and_groups():
    block = mk.vint(2) + b"\x00\x05\x00" + b"abc"
    cluster = mk.uint(mk.CLUSTER_TIMESTAMP, 10) + mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, block)) + mk.element(mk.SIMPLE_BLOCK, mk.vint(1) + b"\xff\xfe\x82" + b"\x01\xff\x01" + b"x" * 256 + b"yz")
    open_ended = mk.CLUSTER.to_bytes(4, "big") + b"\xff" + cluster
    raw = mk.element(mk.EBML, b"") + mk.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + open_ended + mk.element(mk.CLUSTER, cluster) + mk.element(mk.CUES, b"")
    found = mk.parse(raw)[1]
    assert [(p.track, p.timestamp_ns, p.size, p.keyframe, p.cluster, p.lace) for p in found[:3]] == [(2, 15_000_000, 3, True, 0, 0), (1, 8_000_000, 256, True, 0, 0), (1, 8_000_000, 2, True, 0, 1)]
    assert [p.cluster for p in found] == [0, 0, 0, 1, 1, 1]
    assert raw[found[0].offset : found[0].offset + 3] == b"abc"
    assert mk.parse(b"") == ({"scale": 1_000_000, "tracks": {}}, [], [])
    with pytest.raises(ValueError):
        mk.read_vint(b"\x00", 0)


def test_vint():
    for v in (0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**40):
        assert mk.read_vint(mk.vint(v), 0) == (v, len(mk.vint(v)))
    assert mk.read_vint(b"\xff", 0) == (-1, 1)


def test_edge_cases_and_packets(spark):
    texts = [None, "", "a", "é" * 500, "x" * 64, "x" * 64, "long " * 40_000]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id bigint, text string, media string")
    rows = {r.doc_id: r for r in mk.read_back(mk.stored_media(df)).collect()}
    for k, t in enumerate(texts):
        data = mk.padded((t or "").encode())
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert rows[0].media_sha256 == rows[1].media_sha256 and rows[4].feature == rows[5].feature
    table = mk.packets(mk.stored_media(df), "doc_id", "media").groupBy("key").agg({"size": "sum"}).collect()
    assert {r.key: r["sum(size)"] for r in table} == {k: r.payload_bytes for k, r in rows.items()}
    assert mk.read_back(mk.stored_media(df.limit(0))).count() == 0


def test_laces_that_run_off_the_end():
    for raw, kind in ((b"\x01\xff\xff", mk.XIPH), (b"\x02\x05", mk.XIPH), (b"\x02\x41", mk.EBML_LACING), (b"\x01\x90", mk.EBML_LACING), (b"", mk.FIXED), (b"\x01\x09" + b"x" * 5, mk.XIPH)):
        with pytest.raises(ValueError):
            mk.frame_sizes(raw, 0, len(raw), kind)
    with pytest.raises(ValueError):  # what follows the block is not its own
        mk.frame_sizes(b"\x01\xff\xff\x01" + b"x" * 600, 0, 3, mk.XIPH)


def test_files_are_stored_and_broken_ones_give_their_error(spark):
    media = mk.stored_media(spark.createDataFrame([(1, "some text " * 20_000)], "doc_id bigint, text string"))
    assert media.inputFiles() and all("/media-" in f for f in media.inputFiles())
    good = bytes(media.first().media)
    broken = mk.element(mk.EBML, b"") + mk.element(mk.SEGMENT, mk.element(mk.CLUSTER, mk.element(mk.SIMPLE_BLOCK, mk.vint(1) + b"\x00\x00\x02\x01\xff\xff")))
    df = spark.createDataFrame([("good", good), ("broken", broken), ("zero", b"\x00\x01"), ("null", None), ("cut", good[:-2000])], "name string, media binary")
    got = mk.packets(df, "name", "media").collect()
    assert {r.key for r in got} == {"good", "broken", "zero", "cut"} and {r.key for r in got if r.error} == {"broken", "zero", "cut"}
    assert 100 < sum(r.key == "cut" and r.size == 800 for r in got) < 250
    assert all((r.size is None) == (r.error is not None) for r in got) and sum(r.size for r in got if r.key == "good") == 200_000


def test_query(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    rows = queries.op3_matroska(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = mk.padded(raw := (texts[r.doc_id] or "").encode())
        media = mk.write(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and f"packets={-(-len(data) // 800)};" in r.feature
