"""Matroska: byte samples written as a file, and files parsed into packet tables.

The writer makes EBML header, Segment (Info, Tracks, Clusters of laced
SimpleBlocks, Cues) around raw 8-bit samples (A_PCM/INT/LIT, one channel). The
reader walks the variable-length elements of any such file: known and unknown
sizes, BlockGroups and SimpleBlocks, no lacing, Xiph, EBML and fixed-size
lacing; each frame becomes a packet with its track, time and byte range.

Defined cases: null text is empty and, padded, one block of zeros; equal texts
give equal files; an element that claims more bytes than its parent has ends
the parent (as a cut-off download does); a malformed number or lace raises
ValueError from parse(), and gives packets() the packets before it and one more row
of its file with the error and no packet. Null doc_ids and repeated rows each give a row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import arrow_map, as_bytes, stored, tuned

#: Element ids of the Matroska specification (fixed values).
EBML, DOC_TYPE, SEGMENT = 0x1A45DFA3, 0x4282, 0x18538067
INFO, TIMESTAMP_SCALE, DURATION = 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: What ends a cluster or segment of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

UNIT = 64
RATE = 8000
FRAME = 800  # samples: 100 ms
LACED = 8  # frames in a block
CLUSTER_FRAMES = 80
XIPH, FIXED, EBML_LACING = 1, 2, 3


def vint(value: int, length: int = 0) -> bytes:
    """A size: 7 bits a byte, the marker before them; all ones is kept for unknown."""
    n = length or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Frames of one block, with the sizes of all but the last before them."""
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif kind == EBML_LACING:
        head += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            d = len(b) - len(a)
            n = next(k for k in range(1, 9) if abs(d) < (1 << 7 * k - 1) - 1)
            head += vint(d + (1 << 7 * n - 1) - 1, n)
    elif len({*map(len, frames)}) > 1:
        raise ValueError("fixed-size lacing needs equal frames")
    return head + b"".join(frames)


def write(samples: bytes, rate: int = RATE, frame: int = FRAME, laced: int = LACED, kind: int | None = None) -> bytes:
    """A file with one PCM track. Blocks are laced: equal frames by fixed size, the last block by EBML lacing."""
    frames = [samples[k : k + frame] for k in range(0, len(samples), frame)]
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    track = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, frame * 10**9 // rate) + audio
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", 1000 * len(samples) / rate)) + element(0x4D80, b"tidemark") + element(0x5741, b"tidemark"))
    parts = [info, element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues = sum(map(len, parts)), []
    for k in range(0, len(frames), CLUSTER_FRAMES):
        start = k * frame * 1000 // rate
        body = [uint(CLUSTER_TIMESTAMP, start)]
        for j in range(k, min(k + CLUSTER_FRAMES, len(frames)), laced):
            own = frames[j : min(j + laced, k + CLUSTER_FRAMES)]
            how = 0 if len(own) == 1 else kind or (FIXED if len({*map(len, own)}) == 1 else EBML_LACING)
            head_ = vint(1) + struct.pack(">hB", j * frame * 1000 // rate - start, 0x80 | how << 1)
            body.append(element(SIMPLE_BLOCK, head_ + (lace(own, how) if how else own[0])))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def read_vint(raw: bytes, at: int, keep: bool = False, end: int | None = None) -> tuple[int, int]:
    """Value and position after it; keep: with the marker, as ids are. A size of all ones is -1."""
    end = len(raw) if end is None else end
    if at >= end or not raw[at]:
        raise ValueError(f"no variable-length number at {at}")
    n = 9 - raw[at].bit_length()
    if at + n > end:
        raise ValueError(f"a number is cut off at {at}")
    value = int.from_bytes(raw[at : at + n], "big")
    if keep:
        return value, at + n
    value ^= 1 << 7 * n
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def elements(raw: bytes, at: int = 0, end: int | None = None, parent: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, position, start of body, end of body) of what is directly inside."""
    end = len(raw) if end is None else end
    while at < end:
        ident, body = read_vint(raw, at, keep=True, end=end)
        if parent == CLUSTER and ident in TOP:
            return
        size, body = read_vint(raw, body, end=end)
        stop = end if size < 0 else min(body + size, end)
        if size < 0 and ident == CLUSTER:
            stop = max([x[3] for x in elements(raw, body, end, CLUSTER)], default=body)
        yield ident, at, body, stop
        at = stop


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    size: int
    keyframe: bool
    cluster: int
    lace: int


def frame_sizes(raw: bytes, at: int, end: int, kind: int) -> tuple[int, list[int]]:
    """Start of the frames and their sizes."""
    if not kind:
        return at, [end - at]
    if at >= end:
        raise ValueError("lacing sizes exceed the block")
    n, at, sizes = raw[at] + 1, at + 1, []
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError("fixed-size lacing doesn't divide the block")
        return at, [(end - at) // n] * n
    for k in range(n - 1):
        if kind == XIPH:
            size, byte = 0, 255
            while byte == 255:
                if at >= end:
                    raise ValueError("lacing sizes exceed the block")
                byte = raw[at]
                size, at = size + byte, at + 1
        else:
            before = at
            size, at = read_vint(raw, at, end=end)
            if k:
                size = sizes[-1] + size - ((1 << 7 * (at - before) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing sizes exceed the block")
    return at, sizes


def parse(raw: bytes, packets: list[Packet] | None = None) -> tuple[dict, list[Packet], list[tuple[int, int, int]]]:
    """Tracks and scale, packets, and cues as (time, track, absolute position of the cluster). packets: is filled, also where it ends in an error."""
    info: dict = {"scale": 1_000_000, "tracks": {}}
    packets = [] if packets is None else packets
    cues: list[tuple[int, int, int]] = []
    number = lambda a, b: int.from_bytes(raw[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", raw[a:b])[0]
    for top, _, start, stop in elements(raw):
        if top != SEGMENT:
            continue
        for ident, _, a, b in elements(raw, start, stop):
            if ident == INFO:
                for x, _, c, d in elements(raw, a, b):
                    info |= {"scale": number(c, d)} if x == TIMESTAMP_SCALE else {"duration": real(c, d)} if x == DURATION else {}
            elif ident == TRACKS:
                for x, _, c, d in elements(raw, a, b):
                    if x == TRACK_ENTRY:
                        has = {i: (e, f) for i, _, e, f in elements(raw, c, d)}
                        sound = {i: (e, f) for i, _, e, f in elements(raw, *has[AUDIO])} if AUDIO in has else {}
                        info["tracks"][number(*has[TRACK_NUMBER])] = {
                            "type": number(*has[TRACK_TYPE]) if TRACK_TYPE in has else 0, "codec": raw[slice(*has[CODEC_ID])].decode() if CODEC_ID in has else "",
                            "frame_ns": number(*has[DEFAULT_DURATION]) if DEFAULT_DURATION in has else 0, "rate": real(*sound[SAMPLING_FREQUENCY]) if SAMPLING_FREQUENCY in sound else 0.0,
                        }
            elif ident == CUES:
                for x, _, c, d in elements(raw, a, b):
                    point = [(i, e, f) for i, _, e, f in elements(raw, c, d)] if x == CUE_POINT else []
                    time = next((number(e, f) for i, e, f in point if i == CUE_TIME), 0)
                    for i, e, f in point:
                        if i == CUE_TRACK_POSITIONS:
                            has = {y: number(g, h) for y, _, g, h in elements(raw, e, f)}
                            cues.append((time, has.get(CUE_TRACK, 0), start + has.get(CUE_CLUSTER_POSITION, 0)))
            elif ident == CLUSTER:
                base, nth = 0, packets[-1].cluster + 1 if packets else 0
                for x, _, c, d in elements(raw, a, b, CLUSTER):
                    if x == CLUSTER_TIMESTAMP:
                        base = number(c, d)
                    inner = [(c, d, True)] if x == SIMPLE_BLOCK else [(e, f, False) for y, _, e, f in elements(raw, c, d) if y == BLOCK] if x == BLOCK_GROUP else []
                    for e, f, simple in inner:
                        track, at = read_vint(raw, e, end=f)
                        if at + 3 > f:
                            raise ValueError("a block is cut off")
                        time, flags = struct.unpack_from(">hB", raw, at)
                        at, sizes = frame_sizes(raw, at + 3, f, flags >> 1 & 3)
                        step = info["tracks"].get(track, {}).get("frame_ns", 0)
                        for k, size in enumerate(sizes):
                            packets.append(Packet(track, (base + time) * info["scale"] + k * step, at, size, bool(flags & 0x80) if simple else True, nth, k))
                            at += size
    return info, packets, cues


PACKETS = "track int, timestamp_ns bigint, offset bigint, size bigint, keyframe boolean, cluster int, lace int, error string"


def packets(files: DataFrame, key: str, media: str) -> DataFrame:
    """One row a packet: key, track, timestamp_ns, byte range, keyframe, cluster, number in its lace; one more row, with the error, where a file can't be parsed to its end."""
    tuned(files.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own, error = [], None
            try:
                parse(raw.as_py() or b"", own)
            except (ValueError, struct.error, KeyError) as e:
                error = f"{type(e).__name__}: {e}"
            none = [None] * (error is not None)
            yield {"key": [name] * (len(own) + len(none)), "error": [None] * len(own) + [error] * len(none)} | {f: [getattr(p, f) for p in own] + none for f in Packet.__dataclass_fields__}

    kind = files.select(F.col(key).alias("key")).schema
    return arrow_map(files.select(F.col(key).alias("key"), F.col(media).cast("binary").alias("media")), run, StructType([*kind.fields, *StructType.fromDDL(PACKETS).fields]))


def padded(text: bytes, unit: int = UNIT) -> bytes:
    return text + bytes(-len(text) % unit or (0 if text else unit))


def features(samples: bytes, found: list[Packet], info: dict, cues: list[tuple[int, int, int]]) -> str:
    """Packets, clusters and cues, duration, and the samples' mean, deviation, zero crossings and entropy."""
    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    crossings = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    last = found[-1]
    return (
        f"packets={len(found)};clusters={last.cluster + 1};cues={len(cues)};last_ns={last.timestamp_ns};ms={info.get('duration', 0):.3f};"
        f"mean={x.mean():.4f};std={x.std():.4f};crossings={crossings};entropy={-(share * np.log2(share)).sum():.4f}"
    )


def stored_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored doc_id, n_bytes and the Matroska file that holds the padded text as samples."""
    tuned(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column(0), "n_bytes": [len(x.as_py()) for x in batch.column(1)], "media": [write(padded(x.as_py())) for x in batch.column(1)]}

    return stored(arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_bytes(text).alias("raw")), run, "doc_id bigint, n_bytes bigint, media binary"), "media", compression="zstd")


def read_back(files: DataFrame) -> DataFrame:
    """What the stored bytes hold: the payload's size, digest and tail checksum, the file's, and features of its packets."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for value in batch.column(2):
            raw = value.as_py()
            info, found, cues = parse(raw)
            if any(raw[p : p + 4] != CLUSTER.to_bytes(4, "big") for _, _, p in cues):
                raise ValueError("a cue doesn't point to a cluster")
            samples = b"".join(raw[p.offset : p.offset + p.size] for p in found)
            for k, v in (("payload_bytes", len(samples)), ("payload_sha256", hashlib.sha256(samples).hexdigest()), ("tail_crc32", zlib.crc32(samples[-UNIT:])), ("media_bytes", len(raw)), ("media_sha256", hashlib.sha256(raw).hexdigest()), ("feature", features(samples, found, info, cues))):
                out[k].append(v)
        yield {"doc_id": batch.column(0), "n_bytes": batch.column(1)} | out

    return arrow_map(files.select("doc_id", "n_bytes", "media"), run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
