"""WARC archives with an embedded Zstandard dictionary.

Each archive is a row of bytes: a skippable frame (magic 0x184D2A5D) with a
dictionary built from a bounded sample of the archive's own records, then each
record compressed as a frame of its own. An archive holds about `ARCHIVE_BYTES`
of payload, so that writing and reading need bounded memory; the rows are
written as Parquet in the shared folder, as executors share no local files.

Equal payloads of at least `min_bytes` are stored once: the one with the
smallest id is a response, others are revisits without a payload. Only digests
and ids are shuffled to find them; the few that are revisits are then joined to
the pages by digest and id together, so a page that is copied very often is no hot key.
A revisit's length and digest are those of the full payload, kept in its head.

Records are WARC/1.1: each archive begins with a warcinfo record, a response's block
is an HTTP message, each has a date (`date`, since the tables have no capture time).

Defined cases: a null payload is empty; repeated ids each make a record, and of
rows with the smallest id and one payload all are responses; a null id can't be
referred to and stays a response, unless another row has its payload. A null URL is
empty; what a URI can't hold is percent-encoded. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, stored, tuned

MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 8 << 20
#: Bytes of records from which a dictionary is built, and its size.
SAMPLE_BYTES = 512 << 10
DICTIONARY_BYTES = 16 << 10
MIN_BYTES = 100
LEVEL = 3
#: Capture time of records where none is given.
DATE = "1970-01-01T00:00:00Z"


def _head(**fields: str) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n"


def clean_url(url: str | None) -> str:
    """The URL with what a header line or a URI can't hold percent-encoded; escapes that it has stay."""
    return urllib.parse.quote(url or "", safe="%/:?#[]@!$&'()*+,;=~-._")


def info(date: str) -> bytes:
    """The first record of an archive."""
    body = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    return _head(WARC_Type="warcinfo", WARC_Record_ID=f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, date)}>", WARC_Date=date, Content_Type="application/warc-fields", Content_Length=str(len(body))) + body + b"\r\n\r\n"


def record(kind: str, page: int | None, url: str | None, digest: str, length: int, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record: a response is an HTTP message with the payload; a revisit names what it refers to and has no block."""
    block = b"" if kind == "revisit" else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    fields = {
        "WARC_Type": kind, "WARC_Record_ID": f"<urn:page:{'' if page is None else page}>", "WARC_Date": date, "WARC_Target_URI": clean_url(url),
        "WARC_Payload_Digest": f"sha256:{digest}", "X_Payload_Length": str(length), "Content_Type": "application/http; msgtype=response", "Content_Length": str(len(block)),
    }
    if refers_to is not None:
        fields |= {"WARC_Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC_Refers_To": f"<urn:page:{refers_to}>"}
    return _head(**fields) + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, and the block; a response's without its HTTP head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    block = rest[:length]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else block


def dictionary(records: list[bytes]) -> bytes:
    """Built from records up to SAMPLE_BYTES, spread evenly; too few records make their own bytes the dictionary."""
    total = sum(map(len, records))
    every = max(1, -(-total // SAMPLE_BYTES))
    sample = [r[: 16 << 10] for r in records[::every]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n"


def archive(records: list[bytes], date: str = DATE) -> bytes:
    """The dictionary frame, a warcinfo record and the records, each a frame."""
    raw = dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True, write_checksum=True)
    return struct.pack("<II", MAGIC, len(raw)) + raw + packer.compress(info(date)) + b"".join(map(packer.compress, records))


def read_archive(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record, decompressed one by one."""
    magic, size = struct.unpack_from("<II", raw)
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    at, view = 8 + size, memoryview(raw)
    while at < len(raw):
        one = opener.decompressobj()
        out = one.decompress(view[at:])
        if not one.eof:
            raise ValueError("an archive is cut off")
        yield at, out
        at = len(raw) - len(one.unused_data)


def _number(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES, date: str = DATE) -> DataFrame:
    """Rows (archive, records, bytes) of all pages' archives, stored in the shared folder."""
    tuned(pages.sparkSession)
    own = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("url"), as_bytes(payload).alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload"))
    first = own.where(F.col("length") >= min_bytes).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    again = own.select("digest", "page").join(first, "digest").where(~F.col("page").eqNullSafe(F.col("first"))).distinct()  # ids only: a digest may be very frequent
    again = again.select(F.col("digest").alias("of"), F.col("page").alias("by"), "first")
    known = own.join(again, (F.col("digest") == F.col("of")) & F.col("page").eqNullSafe(F.col("by")), "left")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[bytes] = []
        size = 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([len(waiting)], pa.int64()), pa.array([archive(waiting, date)], pa.binary())], names=["records", "bytes"])

        for batch in it:
            for row in zip(*(batch.column(k) for k in range(batch.num_columns)), strict=True):
                digest, page, uri, body, length, first_page = (x.as_py() for x in row)
                waiting.append(record("response" if first_page is None else "revisit", page, uri, digest, length, b"" if first_page is not None else body, first_page, date))
                size += len(waiting[-1])
                if size >= ARCHIVE_BYTES:
                    yield done()
                    waiting, size = [], 0
        if waiting:
            yield done()

    return stored(known.select("digest", "page", "url", "payload", "length", "first").mapInArrow(run, "records bigint, bytes binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """Rows (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, offset).

    A response's length and digest are those of the payload that is read, and
    must be what its head says; a revisit's are those its head names.
    """
    kind = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, offset bigint"
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
    names = [x.split()[0] for x in kind.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for raw in batch.column(0):
                rows = []
                for at, one in read_archive(raw.as_py()):
                    head, body = parsed(one)
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    digest, length = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != length):
                        raise ValueError(f"the payload of {head['WARC-Record-ID']} has changed")
                    rows.append((_number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], _number(head.get("WARC-Refers-To", "")), length, digest, body, at))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return archives.select("bytes").mapInArrow(run, kind)
