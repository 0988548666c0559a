"""A sink and source whose tables appear whole or not at all: `format("publication")`.

Tasks write parts of their own (Parquet) under parts/ and report name, rows, bytes and digest. The commit writes the list of them
as manifest-<version>.json, in one move, after all parts are there; an abort deletes what its tasks wrote. A reader takes the newest manifest, and
its parts alone, checks their sizes and digests, so it never sees half a write, parts of failed tasks, or a later version's parts. `append`
keeps the parts of the version before; `overwrite` doesn't (they stay on disk for readers of the older version until `swept`).

A stream reads versions in order: an offset is a version's number, a batch the parts that its versions added. It starts with the
oldest manifest, or behind version `since`. A writer's version is the newest plus one; of two writers that commit at once, the second fails
and aborts, since a manifest is never replaced.

Options: `path`, a folder that driver and executors share (any file system that pyarrow knows).
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a part, at most: a part is held in memory while it is written.
PART_ROWS = 1 << 18


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    fs, base = pafs.FileSystem.from_uri(path)
    return fs, base.rstrip("/")


def versions(path: str) -> list[int]:
    """Numbers of the manifests that are there."""
    fs, base = opened(path)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    names = [f.base_name for f in found if f.is_file]
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit())


def manifest(path: str, version: int) -> dict:
    fs, base = opened(path)
    with fs.open_input_stream(f"{base}/manifest-{version}.json") as f:
        return json.loads(f.read())


@dataclass
class Part(InputPartition):
    name: str
    rows: int
    size: int
    digest: str


@dataclass
class Written(WriterCommitMessage):
    parts: list


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.before = (versions(path) or [0])[-1]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = opened(self.path)
        fs.create_dir(f"{base}/parts")
        parts: list[dict] = []
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            if not held:
                return
            table = pa.Table.from_batches(held)
            held.clear()
            out = io.BytesIO()
            pq.write_table(table, out)
            raw, name = out.getvalue(), f"{uuid.uuid4().hex}.parquet"
            with fs.open_output_stream(f"{base}/parts/{name}") as f:
                f.write(raw)
            parts.append({"name": name, "rows": table.num_rows, "size": len(raw), "digest": hashlib.sha256(raw).hexdigest()})

        for batch in iterator:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PART_ROWS:
                flush()
        flush()
        return Written(parts)

    def commit(self, messages: list) -> None:
        fs, base = opened(self.path)
        fs.create_dir(base)
        added = [p for m in messages if m is not None for p in m.parts]
        old = [] if self.overwrite or not self.before else manifest(self.path, self.before)["parts"]
        version = self.before + 1
        target = f"{base}/manifest-{version}.json"
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            raise RuntimeError(f"version {version} is there already: another writer was faster")
        held = f"{base}/.manifest-{uuid.uuid4().hex}"
        with fs.open_output_stream(held) as f:
            f.write(json.dumps({"version": version, "parts": old + added, "added": [p["name"] for p in added]}).encode())
        fs.move(held, target)

    def abort(self, messages: list) -> None:
        """Deletes the parts of tasks that ended; those of tasks that failed are in no manifest, and go with `swept`."""
        fs, base = opened(self.path)
        for p in (p for m in messages if m is not None for p in m.parts):
            fs.delete_file(f"{base}/parts/{p['name']}")


def read_part(path: str, part: Part) -> Iterator[pa.RecordBatch]:
    fs, base = opened(path)
    with fs.open_input_stream(f"{base}/parts/{part.name}") as f:
        raw = f.read()
    if len(raw) != part.size or hashlib.sha256(raw).hexdigest() != part.digest:
        raise ValueError(f"{part.name} isn't what its manifest says")
    yield from pq.read_table(pa.BufferReader(raw)).to_batches()


def _parts(rows: list[dict]) -> list[Part]:
    return [Part(p["name"], p["rows"], p["size"], p["digest"]) for p in rows]


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Part]:
        found = versions(self.path)
        return _parts(manifest(self.path, found[-1])["parts"]) if found else []

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from read_part(self.path, partition) if isinstance(partition, Part) else ()


class Stream(DataSourceStreamReader):
    def __init__(self, path: str, since: int) -> None:
        self.path, self.since = path, since

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": self.since}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"version": max([self.since, *versions(self.path)])}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for v in (v for v in versions(self.path) if start["version"] < v <= end["version"]):
            m = manifest(self.path, v)
            new = set(m["added"])
            out += _parts([p for p in m["parts"] if p["name"] in new])
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_part(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class Publication(DataSource):
    @classmethod
    def name(cls) -> str:
        return "publication"

    def schema(self) -> pa.Schema:
        found = versions(self.options["path"])
        for p in manifest(self.options["path"], found[-1])["parts"] if found else []:
            from pyspark.sql.pandas.types import from_arrow_schema

            fs, base = opened(self.options["path"])
            with fs.open_input_file(f"{base}/parts/{p['name']}") as f:
                return from_arrow_schema(pq.read_schema(f))
        raise ValueError("nothing is published there: give a schema")

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(self.options["path"])

    def streamReader(self, schema) -> Stream:  # noqa: ANN001, N802
        return Stream(self.options["path"], int(self.options.get("since", "0")))

    def writer(self, schema, overwrite: bool) -> Writer:  # noqa: ANN001
        to_arrow_schema(schema)  # a type that Arrow hasn't is told before the tasks start
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Publication)


def swept(path: str) -> int:
    """Delete parts that the newest manifest doesn't list, and older manifests; only when no reader of an older version and no writer is at work. Gives the number of parts."""
    fs, base = opened(path)
    found = versions(path)
    keep = {p["name"] for p in manifest(path, found[-1])["parts"]} if found else set()
    gone = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{base}/parts", allow_not_found=True)) if f.is_file and f.base_name not in keep]
    for file in [*gone, *(f"{base}/manifest-{v}.json" for v in found[:-1])]:
        fs.delete_file(file)
    return len(gone)
