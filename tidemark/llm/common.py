"""Shared pieces of the corpus operators: scratch tables, text as bytes, sizing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Rows that a Python worker gets at once; with a long text each this is still some tens of MB.
ARROW_ROWS = 512
#: Text that one group of documents holds, where documents are grouped to be met by answers.
BATCH_BYTES = 12 << 20

_OWN_SCRATCH: dict[str, str] = {}
_STORED: dict[str, list[str]] = {}
_SHIPPED: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where it names none and all runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    key, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if key not in _OWN_SCRATCH:
        _OWN_SCRATCH[key] = tempfile.mkdtemp(prefix="tidemark-")
    return _OWN_SCRATCH[key]


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Delete what stored() wrote for this application; call it when no result of the operators is needed any more. Gives the number of tables."""
    paths = _STORED.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def _shipped(spark: SparkSession) -> None:
    """Give executors this package, once a session: they needn't have it installed."""
    key = spark.sparkContext.applicationId
    if key not in _SHIPPED:
        _SHIPPED.add(key)
        root = Path(__file__).resolve().parent.parent
        name = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
        with zipfile.ZipFile(name, "w") as out:
            for file in root.rglob("*.py"):
                out.write(file, f"{root.name}/{file.relative_to(root)}")
        spark.sparkContext.addPyFile(str(name))


def tuned(spark: SparkSession) -> None:
    """Small Arrow batches, as texts may be long; shuffle files go when a query ends; executors get the code.

    The first two are settings of the session, since results are lazy: they stay, but one that the session has set otherwise is left alone.
    """
    _shipped(spark)
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(ARROW_ROWS)), ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false", "true")):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def as_bytes(column: str = "text") -> F.Column:
    """UTF-8 bytes of a string column, null as empty: Python then decodes nothing."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def batches(docs: DataFrame, text: str = "text", size: int = BATCH_BYTES) -> int:
    """How many groups of about `size` bytes of text the documents make."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, -(-int(total) // size))


def released() -> None:
    """Give back what a reused worker has freed but still holds: the next stage's workers share an executor's memory with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict]], schema: str | StructType) -> DataFrame:
    """mapInArrow where fn gives dicts of columns for each batch."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in it:
            if batch.num_rows:
                for out in fn(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        released()

    return df.mapInArrow(run, kind)


class Carried:
    """The user's columns on their way through an operator: c0, c1, ... inside, so that none of their names meets one of its own.

    In the result they come first, in order and under their names; one whose name (in any case of letters) is also that of
    a column which the operator adds gets `_in` appended, until it is free.
    """

    def __init__(self, docs: DataFrame, *added: str) -> None:
        mine, taken = {a.lower() for a in added}, {c.lower() for c in docs.columns} | {a.lower() for a in added}
        self.before, self.fields, self.names, self.added = docs.columns, docs.schema.fields, [], list(added)
        for name in docs.columns:
            new = name
            if name.lower() in mine:
                while new.lower() in taken:
                    new += "_in"
                taken.add(new.lower())
            self.names.append(new)
        self.inner = [f"c{k}" for k in range(len(self.names))]
        self.docs = docs.toDF(*self.inner)

    def of(self, name: str) -> str:
        """Inner name of a column of the user's."""
        lower = [c.lower() for c in self.before]
        return self.inner[self.before.index(name) if name in self.before else lower.index(name.lower())]

    def schema(self, ddl: str) -> StructType:
        """Inner columns and the added ones."""
        return StructType([StructField(c, f.dataType, f.nullable) for c, f in zip(self.inner, self.fields, strict=True)] + (StructType.fromDDL(ddl).fields if ddl else []))

    def back(self, df: DataFrame) -> DataFrame:
        """df has the inner columns and the added ones."""
        return df.select(*self.inner, *self.added).toDF(*self.names, *self.added)


def own_columns(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their names there, from the result of an operator that carried them."""
    return result.select(*result.columns[: len(docs.columns)]).toDF(*docs.columns)


class Hashes(dict):
    """Word -> 64-bit hash, computed once per word; forgets all when it has grown large."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))
