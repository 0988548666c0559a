"""The run ledger as a stream: keyed upserts by micro-batch, and daily windows with a watermark.

Each micro-batch overwrites its own folder (batch=<id>), so a batch that runs again after a failure changes
nothing; the ledger is the latest row of each key over all folders. `compacted` writes that as one folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import joins
from tidemark.sources.tables import table


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the one that executors share; a temporary one only where the session names none and all runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return os.path.join(named or tempfile.gettempdir(), f"{name}-{uuid.uuid4().hex}")


def source(spark: SparkSession, sf_dir: str, name: str = "events", files: int = 1) -> DataFrame:
    """A Parquet table as a stream, `files` files a micro-batch."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def span(spark: SparkSession, sf_dir: str, name: str = "events", at: str = "ts") -> str:
    """Days from a table's first to its last time, as a watermark's delay: its files may then come in any order and no row is late.

    State is kept as long, so where the disorder of a source is known to be less, that is the delay to take.
    """
    r = table(spark, sf_dir, name).agg(F.datediff(F.max(at), F.min(at)).alias("days")).first()
    return f"{(r.days or 0) + 1} days"


def drained(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Runs all there is into folders of batches, then stops."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, path: str, schema, keys: list[str], *order: Column) -> DataFrame:
    """The ledger: of each key the first row in the order, later batches first."""
    rows = spark.read.schema(schema).parquet(path).select(*schema.names)
    return joins.latest(rows, keys, *order)


def compacted(ledger: DataFrame, path: str) -> None:
    """The ledger as it is, as one batch in a new folder."""
    ledger.write.mode("overwrite").parquet(f"{path}/batch=0")
