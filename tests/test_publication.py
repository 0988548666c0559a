"""Publications: whole or not at all, older ones readable, streams by version."""

import json
import os

import pytest
from pyspark.sql import functions as F
from tidemark.sources import publication


@pytest.fixture
def path(spark, tmp_path):
    publication.register(spark)
    return str(tmp_path / "table")


def put(df, path, mode="append"):
    df.write.format("publication").mode(mode).save(path)


def got(spark, path):
    return sorted(r.id for r in spark.read.format("publication").schema("id bigint").load(path).collect())


def test_versions_and_manifest(spark, path):
    put(spark.range(100).repartition(3), path)
    put(spark.range(100, 120), path)
    assert got(spark, path) == list(range(120)) and publication.versions(path) == [1, 2]
    m = publication.manifest(path, 2)
    assert sum(p["rows"] for p in m["parts"]) == 120 and all(p["size"] == os.path.getsize(f"{path}/parts/{p['name']}") for p in m["parts"])
    put(spark.range(5), path, "overwrite")
    assert got(spark, path) == list(range(5))
    assert spark.read.format("publication").load(path).schema["id"].dataType.simpleString() == "bigint"
    assert publication.swept(path) > 0 and got(spark, path) == list(range(5)) and publication.versions(path) == [3]
    put(spark.range(0), path)
    assert got(spark, path) == list(range(5))


def test_aborted_write_leaves_the_old_one(spark, path):
    put(spark.range(10), path)
    broken = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 999, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="broken"):
        put(broken, path)
    assert got(spark, path) == list(range(10)) and publication.versions(path) == [1]
    listed = {p["name"] for p in publication.manifest(path, 1)["parts"]}
    publication.swept(path)
    assert set(os.listdir(f"{path}/parts")) == listed


def test_half_a_write_is_never_seen(spark, path):
    put(spark.range(10), path)
    writer = publication.Writer(path, False)
    import pyarrow as pa

    message = writer.write(iter([pa.record_batch({"id": [77]})]))  # parts are there, the manifest isn't
    assert got(spark, path) == list(range(10))
    other = publication.Writer(path, False)
    writer.commit([message])
    assert got(spark, path) == [*range(10), 77]
    late = other.write(iter([pa.record_batch({"id": [78]})]))
    with pytest.raises(RuntimeError, match="faster"):
        other.commit([late])
    other.abort([late])
    assert got(spark, path) == [*range(10), 77] and not os.path.exists(f"{path}/parts/{late.parts[0]['name']}")


def test_spoilt_parts_are_told(spark, path):
    put(spark.range(10), path)
    name = publication.manifest(path, 1)["parts"][0]["name"]
    with open(f"{path}/parts/{name}", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="manifest"):
        got(spark, path)


def test_streams_take_versions_in_order(spark, path, tmp_path):
    put(spark.range(10), path)
    put(spark.range(10, 20), path)

    def run():
        stream = spark.readStream.format("publication").schema("id bigint").load(path)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(20))
    put(spark.range(20, 25), path)
    assert run() == list(range(25))
    json.dumps(publication.Stream(path, 0).latestOffset())
