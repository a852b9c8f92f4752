"""Structured Streaming: deduplication with bounded memory, and incremental ingest by id."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def dedup_within(stream: DataFrame, keys: list[str], at: str, memory: str = "90 days") -> DataFrame:
    """One row of each key within `memory` of event time; state older than that is dropped by the watermark."""
    return stream.withWatermark(at, memory).dropDuplicatesWithinWatermark(keys)


def run_once(spark: SparkSession, sf_dir: str, name: str, keys: list[str], at: str, memory: str) -> DataFrame:
    """The keys and their number of rows that dedup_within lets through, over all of a table read as a stream to its end."""
    from tarnwick.sources.shared import shared_dir

    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = stream.withColumn(at, stream[at].cast("timestamp"))
    query = dedup_within(stream, keys, at, memory).select(*keys).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).select(*keys)


def incremental_ingest(source: DataFrame, target: str, state: str, key: str = "id", prepare=lambda df: df):
    """Append rows of a stream whose key the Parquet folder `target` lacks; returns the started query.

    Each micro-batch is anti-joined before `prepare` (such as an embedding), so known rows cost nothing. A batch that is run
    again after a failure finds its own rows stored and adds none. Files carry Bloom filters of the key: a batch of few keys only
    reads the row groups that may hold them.
    """
    from tarnwick.sources import lookup

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(lookup.by_ids(spark, target, new.select(key), key).select(key), key, "left_anti")
        prepare(new).write.option(f"parquet.bloom.filter.enabled#{key}", "true").mode("append").parquet(target)

    return source.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()
