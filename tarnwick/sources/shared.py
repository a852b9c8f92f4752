"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local master without it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tarnwick-")


#: Folders and tables that are kept for results still to be read; a program that ends leaves none of them.
_KEPT: dict[str, str | None] = {}


def _keep(spark: SparkSession, path: str, name: str | None = None) -> None:
    if not _KEPT:
        atexit.register(forget, spark)
    _KEPT[path] = name


def forget(spark: SparkSession) -> int:
    """Delete all that stored() and stored_buckets() have written in this program; frames that read it are void. The number of tables deleted."""
    n = 0
    while _KEPT:
        path, name = _KEPT.popitem()
        with contextlib.suppress(Exception):  # a session that has ended leaves them to the folder's owner
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            n += at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return n


def stored(df: DataFrame, tag: str) -> DataFrame:
    """`df` written to the shared folder and read back, so that what reads it often computes it once."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _keep(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, files) -> tuple:
    """(path, bytes, time of change) of each file: what was made from them holds as long as this stays equal."""
    found = []
    for name in sorted(files):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(found)


def stored_buckets(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Like stored(), in buckets of the columns `by`, so that grouping or joining by them needs no shuffle of this side."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(n, *by).option("path", path).format("parquet").saveAsTable(name)
    _keep(spark, path, name)
    return spark.table(name)
