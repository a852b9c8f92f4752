"""Helpers shared by the training-data operators: shared-folder tables, bounds, word rules."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: maximal runs without ASCII white space.
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Only a local master may fall back to a temporary folder, which is then also set as the
    checkpoint folder; a cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    own = "file://" + tempfile.mkdtemp(prefix="tarnwick-shared-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return written(spark.read.schema(df.schema).parquet(path), path)


def release(*tables: DataFrame) -> None:
    """Delete what was written for `tables`; what was made from them has to be written itself by then.

    The JVM is asked to collect its garbage, so that Spark's cleaner deletes the shuffle files of plans that are done.
    """
    spark = tables[0].sparkSession
    for df in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(df._tarnwick_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.discard(df._tarnwick_path)
        if df._tarnwick_table:
            spark.sql(f"DROP TABLE IF EXISTS {df._tarnwick_table}")
    tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of plans that nothing refers to: the second collection finds what the first let go."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def _forget(spark: SparkSession) -> None:
    """At the end of the driver's program: delete the tables that results were still read from."""
    with contextlib.suppress(Exception):  # a session that is stopped or a JVM that is gone leaves them to the folder's owner
        for path in list(_WRITTEN):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Paths of tables in the shared folder that are still there.
_WRITTEN: set[str] = set()


def written(df: DataFrame, path: str, name: str | None = None) -> DataFrame:
    """`df`, marked as read from `path`, which release() deletes; what isn't released goes when the program ends."""
    if not _WRITTEN:
        atexit.register(_forget, df.sparkSession)
    _WRITTEN.add(path)
    df._tarnwick_path, df._tarnwick_table = path, name
    return df


def at(docs: DataFrame, name: str) -> int:
    """Place of a column: the one of exactly that name, else the one whose name differs only in case."""
    names = docs.columns
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


def plain(docs: DataFrame) -> DataFrame:
    """`docs` with its columns named c0, c1, ..., so that no names clash."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """The columns of `docs` that are named, under new names; other columns may have any names."""
    return plain(docs).select(*(F.col(f"c{at(docs, name)}").alias(new) for new, name in columns.items()))


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with underscores before it while a column of `docs` has that name in whatever case."""
    taken = {n.lower() for n in docs.columns}
    while name in taken:
        name = "_" + name
    return name


#: Tables of keys, of a few dozen bytes each, are broadcast up to so many rows.
MAX_KEYS = 1_000_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """`left` joined to `right`, which has each key once. Rows of the keys in `hot` are joined by broadcast, where they are, so
    that no task gets all rows of one; more hot keys than MAX_KEYS are left to adaptive execution."""
    n = hot.count()
    if not n or n > MAX_KEYS:
        return left.join(right, keys, how)
    few = F.broadcast(hot.select(*keys))
    cold = left.join(few, keys, "left_anti").join(right, keys, how)
    return cold.unionByName(left.join(F.broadcast(right.join(few, keys, "left_semi")), keys))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(column, modulus: int):
    """crc32 of an id's decimal text, modulo `modulus` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefix_starts(totals: DataFrame, key: str, value: str, start: str, total: str | None = None) -> DataFrame:
    """Exclusive prefix sums of per-partition totals: one row per partition, so the one-task
    window sees as many rows as there are partitions, never as many as there are documents."""
    from pyspark.sql import Window

    per = totals.groupBy(key).agg(F.sum(value).alias("_total"))
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    more = [F.sum("_total").over(every).cast("long").alias(total)] if total else []
    return per.select(key, F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long").alias(start), *more)
