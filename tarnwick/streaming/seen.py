"""Keyed memory with its own expiry, as a stateful stream: what passes, and what is forgotten, are rows.

`dropDuplicatesWithinWatermark` forgets by the watermark alone and says nothing of it. Here each key has an end of its own, so
memory is as long as it is meant to be, whatever the watermark's delay, and a purge counts what the memory had held. Keys are
dealt into groups, each with one state and one timer, so that what a call of Python costs is shared by all keys of a group.
"""

from __future__ import annotations

import uuid
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.sources.shared import shared_dir

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups that keys are dealt into by their hash. A call of Python costs milliseconds, so a group's keys share one.
GROUPS = 2048


def _memory(names: list[str], memory: int):
    """State of a group: its keys, since when each is remembered (microseconds), and how many rows have come since."""

    def apply(_, parts, state):
        *keys, since, n = state.getOption or [[] for _ in range(len(names) + 2)]
        held, out = dict(zip(zip(*keys), zip(since, n))), []
        if not state.hasTimedOut:
            times = {}  # a batch's rows of a key come in any order
            for part in parts:
                for *key, t in zip(*(part[c].tolist() for c in [*names, "_us"])):
                    times.setdefault(tuple(key), array("q")).append(t)
            for key, found in times.items():
                found, i = np.sort(np.frombuffer(found, "int64")), 0
                since, n = held.get(key, (None, 0))
                while i < len(found):
                    if since is None or found[i] >= since + memory:
                        if since is not None:
                            out.append((*key, since, "purged", n))
                        since, n = int(found[i]), 0
                        out.append((*key, since, "passed", 1))
                    after = int(found.searchsorted(since + memory))
                    n, i = n + after - i, after
                held[key] = since, n
        now = state.getCurrentWatermarkMs()
        for key in [k for k, (since, _) in held.items() if since + memory <= now * 1000]:
            out.append((*key, held[key][0], "purged", held.pop(key)[1]))
        if held:
            since, n = zip(*held.values())
            state.update((*map(list, zip(*held)), list(since), list(n)))
            # the timer is that of the group's earliest end; it rings when the watermark has passed it
            state.setTimeoutTimestamp(max(-(-(min(since) + memory) // 1000) - 1, now, 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[*names, "_us", "kind", "n"])

    return apply


def remember(stream: DataFrame, keys: list[str], at: str, days: float, late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """(keys, at, kind, n): a row `passed` for each event whose key is not remembered, at its time; a row `purged` for each memory that
    ends, at the time that it began, with the number of events that it had held.

    A key is remembered for `days` of event time from the event that passed; later events don't prolong it. Events of a batch are
    taken in order of time; one that comes later than `late` behind the newest is dropped, one without time too. Keys may be null, and
    are of types that a cast to a string and back keeps. `groups` stays as it is for a checkpoint's life.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    timed = stream.select(*keys, F.col(at).cast("timestamp").alias(at)).withWatermark(at, late).filter(F.col(at).isNotNull())
    dealt = timed.select(at, F.unix_micros(at).alias("_us"), *(F.col(k).cast("string").alias(n) for k, n in zip(keys, names)), F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group"))
    out = ", ".join(f"{n} string" for n in names) + ", _us long, kind string, n long"
    kept = ", ".join(f"{n} array<string>" for n in names) + ", since array<long>, n array<long>"
    made = dealt.groupBy("_group").applyInPandasWithState(_memory(names, int(days * 86_400_000_000)), out, kept, "Append", "EventTimeTimeout")
    return made.select(*(F.col(n).cast(stream.schema[k].dataType).alias(k) for k, n in zip(keys, names)), F.timestamp_micros("_us").alias(at), "kind", "n")


def run_once(spark: SparkSession, path: str, keys: list[str], at: str, days: float, files: int | None = None) -> DataFrame:
    """remember() over all of a Parquet table, read as a stream to its end, `files` files a batch."""
    out = f"{shared_dir(spark)}/seen-{uuid.uuid4().hex}"
    read = spark.readStream.schema(spark.read.parquet(path).schema)
    read = read.option("maxFilesPerTrigger", files) if files else read
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, _PROVIDER)
    try:
        made = remember(read.parquet(f"{path}*"), keys, at, days)
        query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(made.schema).parquet(out)
