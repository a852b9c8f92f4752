"""Keyed memory: what passes and what is forgotten, in one batch and in several, with a restart between."""

import datetime as dt
import random

from tarnwick.streaming.seen import GROUPS, remember, run_once

DAY = dt.timedelta(days=1)


def expected(events, days):
    """Greedy, key by key; memories that end by the newest event are forgotten."""
    newest, out = max(t for _, t in events), []
    for key in {k for k, _ in events}:
        times, since, n = sorted(t for k, t in events if k == key), None, 0
        for t in [*times, None]:
            if since is not None and (t is None or t >= since + days * DAY):
                if since + days * DAY <= newest:
                    out.append((key, since, "purged", n))
                since, n = None, 0
            if t is not None:
                if since is None:
                    since = t
                    out.append((key, t, "passed", 1))
                n += 1
    return sorted(out, key=str)


def test_batches(spark, tmp_path):
    pick, start = random.Random(3), dt.datetime(2024, 1, 1)
    events = sorted(((pick.choice([None, "a", "b", "c"]), start + dt.timedelta(minutes=pick.randrange(60 * 24 * 40))) for _ in range(200)), key=lambda e: e[1])
    want = expected(events, 5)
    for files in (1, 4):
        path = f"{tmp_path}/events{files}.parquet"
        size = -(-len(events) // files)
        for k in range(files):
            spark.createDataFrame(events[k * size : (k + 1) * size], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
        got = run_once(spark, path, ["key"], "ts", 5, files=1 if files > 1 else None)
        assert sorted(((r["key"], r["ts"], r["kind"], r["n"]) for r in got.collect()), key=str) == want


def test_keys_share_states(spark, tmp_path):
    """States, and with them calls of Python, are no more than the groups, however many keys there are. Nulls beside large numbers change no key."""
    start, path = dt.datetime(2024, 1, 1), f"{tmp_path}/many.parquet"
    big = 1 << 60
    events = [((big + k if k else None, "a" if k % 3 else None), start + d * DAY) for k in range(3000) for d in (0, 4, 5, 8)] + [((big, "end"), start + 9 * DAY)]
    spark.createDataFrame([(*k, t) for k, t in events], "id long, s string, ts timestamp").coalesce(1).write.parquet(path)
    made = remember(spark.readStream.schema("id long, s string, ts timestamp").parquet(path), ["id", "s"], "ts", 5)
    query = made.writeStream.format("memory").queryName("many").trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= GROUPS
    got = sorted((((r["id"], r["s"]), r["ts"], r["kind"], r["n"]) for r in spark.table("many").collect()), key=str)
    assert got == expected(events, 5)
