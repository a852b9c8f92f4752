"""Triggers by automaton against plain containment; parts; ten thousand at once."""

import random
import time

from tarnwick.operators import triggers


def plain(texts, words):
    return {k: sorted({t for t, w in words if w is not None and t is not None and w in text.lower()}) if text is not None else [] for k, text in texts}


def got(frame):
    return {r["qid"]: r["topics"] for r in frame.collect()}


def test_against_containment(spark):
    pick = random.Random(1)
    letters = lambda n: "".join(pick.choice("abcé ") for _ in range(n))
    words = [(f"t{pick.randrange(9)}", letters(pick.randrange(1, 5))) for _ in range(60)] + [("t1", "abc"), ("t2", "abc"), ("all", ""), ("no", None), (None, "a")]
    texts = [(k, letters(pick.randrange(0, 30)).title()) for k in range(80)] + [(100, None), (101, ""), (102, "ÉABC")]
    df, w = spark.createDataFrame(texts, "qid long, text string").repartition(3), spark.createDataFrame(words, "topic string, word string")
    assert got(triggers.topics(df, w)) == plain(texts, words)
    assert got(triggers.topics(df, w, most=10)) == plain(texts, words)
    assert set(map(tuple, got(triggers.topics(df, w.limit(0))).values())) == {()}
    assert triggers.topics(df.limit(0), w).collect() == []


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "ab"), (1, "cd")], "qid long, text string")
    w = spark.createDataFrame([("x", "ab"), ("y", "cd")], "topic string, word string")
    for most in (1, 10):
        assert sorted(r["topics"] for r in triggers.topics(df, w, most=most).collect()) == [["x"], ["x"], ["y"]]


def test_time_does_not_grow_with_triggers():
    pick, took = random.Random(2), []
    text = " ".join(f"w{pick.randrange(50_000)}" for _ in range(30_000))
    for n in (100, 10_000):
        machine = triggers._automaton(n, [f"zz{k} never" for k in range(n)])
        began = time.perf_counter()
        for _ in range(5):
            assert not list(machine.iter(text))
        took.append(time.perf_counter() - began)
    assert took[1] < 5 * took[0] + 0.05
