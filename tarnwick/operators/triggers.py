"""Many triggers at once: one automaton of all of them is walked over each text, so time does not grow with their number."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.sources.shared import stored

#: Triggers of one automaton, which is built in each worker from a broadcast list; more are walked in several passes.
MAX_TRIGGERS = 500_000
_AUTOMATA: dict = {}


def _automaton(key, words: list[str]):
    """One automaton a worker and list."""
    if key not in _AUTOMATA:
        import ahocorasick

        made = ahocorasick.Automaton()
        for k, w in enumerate(words):
            if w:
                made.add_word(w, k)
        if len(made):
            made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


def topics(texts: DataFrame, triggers: DataFrame, id_col: str = "qid", text_col: str = "text", most: int = MAX_TRIGGERS) -> DataFrame:
    """(id_col, topics): for each row the sorted topics that have a trigger inside the lower-cased text.

    triggers: (topic, word), words in lower case. A trigger may belong to several topics; an empty one is in every text, null ones
    in none; a null text has no topics. Rows are not shuffled; with more than `most` triggers they are walked once for each part
    of them, and written in between, so that no worker holds two automata.
    """
    spark = texts.sparkSession
    listed = triggers.filter("word is not null and topic is not null").groupBy("word").agg(F.array_sort(F.collect_set(F.col("topic").cast("string"))).alias("topics"))
    parts = -(-listed.count() // most) or 1
    kind = texts.schema[id_col].dataType.simpleString()
    rows = texts.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_text"), F.array().cast("array<string>").alias("topics"))
    for part in range(parts):
        own = listed if parts == 1 else listed.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == part)
        rows = rows.mapInArrow(_walk(spark, own.toArrow()), f"_id {kind}, _text string, topics array<string>")
        rows = rows if part == parts - 1 else stored(rows, "topics")
    return rows.select(F.col("_id").alias(id_col), "topics")


def _walk(spark, listed: pa.Table):
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, listed.column("word").to_pylist(), listed.column("topics").to_pylist()))

    def apply(batches):
        key, words, of = shared.value
        machine = _automaton(key, words)
        always = {t for w, ts in zip(words, of, strict=True) if not w for t in ts}
        for b in batches:
            found = []
            for text, before in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                hit = {k for _, k in machine.iter(text)} if text and len(machine) else ()
                found.append(sorted(set(before).union(always if text is not None else (), *(of[k] for k in hit))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string()))], ["_id", "_text", "topics"])

    return apply
