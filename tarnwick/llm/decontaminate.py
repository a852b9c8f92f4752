"""Benchmark decontamination, in DataFrame functions only.

The benchmark's n-grams are hashed into a broadcast set; each document's words are walked once, the
hash of the n-gram that starts at each word probes the set, and hits are verified word by word. Only
hits, and one row a document, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import MAX_KEYS, at, materialize, pick, plain

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Split between words: ASCII characters other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The set of n-grams is broadcast up to this many; beyond, the probe is an ordinary join.
MAX_BROADCAST = 2_000_000


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z; none for a null text."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def _gram_hash(words: str, at: str, n: int) -> Column:
    return F.expr(f"xxhash64({', '.join(f'get({words}, {at} + {k})' for k in range(n))})")


def benchmark_windows(items: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of all items: gram_hash, size, gram (array), item_ids (array). Short items are one window."""
    words = pick(items, _item=id_col, _text=text_col).select("_item", words_of(F.col("_text")).alias("_w")).filter(F.size("_w") > 0)
    each = words.select("_item", "_w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - n, F.lit(0)))).alias("_at"))
    grams = each.select("_item", F.slice("_w", F.col("_at") + 1, F.lit(n)).alias("gram")).distinct()
    return grams.groupBy("gram").agg(F.sort_array(F.collect_set("_item")).alias("item_ids")).withColumn("size", F.size("gram"))


def numbered_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _row (a number of the row's own in one reading of `docs`), _w (its words)."""
    return pick(docs, _id=id_col, _text=text_col).select("_id", F.monotonically_increasing_id().alias("_row"), words_of(F.col("_text")).alias("_w"))


def find_hits(words: DataFrame, items: DataFrame, n: int = 13, item_id: str = "item_id", item_text: str = "text", broadcast_windows: int = MAX_BROADCAST) -> DataFrame:
    """Per row of numbered_words(): _row, _id, n_words, spans (sorted array of struct<at, size>), item_ids (sorted array).

    spans are the occurrences of benchmark windows, verified word by word. Up to `broadcast_windows` windows are broadcast;
    of more, the hashes of the documents' windows are shuffled with their places, and words only meet hits.
    """
    grams = benchmark_windows(items, n, item_id, item_text)
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # at most n values
    keyed = F.lit(None).cast("long")
    for s in sizes:
        keyed = F.when(F.col("size") == s, _gram_hash("gram", "0", s)).otherwise(keyed)
    grams = grams.select(keyed.alias("_key"), F.col("size").alias("_size"), "gram", "item_ids")
    kind = grams.schema["item_ids"].dataType
    hit = (F.col("_hash") == F.col("_key")) & (F.col("_n") == F.col("_size"))
    same = F.coalesce(F.slice("_w", F.greatest("_at", F.lit(0)) + 1, F.col("_size")) == F.col("gram"), F.lit(False))
    # the words end here: past 128 documents the aggregation sorts, and so keeps, all rows of its task
    columns = ["_id", "_row", F.when(F.col("_at") < 0, F.size("_w")).alias("_n_words"), "_at", "_size", "item_ids", "_same"]
    # position -1 stands for the document itself, so that one without hits keeps a row
    alone = lambda w: w.select("_id", "_row", "_w", F.lit(-1).alias("_at"), F.lit(None).cast("int").alias("_size"), F.lit(None).cast(kind).alias("item_ids"), F.lit(False).alias("_same")).select(*columns)

    def probe(walk: DataFrame, *carried: str) -> DataFrame:
        """A row for each place and size of window: its hash, null where there is none."""
        if len(sizes) == 1:
            return walk.select(*carried, "_at", F.lit(sizes[0]).alias("_n"), F.when(F.col("_at") >= 0, _gram_hash("_w", "_at", sizes[0])).alias("_hash"))
        every = F.array(*(F.struct(F.lit(s).alias("n"), _gram_hash("_w", "_at", s).alias("h")) for s in sizes))
        first = F.array(F.struct(F.lit(sizes[0]).alias("n"), F.lit(None).cast("long").alias("h")))
        each = walk.select(*carried, "_at", F.explode(F.when(F.col("_at") >= 0, every).otherwise(first)).alias("_p"))
        return each.select(*carried, "_at", F.col("_p.n").alias("_n"), F.col("_p.h").alias("_hash"))

    if not sizes:
        probed = alone(words)
    elif grams.count() <= broadcast_windows:
        walk = words.withColumn("_at", F.explode(F.sequence(F.lit(-1), F.size("_w") - 1)))
        joined = probe(walk, "_id", "_row", "_w").join(F.broadcast(grams), hit, "left").filter((F.col("_at") < 0) | F.col("_size").isNotNull())
        probed = joined.withColumn("_same", same).filter("_at < 0 or _same").select(*columns)
    else:
        words = materialize(words, "words")  # so that a row keeps its number in both readings
        walk = words.filter(F.size("_w") > 0).withColumn("_at", F.explode(F.sequence(F.lit(0), F.size("_w") - 1)))
        found = probe(walk, "_row").join(grams, hit).select("_row", "_at", "_size", "gram", "item_ids")
        checked = found.join(words, "_row").withColumn("_same", same).filter("_same").select(*columns)
        probed = alone(words).unionByName(checked)
    return probed.groupBy("_row").agg(
        F.first("_id").alias("_id"),
        F.max("_n_words").cast("long").alias("n_words"),
        F.sort_array(F.collect_list(F.when(F.col("_same"), F.struct(F.col("_at").alias("at"), F.col("_size").alias("size"))))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("_same"), F.col("item_ids")))))).alias("item_ids"),
    )


def contamination(docs: DataFrame, items: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of `docs`: id_col, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, spans.

    n_hit counts the words in the union of the spans. Null and empty texts have no words and are clean; empty tables of
    either side give no hits; repeated rows are separate documents, and so are rows with null ids; an item without words has
    no windows, items that share a window all count, and an item without id gives hits but is not counted; very long texts are walked whole. Other columns are not read,
    whatever their names.
    """
    found = find_hits(numbered_words(docs, id_col, text_col), items, n, item_id, item_text)
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["at"] + s["size"] - F.greatest(a["upto"], s["at"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(a["upto"], s["at"] + s["size"]).alias("upto"),
        ),
        lambda a: a["n"],
    )
    names = F.sort_array(F.transform("item_ids", lambda x: x.cast("string")))
    out = found.withColumn("n_hit", union).select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "item_ids",
        "spans",
    )
    return out


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with all columns. Texts decide: rows of one text stay or go together; null and
    empty texts stay, whatever their ids, and an empty table of items removes nothing."""
    numbered = plain(docs)
    digest = F.unhex(F.sha2(F.coalesce(F.col(f"c{at(docs, text_col)}"), F.lit("")).cast("binary"), 256))
    keyed = numbered.select(digest.alias("doc_id"), F.col(f"c{at(docs, text_col)}").alias("text"))
    bad = materialize(contamination(keyed, items, **options).filter("contaminated").select(F.col("doc_id").alias("_digest")).distinct(), "contaminated")
    side = F.broadcast(bad) if bad.count() <= MAX_KEYS else bad
    return numbered.withColumn("_digest", digest).join(side, "_digest", "left_anti").drop("_digest").toDF(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text: the documents' words with those inside spans removed, joined by spaces (a cleaned, lower-cased text). Null and
    empty texts become empty ones; repeated rows and rows without id are documents of their own."""
    words = materialize(numbered_words(docs, id_col, text_col), "words")  # so that a row keeps its number in both readings
    joined = words.join(find_hits(words, items, n).select("_row", "spans"), "_row")
    kept = F.filter("_w", lambda w, k: ~F.exists("spans", lambda s: (k >= s["at"]) & (k < s["at"] + s["size"])))
    return joined.select(F.col("_id").alias(id_col), F.array_join(kept, " ").alias(text_col))
