"""Sources and sinks: corpora, collections, seen-set. Failures are rows of an error side, not lost rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_corpus(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text): whole text files."""
    read = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def binary_corpus(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], pattern: str = "*.pdf", max_pages: int = 600, min_chars: int = 500) -> tuple[DataFrame, DataFrame]:
    """((path, text), (path, error)): pages from extract(bytes), blank ones dropped, `max_pages` kept and joined by blank lines;
    texts under `min_chars` and files that extract() fails on are errors."""

    def apply(batches):
        for pdf in batches:
            texts, errors = [], []
            for content in pdf["content"]:
                try:
                    pages = [p for p in extract(bytes(content))[:max_pages] if p and p.strip()]
                    texts.append("\n\n".join(pages))
                    errors.append(None)
                except Exception as e:  # an extractor may raise anything; the row keeps the reason
                    texts.append(None)
                    errors.append(str(e))
            yield pdf[["path"]].assign(text=texts, error=errors)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    read = files.mapInPandas(apply, "path string, text string, error string")
    short = F.col("error").isNull() & (F.length("text") < min_chars)
    read = read.withColumn("error", F.when(short, F.lit(f"under {min_chars} characters")).otherwise(F.col("error")))
    return read.filter("error is null").drop("error"), read.filter("error is not null").select("path", "error")


def first_found(*strategies):
    """The first non-empty of several columns, such as of several table extractors."""
    return F.coalesce(*(F.when(F.size(c) > 0, c) for c in strategies))


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Feed entries from JSON lines with the article fields; unreadable lines are in _corrupt."""
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in ("title", "url", "summary", "published", "source", "feed_url")), T.StructField("pos", T.IntegerType()), T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def save_collection(df: DataFrame, name: str, reset: bool = False) -> None:
    df.write.mode("overwrite" if reset else "append").saveAsTable(name)


def collection_counts(chunks: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """collection, n_chunks, status of each expected collection; absent ones count 0 and are not_ingested."""
    names = chunks.sparkSession.createDataFrame([(x,) for x in expected], "collection string")
    n = chunks.groupBy(F.col(column).alias("collection")).agg(F.count("*").alias("n"))
    return names.join(n, "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.when(F.col("n").isNull(), "not_ingested").otherwise("ok").alias("status"))


def write_payload(payload: DataFrame, path: str) -> None:
    """Issue payloads as JSON, without the brand."""
    payload.drop("brand").write.mode("overwrite").json(path)
