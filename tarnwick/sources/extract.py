"""Texts of files by a chain of extractors: the first that gives enough text wins, failures and refusals are rows.

An extractor is a function from bytes to a list of pages. It runs in a worker on one file at a time, under limits of bytes and
time; what it raises, and what it takes too long for, is kept as the reason, and the next one is tried.
"""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Extractor = Callable[[bytes], list[str]]


class TooLong(Exception):
    """An extractor's time is over."""


@contextmanager
def _within(seconds: float):
    """TooLong after so many seconds. Only a main thread can be interrupted, which a worker's is."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise TooLong(f"more than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def chain(content: bytes | None, extractors: list[tuple[str, Extractor]], max_pages: int | None, min_chars: int, seconds: float) -> tuple[str | None, list[str], list[str]]:
    """(name of the extractor that won, its pages, reasons of those before)."""
    reasons = []
    for name, extract in extractors:
        try:
            with _within(seconds):
                pages = [str(p) for p in extract(content)[:max_pages] if p and str(p).strip()]
        except Exception as e:  # an extractor may raise anything; the reason is kept
            reasons.append(f"{name}: {type(e).__name__}: {e}"[:500])
            continue
        if sum(map(len, pages)) >= min_chars:
            return name, pages, reasons
        reasons.append(f"{name}: under {min_chars} characters")
    return None, [], reasons


def extracted(files: DataFrame, extractors: list[tuple[str, Extractor]], max_bytes: int = 200_000_000, max_pages: int | None = 600, min_chars: int = 500, seconds: float = 60, path: str = "path", content: str = "content") -> DataFrame:
    """(path, extractor, page from 1, n_pages, text, reasons): a row a page of what could be read, in order; one row without page for a file
    that none of the extractors read, or that has more than `max_bytes` or no content. reasons tell why others were passed over.
    Blank pages are left out; pages beyond `max_pages` too, if it is given."""
    t = files.select(F.col(path).cast("string").alias("path"), F.octet_length(content).cast("long").alias("size"), F.when(F.octet_length(content) <= max_bytes, F.col(content)).alias("content"))

    def apply(batches):
        for b in batches:
            for k in range(b.num_rows):  # a file at a time: pages may be many
                name, size, body = (b.column(j)[k].as_py() for j in range(3))
                if body is None:
                    won, pages, reasons = None, [], ["no content" if size is None else f"more than {max_bytes} bytes"]
                else:
                    won, pages, reasons = chain(bytes(body), extractors, max_pages, min_chars, seconds)
                n = max(len(pages), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array([won] * n, pa.string()), pa.array(range(1, n + 1) if pages else [None], pa.int32()), pa.array([len(pages)] * n, pa.int32()), pa.array(pages or [None], pa.string()), pa.array([reasons] * n, pa.list_(pa.string()))],
                    ["path", "extractor", "page", "n_pages", "text", "reasons"],
                )

    return t.mapInArrow(apply, "path string, extractor string, page int, n_pages int, text string, reasons array<string>")


def read_files(spark: SparkSession, path: str, extractors: list[tuple[str, Extractor]], pattern: str = "*.pdf", max_bytes: int = 200_000_000, **limits) -> DataFrame:
    """extracted() of all files of a folder. Files over the limit aren't read; Spark passes over empty files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    small = extracted(found.filter(F.col("length") <= max_bytes), extractors, max_bytes, **limits)
    large = found.filter(F.col("length") > max_bytes).select("path", F.lit(None).cast("string").alias("extractor"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("n_pages"), F.lit(None).cast("string").alias("text"), F.array(F.lit(f"more than {max_bytes} bytes")).alias("reasons"))
    return small.unionByName(large)


def xml_pages(content: bytes) -> list[str]:
    """Texts of the `page` elements of a well-formed XML document."""
    from xml.etree import ElementTree

    return ["".join(p.itertext()) for p in ElementTree.fromstring(content).iter("page")]


def plain_pages(content: bytes) -> list[str]:
    """UTF-8 text, cut at form feeds."""
    return content.decode("utf-8").split("\f")
