"""Feeds as a source: RSS and Atom documents become entries, what can't be read becomes rows of an error side.

Files are read by Spark's own text source, in batch and as a stream. So offsets, admission limits and stores that only Spark
reaches are Spark's, and a feed document is parsed where it is read.
"""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("title", "url", "summary", "published", "source")
_SCHEMA = "feed string, pos int, title string, url string, summary string, published string, source string, error string"
#: Where a field is found, by the names of its elements without name spaces; the first that is there counts.
_NAMES = {"title": ("title",), "url": ("link",), "summary": ("description", "summary", "content", "encoded"), "published": ("pubDate", "published", "updated", "date")}


def _name(element) -> str:
    return element.tag.rpartition("}")[2]


def _fields(entry) -> dict[str, str | None]:
    out: dict[str, str | None] = {}
    for field, names in _NAMES.items():
        for name in names:
            found = [x for x in entry if _name(x) == name]
            if field == "url":  # Atom keeps the address in an attribute, and may have others than the entry's own
                found.sort(key=lambda x: x.get("rel", "alternate") != "alternate")
            texts = [t for x in found if (t := (x.get("href") if field == "url" and x.get("href") else "".join(x.itertext())).strip())]
            if texts:
                out[field] = texts[0]
                break
    return out


def parse(content: str | None, max_chars: int = 20_000_000) -> tuple[list[dict], str | None]:
    """(entries in order, error). Entries that end before a fault are kept; a document without feed elements is an error."""
    if not content or not content.strip():
        return [], "empty"
    if len(content) > max_chars:
        return [], f"more than {max_chars} characters"
    reader, entries, source, path, is_feed, error = ElementTree.XMLPullParser(("start", "end")), [], None, [], False, None
    try:
        for k in range(0, len(content), 65_536):
            reader.feed(content[k : k + 65_536].encode("utf-8", "replace") if not content.lstrip().startswith("<?xml") else content[k : k + 65_536])
            for event, x in reader.read_events():
                name = _name(x)
                if event == "start":
                    path.append(name)
                    is_feed |= name in ("rss", "feed", "RDF", "channel")
                    continue
                path.pop()
                if name in ("item", "entry"):
                    entries.append(_fields(x))
                    x.clear()
                elif name == "title" and path and path[-1] in ("channel", "feed") and source is None:
                    source = "".join(x.itertext()).strip() or None
        reader.close()
    except ElementTree.ParseError as e:
        error = str(e)
    if error is None and not is_feed:
        error = "no feed"
    return [x | {"source": source} for x in entries], error


def entries(documents: DataFrame, feed: str = "feed", content: str = "content", max_chars: int = 20_000_000) -> DataFrame:
    """(feed, pos from 1, title, url, summary, published, source, error): the entries of each document; a document with a fault has a
    row more, without pos and with the error. A feed without title is its own source. Works on streams as on tables."""

    def apply(batches):
        for b in batches:
            out: dict[str, list] = {name: [] for name in ("feed", "pos", *FIELDS, "error")}
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, error = parse(text, max_chars)
                for k, entry in enumerate(found, 1):
                    for column, value in {"feed": name, "pos": k, "error": None, **{f: entry.get(f) for f in FIELDS}, "source": entry.get("source") or name}.items():
                        out[column].append(value)
                if error:
                    for column in out:
                        out[column].append({"feed": name, "error": error}.get(column))
            kinds = [pa.string(), pa.int32(), *(pa.string(),) * 6]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)], list(out))

    return documents.select(F.col(feed).cast("string").alias("feed"), F.col(content).alias("content")).mapInArrow(apply, _SCHEMA)


def read_feeds(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """Entries of all feed files of a folder, named by their paths."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    return entries(files.select(F.col("_metadata.file_path").alias("feed"), F.col("value").alias("content")))


def stream_feeds(spark: SparkSession, path: str, pattern: str = "*.xml", files: int | None = None) -> DataFrame:
    """The same as a stream: files that come later are entries of later batches, at most `files` files a batch."""
    read = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern)
    read = read.option("maxFilesPerTrigger", files) if files else read
    return entries(read.load(path).select(F.col("_metadata.file_path").alias("feed"), F.col("value").alias("content")))
