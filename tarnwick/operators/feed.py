"""Feed items: first items per feed, seen-set, purge, section curation, issue payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.functions.text import url_hash


def first_n(items: DataFrame, feed: str, order: str, n: int = 4) -> DataFrame:
    return items.withColumn("pos", F.row_number().over(Window.partitionBy(feed).orderBy(order))).filter(F.col("pos") <= n)


def trimmed(items: DataFrame, title: Column, url: Column, summary: Column, source: Column) -> DataFrame:
    """Article fields: title and url stripped, summary of 300 characters, the url where a feed has no title."""
    return items.select("*", F.trim(title).alias("_title"), F.trim(url).alias("_url"), F.left(summary, F.lit(300)).alias("_summary"), F.coalesce(source, url).alias("_source"))


def filter_new(items: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Items whose url hash is not in `seen`. Copies inside the batch stay; see `distinct_in_batch`."""
    return items.withColumn("url_hash", url_hash(F.col(url))).join(seen.select("url_hash"), "url_hash", "left_anti")


def distinct_in_batch(items: DataFrame, order: str, url: str = "url") -> DataFrame:
    first = F.row_number().over(Window.partitionBy(url_hash(F.col(url))).orderBy(order))
    return items.withColumn("_n", first).filter("_n = 1").drop("_n")


def dedup_stats(items: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """total_scanned, duplicates_removed, seen_total."""
    flagged = items.select(url_hash(F.col(url)).alias("url_hash")).join(seen.select("url_hash", F.lit(True).alias("_s")).distinct(), "url_hash", "left")
    counts = flagged.agg(F.count("*").alias("total_scanned"), F.count_if(F.col("_s").isNotNull()).alias("duplicates_removed"))
    return counts.withColumn("seen_total", seen.agg(F.count("*")).scalar())


def mark_seen(seen: DataFrame, items: DataFrame, copies: bool = False) -> DataFrame:
    """Insert or ignore by url_hash: the seen-set with the items that it lacks, each once; with `copies`, all rows of what it lacked
    before the batch, for a set that keeps every page of a url."""
    new = items.join(seen.select("url_hash"), "url_hash", "left_anti")
    new = new if copies else new.dropDuplicates(["url_hash"])
    return seen.unionByName(new.select(*seen.columns))


def purge(seen: DataFrame, cutoff: Column, at: str = "inserted_at") -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes): rows before the cutoff go."""
    old = F.col(at) < cutoff
    return seen.filter(~old), seen.filter(old)


def top_per_section(items: DataFrame, section: str, score: str, tie: str, n: int = 6, least: int = 65) -> DataFrame:
    order = Window.partitionBy(section).orderBy(F.col(score).desc(), F.col(tie))
    return items.filter(F.col(score) >= least).withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n)


def chips(vendors: Column, source: Column) -> Column:
    """The first two vendors, else the source."""
    return F.slice(F.when(F.size(vendors) > 0, vendors).otherwise(F.array(source)), 1, 2)


def pills(keywords: Column) -> Column:
    """The first five keywords, the first two marked."""
    return F.transform(F.slice(keywords, 1, 5), lambda k, i: F.struct(k.alias("keyword"), (i < 2).alias("highlighted")))


def payload(items: DataFrame, section: str, order: str, fields: list[str]) -> DataFrame:
    """(section, entries): entries in order as an array of structs, for to_json."""
    each = F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("e"))
    per = items.groupBy(section).agg(F.array_sort(F.collect_list(each)).alias("x"))
    return per.select(section, F.transform("x", lambda v: v["e"]).alias("entries"))


def issue_date(ts: Column, zone: str = "Asia/Dubai") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "d MMM yyyy")


def archive_index(files: DataFrame, name: str = "name") -> DataFrame:
    """number, slug, has_pdf, has_mobile of each 'issue-NNN.html', newest first by number."""
    own = files.select(F.col(name).alias("_f")).distinct()
    issues = own.filter(F.col("_f").rlike(r"^issue-[0-9]{3}\.html$")).select(F.regexp_replace("_f", r"\.html$", "").alias("slug"))
    pdf = own.filter(F.col("_f").endswith(".pdf")).select(F.regexp_replace("_f", r"\.pdf$", "").alias("slug"), F.lit(True).alias("_p"))
    mobile = own.filter(F.col("_f").endswith("-mobile.html")).select(F.regexp_replace("_f", r"-mobile\.html$", "").alias("slug"), F.lit(True).alias("_m"))
    out = issues.join(pdf, "slug", "left").join(mobile, "slug", "left")
    return out.select(F.substring("slug", 7, 3).cast("int").alias("number"), "slug", F.col("_p").isNotNull().alias("has_pdf"), F.col("_m").isNotNull().alias("has_mobile")).orderBy(F.desc("slug"))
