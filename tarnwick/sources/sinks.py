"""Issue rendering and delivery. Rendering is column work; PDF engines, repositories and mail are callables that the caller gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.text import html_escape
from tarnwick.operators.feed import chips, pills


def _tag(name: str, css: str, c: Column) -> Column:
    return F.concat(F.lit(f'<{name} class="{css}">'), html_escape(c), F.lit(f"</{name}>"))


def entry_html(e: Column, mobile: bool = False) -> Column:
    """One entry: chips, source, headline, summary and (on desktop) keyword pills."""
    marks = F.array_join(F.transform(chips(e["vendors"], e["source"]), lambda v: _tag("span", "chip", v)), "")
    words = F.array_join(F.transform(pills(e["keywords"]), lambda p: F.when(p["highlighted"], _tag("b", "pill", p["keyword"])).otherwise(_tag("span", "pill", p["keyword"]))), "")
    parts = [F.lit("<article>"), marks, _tag("div", "source", e["source"]), _tag("h3", "title", e["title"]), _tag("p", "summary", e["summary"])]
    return F.concat(*parts, *([] if mobile else [words]), F.lit("</article>"))


def issue_html(title: Column, sections: Column, mobile: bool = False) -> Column:
    """A page from array<struct<title, entries array<struct<...>>>>; sections show how many entries they have."""
    one = lambda s: F.concat(F.lit("<section>"), _tag("h2", "section", s["title"]), _tag("div", "count", F.concat(F.size(s["entries"]).cast("string"), F.lit(" entries"))), F.array_join(F.transform(s["entries"], lambda e: entry_html(e, mobile)), ""), F.lit("</section>"))
    return F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>'), _tag("h1", "issue", title), F.array_join(F.transform(sections, one), ""), F.lit("</body></html>"))


def ticker(items: Column) -> Column:
    """Items twice over, so that a scrolling line has no gap."""
    return F.concat(items, items)


def slug(number: Column) -> Column:
    return F.concat(F.lit("issue-"), F.lpad(number.cast("string"), 3, "0"))


def issue_urls(number: Column, base: str, subdir: str = "") -> Column:
    """struct<html_url, html_mobile_url, pdf_url, pdf_mobile_url, archive_url>."""
    root = f"{base}/{subdir}/" if subdir else f"{base}/"
    at = lambda end: F.concat(F.lit(root + "issues/"), slug(number), F.lit(end))
    return F.struct(at(".html").alias("html_url"), at("-mobile.html").alias("html_mobile_url"), at(".pdf").alias("pdf_url"), at("-mobile.pdf").alias("pdf_mobile_url"), F.lit(root + "index.html").alias("archive_url"))


def pending(files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Files without a result yet, for conversions that skip what exists."""
    return files.join(done.select(key), key, "left_anti")


def deliver(rows: DataFrame, send: Callable[[dict], str]) -> DataFrame:
    """rows with `receipt` and `error`: send(row) may convert, publish or mail; a failure is kept with its reason."""
    from pyspark.sql import types as T

    names = rows.columns

    def apply(batches):
        for pdf in batches:
            receipts, errors = [], []
            for row in pdf.to_dict("records"):
                try:
                    receipts.append(send({k: row[k] for k in names}))
                    errors.append(None)
                except Exception as e:  # a delivery may raise anything; the row keeps the reason
                    receipts.append(None)
                    errors.append(str(e))
            yield pdf.assign(receipt=receipts, error=errors)

    return rows.mapInPandas(apply, T.StructType([*rows.schema.fields, T.StructField("receipt", T.StringType()), T.StructField("error", T.StringType())]))


def next_issue(issues: DataFrame, number: str = "number") -> DataFrame:
    """One row: the largest issue number plus one; 1 for none."""
    return issues.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias(number))
