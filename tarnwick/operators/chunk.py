"""Chunkers: sliding windows, paragraph packing, headed clauses, parameter tables, narrative sections.

All are folds and splits of one row's arrays, so nothing is shuffled: a document is chunked where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import vocab as V
from tarnwick.functions.text import clean_cell, is_noise, mo_path, strip


def sliding(df: DataFrame, size: int = 1200, step: int = 1000, text_col: str = "text", min_chars: int = 50) -> DataFrame:
    """Adds chunk_idx and chunk: windows of `size` characters every `step`; those of `min_chars` or less, stripped, go."""
    starts = F.when(F.length(text_col) > 0, F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(step)))
    out = df.select("*", F.posexplode(starts).alias("chunk_idx", "_at")).withColumn("chunk", F.substring(F.col(text_col), F.col("_at") + 1, F.lit(size))).drop("_at")
    return out.filter(F.length(strip(F.col("chunk"))) > min_chars)


def pack(text: Column, size: int = 1200) -> Column:
    """Paragraphs (split at blank lines) joined while they fit `size`; a longer paragraph is a chunk of its own. No overlap."""
    paras = F.filter(F.transform(F.split(text, "\n{2,}"), strip), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(a, p):
        fits = F.length(a["cur"]) + F.length(p) <= size
        grown = F.when(a["cur"] == "", p).otherwise(F.concat(a["cur"], F.lit("\n\n"), p))
        closed = F.when(F.length(a["cur"]) > 50, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"])
        return F.struct(F.when(fits, a["done"]).otherwise(closed).alias("done"), F.when(fits, grown).otherwise(p).alias("cur"))

    return F.aggregate(paras, zero, step, lambda a: F.when(F.length(a["cur"]) > 50, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))


def pack_overlap(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Paragraphs joined while they fit; a new chunk begins with the last `overlap` characters of the one before. Paragraphs are never cut."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(a, p):
        fits = F.length(a["cur"]) + F.length(p) + 2 <= size
        grown = F.when(a["cur"] == "", p).otherwise(strip(F.concat(a["cur"], F.lit("\n\n"), p)))
        closed = F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"])
        return F.struct(
            F.when(fits, a["done"]).otherwise(closed).alias("done"),
            F.when(fits, grown).otherwise(strip(F.concat(F.right(a["cur"], F.lit(overlap)), F.lit("\n\n"), p))).alias("cur"),
        )

    packed = F.aggregate(F.split(text, "\n\n"), zero, step, lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(packed)


def clause_pattern(heading_space: int = 1, levels: int = 2, title: str | None = None) -> str:
    """A heading line: number of up to `levels` dots, white space, a capitalised title; or an annex. title: the pattern of titles,
    where they are known; without it, a line that only looks like a heading is one."""
    return rf"\d+(?:\.\d+){{0,{levels}}}\s{{{heading_space},}}{title or r'[A-Z][^\n]{3,80}'}$|Annex\s+[A-Z]\s*\((?:normative|informative)\)\s*[:]?\s*{title or '.+'}$"


def clauses(text: Column, heading_space: int = 1, title: str | None = None) -> Column:
    """array<struct<number, heading, body>> of a headed text; text before the first heading is dropped.

    heading_space: white space that the number needs before the title; 2 for texts whose blanks are not collapsed.
    title: as in clause_pattern().
    """
    pattern = clause_pattern(heading_space, title=title)
    parts = F.filter(F.split(text, f"(?md)^(?={pattern})", -1), lambda p: p.rlike(f"(?md)\\A(?:{pattern})"))
    number, heading = r"^(\d+(?:\.\d+)*|Annex\s+[A-Z])", r"(?d)^(?:\d+(?:\.\d+)*\s+|Annex\s+[A-Z]\s*\((?:normative|informative)\)\s*:?\s*)([^\n]*)"
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, number, 1).alias("number"), strip(F.regexp_extract(p, heading, 1)).alias("heading"), strip(p).alias("body")))


def simple_chunks(text: Column, spec: Column, size: int = 1200, overlap: int = 200) -> Column:
    """array<struct<text, sub_chunk, ...>>: packed with overlap, noise dropped; the index counts what was dropped too."""
    prefix = F.when(spec != "", F.concat(F.lit("["), spec, F.lit("]\n\n"))).otherwise("")
    none = F.lit(None).cast("string")
    each = F.transform(pack_overlap(text, size, overlap), lambda t, j: F.struct(strip(F.concat(prefix, t)).alias("text"), j.alias("sub_chunk"), none.alias("section_number"), none.alias("section_heading"), is_noise(t).alias("noise")))
    return F.filter(each, lambda x: ~x["noise"])


def clause_chunks(text: Column, spec: Column, size: int = 1200, overlap: int = 200, heading_space: int = 1, title: str | None = None) -> Column:
    """array<struct<text, sub_chunk, section_number, section_heading, noise>> of a headed text.

    A clause that fits is one chunk with sub_chunk null; a longer one is packed. Each begins with '[spec §n] heading'. Noise is
    dropped. With fewer than three headings the text is chunked without them.
    """
    found = clauses(text, heading_space, title)

    def of(c):
        label = F.concat(F.lit("["), spec, F.lit(" §"), c["number"], F.lit("] "), c["heading"])
        row = lambda t, j, head, noise: F.struct(F.concat(head, F.lit("\n\n"), t).alias("text"), j.alias("sub_chunk"), c["number"].alias("section_number"), c["heading"].alias("section_heading"), noise.alias("noise"))
        whole = F.array(row(c["body"], F.lit(None).cast("int"), label, F.lit(False)))
        parts = F.transform(pack_overlap(c["body"], size, overlap), lambda t, j: row(t, j, F.concat(label, F.lit(" (part "), (j + 1).cast("string"), F.lit(")")), is_noise(t)))
        none = F.array().cast("array<struct<text:string,sub_chunk:int,section_number:string,section_heading:string,noise:boolean>>")
        return F.when(is_noise(c["body"]), none).when(F.length(c["body"]) <= size, whole).otherwise(F.filter(parts, lambda x: ~x["noise"]))

    return F.when(F.size(found) < 3, simple_chunks(text, spec, size, overlap)).otherwise(F.flatten(F.transform(found, of)))


def clause_chunks_v1(text: Column, size: int = 1200, step: int = 1000, title: str = r"[A-Z][^\n]{2,80}") -> Column:
    """array<struct<text, section_number, section_title, chunk_type>>: first generation, letters before numbers, three dots, 1 to 4 blanks.

    A clause over `size` is cut in sliding windows, the first of type clause, the others clause_continued; pieces of 50
    characters or less go. A text without headings is cut as type body. title: the pattern of headings' titles.
    """
    head = r"[A-Z]?\d+(?:\.\d+){0,3}\s{1,4}" + title + "$"
    parts = F.filter(F.split(text, f"(?md)^(?={head})", -1), lambda p: p.rlike(f"(?md)\\A{head}"))
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.length(p) - 1, F.lit(0)), F.lit(step)), lambda a: F.substring(p, a + 1, F.lit(size)))
    row = lambda t, n, h, kind: F.struct(t.alias("text"), n.alias("section_number"), h.alias("section_title"), kind.alias("chunk_type"))

    def of(p):
        body = strip(p)
        number, title = F.regexp_extract(p, r"^([A-Z]?\d+(?:\.\d+)*)", 1), strip(F.regexp_extract(p, r"(?d)^\S+\s+([^\n]*)", 1))
        pieces = F.when(F.length(body) <= size, F.array(body)).otherwise(cut(body))
        return F.transform(pieces, lambda t, j: row(t, number, title, F.when(j == 0, "clause").otherwise("clause_continued")))

    body = F.transform(cut(text), lambda t: row(t, F.lit(""), F.lit(""), F.lit("body")))
    made = F.when(F.size(parts) == 0, body).otherwise(F.flatten(F.transform(parts, of)))
    return F.filter(made, lambda x: F.length(strip(x["text"])) > 50)


def header_row(grid: Column) -> Column:
    """Index of the first of five rows with two non-empty cells or more; 0 if none has."""
    filled = F.transform(F.slice(grid, 1, 5), lambda r: F.size(F.filter(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")) >= 2)
    return F.greatest(F.coalesce(F.array_position(filled, True), F.lit(0)) - 1, F.lit(0)).cast("int")


def column_map(headers: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """map<type, index>: the first header that holds any keyword of a type; one header may serve several types."""
    low = F.transform(headers, lambda h: F.regexp_replace(F.trim(F.lower(F.coalesce(h, F.lit("")))), "\n", " "))

    def first(words):
        def hit(h):
            out = F.contains(h, F.lit(words[0]))
            for w in words[1:]:
                out = out | F.contains(h, F.lit(w))
            return out

        return F.array_position(F.transform(low, hit), True) - 1

    types = keywords or V.COLUMN_KEYWORDS
    every = F.map_from_arrays(F.array(*map(F.lit, types)), F.array(*(first(ws).cast("int") for ws in types.values())))
    return F.map_filter(every, lambda _, v: v >= 0)


def grid_records(df: DataFrame, grid_col: str = "cells") -> DataFrame:
    """One row per parameter record of each table grid, with all other columns of `df`.

    Grids of fewer than two rows, or without a name or description column, give none; rows of fewer than two filled
    cells, or with a name under 3 and a description under 15 characters, are left out. An empty path is looked up in the description.
    """
    at = df.filter(F.size(grid_col) >= 2).withColumn("_h", header_row(F.col(grid_col)))
    at = at.withColumn("_m", column_map(F.transform(F.get(F.col(grid_col), F.col("_h")), clean_cell)))
    at = at.filter(F.map_contains_key("_m", "parameter_name") | F.map_contains_key("_m", "description"))
    rows = at.withColumn("_rows", F.expr(f"slice({grid_col}, _h + 2, size({grid_col}))")).select(*[c for c in df.columns if c != grid_col], "_m", F.posexplode("_rows").alias("row_idx", "_row"))
    rows = rows.filter(F.size(F.filter("_row", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")) >= 2)
    cell = lambda t: F.coalesce(clean_cell(F.get("_row", F.element_at("_m", t))), F.lit(""))
    made = rows.select(*[c for c in df.columns if c != grid_col], "row_idx", *(cell(t).alias(t) for t in V.COLUMN_KEYWORDS))
    made = made.filter((F.length("parameter_name") >= 3) | (F.length("description") >= 15))
    return made.withColumn("mo_path", F.when(F.col("mo_path") == "", F.coalesce(mo_path(F.col("description")), F.lit(""))).otherwise(F.col("mo_path")))


def narrative_sections(text: Column, page: Column, min_chars: int = 80, heading: str = V.NARRATIVE_SECTION[1:]) -> Column:
    """array<struct<section, description>> of a page without tables: numbered sections with bodies over 60 characters, 2000 at most;
    a page without sections is one block; a page under `min_chars` characters gives none. heading: the pattern of a section's first line."""
    parts = F.filter(F.split(text, f"(?md)^(?=(?:{heading}))", -1), lambda p: p.rlike(f"(?md)\\A(?:{heading})"))
    one = lambda p: F.struct(strip(F.regexp_replace(F.regexp_extract(p, r"(?d)^([^\n]*)", 1), r"^(\S+)\s+", "$1 ")).alias("section"), F.left(strip(F.regexp_replace(p, r"(?d)^[^\n]*\n?", "")), F.lit(2000)).alias("description"))
    many = F.filter(F.transform(parts, one), lambda s: F.length(s["description"]) > 60)
    block = F.array(F.struct(F.concat(F.lit("page_"), page.cast("string")).alias("section"), F.left(strip(text), F.lit(2000)).alias("description")))
    none = F.array().cast("array<struct<section:string,description:string>>")
    return F.when(F.length(strip(text)) < min_chars, none).when(F.size(parts) > 0, many).otherwise(block)
