"""Table grids of pages, from positioned words and ruling lines as rows. Everything is a join, a window or an aggregate by page.

words: page, text, x0, x1, top. lines: page, x0, y0, x1, y1. A grid is an array of rows, each an array of cells; a cell without words is null.

Three strategies, in order: cells that ruling lines enclose; columns where left edges of phrases align; phrases of each line, parted by
runs of blanks. A page has the grids of the first strategy whose score is `enough`, else of the best. The score is the share of rows
with two filled cells or more; a page whose grids have less than two rows or columns scores 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.sources.shared import stored

STRATEGIES = ("lines", "edges", "blanks")


def snapped(rows: DataFrame, by: list[str], value: str, name: str, tolerance: float) -> DataFrame:
    """Adds `name`: the least value of the run that a value is in, where neighbours in order are at most `tolerance` apart."""
    order = Window.partitionBy(*by).orderBy(value)
    apart = F.coalesce(F.col(value) - F.lag(value).over(order) > tolerance, F.lit(True))
    marked = rows.withColumn("_new", F.when(apart, F.col(value)))
    return marked.withColumn(name, F.last("_new", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def phrases(words: DataFrame, tolerance: float = 3, gap: float = 2) -> DataFrame:
    """Words with `line` (the top that a text line shares) and `phrase` (its number on the line): a gap of more than `gap` characters begins one.
    Words that have both are left as they are."""
    if "phrase" in words.columns:
        return words
    lined = snapped(words, ["page"], "top", "line", tolerance)
    order = Window.partitionBy("page", "line").orderBy("x0", "x1", "text")
    width = F.try_divide(F.col("x1") - F.col("x0"), F.length("text"))
    begins = F.coalesce(F.col("x0") - F.lag("x1").over(order) > gap * width, F.lit(True))
    return lined.withColumn("_b", begins.cast("int")).withColumn("phrase", F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_b")


def _filled(placed: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """Grids (page, table, cells) of words with page, table, row, column. frame: all cells (page, table, row, column) that there are, with or without words."""
    at = ["page", "table", "row", "column"]
    part = F.struct("line", "x0", "text")
    texts = placed.groupBy(*at, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), " ").alias("text"))
    texts = texts.groupBy(*at).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda p: p["text"]), "\n").alias("text"))
    texts = texts if frame is None else frame.join(texts, at, "left")
    wide = texts.groupBy("page", "table").agg(F.max("column").alias("_last"))
    rows = texts.groupBy("page", "table", "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("m")).join(wide, ["page", "table"])
    rows = rows.select("page", "table", "row", F.transform(F.sequence(F.lit(0), F.col("_last").cast("int")), lambda c: F.element_at("m", c)).alias("cells"))
    return rows.groupBy("page", "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("cells"))


def _numbered(rows: DataFrame, value: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.dense_rank().over(Window.partitionBy("page", "table").orderBy(value)) - 1)


def _merged(segments: DataFrame, at: str, low: str, high: str, tolerance: float) -> DataFrame:
    """Segments of one line that touch are one segment."""
    order = Window.partitionBy("page", at).orderBy(low, high)
    apart = F.coalesce(F.col(low) - F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1)) > tolerance, F.lit(True)).cast("int")
    numbered = segments.withColumn("_new", apart).withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("page", at, "_s").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_s")


def line_cells(lines: DataFrame, snap: float = 3, tolerance: float = 3) -> DataFrame:
    """(page, x, y, x2, y2): cells that lines enclose. Between two neighbouring heights, the uprights that reach over both part a
    page into runs; runs with the same sides are one cell until a level line crosses them."""
    upright = lines.filter((F.abs(F.col("x1") - F.col("x0")) <= snap) & (F.abs(F.col("y1") - F.col("y0")) > snap))
    level = lines.filter((F.abs(F.col("y1") - F.col("y0")) <= snap) & (F.abs(F.col("x1") - F.col("x0")) > snap))
    v = snapped(upright.select("page", F.least("x0", "x1").alias("_x"), F.least("y0", "y1").alias("lo"), F.greatest("y0", "y1").alias("hi")), ["page"], "_x", "x", snap)
    h = snapped(level.select("page", F.least("y0", "y1").alias("_y"), F.least("x0", "x1").alias("left"), F.greatest("x0", "x1").alias("right")), ["page"], "_y", "y", snap)
    v, h = _merged(v, "x", "lo", "hi", tolerance), _merged(h, "y", "left", "right", tolerance)
    heights = h.groupBy("page").agg(F.array_sort(F.collect_set("y")).alias("ys"))
    bands = F.filter(F.arrays_zip(F.slice("ys", F.lit(1), F.size("ys") - 1).alias("y"), F.slice("ys", F.lit(2), F.size("ys")).alias("y2")), lambda b: (F.col("lo") <= b["y"] + tolerance) & (F.col("hi") >= b["y2"] - tolerance))
    sides = v.join(heights, "page").select("page", "x", F.explode(bands).alias("b")).select("page", "x", "b.y", "b.y2").distinct()
    runs = sides.withColumn("x2", F.lead("x").over(Window.partitionBy("page", "y").orderBy("x"))).filter("x2 is not null")
    covered = lambda y: F.coalesce(F.exists("over", lambda o: (o["y"] == F.col(y)) & (o["left"] <= F.col("x") + tolerance) & (o["right"] >= F.col("x2") - tolerance)), F.lit(False))
    over = h.groupBy("page").agg(F.collect_list(F.struct("y", "left", "right")).alias("over"))
    runs = runs.join(over, "page").select("page", "x", "x2", "y", "y2", covered("y").alias("above"), covered("y2").alias("below"))
    order = Window.partitionBy("page", "x", "x2").orderBy("y")
    begins = F.col("above") | F.coalesce(F.lag("y2").over(order) != F.col("y"), F.lit(True))
    numbered = runs.withColumn("_b", begins.cast("int")).withColumn("_c", F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cells = numbered.groupBy("page", "x", "x2", "_c").agg(F.min("y").alias("y"), F.max("y2").alias("y2"), F.min_by("above", "y").alias("a"), F.max_by("below", "y").alias("b"))
    return cells.filter("a and b").select("page", "x", "y", "x2", "y2")


def by_lines(words: DataFrame, lines: DataFrame, snap: float = 3, tolerance: float = 3) -> DataFrame:
    """Grids between ruling lines. A height of a page without cells parts one table from the next."""
    cells = line_cells(lines, snap, tolerance)
    order = Window.partitionBy("page").orderBy("y", "x").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_new", F.coalesce(F.col("y") > F.max("y2").over(order), F.lit(True)).cast("int"))
    cells = cells.withColumn("table", F.sum("_new").over(Window.partitionBy("page").orderBy("y").rangeBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")
    cells = _numbered(_numbered(cells, "y", "row"), "x", "column")
    # a cell may span several steps between crossings: each step of a page knows the cell that it is in
    steps = cells.groupBy("page").agg(F.array_sort(F.collect_set("x")).alias("xs"), F.array_sort(F.collect_set("y")).alias("ys"))
    inside = lambda values, a, b: F.filter(values, lambda v: (v >= F.col(a)) & (v < F.col(b)))
    spread = cells.join(steps, "page").select("page", "table", "row", "column", "x2", "y2", F.explode(inside("xs", "x", "x2")).alias("sx"), "ys", "y")
    spread = spread.select("page", "table", "row", "column", "x2", "y2", "sx", F.explode(inside("ys", "y", "y2")).alias("sy"))
    last = lambda values, at: F.array_max(F.filter(values, lambda v: v <= at))
    lined = words if "line" in words.columns else snapped(words, ["page"], "top", "line", snap)
    lined = lined.withColumn("_x", (F.col("x0") + F.col("x1")) / 2)
    placed = lined.join(steps, "page").withColumn("sx", last("xs", F.col("_x"))).withColumn("sy", last("ys", F.col("top")))
    placed = placed.join(spread, ["page", "sx", "sy"]).filter((F.col("_x") < F.col("x2")) & (F.col("top") < F.col("y2")))
    return _filled(placed, cells.select("page", "table", "row", "column"))


def by_edges(words: DataFrame, tolerance: float = 3, gap: float = 2, least: int = 2) -> DataFrame:
    """Rows are text lines; a column begins where the left edges of at least `least` phrases align. A phrase is in the last column that begins at or before it."""
    parts = phrases(words, tolerance, gap)
    first = snapped(parts.groupBy("page", "line", "phrase").agg(F.min("x0").alias("x")), ["page"], "x", "edge", tolerance)
    edges = first.groupBy("page", "edge").agg(F.count("*").alias("n")).filter(F.col("n") >= least).groupBy("page").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    column = F.greatest(F.size(F.filter("edges", lambda e: e <= F.col("edge"))) - 1, F.lit(0))
    of = first.join(edges, "page").select("page", "line", "phrase", column.alias("column"))
    placed = parts.join(of, ["page", "line", "phrase"]).withColumn("table", F.lit(0))
    return _filled(_numbered(placed, "line", "row"))


def by_blanks(words: DataFrame, tolerance: float = 3, gap: float = 2) -> DataFrame:
    """Rows are text lines, cells their phrases from left to right; rows may have fewer cells than others."""
    placed = _numbered(phrases(words, tolerance, gap).withColumn("table", F.lit(0)), "line", "row").withColumn("column", F.col("phrase").cast("int"))
    made = _filled(placed)
    return made.withColumn("cells", F.transform("cells", lambda r: F.filter(r, lambda c: c.isNotNull())))


def page_grids(words: DataFrame, lines: DataFrame, snap: float = 3, gap: float = 2, least: int = 2, enough: float = 0.5) -> DataFrame:
    """(page, strategy, table, cells) of the strategy chosen for each page. Pages without words have no grids."""
    words, lines = stored(phrases(words, snap, gap), "words"), stored(lines, "rules")  # each strategy reads them
    found = (by_lines(words, lines, snap, snap), by_edges(words, snap, gap, least), by_blanks(words, snap, gap))
    every = stored(reduce(DataFrame.unionByName, (g.select("page", F.lit(k).alias("_k"), "table", "cells") for k, g in enumerate(found))), "grids")
    full = F.filter("cells", lambda r: F.size(F.filter(r, lambda c: c.isNotNull())) >= 2)
    sized = every.withColumn("_ok", (F.size("cells") >= 2) & F.exists("cells", lambda r: F.size(r) >= 2))
    per = sized.groupBy("page", "_k").agg(F.try_divide(F.sum(F.when(F.col("_ok"), F.size(full)).otherwise(0)), F.sum(F.size("cells"))).alias("score"))
    good = F.col("score") >= enough
    best = per.groupBy("page").agg(F.min_by("_k", F.struct((~good).alias("a"), F.when(good, 0.0).otherwise(-F.col("score")).alias("b"), F.col("_k").alias("c"))).alias("_k"))
    names = F.array(*map(F.lit, STRATEGIES))
    return every.join(best, ["page", "_k"]).select("page", F.get(names, F.col("_k")).alias("strategy"), "table", "cells")
