"""Queries over page grids: pages drawn from parts as positioned words and ruling lines."""

from pyspark.sql import functions as F

from tarnwick.operators import grids
from tarnwick.plans.registry import query, table

#: Width of a column and of a character, height of a row, and where a page's grid begins.
_WIDE, _CHAR, _HIGH, _LEFT, _TOP = 260, 5, 20, 40, 45
_HEADS = ["MO Name", "Parameter Name", "Default Value", "Unit", "Description"]
_CELLS_SQL = f"""drawn AS (SELECT p_partkey AS page, r, CASE WHEN r = 0 THEN {_HEADS} ELSE
 [CASE WHEN p_size % 4 = 0 AND r = 1 THEN NULL ELSE p_brand END, p_name, CAST(p_size + r AS VARCHAR), 'mm', 'row ' || r || ' of ' || p_type] END AS cells FROM part, range(4) t(r))"""


def drawn(spark, d):
    """(words, lines): every third page has ruling lines, every third aligned columns alone, every third ragged rows."""
    key, r = F.col("p_partkey"), F.col("r")
    rows = table(spark, d, "part").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(3))))
    own = F.array(F.when(~((F.col("p_size") % 4 == 0) & (r == 1)), F.col("p_brand")), F.col("p_name"), (F.col("p_size") + r).cast("string"), F.lit("mm"), F.concat(F.lit("row "), r.cast("string"), F.lit(" of "), F.col("p_type")))
    cells = rows.select(key.alias("page"), "r", F.posexplode(F.when(r == 0, F.array(*map(F.lit, _HEADS))).otherwise(own)).alias("c", "cell")).filter("cell is not null")
    parts = cells.select("page", "r", "c", "cell", F.posexplode(F.split("cell", " ")).alias("k", "text"))
    before = F.length(F.array_join(F.slice(F.split("cell", " "), F.lit(1), F.col("k")), " ")) + F.when(F.col("k") > 0, 1).otherwise(0)
    shift = F.when(F.col("page") % 3 == 2, 17 * r + 7 * r * F.col("c")).otherwise(0)
    x0 = (_LEFT + _WIDE * F.col("c") + 4 + _CHAR * before + shift).cast("double")
    words = parts.select("page", "text", x0.alias("x0"), (x0 + _CHAR * F.length("text")).alias("x1"), (_TOP + 5 + _HIGH * r).cast("double").alias("top"))
    ruled = table(spark, d, "part").filter(key % 3 == 0).select(key.alias("page"))
    right, end = _LEFT + _WIDE * len(_HEADS), _TOP + _HIGH * 4
    n = lambda c: F.col(c).cast("double")
    upright = ruled.withColumn("x", F.explode(F.sequence(F.lit(_LEFT), F.lit(right), F.lit(_WIDE)))).select("page", n("x").alias("x0"), F.lit(float(_TOP)).alias("y0"), n("x").alias("x1"), F.lit(float(end)).alias("y1"))
    level = ruled.withColumn("y", F.explode(F.sequence(F.lit(_TOP), F.lit(end), F.lit(_HIGH)))).select("page", F.lit(float(_LEFT)).alias("x0"), n("y").alias("y0"), F.lit(float(right)).alias("x1"), n("y").alias("y1"))
    return words, upright.unionByName(level)


@query(
    f"""WITH {_CELLS_SQL} SELECT page, CASE page % 3 WHEN 0 THEN 'lines' WHEN 1 THEN 'edges' ELSE 'blanks' END AS strategy, CAST(0 AS BIGINT) AS tab,
 string_agg(array_to_string(CASE WHEN page % 3 = 2 THEN list_filter(cells, lambda c: c IS NOT NULL) ELSE list_transform(cells, lambda c: coalesce(c, '')) END, '|'), ';' ORDER BY r) AS grid FROM drawn GROUP BY page"""
)
def page_grids(spark, d):
    made = grids.page_grids(*drawn(spark, d))
    shown = F.array_join(F.transform("cells", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "|")), ";")
    return made.select("page", "strategy", F.col("table").cast("long").alias("tab"), shown.alias("grid"))
