"""Tables for looking up few ids among very many: sorted by id in ranges, with Bloom filters in the files' footers.

A reader that asks for ids gets them as a filter of the scan. Files and row groups whose range, or whose Bloom filter, tells that they
hold none are not read: ranges serve ids that lie together, Bloom filters those that are strewn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that one scan may have in its filter; more are joined.
MAX_IDS = 500


def write(df: DataFrame, path: str, id_col: str, group_bytes: int = 32 << 20, files: int | None = None, by: str | None = None) -> None:
    """`df` as Parquet for lookups by id_col. Rows lie in order of the ids' hashes, or of the column `by` where that is what reads
    mostly want; row groups have about `group_bytes`."""
    keys = [by, id_col] if by else [F.xxhash64(id_col)]
    n = () if files is None else (files,)
    ordered = df.repartitionByRange(*n, *keys).sortWithinPartitions(*keys)
    write = ordered.write.option(f"parquet.bloom.filter.enabled#{id_col}", "true").option("parquet.block.size", str(group_bytes))
    write.option("parquet.page.row.count.limit", "1000").parquet(path)


def by_ids(spark, path: str, wanted: DataFrame, id_col: str, most: int = MAX_IDS) -> DataFrame:
    """Rows of the table whose ids are in the first column of `wanted`. Up to `most` distinct ids go to the scan as a filter; more are a join, in
    which Spark may still build a filter at run time. Null ids match nothing."""
    ids = wanted.select(F.col(wanted.columns[0]).alias("_id")).filter("_id is not null").distinct()
    few = [r[0] for r in ids.limit(most + 1).collect()]
    rows = spark.read.parquet(path)
    if len(few) > most:
        return rows.join(ids, rows[id_col] == ids["_id"], "left_semi")
    if not few:
        return rows.limit(0)
    # equalities reach the Bloom filters whatever their number; a long list would become a range. In pairs, so that no expression is deep
    tests = [F.col(id_col) == F.lit(x) for x in few]
    while len(tests) > 1:
        tests = [tests[k] | tests[k + 1] if k + 1 < len(tests) else tests[k] for k in range(0, len(tests), 2)]
    return rows.filter(tests[0])
