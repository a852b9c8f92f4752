"""Lookups of few ids read few rows of a table; the answer is that of a join."""

from pyspark.sql import functions as F

from tarnwick.sources import lookup


def scanned(df):
    """Rows that the scan of an executed plan put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_few_ids(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.range(200_000).select((F.col("id") * 7).alias("id"), F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    lookup.write(df, path, "id", group_bytes=256 << 10, files=4)
    asked = spark.createDataFrame([(7 * k,) for k in (3, 77_777, 150_001)] + [(5,), (None,), (21,)], "k long")
    found = lookup.by_ids(spark, path, asked, "id")
    assert sorted(r["id"] for r in found.collect()) == [21, 7 * 77_777, 7 * 150_001]
    assert scanned(found) < 20_000  # a tenth of the rows
    none = lookup.by_ids(spark, path, spark.createDataFrame([(5,), (8,)], "k long"), "id")
    assert none.collect() == [] and scanned(none) < 20_000


def test_scattered_ids(spark, tmp_path):
    """More ids than a pushed list may have; most row groups hold none of them."""
    path = f"file://{tmp_path}/t"
    df = spark.range(100_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    lookup.write(df, path, "id", group_bytes=32 << 10, files=2, by="id")
    asked = spark.createDataFrame([(k,) for k in [*range(500, 520), *range(90_000, 90_020)]], "k long")
    found = lookup.by_ids(spark, path, asked, "id")
    assert found.count() == 40 and scanned(found) < 10_000


def test_many_ids_are_joined(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    lookup.write(spark.range(1000).withColumn("v", F.col("id") % 3), path, "id", by="v")
    asked = spark.range(0, 1000, 2)
    assert lookup.by_ids(spark, path, asked, "id", most=10).count() == 500
    assert lookup.by_ids(spark, path, asked.limit(0), "id").count() == 0
