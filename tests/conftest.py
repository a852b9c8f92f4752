import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(frame):
    """Comparable rows of a pandas frame: columns by name, values as text, rows sorted."""
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(str, (tuple(repr(v) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))))


@pytest.fixture(scope="session")
def same():
    def check(spark_frame, duck_frame):
        a, b = rows(spark_frame.toPandas()), rows(duck_frame)
        assert a[0] == b[0]
        assert len(a[1]) == len(b[1])
        assert a[1] == b[1]

    return check
