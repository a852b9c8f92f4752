"""Every registered query runs; where SQL can say it, the rows are those of DuckDB."""

import pytest

from tarnwick.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, duck, same, name):
    same(QUERIES[name](spark, sf_dir), duck.execute(ORACLES[name]).fetch_df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["item_id", "doc_id", "rank", "bm25"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
