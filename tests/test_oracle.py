"""Every query that SQL can express, against DuckDB on the small tables."""

import pytest

from tessera import catalog
from tests.helpers import SF, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    ours, theirs = spark_rows(catalog.QUERIES[name](spark, SF)), sql_rows(catalog.ORACLE_SQL[name])
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
    assert theirs[1] or name in ("failures", "failure_streaks")


def test_registry():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(catalog.QUERIES) >= 120


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "chunk_id", "rank", "score"]
