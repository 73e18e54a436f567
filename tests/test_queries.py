"""Every registered search query against its SQL."""

import pytest

from brambling import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(same, name):
    same(catalog.QUERIES[name], catalog.ORACLE[name])


def test_queries_without_sql_run(spark, sf):
    for name in sorted(catalog.QUERIES.keys() - catalog.ORACLE.keys()):
        assert catalog.QUERIES[name](spark, sf).count() > 0, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
