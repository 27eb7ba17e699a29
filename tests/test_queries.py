import pytest

import __spark_entry__ as entry
from compare import spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.CORE))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(entry.queries()[name](spark, SF_DIR)) == sql_rows(entry.oracle_sql()[name], SF_DIR)


def test_every_query_has_its_sql():
    assert set(entry.CORE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
