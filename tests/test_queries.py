"""Every query with SQL gives the same rows on the smallest tables; every name is importable."""

import os

import pytest

import __spark_entry__ as E
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.oracle_sql())


def test_sql_belongs_to_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    said, _ = compare(spark, duck(SF), SF, E.queries()[name], E.oracle_sql()[name])
    assert not said, said
