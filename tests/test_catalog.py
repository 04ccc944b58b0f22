"""Every registered query against its DuckDB check, and the driver contract."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import differences, type_differences
from tests.conftest import SF

SQL = oracle_sql()
WITHOUT_SQL = {"feature_table"}


def test_only_known_queries_have_no_sql():
    own = {name for name in queries() if not re.match(r"op\d+_|pipeline$", name)}
    assert own - set(SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    made = queries()[name](spark, SF)
    relation = con.sql(SQL[name])
    assert type_differences(made, relation) == ""
    want = relation.df()
    assert len(want) > 0
    assert differences(made.toPandas(), want) == ""


def test_entry(spark):
    assert entry(spark).count() > 0
